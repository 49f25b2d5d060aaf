"""Row schemas, vocabularies and fixed values of the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NODES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("qualified_name", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("parent_name", T.StringType()),
        T.StructField("params", T.StringType()),
        T.StructField("return_type", T.StringType()),
        T.StructField("modifiers", T.StringType()),
        T.StructField("is_test", T.BooleanType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("extra", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("signature", T.StringType()),
    ]
)

EDGES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("source_qualified", T.StringType()),
        T.StructField("target_qualified", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("extra", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("confidence_tier", T.StringType()),
    ]
)

RANGES = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

NODE_KINDS = ("File", "Class", "Function", "Test", "Type", "Endpoint", "Scheduler", "ConfigProperty", "Event")
EDGE_KEY = ("kind", "source_qualified", "target_qualified", "file_path", "line")

# Impact weight and direction of each edge kind. "incoming" walks from
# target to source, "outgoing" from source to target, "none" is not walked.
IMPACT_POLICY = (
    ("CALLS", 1.0, "incoming"),
    ("INHERITS", 0.9, "incoming"),
    ("OVERRIDES", 0.9, "incoming"),
    ("IMPLEMENTS", 0.9, "incoming"),
    ("TESTED_BY", 0.7, "outgoing"),
    ("REFERENCES", 0.6, "incoming"),
    ("DEPENDS_ON", 0.6, "incoming"),
    ("IMPORTS_FROM", 0.5, "incoming"),
    ("CONTAINS", 0.3, "none"),
)
IMPACT_DEFAULT = (0.5, "incoming")
IMPACT_DECAY = 0.6
IMPACT_FLOOR = 0.05
MAX_IMPACT_NODES = 500
MAX_IMPACT_DEPTH = 2
MAX_FLOW_DEPTH = 15
MAX_DEPENDENTS = 500

# Substrings that mark a name as security relevant for risk and criticality.
SECURITY_KEYWORDS = (
    "auth", "login", "password", "token", "session", "crypt", "secret", "credential", "permission", "sql", "query",
    "execute", "connect", "socket", "request", "http", "sanitize", "validate", "encrypt", "decrypt", "hash", "sign",
    "verify", "admin", "privilege",
)

# The shorter list that the risk index uses.
RISK_INDEX_KEYWORDS = ("auth", "login", "password", "token", "session", "crypt", "secret", "credential", "permission", "sql", "execute")

# Names of conventional entry points.
ENTRY_NAMES = (
    r"^main$", r"^__main__$", r"^test_", r"^Test[A-Z]", r"^on_", r"^handle_", r"^handler$", r"^handle$", r"^lambda_handler$",
    r"^upgrade$", r"^downgrade$", r"^lifespan$", r"^get_db$",
    r"^on(Create|Start|Resume|Pause|Stop|Destroy|Bind|Receive)", r"^do(Get|Post|Put|Delete)$",
    r"^do_(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)$", r"^log_message$", r"^(middleware|errorHandler)$",
    r"^ng(OnInit|OnChanges|OnDestroy|DoCheck|AfterContentInit|AfterContentChecked|AfterViewInit|AfterViewChecked)$",
    r"^(transform|writeValue|registerOnChange|registerOnTouched|setDisabledState)$",
    r"^(canActivate|canDeactivate|canActivateChild|canLoad|canMatch|resolve)$",
    r"^(componentDidMount|componentDidUpdate|componentWillUnmount|shouldComponentUpdate|render)$",
)
ENTRY_NAMES_PHP = (r"^(boot|register)$", r"^__invoke$")

# Decorators of framework entry points; the first list ignores case.
ENTRY_DECORATORS_ANY_CASE = (
    r"app\.(get|post|put|delete|patch|route|websocket|on_event)", r"router\.(get|post|put|delete|patch|route)",
    r"blueprint\.(route|before_request|after_request)", r"(before|after)_(request|response)", r"click\.(command|group)",
    r"\w+\.(command|group)\b", r"(field|model)_(serializer|validator)", r"(celery\.)?(task|shared_task|periodic_task)",
    r"receiver", r"api_view", r"\baction\b", r"(override_settings|modify_settings)", r"(event\.)?listens_for",
    r"(Get|Post|Put|Delete|Patch|RequestMapping)Mapping", r"(Scheduled|EventListener|Bean|Configuration)", r"KafkaListener",
    r"(WorkflowMethod|ActivityMethod)", r"(Component|Injectable|Controller|Module|Guard|Pipe)",
    r"(Subscribe|Mutation|Query|Resolver)", r"@(Override|OnLifecycleEvent|Composable)",
    r"(HiltViewModel|AndroidEntryPoint|Inject)", r"\w+\.(tool|tool_plain|system_prompt|result_validator)\b",
    r"\w+\.(middleware|exception_handler|on_exception)\b", r"\w+\.route\b",
)
ENTRY_DECORATORS = (r"pytest\.(fixture|mark)", r"(app|router)\.(get|post|put|delete|patch|use|all)\b", r"^tool\b")

# Fixed value: paths of test files.
TEST_FILE = r"([\\/]__tests__[\\/]|\.spec\.[jt]sx?$|\.test\.[jt]sx?$|[\\/]test_[^/\\]*\.py$)"

# Fixed value: names of communities that hold tests, in any letter case.
TEST_COMMUNITY = r"(^test[-/]|[-/]test([:/]|$)|it:should|describe:|spec[-/]|[-/]spec$)"

# Shapes of identifiers inside a query: dotted, snake_case, CamelCase.
QUERY_IDENTIFIERS = (
    r"\b[A-Za-z_][\w]*(?:\.[A-Za-z_][\w]*)+\b",
    r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b",
    r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b",
)

# Affinity of edge kinds for clustering.
AFFINITY = {"CALLS": 1.0, "IMPORTS_FROM": 0.5, "INHERITS": 0.8, "IMPLEMENTS": 0.7, "CONTAINS": 0.3, "TESTED_BY": 0.4, "DEPENDS_ON": 0.6}


def impact_policy(spark: SparkSession) -> DataFrame:
    """(kind, weight, direction), one row per edge kind that has its own."""
    return spark.createDataFrame(list(IMPACT_POLICY), "kind string, weight double, direction string")
