"""Relationship queries: who calls, tests, imports, inherits, handles or contains what."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.functions import text as X
from lattica.graph import Graph
from lattica.operators import resolve
from lattica.plans.materialise import keep

#: Tests in a list of one source and file, about, before it is cut.
LISTED = 4096
#: Between the names of a list, and what stands for this and for the mark itself within a name.
BETWEEN, MARKED = "\x00", {"\x01": "\x01\x02", "\x00": "\x01\x03"}
_SHOW = ("qualified_name", "kind", "name", "file_path")


def _hop(g: Graph, kinds: Sequence[str], end: str, names: Column | str) -> DataFrame:
    """Distinct far ends of edges of some kinds whose near end (``source`` or ``target``) is the name."""
    far = "target" if end == "source" else "source"
    hit = g.edges.filter(F.col("kind").isin(*kinds) & (F.col(f"{end}_qualified") == names))
    return hit.select(F.col(f"{far}_qualified").alias("qualified_name")).distinct()


def _nodes(g: Graph, names: DataFrame, how: str = "inner") -> DataFrame:
    return names.join(g.nodes.select(*_SHOW), "qualified_name", how).select(*_SHOW)


def overloads(g: Graph, target: DataFrame) -> DataFrame:
    """One row per row of ``target`` (_name, _lang): it, and ``_overloads``, the C++ functions and tests of its name (0 for other languages)."""
    same = g.nodes.filter((F.col("language") == "cpp") & F.col("kind").isin("Function", "Test")).join(F.broadcast(target.select(F.col("_name").alias("name"))), "name", "left_semi").agg(F.count(F.lit(1)).alias("_n"))
    return target.crossJoin(same).select("_name", "_lang", F.when(F.col("_lang") == "cpp", F.col("_n")).otherwise(0).alias("_overloads"))


def callers_of(g: Graph, qn: str) -> DataFrame:
    """Nodes that call a node; calls of its bare name from its language family come as unresolved.

    A bare call proves nothing where it is marked as a choice left open, where
    a C++ call has a receiver, or where several C++ functions have the name.
    """
    direct = _nodes(g, _hop(g, ["CALLS"], "target", qn)).withColumn("target_resolution", F.lit("resolved"))
    target = g.nodes.filter(F.col("qualified_name") == qn).select(F.col("name").alias("_name"), F.col("language").alias("_lang")).limit(1)
    bare = _sure(g.edges).filter(F.col("kind") == "CALLS").join(F.broadcast(overloads(g, target)), F.col("target_qualified") == F.col("_name")).filter("_overloads <= 1")
    if "extra" in g.edges.columns:
        bare = bare.filter(~F.coalesce((F.col("_lang") == "cpp") & F.get_json_object("extra", "$.receiver").isNotNull(), F.lit(False)))
    loose = g.nodes.join(bare.select(F.col("source_qualified").alias("qualified_name"), "_lang").distinct(), "qualified_name").filter(X.same_family(F.col("language"), F.col("_lang")))
    fallback = loose.select(*_SHOW).join(direct, "qualified_name", "left_anti").withColumn("target_resolution", F.lit("unresolved"))
    return direct.unionByName(fallback)


def callees_of(g: Graph, qn: str) -> DataFrame:
    """Nodes that a node calls; bare targets without a node stay, as unresolved."""
    out = _hop(g, ["CALLS"], "source", qn).join(g.nodes.select(*_SHOW), "qualified_name", "left")
    kept = F.col("kind").isNotNull() | ~F.col("qualified_name").contains("::")
    return out.filter(kept).select(*_SHOW, F.when(F.col("kind").isNull(), "unresolved").otherwise("resolved").alias("target_resolution"))


def references_to(g: Graph, qn: str) -> DataFrame:
    """Nodes that refer to a node; by bare name too where one node only has the name."""
    name = X.last_segment(F.lit(qn))
    single = g.nodes.filter(F.col("name") == name).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    loose = _hop(g, ["REFERENCES"], "target", name).join(F.broadcast(single), F.lit(True), "left_semi")
    return _nodes(g, _hop(g, ["REFERENCES"], "target", qn).union(loose).distinct())


def imports_of(g: Graph, qn: str) -> DataFrame:
    return g.edges.filter((F.col("kind") == "IMPORTS_FROM") & (F.col("source_qualified") == qn)).select("source_qualified", "target_qualified", "file_path", "line")


def importers_of(g: Graph, path: str) -> DataFrame:
    """Sources that import a file, by its path or by a namespace that its nodes declare."""
    declared = g.nodes.filter(F.col("file_path") == path).select(F.explode(F.from_json(F.get_json_object("extra", "$.csharp_namespaces"), "array<string>")).alias("_t"))
    targets = declared.union(g.nodes.sparkSession.createDataFrame([(path,)], "_t string")).distinct()
    hit = g.edges.filter(F.col("kind") == "IMPORTS_FROM").join(F.broadcast(targets), F.col("target_qualified") == F.col("_t"), "left_semi")
    return hit.select(F.col("source_qualified").alias("qualified_name")).distinct()


def children_of(g: Graph, qn: str) -> DataFrame:
    return _nodes(g, _hop(g, ["CONTAINS"], "source", qn))


def inheritors_of(g: Graph, qn: str) -> DataFrame:
    """Nodes that inherit from or implement a node; by bare name only if none does by full name."""
    full = _hop(g, ["INHERITS", "IMPLEMENTS"], "target", qn)
    none = full.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0")
    bare = _hop(g, ["INHERITS", "IMPLEMENTS"], "target", X.last_segment(F.lit(qn))).join(F.broadcast(none), F.lit(True), "left_semi")
    return _nodes(g, full.union(bare).distinct())


def triggers_of(g: Graph, qn: str) -> DataFrame:
    return _nodes(g, _hop(g, ["TRIGGERS"], "source", qn))


def triggered_by(g: Graph, qn: str) -> DataFrame:
    return _nodes(g, _hop(g, ["TRIGGERS"], "target", qn))


def publishers_of(g: Graph, event: str) -> DataFrame:
    return _nodes(g, _hop(g, ["PUBLISHES"], "target", event))


def listeners_of(g: Graph, event: str) -> DataFrame:
    return _nodes(g, _hop(g, ["HANDLES"], "target", event))


def handlers_of(g: Graph, endpoint: str) -> DataFrame:
    return _nodes(g, _hop(g, ["HANDLES"], "target", endpoint))


def endpoints_for(g: Graph, qn: str) -> DataFrame:
    return _nodes(g, _hop(g, ["HANDLES"], "source", qn)).filter(F.col("kind") == "Endpoint")


def consumers_of(g: Graph, key: str) -> DataFrame:
    """Nodes that read a configuration key, by itself or by a wildcard above it."""
    keys = g.nodes.sparkSession.range(1).select(F.explode(X.key_patterns(X.config_key(F.lit(key)))).alias("_t"))
    hit = g.edges.filter(F.col("kind").isin("CONSUMES", "DEPENDS_ON_CONFIG")).join(F.broadcast(keys), F.col("target_qualified") == F.col("_t"), "left_semi")
    return _nodes(g, hit.select(F.col("source_qualified").alias("qualified_name")).distinct())


def file_summary(g: Graph, path: str) -> DataFrame:
    return g.nodes.filter(F.col("file_path") == path).select(*_SHOW, "line_start", "line_end")


def tests_for(g: Graph, qn: str, named: int = 10) -> DataFrame:
    """Tests of a node, direct or through its callees, and up to ``named`` of each naming convention, unless its name is a C++ overload set."""
    edge = _nodes(g, transitive_tests(g, g.nodes.filter(F.col("qualified_name") == qn)).select(F.col("test").alias("qualified_name")))
    name = X.last_segment(X.last_segment(F.lit(qn)), ".")
    target = g.nodes.filter(F.col("qualified_name") == qn).select(F.col("name").alias("_name"), F.col("language").alias("_lang")).limit(1)
    several = overloads(g, target).filter("_overloads > 1")
    parts = []
    for form in (F.concat(F.lit("test_"), name), F.concat(F.lit("Test"), name)):
        parts.append(g.nodes.filter(F.col("is_test") & (F.instr(F.lower("name"), F.lower(form)) > 0)).orderBy("qualified_name").limit(named).select(*_SHOW))
    conventional = parts[0].union(parts[1]).join(F.broadcast(several), F.lit(True), "left_anti")  # one row or none
    return edge.union(conventional).distinct()


def _sure(edges: DataFrame) -> DataFrame:
    """Edges whose ends are not a choice left open."""
    if "extra" not in edges.columns:
        return edges
    return edges.filter(~F.coalesce(F.col("extra").rlike('"(ambiguous|unresolved)_targets"'), F.lit(False)))


def direct_tests(g: Graph) -> DataFrame:
    """(qualified_name, tests): how many tests that are nodes an edge ties to the full name; ``transitive_tests`` finds these and maybe more."""
    pairs = _sure(g.edges).filter(F.col("kind") == "TESTED_BY").select(F.col("source_qualified").alias("qualified_name"), F.col("target_qualified").alias("test"))
    known = pairs.join(g.nodes.select(F.col("qualified_name").alias("test")), "test", "left_semi")
    return known.repartition("qualified_name").distinct().groupBy("qualified_name").agg(F.count(F.lit(1)).alias("tests"))


def transitive_tests(g: Graph, starts: DataFrame, depth: int = 1, frontier: int | None = 50) -> DataFrame:
    """(qualified_name, test, indirect): tests of each start, direct ones first, then through callees.

    A start that is a class stands for its methods too, one that is a file for
    its classes and functions.  Tests tied to a start's bare name count where
    the test's file and its imports leave that start as the only choice.  At
    most ``frontier`` resolved callees per start and hop are followed, in name
    order; a bare callee, or an edge whose ends are a choice left open, leads nowhere.

    Tests travel as lists by source and file, each one string, so that a start's name and a
    path are shuffled once for many tests.
    """
    sure = _sure(g.edges)
    of_test = sure.filter(F.col("kind") == "TESTED_BY")
    names = g.nodes.select(F.col("qualified_name").alias("test"))
    steps, most = _test_steps(g, sure, starts, depth, frontier)
    heavy = of_test.groupBy("source_qualified").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    # Lists are cut by a hash of the test, alike for all sources, so that none is long.
    cuts = 1 << (max(heavy // LISTED, most // (LISTED // 64), 1) - 1).bit_length()
    file = F.when(F.contains("test", F.lit("::")), F.substring_index("test", "::", 1))
    symbol = F.when(F.contains("test", F.lit("::")), F.expr("substring(test, instr(test, '::') + 2)")).otherwise(F.col("test"))
    for plain, mark in MARKED.items():
        symbol = F.replace(symbol, F.lit(plain), F.lit(mark))
    told = [file.alias("_file"), symbol.alias("_symbol"), (F.pmod(F.xxhash64("test"), F.lit(cuts)) if cuts > 1 else F.lit(0)).alias("_cut")]
    tested = of_test.select(F.col("source_qualified").alias("_n"), F.col("target_qualified").alias("test")).join(names, "test", "left_semi")
    lists = tested.select("_n", *told).groupBy("_n", "_file", "_cut").agg(F.array_join(F.array_sort(F.collect_set("_symbol")), BETWEEN).alias("_symbols"))
    rows = steps.join(lists, "_n").select("qualified_name", "_file", "_cut", "hop", "_symbols")
    bare = keep(of_test.filter(~F.col("source_qualified").contains("::")), "bare-tests")
    imports = g.edges.filter(F.col("kind") == "IMPORTS_FROM")
    gated = g.with_(edges=resolve.resolve_python_imports(g.with_(edges=imports)).select(*g.edges.columns).unionByName(bare.select(*g.edges.columns)))
    named = resolve.resolve_bare_tests(gated).filter("kind = 'TESTED_BY' AND resolution = 'resolved'").select(F.col("source_qualified").alias("qualified_name"), F.col("target_qualified").alias("test"))
    named = named.join(starts.select("qualified_name"), "qualified_name", "left_semi").join(names, "test", "left_semi")
    rows = rows.union(named.select("qualified_name", *told, F.lit(0).alias("hop")).select("qualified_name", "_file", "_cut", "hop", "_symbol"))
    # Dealt by these keys first, so that lists are put together where they arrive and not before they leave.
    keys = ["qualified_name", "_file", "_cut"] if cuts > 1 else ["qualified_name"]
    near, far = F.when(F.col("hop") == 0, F.col("_symbols")), F.when(F.col("hop") > 0, F.col("_symbols"))
    apart = lambda lists: F.flatten(F.transform(F.collect_list(lists), lambda x: F.split(x, BETWEEN)))
    both = rows.repartition(*keys).groupBy("qualified_name", "_file", "_cut").agg(apart(near).alias("_near"), apart(far).alias("_far"))
    marked = lambda tests, indirect: F.transform(tests, lambda t: F.struct(t.alias("symbol"), F.lit(indirect).alias("indirect")))
    every = both.select("qualified_name", "_file", F.explode(F.concat(marked(F.array_distinct("_near"), False), marked(F.array_except("_far", "_near"), True))).alias("_t"))
    symbol = F.col("_t.symbol")
    for plain, mark in reversed(MARKED.items()):
        symbol = F.replace(symbol, F.lit(mark), F.lit(plain))
    return every.select("qualified_name", F.coalesce(F.concat("_file", F.lit("::"), symbol), symbol).alias("test"), F.col("_t.indirect").alias("indirect"))


def _test_steps(g: Graph, sure: DataFrame, starts: DataFrame, depth: int, frontier: int | None) -> tuple[DataFrame, int]:
    """(qualified_name, _n, hop) of each start, what it stands for and the callees it leads to, and a bound of a start's rows."""
    first = lambda rows, key, by: rows if frontier is None else rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(by))).filter(F.col("_r") <= frontier).drop("_r")
    calls = sure.filter((F.col("kind") == "CALLS") & F.col("target_qualified").contains("::")).select(F.col("source_qualified").alias("_s"), F.col("target_qualified").alias("_t"))
    # The first callees of a start are among the first of each node that it stands for.
    calls = first(calls.repartition("_s").distinct(), "_s", "_t")
    roots = starts.select("qualified_name").distinct()
    holders = g.nodes.filter(F.col("kind").isin("Class", "File")).select("qualified_name", "kind", "file_path")
    kinds = keep(roots.join(holders, "qualified_name"), "holders")
    inside = g.edges.filter(F.col("kind") == "CONTAINS").select(F.col("source_qualified").alias("qualified_name"), F.col("target_qualified").alias("_n"))
    of_file = g.nodes.filter(F.col("kind").isin("Class", "Function", "Method")).select("file_path", F.col("qualified_name").alias("_n"))
    members = kinds.filter("kind = 'Class'").join(inside, "qualified_name").select("qualified_name", "_n")
    whole = kinds.filter("kind = 'File'").join(of_file, "file_path").select("qualified_name", "_n")
    at = kinds.select("qualified_name", F.col("qualified_name").alias("_n")).union(members).union(whole).distinct()
    alone = roots.join(kinds.select("qualified_name"), "qualified_name", "left_anti").select("qualified_name", F.col("qualified_name").alias("_n"))
    held, steps = at, at.union(alone).withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        on = lambda rows: rows.join(calls, F.col("_n") == F.col("_s")).select("qualified_name", F.col("_t").alias("_n"))
        at = first(on(at).distinct(), "qualified_name", "_n")
        alone = on(alone) if hop == 1 else first(on(alone).distinct(), "qualified_name", "_n")  # one node's callees are distinct and cut
        steps = steps.union(at.union(alone).withColumn("hop", F.lit(hop)))
    if frontier is None:
        held = steps = keep(steps, "steps")
    most = held.groupBy("qualified_name").agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0] or 0
    return steps, most if frontier is None else most + depth * frontier


def edges_among(g: Graph, names: DataFrame) -> DataFrame:
    """Edges both of whose ends are in ``names`` (qualified_name)."""
    keys = names.select(F.col("qualified_name").alias("_q")).distinct()
    inner = g.edges.join(keys, F.col("source_qualified") == F.col("_q"), "left_semi")
    return inner.join(keys, F.col("target_qualified") == F.col("_q"), "left_semi")


def subgraph(g: Graph, names: DataFrame) -> Graph:
    return Graph(g.nodes.join(names.select("qualified_name").distinct(), "qualified_name", "left_semi"), edges_among(g, names))


def outgoing_targets(g: Graph, names: DataFrame) -> DataFrame:
    return g.edges.join(names.select(F.col("qualified_name").alias("source_qualified")).distinct(), "source_qualified", "left_semi").select(F.col("target_qualified").alias("qualified_name")).distinct()


def incoming_sources(g: Graph, names: DataFrame) -> DataFrame:
    return g.edges.join(names.select(F.col("qualified_name").alias("target_qualified")).distinct(), "target_qualified", "left_semi").select(F.col("source_qualified").alias("qualified_name")).distinct()


def call_targets(g: Graph, include_file_sources: bool = True) -> DataFrame:
    """Distinct targets of calls; optionally not those that only files call.  Sources without a node count."""
    calls = g.edges.filter(F.col("kind") == "CALLS")
    if not include_file_sources:
        # Written first: files are few beside calls, which need not be shuffled to meet them then.
        files = keep(g.nodes.filter(F.col("kind") == "File").select(F.col("qualified_name").alias("source_qualified")), "files")
        calls = calls.join(files, "source_qualified", "left_anti")
    return calls.select(F.col("target_qualified").alias("qualified_name")).distinct()


def orphans(g: Graph, vectors: DataFrame) -> DataFrame:
    """Vectors whose node is gone."""
    return vectors.join(g.nodes.select("qualified_name"), "qualified_name", "left_anti")


def referrer_files(g: Graph, names: DataFrame) -> DataFrame:
    """Files with an edge that touches one of the names."""
    keys = names.select(F.col("qualified_name").alias("_q")).distinct()
    by = lambda end: g.edges.join(keys, F.col(end) == F.col("_q"), "left_semi").select("file_path")
    return by("source_qualified").union(by("target_qualified")).distinct()


def target_candidates(g: Graph, query: str, limit: int = 20) -> DataFrame:
    """Nodes a user's target may mean, ranked: full name, name, substring of the full name, else; then by name."""
    low = query.lower()
    rank = F.when(F.col("qualified_name") == query, 0).when(F.col("name") == query, 1).when(F.instr(F.lower("qualified_name"), low) > 0, 2).otherwise(3)
    hit = g.nodes.filter((F.instr(F.lower("qualified_name"), low) > 0) | (F.instr(F.lower("name"), low) > 0))
    return hit.select("qualified_name", rank.alias("rank")).orderBy("rank", "qualified_name").limit(limit)
