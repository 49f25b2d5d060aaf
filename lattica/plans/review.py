"""Change review: risk of nodes, affected flows, test gaps, dead code, renames, questions and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.functions import text as X
from lattica.graph import Graph
from lattica.operators import aggregates, patterns, ranges, ranking
from lattica.plans import flows as flow_plans
from lattica.plans.materialise import keep, settle

#: Names that need no test of their own.
EXEMPT = (
    "setUp", "tearDown", "setUpBeforeClass", "tearDownAfterClass", "setup_method", "teardown_method", "setUpClass", "tearDownClass",
    "__construct", "__init__", "__destruct",
)
#: Bases whose heirs a framework calls, and ends of class names that stand for such a base.
FRAMEWORK_BASES = ("Base", "DeclarativeBase", "Model", "BaseModel", "BaseSettings", "db.Model", "TableBase", "Stack", "NestedStack", "Construct", "Resource")
FRAMEWORK_SUFFIXES = ("Stack", "Construct", "Pipeline", "Resources", "Layer")
#: Decorators of functions that are not called by name, and directories that name no package.
IMPLICIT = ("property", "abstractmethod", "classmethod", "staticmethod")
PLAIN_DIRS, LEAST_DIR = ("home", "src", "lib", "app"), 4
#: Fixed value: tests of a node beyond which more do not lower its risk.
ENOUGH_TESTS = 5
#: Fixed value: further paths of test code.
TEST_HELP = r"[\\/]e2e[_-]?tests?[\\/]|[\\/]test[_-]utils?[\\/]"


def risk_score(g: Graph, nodes: DataFrame, churn: DataFrame | None = None) -> DataFrame:
    """(qualified_name, risk_score) of nodes from flows, callers, tests, names and, if given, churn (file_path, commits)."""
    n = nodes.select("qualified_name").distinct().join(g.nodes.select("qualified_name", "name", "file_path"), "qualified_name")
    zero = F.lit(0.0)
    if g.memberships is not None:
        n = n.join(flow_plans.flow_counts(g), "qualified_name", "left")
        part = F.when(F.coalesce("criticality", zero) > 0, F.least(F.col("criticality"), F.lit(0.25))).otherwise(F.least(F.coalesce("flows", F.lit(0)) * 0.05, F.lit(0.25)))
    else:
        part = zero
    calls = g.edges.filter(F.col("kind") == "CALLS").select("source_qualified", F.col("target_qualified").alias("qualified_name"))
    crossing = zero
    if g.communities is not None:
        c = g.communities.select("qualified_name", "community_id")
        named = calls.join(c.select(F.col("qualified_name").alias("source_qualified"), F.col("community_id").alias("_from")), "source_qualified", "left")
        # Dealt by target once: equal calls become one there, meet the target's community and are counted.
        pairs = named.repartition("qualified_name").groupBy("qualified_name", "source_qualified", "_from").agg(F.count(F.lit(1)).alias("_n")).join(c, "qualified_name", "left")
        callers = pairs.groupBy("qualified_name").agg(F.sum("_n").alias("_calls"), F.count_if(F.col("_from") != F.col("community_id")).alias("_cross"))
        crossing = F.least(F.coalesce("_cross", F.lit(0)) * 0.05, F.lit(0.15))
    else:
        callers = calls.groupBy("qualified_name").agg(F.count(F.lit(1)).alias("_calls"))
    n = n.join(callers, "qualified_name", "left")
    # From so many tests on the score stays the same: callees are followed only from nodes without as many of their own.
    own = keep(patterns.direct_tests(g).filter(F.col("tests") >= ENOUGH_TESTS).select("qualified_name"), "tested")
    rest = nodes.select("qualified_name").distinct().join(own, "qualified_name", "left_anti")
    tests = patterns.transitive_tests(g, rest).groupBy("qualified_name").agg(F.count(F.lit(1)).alias("_tests"))
    n = n.join(tests.union(own.select("qualified_name", F.lit(ENOUGH_TESTS).cast("long"))), "qualified_name", "left")
    gap = 0.30 - F.least(F.coalesce("_tests", F.lit(0)) / float(ENOUGH_TESTS), F.lit(1.0)) * 0.25
    named = F.when(X.is_security_name(F.col("name"), F.col("qualified_name")), 0.20).otherwise(zero)
    called = F.least(F.coalesce("_calls", F.lit(0)) / 20.0, F.lit(0.10))
    score = part + crossing + gap + named + called
    if churn is not None:
        n = n.join(churn.select("file_path", "commits"), "file_path", "left")
        score = score + F.least(F.coalesce("commits", F.lit(0)) / 10.0, F.lit(1.0)) * 0.15
    return n.select("qualified_name", F.least(F.greatest(score, zero), F.lit(1.0)).alias("risk_score"))


def test_gaps(g: Graph, nodes: DataFrame) -> DataFrame:
    """Changed production nodes without a test."""
    tested = g.edges.filter(F.col("kind") == "TESTED_BY").select(F.col("source_qualified").alias("qualified_name"))
    own = g.nodes.join(nodes.select("qualified_name").distinct(), "qualified_name", "left_semi").filter(~F.col("is_test") & ~F.col("name").isin(*EXEMPT))
    return own.join(tested, "qualified_name", "left_anti").select("qualified_name", "name", "file_path", "line_start", "line_end")


def changed_nodes(g: Graph, spans: DataFrame) -> DataFrame:
    """Functions, tests and classes, hardware declarations apart, that overlap a changed range."""
    hit = ranges.range_join(g, spans).filter(F.col("kind").isin("Function", "Test", "Class"))
    plain = g.nodes.filter(~X.is_hdl(F.col("extra"))).select("qualified_name")
    return hit.join(plain, "qualified_name", "left_semi")


def analyze_changes(g: Graph, spans: DataFrame, limit: int | None = None) -> DataFrame:
    """Changed nodes with their risk, whether they lack tests, and their place among the ten to review first.

    All of them; with a ``limit`` the first by file, line and name, and then
    ``total`` and ``truncated`` tell what there is beside them.
    """
    n = changed_nodes(g, spans)
    if limit is not None:
        n = ranking.bounded(n, ["file_path", "line_start", "qualified_name"], limit, limit)
    n = settle(n)
    told = [c for c in ("total", "truncated") if c in n.columns]
    risk = risk_score(g, n)
    gaps = test_gaps(g, n).select("qualified_name", F.lit(True).alias("test_gap"))
    out = settle(n.select("qualified_name", "kind", "file_path", *told).join(risk, "qualified_name").join(gaps, "qualified_name", "left").withColumn("test_gap", F.coalesce("test_gap", F.lit(False))))
    first = ranking.ranked(out.orderBy(F.desc("risk_score"), "qualified_name").limit(10), [F.desc("risk_score"), "qualified_name"], "qualified_name").select(F.col("item").alias("qualified_name"), (F.col("rank") + 1).alias("priority"))
    return out.join(F.broadcast(first), "qualified_name", "left")  # ten rows


def change_summary(g: Graph, spans: DataFrame, limit: int | None = None) -> DataFrame:
    """One row on a change: overall risk (the highest of a node, 0 without any), how many nodes, gaps and flows it has, and whether some were left out."""
    rows = analyze_changes(g, spans, limit)
    total = F.max("total") if "total" in rows.columns else F.count(F.lit(1))
    cut = F.max("truncated") if "truncated" in rows.columns else F.lit(False)
    row = rows.agg(F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("overall_risk"), F.count(F.lit(1)).alias("changed"), F.coalesce(total, F.lit(0)).cast("long").alias("total"), F.coalesce(cut, F.lit(False)).alias("functions_truncated"), F.coalesce(F.sum(F.col("test_gap").cast("long")), F.lit(0)).cast("long").alias("test_gaps"))
    if g.flows is None:
        return row.withColumn("affected_flows", F.lit(0).cast("long"))
    hit = flow_plans.affected_flows(g, ranges.range_join(g, spans).select("file_path").distinct())
    return row.crossJoin(hit.agg(F.count(F.lit(1)).alias("affected_flows")))  # one row with one row


def risk_band(score: Column) -> Column:
    return F.when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low")


def _imports_near(g: Graph) -> DataFrame:
    """(_from, _path, _target): what each file imports, itself and through one file that it imports."""
    one = g.edges.filter(F.col("kind") == "IMPORTS_FROM").select(F.col("file_path").alias("_from"), F.col("target_qualified").alias("_target")).distinct()
    two = one.join(one.select(F.col("_from").alias("_target"), F.col("_target").alias("_far")), "_target").select("_from", F.col("_far").alias("_target"), F.lit(2).alias("_hop"))
    return one.withColumn("_hop", F.lit(1)).union(two).distinct().withColumn("_path", F.substring_index("_target", "::", 1))


def _plausible(g: Graph, pairs: DataFrame) -> DataFrame:
    """(qualified_name) of pairs (qualified_name, name, file_path, _from) where code in _from may mean the node by its bare name:

    it is the same file, the name is the only one, or the file imports the node's file, its directory, a file that
    does, or a package that a directory of the node's path names.
    """
    only = g.nodes.filter(F.col("kind").isin("Function", "Class") & ~F.col("is_test")).groupBy("name").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("name", F.lit(True).alias("_only"))
    rows = pairs.join(only, "name", "left")
    sure = rows.filter((F.col("file_path") == F.col("_from")) | F.col("_only"))
    package = F.when(F.col("_path").endswith("/__init__.py"), F.regexp_replace("_path", "__init__[.]py$", ""))
    holds = F.startswith("_path", F.col("file_path")) | F.startswith("file_path", F.concat("_path", F.lit("/"))) | F.coalesce(F.startswith("file_path", package), F.lit(False))
    dirs = F.filter(F.slice(F.split(F.translate("file_path", "\\", "/"), "/"), 1, F.size(F.split(F.translate("file_path", "\\", "/"), "/")) - 1), lambda d: (F.length(d) >= LEAST_DIR) & ~d.isin(*PLAIN_DIRS))
    alias = (F.col("_hop") == 1) & ~F.col("_target").startswith("/") & F.exists(dirs, lambda d: F.contains(F.col("_target"), d))
    near = rows.join(_imports_near(g), "_from").filter(holds | alias)
    return sure.select("qualified_name").union(near.select("qualified_name")).distinct()


def dead_code(g: Graph, kind: str | None = None, file_pattern: str | None = None) -> DataFrame:
    """Functions and classes without any sign of use.

    Not considered: tests, test files and helpers, ambient declarations, dunder
    names, constructors, hardware declarations, entry points, classes that a
    signature names, heirs of framework bases and their methods, functions and
    classes whose decorator uses them, and methods that override an abstract one.
    In use is what has a caller, importer, referrer or heir by its full name or
    as ``Parent::name``, a test, a plausible caller or test by its bare name; a
    class whose member is called; a method whose base's method is called.

    What full names leave is written first: where it is few, edges meet it
    without a shuffle, and of edges only those that may concern it go on.
    """
    nodes = g.nodes.withColumns({c: F.lit(None).cast("string") for c in ("params", "return_type", "extra", "parent_name") if c not in g.nodes.columns})
    path, name = F.col("file_path"), F.col("name")
    n = nodes.filter(F.col("kind").isin("Function", "Class") & ~F.col("is_test") & ~X.is_test_file(path) & ~path.rlike(TEST_HELP) & ~path.endswith(".d.ts") & ~X.is_hdl(F.col("extra")))
    n = n.filter(F.col("kind") == kind) if kind else n
    n = n.filter(path.ilike(f"%{file_pattern}%")) if file_pattern else n
    parent = F.when(F.col("parent_name") != "", F.col("parent_name"))
    n = n.filter(~(name.startswith("__") & name.endswith("__")) & ~((name == "constructor") & parent.isNotNull()) & ~X.is_entry_name(name, F.col("language")) & ~X.is_entry_decorator(F.col("extra")))
    named = F.when(F.col("kind") == "Class", name).otherwise(parent)
    n = n.filter(~F.coalesce(named.rlike(f"({'|'.join(FRAMEWORK_SUFFIXES)})$"), F.lit(False)))
    implicit = F.exists(X.decorators(F.col("extra")), lambda d: d.isin(*IMPLICIT) | d.endswith(".abstractmethod") | d.startswith("HostListener"))
    typed = F.exists(X.decorators(F.col("extra")), lambda d: F.contains(d, F.lit("dataclass")))
    n = n.filter(~F.when(F.col("kind") == "Function", implicit).otherwise(typed))
    is_class = F.col("kind") == "Class"
    owner = F.when(is_class, F.col("qualified_name")).when(parent.isNotNull(), F.regexp_replace("qualified_name", r"\.[^.]*$", ""))
    n = n.select("qualified_name", "kind", "name", "file_path", "line_start", "language", parent.alias("parent_name"), owner.alias("_owner"))

    edges = lambda *kinds: g.edges.filter(F.col("kind").isin(*kinds))
    # Uses by full name.
    uses = edges("CALLS", "IMPORTS_FROM", "REFERENCES", "INHERITS").select(F.col("target_qualified").alias("qualified_name")).union(edges("TESTED_BY").select(F.col("source_qualified").alias("qualified_name")))
    n = n.join(uses.distinct(), "qualified_name", "left_anti").withColumn("_short", F.coalesce(F.concat("parent_name", F.lit("::"), "name"), F.lit("")))
    n = left = keep(n, "unused")
    near = lambda rows, on: rows.join(left.select(*on).distinct(), on, "left_semi")
    without = lambda rows, gone, on: rows.join(near(gone, on).distinct(), on, "left_anti")
    n = without(n, uses.select(F.col("qualified_name").alias("_short")), ["_short"])
    # Classes that signatures name.
    texts = nodes.filter(F.col("kind").isin("Function", "Test")).select(F.explode(F.array("params", "return_type")).alias("_t")).filter("_t is not null")
    types = texts.select(F.explode(F.regexp_extract_all("_t", F.lit("[A-Z][A-Za-z0-9_]*"), F.lit(0))).alias("name"), F.lit("Class").alias("kind"))
    n = without(n, types, ["name", "kind"])
    # Framework heirs and overridden abstract methods.
    bases = edges("INHERITS").select(F.col("source_qualified").alias("_owner"), F.col("target_qualified").alias("_base")).distinct()
    n = without(n, bases.filter(X.last_segment(F.col("_base")).isin(*FRAMEWORK_BASES)).select("_owner"), ["_owner"])
    abstract = nodes.filter(F.exists(X.decorators(F.col("extra")), lambda d: F.contains(d, F.lit("abstractmethod")))).select(F.col("qualified_name").alias("_full"))
    methods = n.filter((F.col("kind") == "Function") & F.col("parent_name").isNotNull()).join(bases, "_owner")
    tries = methods.select("qualified_name", F.explode(F.array(F.concat("_base", F.lit("."), "name"), F.concat("file_path", F.lit("::"), "_base", F.lit("."), "name"))).alias("_full"))
    n = without(n, tries.join(abstract, "_full", "left_semi").select("qualified_name"), ["qualified_name"])
    # Uses by bare name from where it is plausible.
    sources = g.nodes.select(F.col("qualified_name").alias("source_qualified"), F.col("language").alias("_lang"))
    calls = edges("CALLS").select("source_qualified", "target_qualified", F.col("file_path").alias("_from"))
    bare = near(calls.filter(~F.col("target_qualified").contains("::")).withColumnRenamed("target_qualified", "name"), ["name"]).distinct().join(sources, "source_qualified").select("name", "_from", "_lang")
    tails = near(calls.filter(F.col("target_qualified").contains("::")).select(X.last_segment(F.col("target_qualified")).alias("name"), "_from", F.lit(None).cast("string").alias("_lang")), ["name"])
    tests = near(edges("TESTED_BY").filter(~F.col("source_qualified").contains("::")).select(F.col("source_qualified").alias("name"), F.col("file_path").alias("_from"), F.lit(None).cast("string").alias("_lang")), ["name"])
    spoken = F.col("_lang").isNull() | F.col("language").isNull() | X.same_family(F.col("language"), F.col("_lang"))
    pairs = n.select("qualified_name", "name", "file_path", "language").join(bare.union(tails).union(tests).distinct(), "name").filter(spoken)
    n = without(n, _plausible(g, pairs), ["qualified_name"])
    heirs = near(edges("INHERITS").filter(~F.col("target_qualified").contains("::")).select("source_qualified", F.col("target_qualified").alias("name")), ["name"]).join(sources, "source_qualified").select("name", "_lang", F.lit("Class").alias("kind"))
    n = without(n, n.join(heirs, ["name", "kind"]).filter(spoken).select("qualified_name"), ["qualified_name"])
    # Classes one of whose members is called: a target with the class's name, or an end of a longer one, before a dot.
    before = calls.select(F.explode(F.regexp_extract_all("target_qualified", F.lit(r"([\w$]+)\."), F.lit(1))).alias("_w")).distinct()
    ends = before.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("_w")), lambda i: F.substring("_w", i, F.length("_w")))).alias("name"), F.lit("Class").alias("kind"))
    n = without(n, ends, ["name", "kind"])
    # Methods whose base's method is called.
    based = bases.select("_owner", X.last_segment(F.col("_base")).alias("_parent"))
    theirs = left.filter(F.col("kind") == "Function").join(based, "_owner").select("qualified_name", "_parent", "name")
    members = g.nodes.filter(F.col("kind").isin("Function", "Test")).select(F.col("parent_name").alias("_parent"), "name", F.col("qualified_name").alias("target_qualified"))
    over = keep(theirs.join(members, ["_parent", "name"]).select("qualified_name", "target_qualified").distinct(), "overridden")
    alive = calls.select("target_qualified").join(over, "target_qualified").select("qualified_name")
    return without(n, alive, ["qualified_name"]).select("qualified_name", "kind", "name", "file_path", "line_start")


def _moves(g: Graph) -> DataFrame:
    """(qualified_name, community_id, move_to) of functions all of whose callers are in exactly one other community.

    Equal calls need not become one for that; they meet the communities of
    their sources, and two numbers of each target go on.
    """
    c = g.communities.select("qualified_name", "community_id")
    calls = g.edges.filter(F.col("kind") == "CALLS").select("source_qualified", "target_qualified")
    rows = calls.join(c.select(F.col("qualified_name").alias("source_qualified"), F.col("community_id").alias("_from")), "source_qualified")
    one = rows.groupBy(F.col("target_qualified").alias("qualified_name")).agg(F.min("_from").alias("move_to"), F.max("_from").alias("_last")).filter("_last = move_to").drop("_last")
    own = c.join(g.nodes.filter(F.col("kind") == "Function").select("qualified_name"), "qualified_name", "left_semi")
    return one.join(own, "qualified_name").filter(F.col("community_id") != F.col("move_to")).select("qualified_name", "community_id", "move_to")


def suggest_moves(g: Graph) -> DataFrame:
    """Functions all of whose callers are in exactly one other community, with how many of these there are."""
    moves = keep(_moves(g), "moves")
    known = g.communities.select(F.col("qualified_name").alias("source_qualified"))
    calls = g.edges.filter(F.col("kind") == "CALLS").select("source_qualified", F.col("target_qualified").alias("qualified_name"))
    calls = calls.join(moves.select("qualified_name"), "qualified_name", "left_semi").distinct().join(known, "source_qualified")
    return moves.join(calls.groupBy("qualified_name").agg(F.count(F.lit(1)).alias("callers")), "qualified_name").select("qualified_name", "community_id", "move_to", "callers")


def suggest_refactor(g: Graph) -> DataFrame:
    """(action, qualified_name, to_community): moves of functions to the one community that calls them, removals of dead code."""
    moves = _moves(g).select(F.lit("move").alias("action"), "qualified_name", F.col("move_to").alias("to_community"))
    gone = dead_code(g).select(F.lit("remove").alias("action"), "qualified_name", F.lit(None).cast("long").alias("to_community"))
    return moves.unionByName(gone)


def rename_preview(g: Graph, old: str) -> DataFrame:
    """(what, file_path, line) of the sites that a rename touches; call and import sites of one line once."""
    found = g.nodes.filter(F.col("name") == old)
    names = found.select("qualified_name")
    define = found.select(F.lit("definition").alias("what"), "file_path", F.col("line_start").alias("line"))
    hit = lambda kind: g.edges.filter(F.col("kind") == kind).join(names, F.col("target_qualified") == F.col("qualified_name"), "left_semi")
    calls = hit("CALLS").select(F.lit("call"), "file_path", "line")
    bare = g.edges.filter((F.col("kind") == "CALLS") & (F.col("target_qualified") == old)).select(F.lit("bare_call"), "file_path", "line")
    imports = hit("IMPORTS_FROM").select(F.lit("import"), "file_path", "line")
    return define.union(calls).union(bare.distinct()).union(imports.distinct())


def suggested_questions(g: Graph, bridges: int = 3, sources: int | None = None) -> DataFrame:
    """(category, subject): prompts from bridges, hubs without tests, odd edges, small communities and hotspots.

    ``sources`` is handed to the betweenness behind the bridges.
    """
    from lattica.plans import centrality

    between = centrality.bridge_nodes(g, bridges, sources).select(F.lit("bridge_node").alias("category"), F.col("qualified_name").alias("subject"))
    tested = g.edges.filter(F.col("kind") == "TESTED_BY").select(F.col("source_qualified").alias("qualified_name"))
    hubs = aggregates.hub_nodes(g, 3).join(tested, "qualified_name", "left_anti").select(F.lit("hub_untested").alias("category"), F.col("qualified_name").alias("subject"))
    odd = aggregates.surprising_edges(g, 3).select(F.lit("surprise"), F.concat_ws(" -> ", "source_qualified", "target_qualified"))
    thin = aggregates.thin_communities(g).orderBy("size", "community_id").limit(2).select(F.lit("thin_community"), F.col("community_id").cast("string"))
    hot = aggregates.untested_hotspots(g, limit=2).select(F.lit("hotspot"), "qualified_name")
    return between.union(hubs).union(odd).union(thin).union(hot)


def review_guidance(g: Graph, changed: DataFrame, impacted: DataFrame) -> DataFrame:
    """One row of flags: untested changes, many nodes, inheritance, many files."""
    names = changed.select("qualified_name").distinct()
    heirs = g.edges.filter(F.col("kind").isin("INHERITS", "IMPLEMENTS")).join(names, F.col("source_qualified") == F.col("qualified_name"), "left_semi")
    count = lambda rows, name, col=F.lit(1): rows.agg(F.count(col).alias(name))
    row = count(test_gaps(g, changed), "untested").crossJoin(count(impacted, "nodes")).crossJoin(impacted.agg(F.countDistinct("file_path").alias("files"))).crossJoin(count(heirs, "heirs"))
    return row.select((F.col("untested") > 0).alias("has_untested"), (F.col("nodes") > 20).alias("wide_impact"), (F.col("heirs") > 0).alias("touches_inheritance"), (F.col("files") > 3).alias("many_files"))


def enrich_context(g: Graph, names: DataFrame, callers: int = 5, callees: int = 5, tests: int = 3, flows: int = 3) -> DataFrame:
    """(qualified_name, relation, other, position): nearest relations of each name, its community, and the most critical flows it is part of where the graph has them."""
    n = names.select("qualified_name").distinct()
    e = g.edges.select("kind", "source_qualified", "target_qualified").distinct()
    part = lambda kind, mine, other, rel, k: ranking.top_k_per_group(
        e.filter(F.col("kind") == kind).join(n, F.col(mine) == F.col("qualified_name")).select("qualified_name", F.lit(rel).alias("relation"), F.col(other).alias("other")).distinct(), ["qualified_name"], ["other"], k
    )
    out = part("CALLS", "target_qualified", "source_qualified", "caller", callers).union(part("CALLS", "source_qualified", "target_qualified", "callee", callees)).union(part("TESTED_BY", "source_qualified", "target_qualified", "test", tests))
    if g.memberships is not None:
        steps = flow_plans.flows_of(g, n).select("flow_id", "qualified_name").join(g.flows.select("flow_id", "entry", "criticality"), "flow_id")
        best = ranking.top_k_per_group(steps.select("qualified_name", F.lit("flow").alias("relation"), F.col("entry").alias("other"), "criticality"), ["qualified_name"], [F.desc("criticality"), "other"], flows)
        out = out.union(best.select("qualified_name", "relation", "other", "position"))
    if g.communities is not None:
        out = out.union(n.join(g.communities, "qualified_name").select("qualified_name", F.lit("community"), F.col("community_id").cast("string"), F.lit(1)))
    return out


def minimal_context(g: Graph, spans: DataFrame, top: int = 5) -> DataFrame:
    """(what, value): the size of the graph and the riskiest changed nodes, what a first look at a change needs."""
    total = lambda rows, what: rows.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(what).alias("what"), "value")
    sizes = total(g.nodes, "nodes").union(total(g.edges, "edges")).union(total(g.nodes.filter(F.col("kind") == "File"), "files"))
    risky = analyze_changes(g, spans).withColumn("risk_score", F.round("risk_score", 9)).orderBy(F.desc("risk_score"), "qualified_name").limit(top)
    return sizes.union(risky.select(F.lit("changed"), "qualified_name"))


def review_context(g: Graph, files: DataFrame, depth: int = 2) -> DataFrame:
    """(part, subject, detail) of what a reviewer of changed files needs: the changed nodes, the impacted ones with their
    scores, the edges among all of these, the impacted files, and the guidance that holds."""
    from lattica.plans import impact

    changed = g.nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").filter(F.col("kind") != "File")
    hit = settle(impact.impact_radius(g, files, depth).select("qualified_name", "kind", "file_path", "score"))
    every = changed.select("qualified_name").union(hit.select("qualified_name")).distinct()
    edges = patterns.edges_among(g, every).select(F.lit("edge"), F.concat_ws(" -> ", "source_qualified", "target_qualified"), "kind")
    flags = review_guidance(g, changed, hit)
    told = flags.select(F.explode(F.array(*(F.struct(F.lit(c).alias("flag"), F.col(c).alias("holds")) for c in flags.columns))).alias("f")).filter("f.holds")
    return (
        changed.select(F.lit("changed").alias("part"), F.col("qualified_name").alias("subject"), F.col("kind").alias("detail"))
        .union(hit.select(F.lit("impacted"), "qualified_name", F.round("score", 9).cast("string")))
        .union(edges)
        .union(hit.select("file_path").distinct().select(F.lit("impacted_file"), "file_path", F.lit("")))
        .union(told.select(F.lit("guidance"), "f.flag", F.lit("")))
    )
