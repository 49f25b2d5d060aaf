"""What large graphs shuffle: each step's plan, beside its rows."""

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica import catalog_more  # noqa: F401
from lattica.catalog import QUERIES
from lattica.graph import Graph
from lattica.operators import aggregates, patterns
from lattica.plans import communities, impact, maintenance, review, store, text_index
from lattica.plans.ledger import GraphStore
from lattica.plans.materialise import keep
from lattica.sources import derived

NODE = "kind string, name string, qualified_name string, file_path string, line_start int, line_end int, language string, parent_name string, is_test boolean, extra string"
EDGE = "kind string, source_qualified string, target_qualified string, file_path string, line int, extra string, confidence double"


def graph(spark, names, edges, tests=(), of=None):
    rows = [("Test" if q in tests else "Function", q.split("::")[-1], q, q.split("::")[0], 1, 9, "python", None, q in tests, "{}") for q in names]
    g = Graph(spark.createDataFrame(rows, NODE), spark.createDataFrame([(k, s, t, s.split("::")[0], 1, "{}", 1.0) for k, s, t in edges], EDGE))
    return g.with_(communities=spark.createDataFrame(list(of.items()), "qualified_name string, community_id long")) if of else g


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_queries_on_nodes_make_no_edges(spark, sf_dir, tmp_path):
    for f in os.listdir(sf_dir):
        os.symlink(f"{sf_dir}/{f}", f"{tmp_path}/{f}")
    at = str(tmp_path)
    for q in ("file_hashes", "change_detect", "search_quality", "search_nodes", "fts_index"):
        assert QUERIES[q](spark, at).count() >= 0
    root = derived._STORED[spark.sparkContext.applicationId, at].removeprefix("file://")
    assert os.path.exists(f"{root}/nodes") and not os.path.exists(f"{root}/edges")
    assert QUERIES["scan_edges"](spark, at).count() > 0 and os.path.exists(f"{root}/edges")


def test_postings_carry_their_length(spark):
    g = graph(spark, ["/a.py::get_users", "/a.py::x"], [])
    rows = text_index.postings(g.nodes)
    assert "Join" not in plan(rows) and "Exchange" not in plan(rows)
    assert {(r.qualified_name, r.len) for r in rows.collect()} == {("/a.py::get_users", 8), ("/a.py::x", 6)}
    assert [tuple(r) for r in text_index._lengths(g.nodes).collect()] == [("/a.py", 2, 14)]


def test_names_of_communities_count_before_they_meet(spark):
    names = [f"/a/x.py::do_{w}" for w in ("beta", "alpha")] + ["/a/x.py::test_one", "/b/y.py::test_two"]
    found = spark.createDataFrame([(q, q[1]) for q in names], "qualified_name string, community string")
    out = communities.community_names(graph(spark, names, [], tests=names[2:]), found)
    assert plan(out).count("Window ") <= 1  # numbers of equal names
    assert {(r.community, r.name, r["size"]) for r in out.collect()} == {("a", "a-alpha", 2), ("b", "b-two", 1)}


def test_cohesion_joins_edges_once(spark):
    names = ["/a::1", "/a::2", "/b::1"]
    g = graph(spark, names, [("CALLS", "/a::1", "/a::2"), ("CALLS", "/a::1", "/b::1"), ("CALLS", "/b::1", "ext"), ("CALLS", "ext", "other")], of={q: ord(q[1]) for q in names})
    out = aggregates.community_cohesion(g)
    assert plan(out).count("Join") == 3
    assert {(chr(r.community_id), r.internal, r.external) for r in out.collect()} == {("a", 1, 1), ("b", 0, 2)}


def test_rounds_of_impact_shuffle_no_steps_to_few_names(spark, monkeypatch):
    g = graph(spark, [f"/a::{i}" for i in range(9)], [("CALLS", f"/a::{i}", f"/a::{i + 1}") for i in range(8)] * 2 + [("TESTED_BY", "/a::8", "/a::7")])
    plans = []
    kept = impact.keep
    monkeypatch.setattr(impact, "keep", lambda df, name: plans.append((name, plan(df))) or kept(df, name))
    got = {r.qualified_name: r.score for r in impact.impact_scores(g, spark.createDataFrame([("/a::8",)], "qualified_name string"), 3, 0.0).collect()}
    fronts = [p for name, p in plans if name == "front"]
    assert len(fronts) == 3 and not any("hashpartitioning(src" in p or "hashpartitioning(source_qualified" in p or "hashpartitioning(target_qualified" in p for p in fronts)
    one = got["/a::7"]
    assert set(got) >= {f"/a::{i}" for i in (8, 7, 6, 5)} and got["/a::8"] == 1.0 and got["/a::6"] < one < 1.0


def test_vault_shuffles_edges_twice(spark):
    names = ["/a.py::f", "/a.py::g", "/b.py::f"]
    g = graph(spark, names, [("CALLS", names[0], names[1]), ("REFERENCES", names[1], names[0]), ("CALLS", names[2], names[0]), ("CALLS", names[1], names[1]), ("CALLS", names[2], "ext")], of={q: 1 for q in names})
    noted = store._noted(g)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = store.obsidian_links(g, noted)
        assert plan(links).count("Exchange hash") == 4  # twice what comes of edges, twice the pages
        page = {r.qualified_name: r.page for r in noted.collect()}
        want = {(names[0], names[1], "CALLS"), (names[1], names[0], "CALLS"), (names[2], names[0], "CALLS"), (names[0], names[2], "CALLS"), (names[1], names[1], "CALLS")}
        got = [(r.page, r.item, r.line) for r in links.collect()]
        assert sorted((p, i) for p, i, _ in got if i) == sorted((page[a], page[b]) for a, b, _ in want)
        assert sorted(p for p, i, line in got if line == "## Connections" and i == "") == sorted(page.values())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in plan(store.obsidian_index(g, noted)).replace("BroadcastNestedLoopJoin", "")


def test_changed_buckets_are_found_without_comparing_rows(spark, tmp_path, monkeypatch):
    kept = GraphStore(spark, f"file://{tmp_path}/s", 8)
    row = "file_path string, source_qualified string, target_qualified string"
    old = spark.createDataFrame([("/a", "x", None), ("/b", "x", "y"), ("/c", "x", "y"), ("/c", "x", "y")], row)
    kept.write(Graph(spark.createDataFrame([], NODE), old))
    at = kept.state()
    monkeypatch.setattr(DataFrame, "exceptAll", None)
    none = spark.createDataFrame([], "file_path string")
    moved = lambda rows: {b for b in maintenance._moved(kept, at, "edges", old, spark.createDataFrame(rows, row), none)[0]}
    home = {r.file_path: r.b for r in old.select("file_path", kept.bucket("edges", at).alias("b")).collect()}
    assert moved([tuple(r) for r in old.collect()]) == set()
    assert moved([("/a", None, "x"), ("/b", "x", "y"), ("/c", "x", "y")]) == {home["/a"], home["/c"]}


def test_tests_travel_as_lists(spark, monkeypatch):
    names = ["/a.py", "/a.py::f", "/a.py::g", "/a.py::h", "run"] + [f"/t.py::t{i}" for i in range(6)] + ["/t.py::C::deep", "plain"]
    tested = [("/a.py::g", f"/t.py::t{i}") for i in range(5)] + [("/a.py::h", "/t.py::t4"), ("/a.py::h", "/t.py::C::deep"), ("/a.py::f", "/t.py::t0"), ("/a.py::f", "plain"), ("/a.py::f", "/gone.py::t"), ("run", "/t.py::t5")]
    edges = [("TESTED_BY", s, t) for s, t in tested * 2] + [("CALLS", "/a.py::f", "/a.py::g"), ("CALLS", "/a.py::f", "/a.py::h"), ("CALLS", "/a.py::g", "/a.py::h"), ("CALLS", "/a.py::f", "run")]
    g = graph(spark, names, edges, tests=names[5:])
    g = g.with_(nodes=g.nodes.withColumn("kind", F.when(F.col("qualified_name") == "/a.py", "File").otherwise(F.col("kind"))))
    starts = spark.createDataFrame([("/a.py",), ("/a.py::f",), ("/a.py::g",)], "qualified_name string")
    t = [f"/t.py::t{i}" for i in range(5)] + ["/t.py::C::deep", "plain"]
    f = {("/a.py::f", q, q not in (t[0], "plain")) for q in t}
    want = f | {("/a.py", q, False) for q in t} | {("/a.py::g", q, q == t[5]) for q in t[:6]}
    for most in (patterns.LISTED, 64):
        monkeypatch.setattr(patterns, "LISTED", most)
        for depth, frontier in ((1, 50), (1, None)):
            rows = patterns.transitive_tests(g, starts, depth, frontier)
            assert not any("Exchange hash" in line and "test#" in line and "qualified_name#" in line for line in plan(rows).splitlines())
            assert sorted(map(tuple, rows.collect())) == sorted(want)
    odd = [f"/o.py::{x}" for x in ("a\x00b", "a\x01\x03b", "a\x01b", "\x00", "")] + ["\x01"]
    strange = graph(spark, names[:2] + odd, [("TESTED_BY", "/a.py::f", q) for q in odd])
    assert sorted(map(tuple, patterns.transitive_tests(strange, starts).collect())) == sorted((s, q, False) for q in odd for s in ["/a.py::f"])
    monkeypatch.setattr(patterns, "LISTED", 64)
    many = graph(spark, names[:4] + [f"/t.py::n{i}" for i in range(200)], [("TESTED_BY", "/a.py::g", f"/t.py::n{i}") for i in range(200)] + edges, tests=names[5:])
    got = sorted(map(tuple, patterns.transitive_tests(many, starts.filter("qualified_name like '%f'")).collect()))
    assert got == [("/a.py::f", q, True) for q in sorted(f"/t.py::n{i}" for i in range(200))]
    one = patterns.transitive_tests(g, starts.filter("qualified_name like '%f'"), frontier=1)
    assert sorted(map(tuple, one.collect())) == sorted(("/a.py::f", q, q in t[1:5]) for q in t[:5] + ["plain"])


def shuffled(spark, run):
    """What a run returns, and the rows that its stages wrote to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    empty = spark.sparkContext._jvm.java.util.ArrayList()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(empty, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), empty)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    old = stages()
    got = run()
    return got, sum(n for k, n in stages().items() if k not in old)


def test_dead_code_and_moves_shuffle_calls_once(spark):
    names = ["/a/x.py::dead", "/b/y.py::moved", "/b/y.py::stays"] + [f"/a/x.py::f{i}" for i in range(40)]
    calls = [("CALLS", f"/a/x.py::f{i}", f"/a/x.py::f{j}") for i in range(40) for j in range(40)]
    more = [("CALLS", f"/a/x.py::f{i}", "/b/y.py::moved") for i in range(3)] + [("CALLS", "/a/x.py::f1", "/b/y.py::stays"), ("CALLS", "/b/y.py::moved", "/b/y.py::stays"), ("CALLS", "ext", "/b/y.py::stays")]
    g = graph(spark, names, calls + more + more[:1], of={q: 1 + (q[1] == "b") for q in names})
    g = g.with_(edges=keep(g.edges, "calls"), nodes=keep(g.nodes, "names"))
    want = [("move", "/b/y.py::moved", 1), ("remove", "/a/x.py::dead", None)]
    got, rows = shuffled(spark, lambda: review.suggest_refactor(g).collect())
    assert sorted(map(tuple, got)) == want
    assert rows < 1000  # of 1,607 calls
    assert [tuple(r) for r in review.suggest_moves(g).collect()] == [("/b/y.py::moved", 2, 1, 3)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, rows = shuffled(spark, lambda: review.suggest_refactor(g).collect())
        assert sorted(map(tuple, got)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_risk_follows_callees_only_where_own_tests_are_few(spark, monkeypatch):
    from lattica.operators import patterns
    from lattica.plans import review
    from tests.test_loops import graph

    tests = [f"/tests/t.py::test_{i}" for i in range(8)]
    edges = [("TESTED_BY", "/a.py::many", t) for t in tests[:6]] + [("TESTED_BY", "/a.py::many", tests[0])] * 3
    edges += [("TESTED_BY", "/a.py::few", t) for t in tests[:4]] + [("TESTED_BY", "/a.py::few", tests[0])] * 4 + [("TESTED_BY", "/a.py::gone", f"/x.py::t{i}") for i in range(7)]
    edges += [("CALLS", "/a.py::many", "/a.py::few"), ("CALLS", "/a.py::lone", "/a.py::few"), ("CALLS", "/b.py::far", "/a.py::lone"), ("CALLS", "/b.py::far", "/a.py::lone"), ("CALLS", "/a.py::few", "/a.py::lone")]
    names = ["/a.py::many", "/a.py::few", "/a.py::lone", "/a.py::gone", "/b.py::far"]
    g = graph(spark, [*names, *tests], edges, tests)
    g = g.with_(communities=spark.createDataFrame([(q, ord(q[1])) for q in names], "qualified_name string, community_id long"))
    asked, real = [], patterns.transitive_tests
    monkeypatch.setattr(patterns, "transitive_tests", lambda g, starts: asked.extend(r.qualified_name for r in starts.collect()) or real(g, starts))
    got = {r.qualified_name: r.risk_score for r in review.risk_score(g, g.nodes.filter("not is_test")).collect()}
    counted = {"/a.py::many": 5, "/a.py::few": 4, "/a.py::lone": 4, "/a.py::gone": 0, "/b.py::far": 0}
    calls, cross = {"/a.py::lone": 3, "/a.py::few": 2}, {"/a.py::lone": 1}
    want = {q: 0.30 - min(counted[q] / 5, 1) * 0.25 + min(cross.get(q, 0) * 0.05, 0.15) + min(calls.get(q, 0) / 20, 0.1) for q in names}
    assert {q: round(v, 9) for q, v in got.items()} == {q: round(v, 9) for q, v in want.items()}
    assert sorted(asked) == sorted(set(names) - {"/a.py::many"})


def test_reach_meets_a_small_front_without_a_shuffle_of_steps(spark, monkeypatch):
    from lattica.plans import impact

    plans, kept = [], impact.keep
    monkeypatch.setattr(impact, "keep", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    steps = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("x", "a")], "src string, dst string")
    found = impact.reach(steps, spark.createDataFrame([("a",), ("a",)], "node string"), 2)
    assert sorted(map(tuple, found.collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]
    assert len(plans) == 3 and all("SortMergeJoin" not in p for p in plans)
