"""Seeded graphs with hand-written expectations."""

import hashlib
import subprocess

import pytest
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators import aggregates, lookups, patterns, ranges, ranking, resolve, search
from lattica.plans import centrality, communities, flows, impact, review, store
from lattica.plans.store import GraphStore
from lattica.sources import files, history
from lattica.streaming import watch

N = "kind string, name string, qualified_name string, file_path string, line_start int, line_end int, language string, parent_name string, is_test boolean, extra string"
E = "kind string, source_qualified string, target_qualified string, file_path string, line int, extra string, confidence double"


def node(qn, kind="Function", language="python", lines=(1, 10), extra="{}", parent=None, test=False):
    path, _, rest = qn.partition("::")
    name = rest.split("::")[-1].split(".")[-1] or path
    return kind, name, qn, path, *lines, language, parent, test, extra


def edge(kind, a, b, path=None, line=1, extra="{}"):
    return kind, a, b, path or a.split("::")[0], line, extra, 1.0


def build(spark, nodes, edges):
    return Graph(spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E))


def names(df, col="qualified_name"):
    return sorted(r[col] for r in df.collect())


def one_col(spark, col, *values):
    return spark.createDataFrame([(v,) for v in values], f"{col} string")


@pytest.fixture
def chain(spark):
    fs = [node(f"/{x}.py", "File") for x in "abcd"]
    return build(spark, fs + [node(f"/{x}.py::{x}") for x in "abcd"], [edge("CALLS", f"/{b}.py::{b}", f"/{a}.py::{a}") for a, b in ("ab", "bc", "cd")])


def test_impact_follows_callers(spark, chain):
    start = one_col(spark, "file_path", "/a.py")
    two = {r.qualified_name: r.score for r in impact.impact_radius(chain, start, 2).collect()}
    assert two == {"/b.py::b": pytest.approx(0.6), "/c.py::c": pytest.approx(0.36)}
    rows = impact.impact_radius(chain, start, 3, 2).collect()
    assert len(rows) == 2 and all(r.truncated and r.total_impacted == 3 for r in rows)


@pytest.mark.parametrize("kind", ["CALLS", "INHERITS", "IMPLEMENTS", "REFERENCES", "IMPORTS_FROM", "UNHEARD_OF"])
def test_impact_reaches_dependents_only(spark, kind):
    g = build(spark, [node(f"/{x}.py::{x}") for x in "abc"], [edge(kind, "/a.py::a", "/b.py::b"), edge(kind, "/b.py::b", "/c.py::c")])
    assert names(impact.impact_radius(g, one_col(spark, "file_path", "/b.py"))) == ["/a.py::a"]


def test_impact_goes_from_production_to_tests(spark):
    g = build(spark, [node("/p.py::p"), node("/t.py::t", "Test", test=True)], [edge("TESTED_BY", "/p.py::p", "/t.py::t"), edge("CONTAINS", "/p.py::p", "/t.py::t")])
    assert names(impact.impact_radius(g, one_col(spark, "file_path", "/p.py"))) == ["/t.py::t"]
    assert names(impact.impact_radius(g, one_col(spark, "file_path", "/t.py"))) == []


def test_impact_takes_the_best_path_through_ghosts_and_cycles(spark):
    es = [edge("IMPORTS_FROM", "/b.py::b", "/a.py::a"), edge("CALLS", "ghost", "/a.py::a"), edge("CALLS", "/b.py::b", "ghost"), edge("CALLS", "/a.py::a", "/b.py::b")]
    g = build(spark, [node("/a.py::a"), node("/b.py::b")], es)
    rows = impact.impact_radius(g, one_col(spark, "file_path", "/a.py"), 4).collect()
    assert [(r.qualified_name, r.score) for r in rows] == [("/b.py::b", pytest.approx(0.36))]


def test_bidirectional_reach_differs(spark, chain):
    got = {r.qualified_name: r.hop for r in impact.impact_bidirectional(chain, one_col(spark, "file_path", "/b.py"), 1).collect()}
    assert got == {"/a.py::a": 1, "/c.py::c": 1}


def test_flows_with_a_cycle(spark):
    g = build(spark, [node(f"/m.py::{x}") for x in ("top", "a", "b", "lone")], [edge("CALLS", "/m.py::top", "/m.py::a"), edge("CALLS", "/m.py::a", "/m.py::b"), edge("CALLS", "/m.py::b", "/m.py::a"), edge("CALLS", "/m.py::b", "outside")])
    assert names(flows.entry_points(g)) == ["/m.py::lone", "/m.py::top"]
    t = flows.trace(g, flows.entry_points(g))
    assert [(r.qualified_name, r.hop, r.position) for r in t.orderBy("position").collect()] == [("/m.py::top", 0, 0), ("/m.py::a", 1, 1), ("/m.py::b", 2, 2)]
    row = flows.criticality(g, flows.reach(g, flows.entry_points(g))).first()
    assert (row.node_count, row.file_count, row.depth) == (3, 1, 2)
    assert row.criticality == pytest.approx(0.2 * 0.2 + 0.15 + 0.1 * 0.2)


def test_entry_points_by_decorator_and_name(spark):
    ns = [node("/a.py::used"), node("/a.py::route", extra='{"decorators": ["app.get(x)"]}'), node("/a.py::handle_it"), node("/a.php::boot", language="php"), node("/a.py::boot"), node("/a.py::caller")]
    es = [edge("CALLS", "/a.py::caller", f"{q}") for q in ("/a.py::used", "/a.py::route", "/a.py::handle_it", "/a.php::boot", "/a.py::boot")]
    assert names(flows.entry_points(build(spark, ns, es))) == ["/a.php::boot", "/a.py::caller", "/a.py::handle_it", "/a.py::route"]


def test_incremental_flows_equal_a_full_trace(spark):
    ns = [node(f"/{x}.py::{x}") for x in "abcd"]
    g = build(spark, ns, [edge("CALLS", "/a.py::a", "/b.py::b"), edge("CALLS", "/c.py::c", "/d.py::d")])
    old = flows.flow_tables(g)
    more = g.with_(edges=g.edges.union(spark.createDataFrame([edge("CALLS", "/b.py::b", "/d.py::d")], E)), flows=old.flows, memberships=old.memberships)
    inc = flows.incremental_flows(more, one_col(spark, "file_path", "/b.py"))
    full = flows.flow_tables(more)
    pick = lambda f: sorted(map(tuple, f.flows.select("entry", "node_count", "criticality").collect()))
    assert pick(inc) == pick(full)


def test_callers_fall_back_to_bare_names_of_the_family(spark):
    ns = [node("/a.ts::f", language="typescript"), node("/b.js::g", language="javascript"), node("/c.py::h"), node("/d.ts::k", language="typescript")]
    g = build(spark, ns, [edge("CALLS", "/d.ts::k", "/a.ts::f"), edge("CALLS", "/b.js::g", "f"), edge("CALLS", "/c.py::h", "f")])
    assert {(r.qualified_name, r.target_resolution) for r in patterns.callers_of(g, "/a.ts::f").collect()} == {("/d.ts::k", "resolved"), ("/b.js::g", "unresolved")}


def test_consumers_match_wildcards_above_a_key(spark):
    ns = [node(f"/a.java::{x}", language="java") for x in "xyz"]
    g = build(spark, ns, [edge("CONSUMES", "/a.java::x", "config:app.port"), edge("CONSUMES", "/a.java::y", "config:app.*"), edge("CONSUMES", "/a.java::z", "config:other.*")])
    assert names(patterns.consumers_of(g, "app.port")) == ["/a.java::x", "/a.java::y"]


def test_bare_calls_need_exactly_one_candidate(spark):
    ns = [node("/a.py::run"), node("/b.py::load"), node("/c.py::load"), node("/d.py::save")]
    es = [edge("CALLS", "/a.py::run", "load"), edge("CALLS", "/a.py::run", "save"), edge("CALLS", "/a.py::run", "gone"), edge("IMPORTS_FROM", "/a.py", "/b.py", "/a.py"), edge("IMPORTS_FROM", "/a.py", "/c.py", "/a.py"), edge("IMPORTS_FROM", "/a.py", "/d.py", "/a.py")]
    got = {(r.target_qualified, r.resolution) for r in resolve.resolve_bare_calls(build(spark, ns, es)).filter("kind = 'CALLS'").collect()}
    assert got == {("load", "ambiguous"), ("/d.py::save", "resolved"), ("gone", "unresolved")}


def test_other_resolvers(spark):
    ns = [node("/pkg/util.py", "File"), node("/x/util.py", "File"), node("/pkg/only.py", "File"), node("/a.java::Svc", "Class"), node("/b.java::Impl", "Class"), node("/b.java::Impl.go", parent="Impl"), node("/t/main.tf::net"), node("/m.php::Owner.act", parent="Owner", language="php")]
    es = [
        edge("IMPORTS_FROM", "/q.py", "pkg.only"), edge("IMPORTS_FROM", "/q.py", "util"),
        edge("INJECTS", "/c.java::Ctl", "/a.java::Svc", extra='{"field_name": "svc"}'), edge("IMPLEMENTS", "/b.java::Impl", "/a.java::Svc"),
        edge("CALLS", "/c.java::Ctl.serve", "svc.go", extra='{"receiver": "svc"}'), edge("REFERENCES", "/t/use.tf::x", "net"),
        edge("PUBLISHES", "/p.java::p", "event:Paid"), edge("HANDLES", "/l.java::l", "event:Paid"), edge("CALLS", "/z.php::z", "Owner::act"),
    ]
    g = build(spark, ns, es)
    targets = lambda df, kind: {r.target_qualified for r in df.filter(F.col("kind") == kind).collect()}
    assert targets(resolve.resolve_python_imports(g), "IMPORTS_FROM") == {"/pkg/only.py", "util"}
    assert "/b.java::Impl.go" in targets(resolve.resolve_spring_di(g), "CALLS")
    assert targets(resolve.resolve_hcl(g), "REFERENCES") == {"/t/main.tf::net"}
    assert [(r.source_qualified, r.target_qualified) for r in resolve.event_calls(g).collect()] == [("/p.java::p", "/l.java::l")]
    assert "/m.php::Owner.act" in targets(resolve.resolve_scoped(g), "CALLS")


def test_cpp_scope_takes_the_innermost(spark):
    ns = [node("/a.cc::outer::f"), node("/a.cc::outer::inner::f")]
    g = build(spark, ns, [edge("CALLS", "/b.cc::g", "f", extra='{"receiver_scope": "outer::inner"}')])
    assert resolve.resolve_cpp_scope(g).first().target_qualified == "/a.cc::outer::inner::f"


DIFF = """--- a/x.py
+++ b/x.py
@@ -1,2 +3,4 @@ def f
+a
@@ -9 +12 @@
-b
+c
@@ -20,3 +22,0 @@
-d
--- a/y.py
+++ b/y.py
@@ -0,0 +1,2 @@
+e
"""


def test_unified_diff(spark):
    got = {(r.file_path, r.start, r.end) for r in ranges.parse_unified_diff(spark.createDataFrame([(1, DIFF), (2, ""), (3, None)], "diff_id int, text string")).collect()}
    assert got == {("x.py", 3, 6), ("x.py", 12, 12), ("x.py", 22, 22), ("y.py", 1, 2)}


def test_numstat(spark):
    got = {tuple(r) for r in ranges.parse_numstat(spark.createDataFrame([("1\t2\ta.py\x00-\t-\tb.bin\x003\t0\ta.py\x00",)], "text string")).collect()}
    assert got == {("a.py", 2), ("b.bin", 1)}


def test_windows_merge_where_they_touch(spark):
    spans = spark.createDataFrame([("a", 10, 12), ("a", 15, 16), ("a", 30, 31), ("b", 1, 1)], "file_path string, start int, end int")
    assert {tuple(r) for r in ranges.merge_windows(spans).collect()} == {("a", 8, 18), ("a", 28, 33), ("b", 1, 3)}


def test_betweenness_of_a_path_and_a_star(spark, chain):
    rows = centrality.bridge_nodes(chain).collect()
    assert {r.qualified_name: r.betweenness for r in rows} == {"/b.py::b": pytest.approx(2 / 6), "/c.py::c": pytest.approx(2 / 6)}


def two_clusters(spark):
    a, b = [f"/auth/{x}.py::{x}" for x in ("login", "logout", "check")], [f"/db/{x}.py::{x}" for x in ("connect", "query", "close")]
    es = [edge("CALLS", x, y) for c in (a, b) for x in c for y in c if x < y] + [edge("CALLS", a[0], b[0])]
    return build(spark, [node(q) for q in a + b], es), a, b


def test_communities_find_two_clusters(spark):
    g, a, b = two_clusters(spark)
    for found in (communities.by_directory(g), communities.by_modularity(g)):
        of = {r.qualified_name: r.community for r in found.collect()}
        assert len({of[q] for q in a}) == len({of[q] for q in b}) == 1 and of[a[0]] != of[b[0]]
    assert communities.modularity(g, communities.by_modularity(g)).first()[0] > 0.3
    named = {r.name for r in communities.community_names(g, communities.by_directory(g)).collect()}
    assert all(n.startswith(("auth-", "db-")) for n in named) and len(named) == 2


def test_cohesion_in_one_pass(spark):
    g, a, b = two_clusters(spark)
    g = g.with_(communities=spark.createDataFrame([(q, 0) for q in a] + [(q, 1) for q in b], "qualified_name string, community_id long"))
    assert {r.community_id: (r.internal, r.external, r.cohesion) for r in aggregates.community_cohesion(g).collect()} == {0: (3, 1, 0.75), 1: (3, 1, 0.75)}


def test_dead_code(spark):
    ns = [node("/a.py::used"), node("/a.py::dead"), node("/a.py::main"), node("/a.py::__repr__"), node("/a.py::near"), node("/b.py::only"), node("/b.py::twin"), node("/e.py::twin"), node("/a.py::tested"), node("/c.py::y"), node("/d.py::z")]
    es = [edge("CALLS", "/b.py::x", "/a.py::used"), edge("CALLS", "/c.py::y", "near", "/c.py"), edge("IMPORTS_FROM", "/c.py", "/a.py", "/c.py"), edge("CALLS", "/d.py::z", "only", "/d.py"), edge("CALLS", "/d.py::z", "twin", "/d.py"), edge("TESTED_BY", "/a.py::tested", "/t.py::t")]
    es += [edge("CALLS", "/m.py", "/c.py::y"), edge("CALLS", "/m.py", "/d.py::z")]
    assert names(review.dead_code(build(spark, ns, es))) == ["/a.py::dead", "/b.py::twin", "/e.py::twin"]


def test_dead_code_leaves_what_frameworks_and_types_use(spark):
    deco = lambda *d: '{"decorators": [' + ", ".join(f'"{x}"' for x in d) + "]}"
    cls = lambda qn, **k: node(qn, "Class", **k)
    ns = [
        node("/x/api.d.ts::ambient"), node("/a.ts::C.constructor", parent="C"), node("/a.py::P.size", parent="P", extra=deco("property")),
        cls("/a.py::Row", extra=deco("dataclass")), cls("/a.py::User"), node("/a.py::User.save", parent="User"), cls("/a.py::AppStack"),
        node("/a.py::AppStack.wire", parent="AppStack"), node("/a.py::Shape.area", parent="Shape", extra=deco("abstractmethod")),
        node("/a.py::Disc.area", parent="Disc"), node("/a.py::Root.run", parent="Root"), node("/a.py::Leaf.run", parent="Leaf"),
        cls("/a.py::Owner"), node("/a.py::K.go", parent="K"), cls("/a.py::Lost"), node("/a.py::K.lost", parent="K"),
    ]
    es = [
        edge("INHERITS", "/a.py::User", "BaseModel"), edge("INHERITS", "/a.py::Disc", "/a.py::Shape"), edge("INHERITS", "/a.py::Leaf", "Root"),
        edge("CALLS", "/m.py::m", "/a.py::Root.run"), edge("CALLS", "/m.py::m", "Owner.build"), edge("CALLS", "/m.py::m", "K::go"),
    ]
    assert names(review.dead_code(build(spark, ns, es))) == ["/a.py::K.lost", "/a.py::Lost"]


def test_fixed_names_and_keys(spark):
    from lattica.functions import text as X

    keys = {"server.port-name": "server.portName", "APP.max_size[2]": "app.maxSize[2]", "plain.Key": "plain.Key", " a.--.b ": "a..b", "A-B": "aB"}
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", X.config_key(F.col("k")).alias("c")).collect()
    assert {r.k: r.c for r in got} == keys
    tests = {"test-api": True, "api/test": True, "it:should do": True, "Testing": False, "latest": False, "a-spec": True, "spec-a": True}
    got = spark.createDataFrame([(k,) for k in tests], "k string").select("k", X.is_test_community(F.col("k")).alias("c")).collect()
    assert {r.k: r.c for r in got} == tests
    ns = [node("/a.py::setUp"), node("/a.py::main"), node("/a.py::__construct")]
    assert names(review.test_gaps(build(spark, ns, []), build(spark, ns, []).nodes)) == ["/a.py::main"]
    ig = {"dist/a.js": True, "x/dist/a.js": False, "x/node_modules/b.js": True, "x/a.min.js": True, "yarn.lock": True, "src/a.py": False}
    got = spark.createDataFrame([(k,) for k in ig], "k string").select("k", files.is_ignored(F.col("k")).alias("c")).collect()
    assert {r.k: r.c for r in got} == ig


def test_phrase_and_term_search(spark):
    ns = [node("/u.py::get_users"), node("/u.py::create_user"), node("/u.py::UserService", "Class"), node("/x.py::users_get")]
    g = build(spark, ns, [])
    found = names(search.phrase_search(search.node_index(g), "qualified_name", "get user"))
    assert found == ["/u.py::get_users"]
    assert names(search.all_terms_search(search.node_index(g), "qualified_name", "user get")) == ["/u.py::get_users", "/x.py::users_get"]
    assert search.query_identifiers("Who calls Context.Next in get_users of APIRoute") == ["context.next", "get_users"]
    best = search.hybrid_search(g, "UserService").first()
    assert best.qualified_name == "/u.py::UserService"


def test_vector_search_of_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [0.6, 0.8])], "id int, embedding array<float>")
    assert [(r.id, round(r.score, 6)) for r in search.vector_search(v, "id", [1.0, 0.0]).collect()] == [(1, 1.0), (4, 0.6), (2, 0.0), (3, 0.0)]


def test_rrf(spark):
    lists = [spark.createDataFrame([("a", 0), ("b", 1)], "item string, rank int"), spark.createDataFrame([("b", 0)], "item string, rank int")]
    got = {r["item"]: r["score"] for r in ranking.rrf_merge(lists).collect()}
    assert got == {"a": pytest.approx(1 / 61), "b": pytest.approx(1 / 62 + 1 / 61)}


def test_store_versions_upserts_and_streams(spark, tmp_path):
    g = build(spark, [node("/a.py::f"), node("/b.py::g")], [edge("CALLS", "/b.py::g", "/a.py::f"), edge("CALLS", "/a.py::f", "/b.py::g")])
    s = GraphStore(spark, f"file://{tmp_path}/store")
    first = s.write(g)
    s.write(store.remove_files_permanently(s.read(), one_col(spark, "file_path", "/a.py")))
    assert names(s.read().nodes) == ["/b.py::g"] and s.read().edges.count() == 0
    assert names(s.read(first).nodes) == ["/a.py::f", "/b.py::g"]
    s.write(s.read(first))

    def parse(batch):
        rows = batch.select(F.lit("Function").alias("kind"), F.lit("new").alias("name"), F.concat("file_path", F.lit("::new")).alias("qualified_name"), "file_path", F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), F.lit("python").alias("language"), F.lit(None).cast("string").alias("parent_name"), F.lit(False).alias("is_test"), F.lit("{}").alias("extra"), F.lit(1).alias("seq"))
        return Graph(rows, batch.sparkSession.createDataFrame([], E + ", seq int"))

    src = f"{tmp_path}/in"
    changes = spark.createDataFrame([("/a.py", False), ("/b.py", True)], "file_path string, deleted boolean")
    changes.write.parquet(src)
    stream = spark.readStream.schema(changes.schema).parquet(src)
    q = watch.watch(stream, s, parse, f"{tmp_path}/cp", "0 seconds")
    q.processAllAvailable()
    q.stop()
    assert names(s.read().nodes) == ["/a.py::new"]


def test_snapshot_diff(spark, chain):
    after = store.remove_files_permanently(chain, one_col(spark, "file_path", "/d.py"))
    got = {(r.change, r.subject) for r in communities.snapshot_diff(chain, after).collect()}
    assert got == {("node_removed", "/d.py"), ("node_removed", "/d.py::d"), ("edge_removed", "/d.py::d->/c.py::c:CALLS")}


def test_change_detection_and_directories(spark):
    from hashlib import sha256

    h = sha256(b"same").hexdigest()
    n = spark.createDataFrame([("File", "/a.py", h), ("File", "/b.py", h), ("File", "/d/c.py", h)], "kind string, file_path string, file_hash string")
    g = Graph(n, spark.createDataFrame([], E))
    now = spark.createDataFrame([("/a.py", b"same"), ("/b.py", b"other"), ("/n.py", b"x")], "file_path string, content binary")
    assert {tuple(r) for r in store.change_detect(g, now).collect()} == {("/b.py", "changed"), ("/n.py", "new"), ("/d/c.py", "gone")}
    assert names(store.delete_directories(g, one_col(spark, "path", "/d")), "file_path") == ["/d/c.py"]


def test_exports_escape(spark):
    g = build(spark, [node("/a.py::it's<b>")], [])
    assert "it\\'s" in store.cypher_lines(g).first().value and "&lt;b&gt;" in store.graphml_lines(g).first().value


def test_file_inventory_and_logs(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x")
    (tmp_path / "src" / "b.py").write_bytes(b"a\x00b")
    (tmp_path / "src" / "c.txt").write_text("x")
    (tmp_path / "src" / "node_modules" / "d.py").write_text("x")
    got = files.collect_files(spark, f"file://{tmp_path}/src", {".py": "python"})
    assert [r.file_path.rsplit("/", 1)[1] for r in got.collect()] == ["a.py"]
    (tmp_path / "log.jsonl").write_text('{"ts": "2024-01-01T00:00:00", "tool": "t", "repo": "r", "baseline_tokens": 10, "returned_tokens": 4, "saved_tokens": 6}\nbroken\n')
    assert files.read_savings_log(spark, f"file://{tmp_path}/log.jsonl").filter("tool is not null").count() == 1


def test_lookups_of_empty_graphs(spark):
    g = build(spark, [], [])
    assert lookups.exists(g.nodes).first().found is False
    assert impact.impact_radius(g, one_col(spark, "file_path", "/a.py")).count() == 0
    assert communities.by_directory(g).count() == 0 and communities.by_modularity(g).count() == 0
    assert flows.trace(g, flows.entry_points(g)).count() == 0
    assert aggregates.graph_stats(g).count() == 3


def test_name_status_of_a_checkout(spark, tmp_path):
    raw = "M\0a.py\0R087\0old name.py\0new.py\0C100\0a.py\0D.py\0D\0gone.py\0"
    rows = spark.createDataFrame([(1, raw), (2, None), (3, "")], "id int, raw string")
    got = [(r.id, r.position, r.file_path) for r in history.parse_name_status(rows, "raw").orderBy("id", "position").collect()]
    assert got == [(1, 0, "a.py"), (1, 1, "old name.py"), (1, 2, "new.py"), (1, 3, "D.py"), (1, 4, "gone.py")]

    def git(*args):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=tmp_path, check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "x.py").write_text("x = 1\n" * 20)
    (tmp_path / "y.py").write_text("y\n")
    git("add", "."), git("commit", "-qm", "one")
    git("mv", "x.py", "z.py")
    (tmp_path / "y.py").write_text("yy\n")
    git("add", "."), git("commit", "-qm", "two")
    assert names(history.changed_files(spark, str(tmp_path)), "file_path") == ["x.py", "y.py", "z.py"]
    for ref in ("--output=x", "a b", ""):
        with pytest.raises(ValueError):
            history.changed_files(spark, str(tmp_path), ref)
    head = history.head_of(spark, "r", str(tmp_path), None)
    built = subprocess.run(["git", "rev-parse", "HEAD~1"], cwd=tmp_path, capture_output=True, text=True).stdout.strip()
    at = spark.createDataFrame([("r", "git_head_sha", built), ("r", "last_updated", "not a time")], "repo string, key string, value string")
    assert history.freshness(at, head).first().build_relation == "unknown"
    row = history.freshness(at, history.head_of(spark, "r", str(tmp_path), built)).first()
    assert (row.build_relation, row.age_seconds) == ("ancestor", None)


def test_registry_keeps_places(spark):
    shape = "seq long, path string, alias string, data_dir string"
    known = spark.createDataFrame([(1, "/a", "one", None), (2, "/b", None, "/d")], shape)
    got = history.register(known, spark.createDataFrame([(3, "/b", "two", ""), (4, "/c", "one", None)], shape))
    assert [tuple(r) for r in got.orderBy("seq").collect()] == [(1, "/a", "one", None), (2, "/b", "two", "/d"), (4, "/c", "one", None)]
    assert names(history.find(got, alias="one"), "path") == ["/a"] and names(history.find(got, path="/c"), "path") == ["/c"] and not history.find(got, alias="none").count()
    assert names(history.unregister(got, "one"), "path") == ["/b"] and names(history.unregister(got, "/b"), "path") == ["/a", "/c"]


def test_vault_pages(spark, tmp_path):
    g = build(spark, [node("/a.py::My Thing"), node("/b.py::my_thing", "Class"), node("/c.py::!!")], [edge("CALLS", "/a.py::My Thing", "/b.py::my_thing"), edge("CALLS", "/a.py::My Thing", "nowhere"), edge("REFERENCES", "/b.py::my_thing", "/a.py::My Thing")])
    g = g.with_(communities=spark.createDataFrame([("/a.py::My Thing", 7)], "qualified_name string, community_id long"))
    second = "my-thing-" + hashlib.sha256(b"/b.py::my_thing").hexdigest()[:8]
    lines = {}
    for r in store.obsidian_lines(g).orderBy("page", "section", "item").collect():
        lines.setdefault(r.page, []).append(r.line)
    assert sorted(lines) == sorted(["my-thing", second, "unnamed", "_INDEX", "_COMMUNITY_7"])
    assert lines["my-thing"][:6] == ["---", "kind: Function", "file: /a.py", "language: python", "community: 7", "tags:"]
    assert lines["my-thing"][-2:] == ["## Connections", f"- CALLS: [[{second}|My Thing {second[-8:].capitalize()}]]"]
    assert "community: " not in "\n".join(lines["unnamed"]) and "## Connections" not in lines["unnamed"]
    assert lines["_COMMUNITY_7"][-1] == "- [[my-thing]]" and lines["_INDEX"][:3] == ["**Nodes:** 3", "**Edges:** 3", "**Communities:** 1"] and len(lines["_INDEX"]) == 6
    store.export_obsidian(g, str(tmp_path / "vault"))
    assert spark.read.parquet(str(tmp_path / "vault")).filter("page = 'my-thing'").count() == len(lines["my-thing"])


def test_savings_log_is_appended(spark, tmp_path):
    one = spark.createDataFrame([("/r", "measure", 10, 4, 6, 60)], "repo string, kind string, baseline_tokens int, returned_tokens int, saved_tokens int, saved_percent int")
    for _ in range(2):
        history.log_savings(one, str(tmp_path / "a"), str(tmp_path / "b"))
    assert [files.read_savings_log(spark, str(tmp_path / p)).agg(F.sum("saved_tokens")).first()[0] for p in "ab"] == [12, 12]
