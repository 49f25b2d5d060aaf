"""The bucketed store, incremental updates, forgetting and watching, against builds from scratch."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators import resolve
from lattica.plans import maintenance
from lattica.plans.ledger import Conflict, GraphStore
from lattica.streaming import watch

#: The passes that the toy language needs.
PASSES = tuple(p for p in maintenance.PASSES if p.run in (resolve.resolve_python_imports, resolve.resolve_bare_calls))
NODE = "kind string, name string, qualified_name string, file_path string, line_start int, line_end int, language string, parent_name string, is_test boolean, extra string, seq int"


def parse(files):
    """Lines ``def f``, ``call f``, ``import path``; a file that begins with ``!`` fails."""
    rows = files.filter(~F.startswith("content", F.lit("!"))).select("file_path", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    word = F.substring_index("text", " ", -1)
    base = lambda kind, name, qn: (F.lit(kind).alias("kind"), name.alias("name"), qn.alias("qualified_name"), "file_path", F.lit(1).alias("line_start"), F.lit(9).alias("line_end"), F.lit("python").alias("language"), F.lit(None).cast("string").alias("parent_name"), F.lit(False).alias("is_test"), F.lit("{}").alias("extra"), F.lit(1).alias("seq"))
    own = files.filter(~F.startswith("content", F.lit("!"))).select(*base("File", F.col("file_path"), F.col("file_path")))
    defs = rows.filter(F.startswith("text", F.lit("def "))).select(*base("Function", word, F.concat("file_path", F.lit("::"), word)))
    first = rows.filter(F.startswith("text", F.lit("def "))).groupBy("file_path").agg(F.min_by(word, "line").alias("f"))
    edge = lambda kind, src: (F.lit(kind).alias("kind"), src.alias("source_qualified"), word.alias("target_qualified"), "file_path", F.col("line").cast("int").alias("line"), F.lit("{}").alias("extra"), F.lit(1).alias("seq"))
    calls = rows.filter(F.startswith("text", F.lit("call "))).join(first, "file_path").select(*edge("CALLS", F.concat("file_path", F.lit("::"), F.col("f"))))
    imports = rows.filter(F.startswith("text", F.lit("import "))).select(*edge("IMPORTS_FROM", F.col("file_path")))
    return Graph(own.union(defs), calls.union(imports))


def listing(spark, files):
    return spark.createDataFrame(sorted(files.items()), "file_path string, content string")


def state(g):
    n = Counter((r.qualified_name, r.kind, r.file_hash) for r in g.nodes.select("qualified_name", "kind", "file_hash").collect())
    e = Counter((r.kind, r.source_qualified, r.target_qualified, r.file_path, r.line) for r in g.edges.select("kind", "source_qualified", "target_qualified", "file_path", "line").collect())
    return n, e


def fresh(spark, files):
    return state(maintenance.build(listing(spark, files), parse, PASSES))


def size(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(path) for f in fs)


FILES = {
    "/a.py": "def f\ncall g\nimport /b.py",
    "/b.py": "def g\ncall h\nimport /c.py",
    "/c.py": "def h\ncall nowhere",
    "/d.py": "def k\ncall g\nimport /b.py\nimport /e.py",
    "/e.py": "def g\ndef m",
}


def test_two_writers_cannot_both_win(spark, tmp_path):
    s = GraphStore(spark, f"file://{tmp_path}/s", 4)
    s.put(a="1")
    at = s.state()
    rows = lambda v: spark.createDataFrame([("a", v)], "key string, value string")
    mine, theirs = s.replaced("metadata", at, rows("x"), rows("x")), s.replaced("metadata", at, rows("y"), rows("y"))
    s.commit(at, {"metadata": theirs})
    with pytest.raises(Conflict):
        s.commit(at, {"metadata": mine})
    assert s.get("a") == "y"
    seen = []

    def change(at):
        if not seen:
            GraphStore(spark, s.root).put(b="2")  # another writer comes first once
        seen.append(at.number)
        return {"metadata": s.replaced("metadata", at, rows("z"), rows("z"))}

    s.update(change)
    assert len(seen) == 2 and (s.get("a"), s.get("b")) == ("z", "2")


def test_versions_fold_over_whole_entries_and_vacuum(spark, tmp_path):
    s = GraphStore(spark, f"file://{tmp_path}/s", 3)
    for i in range(18):
        s.put(**{f"k{i % 5}": str(i)})
    assert s.version() == 17 and {r.key: r.value for r in s.table("metadata").collect()} == {"k0": "15", "k1": "16", "k2": "17", "k3": "13", "k4": "14"}
    old = {r.key: r.value for r in s.table("metadata", s.state(6)).collect()}
    assert old == {"k0": "5", "k1": "6", "k2": "2", "k3": "3", "k4": "4"}
    assert s.vacuum() > 5 and s.get("k2") == "17"


def test_an_update_writes_what_changed(spark, tmp_path):
    s = GraphStore(spark, f"file://{tmp_path}/s", 16)
    files = {f"/p/{i}.py": f"def f{i}\n" + "\n".join(f"call x{j}" for j in range(200)) for i in range(120)}
    s.write(maintenance.build(listing(spark, files), parse))
    before = size(tmp_path)
    files["/p/7.py"] += "\ndef extra"
    got = maintenance.incremental_update(s, listing(spark, files), parse, passes=())
    assert [(r.file_path, r.outcome) for r in got.collect()] == [("/p/7.py", "parsed")]
    assert size(tmp_path) - before < before / 4
    assert s.read().nodes.filter("name = 'extra'").count() == 1


def test_ten_updates_equal_builds(spark, tmp_path):
    rng = random.Random(12)
    s = GraphStore(spark, f"file://{tmp_path}/s", 4)
    files, removed = dict(FILES), set()
    s.write(maintenance.build(listing(spark, files), parse, ()))
    for turn in range(10):
        for _ in range(rng.randint(1, 3)):
            path = f"/{rng.choice('abcdefg')}.py"
            if path in files and rng.random() < 0.4:
                del files[path]
                removed.add(path)
            else:
                files[path] = "\n".join([f"def {rng.choice('fghkm')}", f"call {rng.choice('fghkmn')}", f"import /{rng.choice('abcdefg')}.py"])
        maintenance.incremental_update(s, listing(spark, files), parse, passes=())
        want = maintenance.build(listing(spark, files), parse, passes=())
        got, built = state(s.read()), state(want)
        assert got[0] == built[0], turn
        missing = built[1] - got[1]  # edges into a file that went go with it, also if one of its name comes back
        assert not got[1] - built[1] and all(e[2] in removed for e in missing), turn


def test_outcomes(spark, tmp_path):
    s = GraphStore(spark, f"file://{tmp_path}/s", 4)
    s.write(maintenance.build(listing(spark, FILES), parse, PASSES))
    now = dict(FILES) | {"/c.py": "! broken", "/b.py": "def g\ndef g2\nimport /c.py", "/z.py": "def z"}
    del now["/e.py"]
    got = {r.file_path: (r.outcome, r.dependent) for r in maintenance.incremental_update(s, listing(spark, now), parse, passes=PASSES).collect()}
    assert got["/b.py"] == ("parsed", False) and got["/c.py"] == ("failed", False) and got["/z.py"] == ("parsed", False) and got["/e.py"] == ("stale", False)
    assert got["/a.py"] == ("unchanged", True)
    names = {r.qualified_name for r in s.read().nodes.collect()}
    assert {"/c.py::h", "/b.py::g2", "/z.py::z"} <= names and "/e.py::m" not in names
    assert s.get("last_build_type") == "incremental"
    asked = maintenance.incremental_update(s, listing(spark, now), parse, spark.createDataFrame([("/z.py",), ("/no.py",)], "file_path string"), reconcile=False, passes=())
    assert {r.file_path: r.outcome for r in asked.collect()} == {"/z.py": "unchanged", "/no.py": "unknown"}


def test_forgetting_is_a_build_without_the_file(spark, tmp_path):
    for gone in ("/e.py", "/b.py"):
        s = GraphStore(spark, f"file://{tmp_path}/s{gone[1]}", 4)
        g = maintenance.build(listing(spark, FILES), parse, PASSES)
        s.write(g, vectors=g.nodes.select("qualified_name", F.array(F.lit(1.0)).alias("embedding")))
        assert s.read().edges.filter("target_qualified = '/b.py::g'").count() == 1  # /d.py has two choices
        left = {k: v for k, v in FILES.items() if k != gone}
        told = maintenance.forget(s, spark.createDataFrame([(gone,)], "file_path string"), listing(spark, left), parse, passes=PASSES)
        assert (gone, "forgotten") in {tuple(r) for r in told.collect()}
        assert state(s.read()) == fresh(spark, left), gone
        kept = {r.qualified_name for r in s.table("vectors").collect()}
        assert kept == {r.qualified_name for r in s.read().nodes.collect()}


def test_forgetting_without_a_parser_queues_referrers(spark, tmp_path):
    s = GraphStore(spark, f"file://{tmp_path}/s", 4)
    g = maintenance.build(listing(spark, FILES), parse, PASSES)
    flows = spark.createDataFrame([(1, "/a.py::f"), (2, "/c.py::h")], "flow_id long, entry string")
    steps = spark.createDataFrame([(1, "/a.py::f"), (1, "/b.py::g"), (2, "/c.py::h")], "flow_id long, qualified_name string")
    s.write(g.with_(flows=flows, memberships=steps, communities=g.nodes.select("qualified_name", F.lit(1).alias("community_id"))))
    told = maintenance.forget(s, spark.createDataFrame([("/b.py",)], "file_path string"), passes=PASSES)
    assert {tuple(r) for r in told.collect()} == {("/b.py", "forgotten"), ("/a.py", "queued"), ("/d.py", "queued")}
    now = s.read()
    assert [r.flow_id for r in now.flows.collect()] == [2] and [r.flow_id for r in now.memberships.collect()] == [2]
    assert now.communities.filter("qualified_name like '/b.py%'").count() == 0
    assert {r.target_qualified for r in now.edges.filter("file_path = '/a.py' and kind = 'CALLS'").collect()} == {"g"}
    again = maintenance.incremental_update(s, listing(spark, FILES), parse, reconcile=False, passes=PASSES)
    assert {"/a.py", "/d.py"} <= {r.file_path for r in again.collect()}
    assert s.table("queue").count() == 0


def test_batches_of_a_stream_count_once_and_moves_end_the_old_path(spark, tmp_path):
    s = GraphStore(spark, f"file://{tmp_path}/s", 4)
    schema = "file_path string, deleted boolean, content string, moved_from string, seq int"
    first = spark.createDataFrame([("/a.py", False, "def old", None, 1), ("/a.py", False, "def new", None, 2), ("/b.py", False, "def g", None, 1), ("/x.py", True, None, None, 1)], schema)
    assert watch.apply_batch(s, first, parse, 0, passes=PASSES) is not None
    assert watch.apply_batch(s, first, parse, 0, passes=PASSES) is None
    second = spark.createDataFrame([("/c.py", False, "def g", "/b.py", 3)], schema)
    watch.apply_batch(s, second, parse, 1, passes=PASSES)
    assert {r.qualified_name for r in s.read().nodes.filter("kind = 'Function'").collect()} == {"/a.py::new", "/c.py::g"}
    assert s.get("batch:watch") == "1"
