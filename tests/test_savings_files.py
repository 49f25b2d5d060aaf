"""Token accounting, and the inventory of files below a root."""

import os
import subprocess

from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.plans import savings
from lattica.sources import files, history
from tests.test_graph import E, build, edge, node


def test_answers_cost_their_nodes_and_first_edges(spark):
    a, b = "/a.py::a", "/a.py::b"
    g = build(spark, [node(a), node(b)], [edge("CALLS", a, b, line=n) for n in range(9)])
    asked = spark.createDataFrame([("x",), ("y",), ("y",)], "question string")
    hits = spark.createDataFrame([("x", a), ("x", a), ("x", "/gone.py::z")], "question string, qualified_name string")
    corpus = spark.createDataFrame([("w" * 4000,), ("",), (None,)], "text string")
    got = {r.question: r for r in savings.token_reduction(g, asked, hits, corpus).collect()}
    assert set(got) == {"x", "y"} and got["y"].graph_tokens == 0 and got["y"].reduction_ratio == 0
    assert got["x"].naive_tokens == 1001
    size = lambda rows, cols: sum(max(1, len(r[0]) // 4) for r in rows.select(F.to_json(F.struct(*cols))).collect())
    want = size(g.nodes.filter(F.col("qualified_name") == a), savings._NODE) + size(g.edges.filter("line < 5"), savings._EDGE)
    assert got["x"].graph_tokens == want and got["x"].average_ratio == got["x"].reduction_ratio / 2


def test_savings_of_a_change(spark):
    a, b, c = "/a.py::a", "/b.py::b", "/c.py::c"
    g = build(spark, [node(a), node(b), node(c)], [edge("CALLS", b, a), edge("CALLS", c, b)])
    texts = spark.createDataFrame([("/a.py", "x" * 400), ("/b.py", "x" * 4000), ("/b.py", "x" * 4), ("/c.py", None), ("/z.py", "x")], "file_path string, text string")
    changed = spark.createDataFrame([("/a.py",), ("/a.py",)], "file_path string")
    r = savings.measure_savings(g, changed, texts).first()
    assert (r.changed_files, r.impacted_files, r.changed_nodes, r.impacted_nodes, r.nodes_omitted) == (1, 2, 1, 2, 0)
    assert (r.changed_tokens, r.impacted_tokens, r.baseline_tokens) == (100, 1001, 1101)
    assert r.returned_tokens == 100 + r.graph_tokens and r.saved_tokens == 1101 - r.returned_tokens
    assert r.search_trace_tokens == 1 * 200 * 2 + 2 * 1000 and r.total_counterfactual == 2400 + 100 + 1600 + 1101
    few = savings.measure_savings(g, changed, texts, limit=1).first()
    assert (few.impacted_nodes, few.nodes_omitted, few.impacted_files) == (1, 1, 1)
    none = savings.measure_savings(g, changed.limit(0), texts).first()
    assert none.baseline_tokens == 0 and none.saved_tokens == 0 and none.saved_percent == 0


def test_savings_of_an_empty_graph(spark):
    g = Graph(build(spark, [node("/a.py::a")], []).nodes.limit(0), spark.createDataFrame([], E))
    texts = spark.createDataFrame([("/a.py", "x" * 40)], "file_path string, text string")
    r = savings.measure_savings(g, texts.select("file_path"), texts).first()
    assert (r.changed_tokens, r.impacted_files, r.changed_nodes) == (10, 0, 0)
    q = spark.createDataFrame([("x",)], "question string")
    got = savings.token_reduction(g, q, q.withColumn("qualified_name", F.lit("n")), texts).first()
    assert (got.naive_tokens, got.graph_tokens, got.average_ratio) == (10, 0, 0.0)


def test_ignore_rules():
    rules = ["# words", "", "gen/", "/top/", "a/b/", "cache/**", "a/c/**", "*.tmp.py", "!m/target/"]
    assert files.ignore_rules(rules) == (["**/gen/**", "/top/**", "a/b/**", "**/cache/**", "a/c/**", "*.tmp.py"], ["m/target"])


def below(rows, root):
    return sorted(r.file_path.split(f"{root.name}/", 1)[1] for r in rows.select("file_path").collect())


def test_inventory_rules(spark, tmp_path):
    root = tmp_path / "tree"
    kept = ["a.py", "m/x.py", "lone/target/real.py", "spare/target/s.py", "deep/gone.py"]
    for p in [*kept, "m/target/out.py", "m/target/deep/out.py", "target/top.py", "gen/g.py", "deep/gen/g.py", "t.tmp.py", "n.txt"]:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("x")
    for p in ("m/pom.xml", "spare/Cargo.toml", "pom.xml"):
        (root / p).write_text("<x/>")
    (root / "bin.py").write_bytes(b"a\x00")
    (root / "rules").write_text("gen/\n*.tmp.py\n!spare/target\n")
    outside = tmp_path / "outside"
    outside.mkdir()
    (outside / "o.py").write_text("x")
    os.symlink(outside / "o.py", root / "link.py")
    os.symlink(outside, root / "linked")
    take = lambda **more: below(files.collect_files(spark, f"file://{root}", {".py": "python"}, **more), root)
    assert take(ignore_file="rules") == sorted(kept)
    assert "gen/g.py" in take() and "spare/target/s.py" not in take()
    assert take(ignore_file="rules", max_bytes=0) == []
    paths = spark.createDataFrame([("a.py",), ("m/x.py",), ("gen/g.py",), ("away.py",)], "file_path string")
    assert take(ignore_file="rules", tracked=paths) == ["a.py", "m/x.py"]
    assert take(ignore_file="rules", tracked=paths.limit(0)) == sorted(kept)


def test_tracked_files(spark, tmp_path):
    assert history.tracked_files(spark, str(tmp_path)).count() == 0
    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    for p in ("a b.py", "c.py", "not.py"):
        (tmp_path / p).write_text("x")
    subprocess.run(["git", "add", "a b.py", "c.py"], cwd=tmp_path, check=True)
    assert {r.file_path for r in history.tracked_files(spark, str(tmp_path)).collect()} == {"a b.py", "c.py"}
