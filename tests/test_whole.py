"""Whole jobs against brute force on small tables."""

import pytest
from pyspark.sql import functions as F

from lattica.catalog_more import QUERIES
from lattica.graph import Graph
from lattica.operators import ranges
from lattica.sources.derived import EDGES_SQL, NODES_SQL, supply_graph

LINES = [(o, (o * 5 + k * 3) % 9 + 1, (o + k) % 2 + 1, k, 1.0, "R" if (o + k) % 3 == 0 else "N") for o in range(1, 60) for k in (1, 2, 3)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Nine parts, two suppliers and 59 orders, whose numbers leave every remainder."""
    at = tmp_path_factory.mktemp("tables")
    tables = {
        "part": ([(k, f"Brand#1{k % 3}", 7) for k in range(1, 10)], "p_partkey long, p_brand string, p_size int"),
        "lineitem": (LINES, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string"),
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(0, "CHINA", 0), (1, "JAPAN", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(1, 0), (2, 1)], "s_suppkey long, s_nationkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_every_line_item_gives_its_edges(spark, small):
    g = supply_graph(spark, small)
    path = lambda p: f"/src/brand1{p % 3}.py"
    part = lambda p: f"{path(p)}::part_{p}"
    land = lambda s: f"/geo/asia/{('china', 'japan')[s - 1]}.java"
    supplier = lambda s: f"{land(s)}::Nation{s - 1}.supply_token_{s}"
    test = lambda o: f"/tests/t.py::test_{o}"
    at = {(o, k): p for o, p, _, k, _, _ in LINES}
    want = {
        "CALLS": {(part(p), part(at[o, k + 1])) for (o, k), p in at.items() if (o, k + 1) in at},
        "TESTED_BY": {(part(p), test(o)) for o, p, _, _, _, flag in LINES if flag == "R"},
        "REFERENCES": {(part(p), supplier(s)) for _, p, s, _, _, _ in LINES},
        "IMPORTS_FROM": {(path(p), land(s)) for _, p, s, _, _, _ in LINES},
    }
    for kind, pairs in want.items():
        got = [(r.source_qualified, r.target_qualified) for r in g.edges.filter(f"kind = '{kind}'").collect()]
        assert sorted(got) == sorted(pairs), kind
    assert sorted(r.qualified_name for r in g.nodes.filter("kind = 'Test'").collect()) == sorted({test(o) for o, *_, flag in LINES if flag == "R"})


def test_graph_equals_its_sql_and_moves_no_names(spark, small):
    g = supply_graph(spark, small)
    tables = {n: spark.read.parquet(f"{small}/{n}.parquet") for n in ("part", "lineitem", "nation", "region", "supplier")}
    for sql, rows in ((EDGES_SQL, g.edges), (NODES_SQL, g.nodes)):
        want = spark.sql(sql, **{n: t for n, t in tables.items() if "{" + n + "}" in sql})
        assert rows.schema == want.schema and rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty()
    plan = g.edges._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line.split("Aggregate [", 1)[1].split("], [")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert grouped and not [line for line in grouped if "_qualified" in line or "::part_" in line]


def test_enclosing_function_by_blocks_of_lines(spark):
    spans = [(a, a + (a * 13) % 9 * (a * 7) % 41 - 1) for a in range(-3, 90)]
    nodes = spark.createDataFrame([("Function", "/f.py", f"q{i}", a, b) for i, (a, b) in enumerate(spans)] + [("Test", "/f.py", "all", -3, 200), ("Function", "/f.py", "none", None, 7)], "kind string, file_path string, qualified_name string, line_start int, line_end int")
    sites = spark.createDataFrame([("/f.py", x) for x in range(-6, 125)] * 2 + [("/g.py", 1)], "file_path string, line int")
    want = {x: min([(b - a, f"q{i}") for i, (a, b) in enumerate(spans) if a <= x <= b] + [(203, "all")])[1] for x in range(-3, 125)}
    assert {r.line: r.qualified_name for r in ranges.enclosing_function(Graph(nodes, None), sites).collect()} == want
    cut = nodes.filter("line_start <= line_end").withColumn("at", ranges._blocks(F.col("line_start"), F.col("line_end"))).collect()
    for r in cut:
        lines = [x for at in r["at"] for x in range(at["block"] << at["level"], (at["block"] + 1) << at["level"])]
        assert sorted(lines) == list(range(r.line_start, r.line_end + 1)) and len(r["at"]) <= 16


def test_line_budget_takes_every_part(spark, tmp_path):
    sizes = {k: k % 3 + 1 for k in range(30, 400)}
    spark.createDataFrame(list(sizes.items()), "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    left, want = 200, []
    for k, size in sizes.items():
        if left > 0:
            want.append((k, min(size, left)))
            left -= size
    assert sorted(tuple(r) for r in QUERIES["line_budget"](spark, str(tmp_path)).collect()) == want
    spans = spark.createDataFrame([(k, 1, n) for k, n in sizes.items()], "k long, start int, end int").repartition(7)
    got = ranges.line_budget(spans, 700, ["k"]).collect()
    assert sum(r.given for r in got) == 700 and max(r.k for r in got) == 30 + len(got) - 1


def test_registered_flows_go_to_the_default_depth(spark, small, tmp_path):
    import shutil

    shutil.copytree(small, tmp_path, dirs_exist_ok=True)
    steps = [(k, k + 1) for k in range(1, 20)] + [(12, 4), (21, 22)]
    part = spark.createDataFrame([(k, f"Brand#1{k % 3}", 7) for k in range(1, 23)], "p_partkey long, p_brand string, p_size int")
    lines = [(o, p, 1, k, 1.0, "N") for o, pair in enumerate(steps) for k, p in enumerate(pair)]
    part.write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    name = lambda p: f"/src/brand1{p % 3}.py::part_{p}"
    want = {}
    for entry in (1, 21):
        hops, front = {entry: 0}, [entry]
        while front:
            front = [b for a in front for x, b in steps if x == a and b not in hops and not hops.update({b: hops[a] + 1})]
        want |= {(name(entry), name(p)): h for p, h in hops.items() if h <= 15}
    run = lambda q: QUERIES[q](spark, str(tmp_path)).collect()
    assert max(want.values()) > 3
    assert {(r.entry, r.qualified_name): r.hop for r in run("trace_flows")} == want
    assert {(r.entry, r.qualified_name) for r in run("flow_position")} == set(want)
    deepest = {(e, sum(x == e for x, _ in want), max(h for (x, _), h in want.items() if x == e)) for e, _ in want}
    for q in ("flow_criticality", "incremental_flows", "store_flows"):
        assert {(r.entry, r.node_count, r.depth) for r in run(q)} == deepest, q
