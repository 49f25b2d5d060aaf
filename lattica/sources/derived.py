"""A property graph over the relational tables, in SQL that Spark and other engines share."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.plans.materialise import shared_dir

_PART_PATH = "concat('/src/', lower(replace(p_brand, '#', '')), '.py')"
_PART = f"concat({_PART_PATH}, '::part_', cast(p_partkey as string))"
_NATION_PATH = "concat('/geo/', lower(replace(r_name, ' ', '_')), '/', lower(replace(n_name, ' ', '_')), '.java')"
_TEST = "concat('/tests/t.py::test_', cast(l_orderkey as string))"

#: {table} stands for an input table.
NODES_SQL = f"""
SELECT kind, name, qualified_name, file_path, cast(line_start as int) AS line_start, cast(line_end as int) AS line_end, language, parent_name, is_test, extra FROM (
  SELECT 'File' AS kind, {_PART_PATH} AS name, {_PART_PATH} AS qualified_name, {_PART_PATH} AS file_path, 1 AS line_start, 6000 AS line_end, 'python' AS language, cast(null as string) AS parent_name, false AS is_test, '{{{{}}}}' AS extra FROM (SELECT DISTINCT p_brand FROM {{part}}) b
  UNION ALL SELECT 'Function', concat('part_', cast(p_partkey as string)), {_PART}, {_PART_PATH}, (p_partkey * 7) % 5000 + 1, (p_partkey * 7) % 5000 + p_size + p_partkey % 80, 'python', cast(null as string), false,
    CASE WHEN p_partkey % 50 = 0 THEN '{{{{"decorators": ["app.get"]}}}}' WHEN p_partkey % 70 = 0 THEN '{{{{"verilog_kind": "module"}}}}' ELSE '{{{{}}}}' END FROM {{part}}
  UNION ALL SELECT 'File', {_NATION_PATH}, {_NATION_PATH}, {_NATION_PATH}, 1, 6000, 'java', cast(null as string), false, '{{{{}}}}' FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
  UNION ALL SELECT 'Class', concat('Region', cast(r_regionkey as string)), concat('/geo/', lower(replace(r_name, ' ', '_')), '/base.java::Region', cast(r_regionkey as string)), concat('/geo/', lower(replace(r_name, ' ', '_')), '/base.java'), 1, 90, 'java', cast(null as string), false, '{{{{}}}}' FROM {{region}}
  UNION ALL SELECT 'Class', concat('Nation', cast(n_nationkey as string)), concat({_NATION_PATH}, '::Nation', cast(n_nationkey as string)), {_NATION_PATH}, 1, 400, 'java', cast(null as string), false, '{{{{}}}}' FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
  UNION ALL SELECT 'Function', concat('supply_token_', cast(s_suppkey as string)), concat({_NATION_PATH}, '::Nation', cast(n_nationkey as string), '.supply_token_', cast(s_suppkey as string)), {_NATION_PATH}, (s_suppkey * 3) % 380 + 2, (s_suppkey * 3) % 380 + 10, 'java', concat('Nation', cast(n_nationkey as string)), false, '{{{{}}}}' FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT 'Test', concat('test_', cast(l_orderkey as string)), {_TEST}, '/tests/t.py', l_orderkey % 900 + 1, l_orderkey % 900 + 9, 'python', cast(null as string), true, '{{{{}}}}' FROM {{lineitem}} WHERE l_returnflag = 'R'
) n
""".replace("{{{{", "{{").replace("}}}}", "}}")

EDGES_SQL = f"""
SELECT kind, source_qualified, target_qualified, file_path, cast(line as int) AS line, confidence FROM (
  SELECT 'CONTAINS' AS kind, {_PART_PATH} AS source_qualified, {_PART} AS target_qualified, {_PART_PATH} AS file_path, 1 AS line, 1.0e0 AS confidence FROM {{part}}
  UNION ALL SELECT DISTINCT 'CALLS', concat('/src/', lower(replace(a_brand, '#', '')), '.py::part_', cast(a_key as string)), concat('/src/', lower(replace(b_brand, '#', '')), '.py::part_', cast(b_key as string)), concat('/src/', lower(replace(a_brand, '#', '')), '.py'), 2, 1.0e0 FROM (
    SELECT l_partkey AS a_key, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS b_key FROM {{lineitem}}) p
    JOIN (SELECT p_partkey AS ka, p_brand AS a_brand FROM {{part}}) pa ON a_key = ka JOIN (SELECT p_partkey AS kb, p_brand AS b_brand FROM {{part}}) pb ON b_key = kb
  UNION ALL SELECT 'CALLS', {_PART}, concat('ext_', cast(p_partkey % 13 as string)), {_PART_PATH}, 3, 0.5e0 FROM {{part}} WHERE p_partkey % 97 = 0
  UNION ALL SELECT DISTINCT 'TESTED_BY', {_PART}, {_TEST}, {_PART_PATH}, 4, 1.0e0 FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey WHERE l_returnflag = 'R'
  UNION ALL SELECT DISTINCT 'REFERENCES', {_PART}, concat({_NATION_PATH}, '::Nation', cast(n_nationkey as string), '.supply_token_', cast(s_suppkey as string)), {_PART_PATH}, 5, 0.9e0 FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT 'IMPORTS_FROM', {_PART_PATH}, {_NATION_PATH}, {_PART_PATH}, 1, 1.0e0 FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
  UNION ALL SELECT 'INHERITS', concat({_NATION_PATH}, '::Nation', cast(n_nationkey as string)), concat('/geo/', lower(replace(r_name, ' ', '_')), '/base.java::Region', cast(r_regionkey as string)), {_NATION_PATH}, 1, 1.0e0 FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
  UNION ALL SELECT 'CONTAINS', concat({_NATION_PATH}, '::Nation', cast(n_nationkey as string)), concat({_NATION_PATH}, '::Nation', cast(n_nationkey as string), '.supply_token_', cast(s_suppkey as string)), {_NATION_PATH}, 1, 1.0e0 FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
) e
"""

TABLES = ("part", "lineitem", "nation", "region", "supplier")


def plain_sql(sql: str) -> str:
    """The statement over tables of their own names."""
    return sql.format(**{t: t for t in TABLES})


def _frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def _edge_parts(frames: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
    """The rows of ``EDGES_SQL`` by kind, without the kind: pairs are made distinct and joined by their keys, and names are put together last.

    So what is shuffled is two numbers a line item, not two names.  Keys and
    brands are taken not to be null, as names of nodes come from them.
    """
    part = frames["part"].select("p_partkey", F.expr(_PART_PATH).alias("path")).distinct()
    named = lambda key, path: F.concat(path, F.lit("::part_"), key.cast("string"))
    of = lambda key, path: part.select(F.col("p_partkey").alias(key), F.col("path").alias(path))
    rows = lambda df, src, dst, path, line, sure: df.select(src.alias("source_qualified"), dst.alias("target_qualified"), path.alias("file_path"), F.lit(line).alias("line"), F.lit(sure).alias("confidence"))
    where = frames["nation"].join(frames["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name", "r_regionkey", F.expr(_NATION_PATH).alias("place"), F.expr(f"concat({_NATION_PATH}, '::Nation', cast(n_nationkey as string))").alias("owner"))
    supplier = frames["supplier"].join(where, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "place", "owner", F.concat("owner", F.lit(".supply_token_"), F.col("s_suppkey").cast("string")).alias("method"))
    items = frames["lineitem"]
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    pairs = items.select(F.col("l_partkey").alias("a"), after.alias("b")).filter("a is not null and b is not null").distinct()
    calls = pairs.join(of("a", "a_path"), "a").join(of("b", "b_path"), "b")
    tested = items.filter("l_returnflag = 'R'").select("l_partkey", "l_orderkey").distinct().join(of("l_partkey", "path"), "l_partkey")
    supplied = items.select("l_partkey", "l_suppkey").distinct().join(of("l_partkey", "path"), "l_partkey").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    name, path = named(F.col("p_partkey"), F.col("path")), F.col("path")
    own = frames["part"].select("p_partkey", F.expr(_PART_PATH).alias("path"))
    return [
        ("CONTAINS", rows(own, path, name, path, 1, 1.0)),
        ("CALLS", rows(calls, named(F.col("a"), F.col("a_path")), named(F.col("b"), F.col("b_path")), F.col("a_path"), 2, 1.0)),
        ("CALLS", rows(own.filter("p_partkey % 97 = 0"), name, F.expr("concat('ext_', cast(p_partkey % 13 as string))"), path, 3, 0.5)),
        ("TESTED_BY", rows(tested, named(F.col("l_partkey"), path), F.expr(_TEST), path, 4, 1.0)),
        ("REFERENCES", rows(supplied, named(F.col("l_partkey"), path), F.col("method"), path, 5, 0.9)),
        ("IMPORTS_FROM", rows(supplied.select("path", "place").distinct(), path, F.col("place"), path, 1, 1.0)),
        ("INHERITS", rows(where, F.col("owner"), F.expr("concat('/geo/', lower(replace(r_name, ' ', '_')), '/base.java::Region', cast(r_regionkey as string))"), F.col("place"), 1, 1.0)),
        ("CONTAINS", rows(supplier, F.col("owner"), F.col("method"), F.col("place"), 1, 1.0)),
    ]


def _nodes(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """The rows of ``NODES_SQL``; of line items it needs one row for each returned order, so the names of tests are made of these."""
    used = {t: f for t, f in frames.items() if "{" + t + "}" in NODES_SQL}
    used["lineitem"] = used["lineitem"].filter("l_returnflag = 'R'").select("l_orderkey", "l_returnflag").distinct()
    return spark.sql(NODES_SQL.replace("UNION ALL SELECT DISTINCT 'Test'", "UNION ALL SELECT 'Test'"), **used)


def supply_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts as functions of brand files, suppliers as methods of nation classes, returned orders as tests."""
    frames = _frames(spark, sf_dir)
    edges = functools.reduce(DataFrame.union, (rows.select(F.lit(kind).alias("kind"), *rows.columns) for kind, rows in _edge_parts(frames)))
    return Graph(_nodes(spark, frames), edges)


#: Where this application stores the graph of a folder of tables, and which of its tables are written.
_STORED: dict[tuple[str, str], str] = {}
_WRITTEN: set[str] = set()


def stored_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The derived graph with one community per file, each table written once an application and folder when it is first asked for: edges parted by kind.

    A query that names a kind reads that part only, none repeats the joins
    that make the edges, and one of nodes alone does not make edges.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    path = _STORED.setdefault(key, f"{shared_dir(spark)}/lattica/graph-{uuid.uuid4().hex}")

    def once(table: str, write) -> str:
        at = f"{path}/{table}"
        if at not in _WRITTEN:
            write(at)
            _WRITTEN.add(at)
        return at

    def nodes() -> DataFrame:
        return spark.read.parquet(once("nodes", lambda at: _nodes(spark, _frames(spark, sf_dir)).write.parquet(at)))

    def write_edges(at: str) -> None:
        # A kind at a time, so that no task sorts its rows by kind before it writes them.
        for kind, rows in _edge_parts(_frames(spark, sf_dir)):
            rows.write.mode("append").parquet(f"{at}/kind={kind}")

    def edges() -> DataFrame:
        rows = spark.read.schema("source_qualified string, target_qualified string, file_path string, line int, confidence double, kind string").parquet(once("edges", write_edges))
        return rows.select("kind", "source_qualified", "target_qualified", "file_path", "line", "confidence")

    def write_communities(at: str) -> None:
        own = nodes().filter(F.col("kind") != "File").select("qualified_name", "file_path")
        ids = own.select("file_path").distinct().select("file_path", F.row_number().over(by_path()).cast("long").alias("community_id"))
        own.join(ids, "file_path").select("qualified_name", "community_id").write.parquet(at)

    return Graph(nodes, edges, lambda: spark.read.parquet(once("communities", write_communities)))


def by_path():
    """Order of files; there is one row per file, not per node."""
    return Window.orderBy("file_path")
