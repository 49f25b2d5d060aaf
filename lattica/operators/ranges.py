"""Diffs as rows, and interval joins of line ranges with entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.graph import Graph
from lattica.plans.materialise import settle


def parse_unified_diff(diffs: DataFrame, text: str = "text") -> DataFrame:
    """(diff_id, file_path, start, end) of every hunk's new side; a hunk of no lines is its start line.

    Input rows are (diff_id, text).  A header ``+++ /dev/null`` belongs to no file.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split(F.col(text), "\n")).alias("_at", "_l"))
    head = F.when(F.col("_l").startswith("+++ "), F.regexp_extract("_l", r"^\+\+\+ (?:b/)?(\S.*?)\s*$", 1))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    at = W.partitionBy("diff_id").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("file_path", F.last(head, ignorenulls=True).over(at)).filter(F.col("_l").rlike(hunk))
    start = F.regexp_extract("_l", hunk, 1).cast("int")
    counted = F.regexp_extract("_l", hunk, 2)
    n = F.when(counted == "", 1).otherwise(counted.cast("int"))
    return rows.filter("file_path is not null and file_path <> '/dev/null'").select("diff_id", "file_path", start.alias("start"), (start + F.greatest(n - 1, F.lit(0))).alias("end"))


def parse_numstat(logs: DataFrame, text: str = "text") -> DataFrame:
    """(file_path, commits) from NUL-separated ``added TAB deleted TAB path`` records."""
    records = logs.select(F.explode(F.split(F.col(text), "[\\x00\\n]")).alias("_r")).filter(F.col("_r").rlike(r"^(\d+|-)\t(\d+|-)\t."))
    return records.groupBy(F.regexp_extract("_r", r"^(?:\d+|-)\t(?:\d+|-)\t(.+)$", 1).alias("file_path")).agg(F.count(F.lit(1)).alias("commits"))


def range_join(g: Graph, ranges: DataFrame) -> DataFrame:
    """Nodes that overlap a changed range of their file, each once.

    A path of the ranges that no node has also matches stored paths that end in
    it.  Nodes without lines match nothing.  The join is on the file, with the
    overlap as a further condition, so only one file's rows meet.
    """
    r = ranges.select(F.col("file_path").alias("_f"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    files = g.nodes.select("file_path").distinct()
    asked = r.select("_f").distinct()
    exact = asked.join(files, F.col("_f") == F.col("file_path"))
    parts = F.split("file_path", "/")
    tails = files.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("_f"))
    loose = asked.join(exact, "_f", "left_anti").join(tails, "_f").select("_f", "file_path")
    paths = exact.select("_f", "file_path").union(loose)
    hit = g.nodes.join(paths, "file_path").join(r, "_f").filter((F.col("line_start") <= F.col("_b")) & (F.col("line_end") >= F.col("_a")))
    return hit.select("qualified_name", "kind", "name", "file_path", "line_start", "line_end").distinct()


#: Lines are whole numbers below two to this power.
LINE_BITS = 32


def _blocks(start: Column, end: Column) -> Column:
    """The (level, block) that make up lines ``start`` to ``end``, two of a level at most; block n of a level holds the lines n * 2^level and on."""
    a, b = F.lit(1).cast("long") * start, F.lit(1).cast("long") * end + 1

    def at(level: Column) -> Column:
        first, last = F.call_function("shiftright", a + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level), F.call_function("shiftright", b, level)
        here = first < last
        left = F.when(here & (F.pmod(first, F.lit(2)) == 1), F.struct(level.alias("level"), first.alias("block")))
        right = F.when(here & (F.pmod(last, F.lit(2)) == 1), F.struct(level.alias("level"), (last - 1).alias("block")))
        return F.array_compact(F.array(left, right))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LINE_BITS)), at)))


def enclosing_function(g: Graph, sites: DataFrame) -> DataFrame:
    """For each (file_path, line), the function or test of least extent around the line.

    Functions are cut into blocks of a power of two lines and each block keeps
    the best of its functions, so a line meets one function per block that it
    lies in, however many its file has.
    """
    f = g.nodes.filter(F.col("kind").isin("Function", "Test") & (F.col("line_start") <= F.col("line_end")))
    spans = f.groupBy("file_path", "line_start", "line_end").agg(F.min("qualified_name").alias("qualified_name"))
    best = F.struct((F.col("line_end") - F.col("line_start")).alias("extent"), "qualified_name")
    cut = spans.select("file_path", best.alias("best"), F.explode(_blocks(F.col("line_start"), F.col("line_end"))).alias("_at"))
    least = cut.groupBy("file_path", F.col("_at.level").alias("level"), F.col("_at.block").alias("block")).agg(F.min("best").alias("best"))
    asked = sites.select("file_path", "line").filter("line is not null").distinct()
    level = F.explode(F.sequence(F.lit(0), F.lit(LINE_BITS)))
    points = asked.select("file_path", "line", level.alias("level")).withColumn("block", F.expr("shiftright(cast(line AS bigint), level)"))
    hit = points.join(least, ["file_path", "level", "block"])
    return hit.groupBy("file_path", "line").agg(F.min("best").alias("best")).select("file_path", "line", "best.qualified_name")


def merge_windows(spans: DataFrame, around: int = 2) -> DataFrame:
    """(file_path, start, end): windows of ``around`` lines about spans, joined where they touch."""
    w = spans.select("file_path", F.greatest(F.col("start") - around, F.lit(1)).alias("start"), (F.col("end") + around).alias("end"))
    before = W.partitionBy("file_path").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    w = w.withColumn("_new", F.coalesce(F.col("start") > F.max("end").over(before) + 1, F.lit(True)).cast("int"))
    w = w.withColumn("_g", F.sum("_new").over(W.partitionBy("file_path").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)))
    return w.groupBy("file_path", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def line_budget(spans: DataFrame, budget: int, order: list[str | Column]) -> DataFrame:
    """Spans cut to a budget of lines they share in order; ``given`` has the lines each gets.

    Spans are dealt by ranges of the order, so that only the sums of the ranges
    pass through one task.
    """
    dealt = settle(spans.repartitionByRange(*order).withColumns({"_range": F.spark_partition_id(), "_size": F.col("end") - F.col("start") + 1}))
    sums = dealt.groupBy("_range").agg(F.sum("_size").alias("_sum"))
    bases = sums.select("_range", F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.sum("_size").over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    before = F.col("_base") + F.coalesce(inside, F.lit(0))
    left = dealt.join(bases, "_range").withColumn("given", F.greatest(F.lit(0), F.least("_size", F.lit(budget) - before)).cast("long"))
    return left.filter("given > 0").select(*spans.columns, "given")
