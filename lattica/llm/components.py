"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import drop_stored, store


def _least(sym: DataFrame) -> DataFrame:
    """Each node with the least of itself and its neighbours."""
    return sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours above (large) or below (small) a node move to its least neighbour."""
    if large:
        sym = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        out = sym.join(_least(sym), "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = _least(down)
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); a component is named by its least node.

    Works by joins and partial minima, so a node with many neighbours is never
    one task's group.  Each round is written to the shared folder; the number
    of rounds grows with the logarithm of the longest path.
    """
    now = store(edges.filter(F.col("a") != F.col("b")).distinct(), "cc")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    seen = None
    for _ in range(rounds):
        after = store(_star(_star(now, True), False), "cc")
        drop_stored(now)
        now = after
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
