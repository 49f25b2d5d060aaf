"""Betweenness of nodes by Brandes' accumulation as rounds of joins: forward by level, backward by level."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.plans.materialise import discard, keep


def shortest_paths(steps: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """For each level its stored rows (s, v, paths): nodes at that distance from s, and how many shortest paths lead there."""
    front = keep(sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")), "level")
    levels = [front]
    while True:
        found = front.join(steps, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        seen = levels[0].select("s", "v")
        for level in levels[1:]:
            seen = seen.union(level.select("s", "v"))
        front = keep(found.join(seen, ["s", "v"], "left_anti"), "level")
        if front.isEmpty():
            discard(front)
            return levels
        levels.append(front)


def numbered(steps: DataFrame) -> DataFrame:
    """(node, id): the names at the ends of steps (src, dst), stored with a number each."""
    names = steps.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return keep(names.withColumn("id", F.monotonically_increasing_id()), "names")


#: Rows of one level that a round of sources may have at most, if it has more than one source.
ROUND_ROWS = 1 << 24


def betweenness(steps: DataFrame, sources: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(node, share): over the sources, the summed share of shortest paths from each that pass through a node.

    ``steps`` is (src, dst), ``sources`` (node).  A row is a source and a node
    it reaches, by numbers (``names``, those of the steps unless given), as the
    steps meet the rows of every level twice; no task holds an adjacency, and a
    level is written once.  Sources are taken in rounds, and a round's rows go
    before the next begins, so that what is stored grows with the nodes and not
    with the pairs; the number of rounds does.
    Backward, the nodes of a level hand (1 + share) / paths to those before
    them that a step leads from.
    """
    names = numbered(steps) if names is None else names
    of = lambda end, col: names.select(F.col("node").alias(end), F.col("id").alias(col))
    ends = steps.select("src", "dst").filter("src <> dst").join(of("src", "_src"), "src").join(of("dst", "_dst"), "dst")
    steps = keep(ends.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct(), "steps")
    starts = sources.select("node").distinct().join(names, "node").select(F.col("id").alias("node"))
    starts = keep(starts.join(steps.select(F.col("src").alias("node")).distinct(), "node", "left_semi"), "sources")
    rounds = -(-starts.count() * names.count() // ROUND_ROWS)
    total = None
    for k in range(rounds):
        part = starts.filter(F.pmod(F.xxhash64("node"), F.lit(rounds)) == k)
        found = _shares(steps, part)
        if total is not None:
            found = [total, *found]
        if found:
            total = keep(functools.reduce(DataFrame.union, found).groupBy("id").agg(F.sum("share").alias("share")), "total")
            for rows in found:
                discard(rows)
    if total is None:
        return sources.select("node", F.lit(0.0).alias("share")).limit(0)
    return total.join(names, "id").select("node", "share")


def _shares(steps: DataFrame, starts: DataFrame) -> list[DataFrame]:
    """Stored rows (id, share) that sum up to what the sources (node) of one round give each node."""
    levels = shortest_paths(steps, starts)
    reached = functools.reduce(DataFrame.union, (level.select("v") for level in levels)).distinct()
    steps = walked = keep(steps.join(reached, F.col("src") == F.col("v"), "left_semi"), "walked")
    out, stored, last = [], [], None
    for level in reversed(range(1, len(levels))):
        here = levels[level] if last is None else levels[level].join(last, ["s", "v"], "left")
        share = F.lit(0.0) if last is None else F.coalesce("got", F.lit(0.0)) * F.col("paths")
        here = keep(here.select("s", "v", ((F.lit(1.0) + share) / F.col("paths")).alias("each"), share.alias("share")), "shares")
        stored.append(here)
        out.append(keep(here.filter("share > 0").groupBy(F.col("v").alias("id")).agg(F.sum("share").alias("share")), "sums"))
        last = here.join(steps, F.col("v") == F.col("dst")).groupBy("s", F.col("src").alias("v")).agg(F.sum("each").alias("got"))
    for rows in (*levels, *stored, walked):
        discard(rows)
    return out


def bridge_nodes(g: Graph, top: int = 10, sources: int | None = None, seed: int = 42) -> DataFrame:
    """Nodes by normalised betweenness on the merged directed graph, names without a node included on paths.

    Every name is a source; with ``sources`` so many, by least hash, stand for
    all and the shares are scaled up.  Values are rounded to twelve digits
    before they order, so that the order of addition decides nothing.
    """
    steps = g.edges.select(F.col("source_qualified").alias("src"), F.col("target_qualified").alias("dst"))
    every = numbered(steps)
    n = every.count()
    picked = every if sources is None or sources >= n else every.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(sources)
    used = n if sources is None else min(n, sources)
    scale = (n / used if used else 0.0) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    scored = betweenness(steps, picked.select("node"), every).select(F.col("node").alias("qualified_name"), F.round(F.col("share") * scale, 12).alias("betweenness"))
    nodes = g.nodes.filter(F.col("kind") != "File").select("qualified_name", "kind", "file_path")
    return scored.filter("betweenness > 0").join(nodes, "qualified_name").orderBy(F.desc("betweenness"), "qualified_name").limit(top)
