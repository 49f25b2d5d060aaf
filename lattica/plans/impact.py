"""Reach over the graph in bounded hops: weighted impact, plain reach, dependents, traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica import schemas
from lattica.functions import text as X
from lattica.graph import Graph
from lattica.operators import ranking
from lattica.plans.materialise import keep


def impact_edges(g: Graph) -> DataFrame:
    """(src, dst, factor): the direction and the loss of a step, a row per edge; of parallel ones the best counts where walks meet."""
    policy = F.broadcast(schemas.impact_policy(g.edges.sparkSession))  # a row per edge kind
    weight, direction = schemas.IMPACT_DEFAULT
    e = g.edges.select("kind", "source_qualified", "target_qualified").join(policy, "kind", "left")
    e = e.withColumn("direction", F.coalesce("direction", F.lit(direction))).filter("direction <> 'none'")
    out = F.col("direction") == "outgoing"
    return e.select(
        F.when(out, F.col("source_qualified")).otherwise(F.col("target_qualified")).alias("src"),
        F.when(out, F.col("target_qualified")).otherwise(F.col("source_qualified")).alias("dst"),
        (F.coalesce("weight", F.lit(weight)) * schemas.IMPACT_DECAY).alias("factor"),
    )


def impact_scores(g: Graph, seeds: DataFrame, depth: int = schemas.MAX_IMPACT_DEPTH, floor: float = schemas.IMPACT_FLOOR) -> DataFrame:
    """(qualified_name, score): best product of factors over walks from the seeds, 1 at the seeds.

    Each round carries only names whose score has just risen; a round that
    raises none ends the loop.  They are stored as files, whose size is known,
    so a round of few names goes to the steps and does not shuffle them.
    """
    steps = impact_edges(g)
    best = keep(seeds.select("qualified_name").distinct().withColumn("score", F.lit(1.0)), "best")
    front = best
    for _ in range(depth):
        reached = front.join(steps, F.col("qualified_name") == F.col("src")).groupBy(F.col("dst").alias("qualified_name")).agg(F.max(F.col("score") * F.col("factor")).alias("score"))
        old = best.withColumnRenamed("score", "old")
        front = keep(reached.filter(F.col("score") > floor).join(old, "qualified_name", "left").filter("old is null or score > old").select("qualified_name", "score"), "front")
        if front.isEmpty():
            break
        best = keep(best.union(front).groupBy("qualified_name").agg(F.max("score").alias("score")), "best")
    return best


def seeds_of_files(g: Graph, files: DataFrame) -> DataFrame:
    """All nodes of the files, and the namespaces they declare."""
    own = g.nodes.join(files.select("file_path").distinct(), "file_path", "left_semi")
    spaces = own.select(F.explode(F.from_json(F.get_json_object("extra", "$.csharp_namespaces"), "array<string>")).alias("qualified_name"))
    return own.select("qualified_name").union(spaces).distinct()


def impact_radius(g: Graph, files: DataFrame, depth: int = schemas.MAX_IMPACT_DEPTH, limit: int = schemas.MAX_IMPACT_NODES) -> DataFrame:
    """Nodes that a change of the files may affect, best first, with how many there are in all.

    Names without a node carry impact on but are not listed.
    """
    seeds = seeds_of_files(g, files)
    scores = impact_scores(g, seeds, depth).join(seeds, "qualified_name", "left_anti")
    hit = g.nodes.filter(~X.is_hdl(F.col("extra"))).select("qualified_name", "kind", "file_path").join(scores, "qualified_name")
    return ranking.bounded(hit, [F.desc("score"), "qualified_name"], limit, limit).withColumnRenamed("total", "total_impacted")


def reach(steps: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, hop): nodes by their least number of steps (src, dst) from the seeds (node), seeds at 0.

    Equal steps need not become one, as the nodes they lead to do; a front is
    written, so that where it is small the steps meet it without a shuffle.
    """
    seen = front = keep(seeds.select("node").distinct().withColumn("hop", F.lit(0)), "reached")
    for hop in range(1, depth + 1):
        found = steps.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = keep(found.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)), "reached")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def _both_ways(edges: DataFrame) -> DataFrame:
    there = edges.select(F.col("source_qualified").alias("src"), F.col("target_qualified").alias("dst"))
    return there.union(there.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def impact_bidirectional(g: Graph, files: DataFrame, depth: int = 2) -> DataFrame:
    """Unweighted reach over all edges both ways, seeds excluded; nodes only."""
    seeds = g.nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select(F.col("qualified_name").alias("node"))
    found = reach(_both_ways(g.edges), seeds, depth).filter("hop > 0").withColumnRenamed("node", "qualified_name")
    return g.nodes.select("qualified_name", "kind", "file_path").join(found, "qualified_name")


def find_dependents(g: Graph, path: str, hops: int = 2, limit: int = schemas.MAX_DEPENDENTS) -> DataFrame:
    """Files that depend on a file, by edges into its nodes, up to a number of hops."""
    owner = g.nodes.select(F.col("qualified_name").alias("target_qualified"), F.col("file_path").alias("src"))
    steps = g.edges.filter(~F.col("kind").isin("CONTAINS", "TESTED_BY")).join(owner, "target_qualified").select("src", F.col("file_path").alias("dst")).filter("src <> dst")
    start = g.nodes.sparkSession.createDataFrame([(path,)], "node string")
    found = reach(steps, start, hops).filter("hop > 0").select(F.col("node").alias("file_path"), "hop")
    return ranking.bounded(found, ["hop", "file_path"], limit, limit)


def traverse(g: Graph, start: str, depth: int = 3, token_budget: int = 2000) -> DataFrame:
    """Breadth-first walk over edges both ways from a node, cut where the running token estimate meets the budget."""
    depth = min(max(depth, 1), 6)
    seeds = g.nodes.sparkSession.createDataFrame([(start,)], "node string")
    found = reach(_both_ways(g.edges), seeds, depth).withColumnRenamed("node", "qualified_name")
    rows = g.nodes.select("qualified_name", "kind", "file_path").join(found, "qualified_name")
    tokens = X.estimate_tokens(F.concat("qualified_name", "kind", "file_path"))
    return ranking.token_budget_prefix(rows, ["hop", "qualified_name"], tokens, token_budget)


def _walked(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(key, node, hop): what is up to ``hops`` edges, either way, from the nodes of each key in ``starts`` (key, node)."""
    front = keep(starts.select("key", "node").distinct().withColumn("hop", F.lit(0)), "walk")
    seen = front
    for hop in range(1, hops + 1):
        there = edges.join(front, F.col("source_qualified") == F.col("node")).select("key", F.col("target_qualified").alias("node"))
        back = edges.join(front, F.col("target_qualified") == F.col("node")).select("key", F.col("source_qualified").alias("node"))
        front = keep(there.union(back).distinct().join(seen.select("key", "node"), ["key", "node"], "left_anti").withColumn("hop", F.lit(hop)), "walk")
        seen = seen.union(front)
    return seen


def multi_hop(g: Graph, tasks: DataFrame, hops: int = 2) -> DataFrame:
    """(task, expected, hop): for each expected node the least number of edges, either way, from its task's start; null beyond ``hops``.

    ``tasks`` is (task, start, expected).  Tasks walk half of the hops, the
    expected nodes, which tasks share, the other half; where both come, their
    hops add up.  So no task carries all that is ``hops`` edges away.
    """
    edges = g.edges.select("source_qualified", "target_qualified")
    ahead = _walked(edges, tasks.select(F.col("task").alias("key"), F.col("start").alias("node")), hops // 2)
    behind = _walked(edges, tasks.select(F.col("expected").alias("key"), F.col("expected").alias("node")), hops - hops // 2)
    wanted = tasks.select("task", "expected").distinct()
    near = ahead.join(behind.select("node").distinct(), "node", "left_semi").join(wanted.withColumnRenamed("task", "key"), "key")
    met = near.join(behind.select(F.col("key").alias("expected"), "node", F.col("hop").alias("_more")), ["expected", "node"])
    least = met.groupBy(F.col("key").alias("task"), "expected").agg(F.min(F.col("hop") + F.col("_more")).alias("hop"))
    return wanted.join(least, ["task", "expected"], "left").select("task", "expected", "hop")


def multi_hop_recall(g: Graph, tasks: DataFrame, hops: int = 2) -> DataFrame:
    """One row: how many tasks there are, how many of the expected nodes are reached, and that share."""
    found = multi_hop(g, tasks, hops)
    return found.agg(F.countDistinct("task").alias("tasks"), F.count(F.lit(1)).alias("expected"), F.count("hop").alias("reached")).withColumn("recall", F.when(F.col("expected") > 0, F.col("reached") / F.col("expected")).otherwise(0.0))
