"""Token accounting: what questions and changes cost with the graph, beside reading files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica import schemas
from lattica.functions import text as X
from lattica.graph import Graph
from lattica.plans import impact
from lattica.plans.materialise import settle

#: Tokens that one step of work without a graph is taken to cost.
GREP_ONE = 200
READ_FILE = 800
READ_TEST_FILE = 600
GREP_AND_READ = 1000
TRACE_ONE_HOP = 400
ANALYSE_ONE = 100
#: More impacted nodes than these are a medium and a high risk.
MEDIUM_RISK, HIGH_RISK = 5, 20
#: Fixed value: searches by hop are counted up to this depth.
DEEPEST_SEARCH = 3
_NODE = ("kind", "name", "qualified_name", "file_path")
_EDGE = ("kind", "source_qualified", "target_qualified", "file_path", "line")


def floor_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def token_reduction(g: Graph, questions: DataFrame, hits: DataFrame, corpus: DataFrame, text: str = "text", edges: int = 5) -> DataFrame:
    """(question, naive_tokens, graph_tokens, reduction_ratio, average_ratio): reading the whole corpus against the answers of a search.

    ``questions`` is (question), ``hits`` (question, qualified_name) is what any
    search found for them; a name without a node counts nothing.  An answer is
    the JSON of its node and of its first ``edges`` outgoing edges by line.  A
    question without hits has the ratio 0 and counts in the average.  Null
    texts are files that could not be read.
    """
    asked = questions.select("question").distinct()
    found = hits.select("question", "qualified_name").distinct()
    nodes = found.join(g.nodes.select(*_NODE), "qualified_name").select("question", "qualified_name", floor_tokens(F.to_json(F.struct(*_NODE))).alias("tokens"))
    out = g.edges.select(*_EDGE).join(found.select(F.col("qualified_name").alias("source_qualified")).distinct(), "source_qualified", "left_semi")
    place = F.row_number().over(W.partitionBy("source_qualified").orderBy("line", "kind", "target_qualified", "file_path"))
    first = out.withColumn("_place", place).filter(F.col("_place") <= edges)
    around = first.groupBy("source_qualified").agg(F.sum(floor_tokens(F.to_json(F.struct(*_EDGE)))).alias("more"))
    cost = nodes.join(around, F.col("qualified_name") == F.col("source_qualified"), "left").groupBy("question").agg(F.sum(F.col("tokens") + F.coalesce("more", F.lit(0))).alias("graph_tokens"))
    naive = corpus.filter(F.col(text).isNotNull()).agg(F.coalesce(F.sum(floor_tokens(F.col(text))), F.lit(0)).alias("naive_tokens"))
    rows = asked.join(cost, "question", "left").crossJoin(F.broadcast(naive))  # one row
    rows = rows.select("question", "naive_tokens", F.coalesce("graph_tokens", F.lit(0)).cast("long").alias("graph_tokens"))
    rows = settle(rows.withColumn("reduction_ratio", F.when(F.col("graph_tokens") > 0, F.col("naive_tokens") / F.col("graph_tokens")).otherwise(F.lit(0.0))))
    average = rows.agg(F.avg("reduction_ratio").alias("average_ratio"))
    return rows.crossJoin(F.broadcast(average))  # one row


def without_graph(changed: Column, impacted: Column, files: Column, file_tokens: Column, depth: int, callers: Column | int = 0, tested: Column | int = 0, flow_hops: Column | int = 0) -> dict[str, Column]:
    """Modelled tokens of the same work by searching and reading: tracing, analysis, whole files, and their sum.

    ``tested`` counts changed functions whose tests were looked for, found or not.
    """
    count = lambda c: c if isinstance(c, Column) else F.lit(c)
    trace = changed * GREP_ONE * min(depth, DEEPEST_SEARCH) + impacted * GREP_AND_READ + count(callers) * GREP_ONE
    analysis = count(tested) * (GREP_ONE + READ_TEST_FILE) + changed * ANALYSE_ONE + (count(flow_hops) * TRACE_ONE_HOP).cast("long")
    whole = files * READ_FILE
    parts = {"search_trace_tokens": trace, "analysis_tokens": analysis, "precision_tokens": whole}
    parts["total_counterfactual"] = trace + analysis + whole + file_tokens
    return {name: c.cast("long") for name, c in parts.items()}


def measure_savings(g: Graph, changed: DataFrame, contents: DataFrame, depth: int = schemas.MAX_IMPACT_DEPTH, limit: int = schemas.MAX_IMPACT_NODES, text: str = "text") -> DataFrame:
    """One row: tokens of reading the changed and the impacted files, against the changed files and the graph's short answer.

    ``changed`` is (file_path), repeats count once; ``contents`` is (file_path,
    text), and a file may lie in several parts.  At most ``limit`` nodes are
    listed, best first; ``nodes_omitted`` tells how many more there are, and
    impacted files are those of listed nodes.  A change that names no file of
    the graph still costs what its files hold.
    """
    asked = changed.select("file_path").distinct()
    listed = settle(impact.impact_radius(g, asked, depth, limit))  # at most ``limit`` rows
    near = listed.select("file_path").distinct().join(asked, "file_path", "left_anti")
    wanted = asked.select("file_path", F.lit(True).alias("_own")).union(near.select("file_path", F.lit(False)))
    sizes = contents.select("file_path", X.estimate_tokens(F.col(text)).alias("_t")).join(wanted, "file_path")
    of = lambda own: F.coalesce(F.sum(F.when(F.col("_own") == own, F.col("_t"))), F.lit(0)).cast("long")
    tokens = sizes.agg(of(True).alias("changed_tokens"), of(False).alias("impacted_tokens"))
    names = listed.orderBy(F.desc("score"), "qualified_name").limit(5).join(g.nodes.select("qualified_name", "name"), "qualified_name")
    key = names.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "qualified_name", "name"))).alias("_k"))
    counts = listed.agg(F.count(F.lit(1)).alias("impacted_nodes"), F.coalesce(F.max("total_impacted"), F.lit(0)).alias("total"))
    files = near.agg(F.count(F.lit(1)).alias("impacted_files"))
    own = g.nodes.join(asked, "file_path", "left_semi").agg(F.count(F.lit(1)).alias("changed_nodes"))
    row = asked.agg(F.count(F.lit(1)).alias("changed_files"))
    for more in (own, counts, files, tokens, key):
        row = row.crossJoin(F.broadcast(more))  # one row each
    risk = F.when(F.col("impacted_nodes") > HIGH_RISK, "high").when(F.col("impacted_nodes") > MEDIUM_RISK, "medium").otherwise("low")
    row = row.withColumn("nodes_omitted", F.greatest(F.lit(0), F.col("total") - F.col("impacted_nodes")))
    answer = F.to_json(F.struct("changed_files", "changed_nodes", "impacted_nodes", "impacted_files", risk.alias("risk"), F.col("_k.name").alias("key_entities"), "nodes_omitted"))
    row = row.withColumn("graph_tokens", X.estimate_tokens(answer))
    row = row.withColumn("baseline_tokens", F.col("changed_tokens") + F.col("impacted_tokens")).withColumn("returned_tokens", F.col("changed_tokens") + F.col("graph_tokens"))
    model = without_graph(F.col("changed_nodes"), F.col("impacted_nodes"), F.col("impacted_files"), F.col("baseline_tokens"), depth)
    saved = lambda whole: F.greatest(F.lit(0), F.col(whole) - F.col("returned_tokens")).cast("long")
    row = row.withColumns({**model, "saved_tokens": saved("baseline_tokens")}).withColumn("counterfactual_saved", saved("total_counterfactual"))
    return row.select(
        "changed_files", "impacted_files", "changed_nodes", "impacted_nodes", "nodes_omitted", "changed_tokens", "impacted_tokens", "baseline_tokens", "graph_tokens", "returned_tokens", "saved_tokens",
        X.ratio_percent(F.col("saved_tokens"), F.col("baseline_tokens")).alias("saved_percent"), *model, "counterfactual_saved",
        X.ratio_percent(F.col("counterfactual_saved"), F.col("total_counterfactual")).alias("counterfactual_saved_percent"),
    )
