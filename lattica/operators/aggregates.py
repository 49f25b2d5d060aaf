"""Counts, degrees, risk, coupling and summaries over the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.functions import text as X
from lattica.graph import Graph


def graph_stats(g: Graph) -> DataFrame:
    """(metric, key, n): totals, nodes by kind, edges by kind, files by language."""
    kind = F.when(X.is_hdl(F.col("extra")), "Signal").otherwise(F.col("kind"))
    one = lambda rows, metric, key: rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(metric).alias("metric"), "key", "n")
    total = lambda rows, metric: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), "n")
    files = g.nodes.filter(F.col("kind") == "File")
    return (
        total(g.nodes, "nodes").union(total(g.edges, "edges")).union(total(files, "files"))
        .union(one(g.nodes, "nodes_by_kind", kind)).union(one(g.edges, "edges_by_kind", F.col("kind")))
        .union(one(files.filter(F.col("language").isNotNull()), "languages", F.col("language")))
    )


def degrees(g: Graph) -> DataFrame:
    """(qualified_name, in_degree, out_degree, degree) of every end of an edge, with or without a node; call sites count each."""
    ends = g.edges.select(F.col("source_qualified").alias("qualified_name"), F.lit(0).alias("_i"), F.lit(1).alias("_o")).union(g.edges.select("target_qualified", F.lit(1), F.lit(0)))
    out = ends.groupBy("qualified_name").agg(F.sum("_i").alias("in_degree"), F.sum("_o").alias("out_degree"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def hub_nodes(g: Graph, top: int = 10) -> DataFrame:
    nodes = g.nodes.filter(F.col("kind") != "File").select("qualified_name", "name", "kind", "file_path")
    return degrees(g).join(nodes, "qualified_name").orderBy(F.desc("degree"), "qualified_name").limit(top)


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """One row: the element at n // 2 of the sorted values, by counting equal values first."""
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("_c", F.sum("n").over(W.orderBy("v"))).withColumn("_all", F.sum("n").over(W.partitionBy()))
    return upto.filter(F.col("_c") > F.floor(F.col("_all") / 2)).agg(F.min("v").alias("median"))


def _communities(g: Graph) -> DataFrame:
    if g.communities is None:
        raise ValueError("this operator needs communities")
    return g.communities.select("qualified_name", "community_id")


def isolated_nodes(g: Graph, limit: int = 50) -> DataFrame:
    nodes = g.nodes.filter(F.col("kind") != "File").select("qualified_name", "kind", "file_path")
    out = nodes.join(degrees(g).select("qualified_name", "degree"), "qualified_name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return out.filter("degree <= 1").orderBy("qualified_name").limit(limit)


def thin_communities(g: Graph, least: int = 3) -> DataFrame:
    return _communities(g).groupBy("community_id").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") < least)


def untested_hotspots(g: Graph, least: int = 5, limit: int = 20) -> DataFrame:
    tested = g.edges.filter(F.col("kind") == "TESTED_BY").select(F.col("source_qualified").alias("qualified_name"))
    nodes = g.nodes.filter((F.col("kind") != "File") & ~F.col("is_test")).select("qualified_name", "kind", "file_path")
    hot = nodes.join(degrees(g).filter(F.col("degree") >= least).select("qualified_name", "degree"), "qualified_name")
    return hot.join(tested, "qualified_name", "left_anti").orderBy(F.desc("degree"), "qualified_name").limit(limit)


def single_file_communities(g: Graph, least: int = 3) -> DataFrame:
    members = _communities(g).join(g.nodes.select("qualified_name", "file_path"), "qualified_name")
    sizes = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("file_path").alias("files"), F.min("file_path").alias("file_path"))
    return sizes.filter((F.col("files") == 1) & (F.col("size") >= least)).select("community_id", "size", "file_path")


def _with_ends(g: Graph, columns: tuple[str, ...], nodes: DataFrame) -> DataFrame:
    """Edges with columns of both end nodes, as source_* and target_*."""
    side = lambda end: nodes.select(F.col("qualified_name").alias(f"{end}_qualified"), *(F.col(c).alias(f"{end}_{c}") for c in columns))
    return g.edges.join(side("source"), "source_qualified").join(side("target"), "target_qualified")


def surprising_edges(g: Graph, top: int = 15) -> DataFrame:
    """Edges by how unexpected they are: across communities, languages, degrees or the test boundary."""
    nodes = g.nodes.filter(F.col("kind") != "File").select("qualified_name", F.col("kind").alias("node_kind"), "file_path", "is_test")
    deg = degrees(g).select("qualified_name", "degree")
    nodes = nodes.join(_communities(g), "qualified_name", "left").join(deg, "qualified_name", "left").withColumn("ext", X.extension(F.col("file_path")))
    bound = upper_median(deg, "degree").select(F.greatest(F.col("median") * 3, F.lit(10)).alias("_high"))
    e = _with_ends(g, ("node_kind", "is_test", "community_id", "degree", "ext"), nodes).crossJoin(F.broadcast(bound))
    score = lambda test, points: F.when(test, F.lit(points)).otherwise(F.lit(0.0))
    cross = F.coalesce(F.col("source_community_id") != F.col("target_community_id"), F.lit(False))
    langs = (F.col("source_ext") != "") & (F.col("target_ext") != "") & (F.col("source_ext") != F.col("target_ext"))
    rim = ((F.col("source_degree") <= 2) & (F.col("target_degree") >= F.col("_high"))) | ((F.col("target_degree") <= 2) & (F.col("source_degree") >= F.col("_high")))
    tests = (F.col("source_is_test") != F.col("target_is_test")) & (F.col("kind") == "CALLS")
    odd = (F.col("kind") == "CALLS") & (F.col("source_node_kind") == "Type")
    named = ((cross, "cross-community"), (langs, "cross-language"), (rim, "peripheral-to-hub"), (tests, "cross-test-boundary"), (odd, "unusual-edge-kind"))
    e = e.withColumn("surprise", score(cross, 0.3) + score(langs, 0.2) + score(rim, 0.2) + score(tests, 0.15) + score(odd, 0.15))
    e = e.withColumn("reasons", F.filter(F.array(*(F.when(t, F.lit(n)) for t, n in named)), lambda r: r.isNotNull()))
    out = e.filter("surprise > 0").select("source_qualified", "target_qualified", "kind", "line", "surprise", "reasons")
    return out.orderBy(F.desc("surprise"), "source_qualified", "target_qualified", "kind", "line").limit(top)


def _edge_communities(g: Graph) -> DataFrame:
    c = _communities(g)
    side = lambda end: c.select(F.col("qualified_name").alias(f"{end}_qualified"), F.col("community_id").alias(f"{end}_community"))
    return g.edges.join(side("source"), "source_qualified", "left").join(side("target"), "target_qualified", "left")


def community_cohesion(g: Graph) -> DataFrame:
    """Edges inside a community over all that touch it, 0 without any, in one pass over the edges."""
    a, b = F.col("source_community"), F.col("target_community")
    pairs = _edge_communities(g).groupBy(a, b).agg(F.count(F.lit(1)).alias("_n"))
    ends = F.when(a == b, F.array(F.struct(a.alias("community_id"), F.col("_n").alias("_in"), F.lit(0).cast("long").alias("_out"))))
    ends = F.coalesce(ends, F.array(*(F.struct(c.alias("community_id"), F.lit(0).cast("long").alias("_in"), F.col("_n").alias("_out")) for c in (a, b))))
    sums = pairs.select(F.explode(ends).alias("_e")).select("_e.*").filter("community_id is not null").groupBy("community_id").agg(F.sum("_in").alias("internal"), F.sum("_out").alias("external"))
    every = _communities(g).select("community_id").distinct().join(sums, "community_id", "left").na.fill(0, ["internal", "external"])
    whole = F.col("internal") + F.col("external")
    return every.withColumn("cohesion", F.when(whole > 0, F.col("internal") / whole).otherwise(F.lit(0.0)))


def cross_community(g: Graph, warn_above: int = 10, names: DataFrame | None = None) -> DataFrame:
    """Edges, but for tests, between two communities, with a flag where they are many.

    With ``names`` (community_id, name) pairs with a community of tests are never flagged.
    """
    e = _edge_communities(g).filter((F.col("kind") != "TESTED_BY") & (F.col("source_community") != F.col("target_community")))
    pair = e.groupBy(F.least("source_community", "target_community").alias("community_a"), F.greatest("source_community", "target_community").alias("community_b")).agg(F.count(F.lit(1)).alias("edges"))
    if names is None:
        return pair.withColumn("coupled", F.col("edges") > warn_above)
    tests = names.filter(X.is_test_community(F.col("name"))).select("community_id").distinct()
    side = lambda end: tests.select(F.col("community_id").alias(f"community_{end}"), F.lit(True).alias(f"_{end}"))
    marked = pair.join(side("a"), "community_a", "left").join(side("b"), "community_b", "left")
    real = F.col("_a").isNull() & F.col("_b").isNull()
    return marked.select("community_a", "community_b", "edges", ((F.col("edges") > warn_above) & real).alias("coupled"))


def cross_community_kinds(g: Graph, top: int = 3) -> DataFrame:
    """Per pair of communities, the edges and the most frequent kinds."""
    e = _edge_communities(g).filter((F.col("kind") != "TESTED_BY") & (F.col("source_community") != F.col("target_community")))
    by_kind = e.groupBy(F.least("source_community", "target_community").alias("community_a"), F.greatest("source_community", "target_community").alias("community_b"), "kind").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("community_a", "community_b")
    ranked = by_kind.withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "kind"))).withColumn("edges", F.sum("n").over(w))
    return ranked.filter(F.col("_r") <= top).select("community_a", "community_b", "edges", "kind", "n")


def community_sizes(g: Graph) -> DataFrame:
    """Members, distinct files and the dominant language of each community; ties go to the first by name."""
    m = _communities(g).join(g.nodes.select("qualified_name", "file_path", "language"), "qualified_name")
    langs = m.filter(F.col("language").isNotNull()).groupBy("community_id", "language").agg(F.count(F.lit(1)).alias("n"))
    top = langs.withColumn("_r", F.row_number().over(W.partitionBy("community_id").orderBy(F.desc("n"), "language"))).filter("_r = 1").select("community_id", F.col("language").alias("dominant_language"))
    return m.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("file_path").alias("files")).join(top, "community_id", "left")


def file_symbols(g: Graph) -> DataFrame:
    return g.nodes.filter(F.col("kind") != "File").groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols"))


def file_edges(g: Graph) -> DataFrame:
    """Directed weights between files, by the files of both end nodes."""
    e = _with_ends(g, ("file",), g.nodes.select("qualified_name", F.col("file_path").alias("file")))
    return e.filter(F.col("source_file") != F.col("target_file")).groupBy("source_file", "target_file").agg(F.count(F.lit(1)).alias("weight"))


def community_graph(g: Graph) -> DataFrame:
    """Undirected weights between communities; nodes without one are in -1."""
    n = g.nodes.filter(F.col("kind") != "File").select("qualified_name").join(_communities(g), "qualified_name", "left").select("qualified_name", F.coalesce("community_id", F.lit(-1)).alias("community"))
    e = _with_ends(g, ("community",), n).filter(F.col("source_community") != F.col("target_community"))
    return e.groupBy(F.least("source_community", "target_community").alias("community_a"), F.greatest("source_community", "target_community").alias("community_b")).agg(F.count(F.lit(1)).alias("weight"))


def community_summaries(g: Graph, top: int = 5, files: int = 20) -> DataFrame:
    """Per community: its best connected symbols, and as purpose the last directory that its first files share."""
    members = _communities(g).join(g.nodes.select("qualified_name", "name", "file_path"), "qualified_name")
    ranked = members.join(degrees(g).select("qualified_name", "degree"), "qualified_name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    w = W.partitionBy("community_id").orderBy(F.desc("degree"), "qualified_name")
    best = ranked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top)
    symbols = best.groupBy("community_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "name"))), lambda s: s["name"]).alias("key_symbols"))
    paths = members.select("community_id", "file_path").distinct().withColumn("_r", F.row_number().over(W.partitionBy("community_id").orderBy("file_path"))).filter(F.col("_r") <= files)
    ends = paths.groupBy("community_id").agg(F.split(F.min("file_path"), "/").alias("a"), F.split(F.max("file_path"), "/").alias("b"))
    # What the least and the greatest path share, all between them share.
    same = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b")) - 1), lambda i: F.slice("a", 1, i) == F.slice("b", 1, i)), lambda x: x))
    purpose = F.when(same > 0, F.element_at("a", same)).otherwise("")
    return symbols.join(ends.select("community_id", purpose.alias("purpose")), "community_id")


def risk_index(g: Graph) -> DataFrame:
    """A static risk of functions, classes and tests from callers, tests and names."""
    callers = g.edges.filter(F.col("kind") == "CALLS").groupBy(F.col("target_qualified").alias("qualified_name")).agg(F.count(F.lit(1)).alias("caller_count"))
    tests = g.edges.filter(F.col("kind") == "TESTED_BY").groupBy(F.col("source_qualified").alias("qualified_name")).agg(F.count(F.lit(1)).alias("_t"))
    n = g.nodes.filter(F.col("kind").isin("Function", "Class", "Test")).select("qualified_name", "name")
    n = n.join(callers, "qualified_name", "left").join(tests, "qualified_name", "left").na.fill(0, ["caller_count", "_t"])
    sec = X.is_risk_index_name(F.col("name"))
    untested = F.col("_t") == 0
    risk = F.when(F.col("caller_count") > 10, 0.3).when(F.col("caller_count") > 3, 0.15).otherwise(0.0) + F.when(untested, 0.3).otherwise(0.0) + F.when(sec, 0.4).otherwise(0.0)
    return n.select("qualified_name", F.least(risk, F.lit(1.0)).alias("risk_score"), "caller_count", F.when(untested, "untested").otherwise("tested").alias("test_coverage"), sec.cast("int").alias("security_relevant"))


def affected_community_count(g: Graph, files: DataFrame) -> DataFrame:
    hit = g.nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").join(_communities(g), "qualified_name")
    return hit.agg(F.countDistinct("community_id").alias("n"))


def name_uniqueness(g: Graph) -> DataFrame:
    return g.nodes.filter(F.col("kind").isin("Function", "Class") & ~F.col("is_test")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def file_churn(commits: DataFrame, until: Column, days: int = 90) -> DataFrame:
    """Changes per file in the ``days`` before ``until``, from rows (file_path, ts)."""
    recent = (F.col("ts") <= until) & (F.col("ts") > until - F.expr(f"interval {days} days"))
    return commits.filter(recent).groupBy("file_path").agg(F.count(F.lit(1)).alias("commits"))


def savings_summary(entries: DataFrame) -> DataFrame:
    """(dimension, key, runs, baseline, returned, saved): totals, and by day, tool and repo, as grouping sets."""
    rows = entries.select(F.substring(F.col("ts").cast("string"), 1, 10).alias("day"), "tool", "repo", "baseline_tokens", "returned_tokens", "saved_tokens")
    out = rows.groupingSets([[], ["day"], ["tool"], ["repo"]], "day", "tool", "repo").agg(F.count(F.lit(1)).alias("runs"), F.sum("baseline_tokens").alias("baseline"), F.sum("returned_tokens").alias("returned"), F.sum("saved_tokens").alias("saved"), F.grouping("day").alias("_d"), F.grouping("tool").alias("_t"), F.grouping("repo").alias("_r"))
    kind = F.when(F.col("_d") == 0, "day").when(F.col("_t") == 0, "tool").when(F.col("_r") == 0, "repo").otherwise("total")
    key = F.when(F.col("_d") == 0, F.col("day")).when(F.col("_t") == 0, F.col("tool")).when(F.col("_r") == 0, F.col("repo")).otherwise("")
    return out.select(kind.alias("dimension"), key.alias("key"), "runs", "baseline", "returned", "saved")


def precision_recall(predicted: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """One row of precision, recall and F1 of distinct keys; 0 where a side is empty."""
    p, a = predicted.select(key).distinct(), actual.select(key).distinct()
    n = p.agg(F.count(F.lit(1)).alias("predicted")).crossJoin(a.agg(F.count(F.lit(1)).alias("actual"))).crossJoin(p.join(a, key, "left_semi").agg(F.count(F.lit(1)).alias("hits")))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
    n = n.withColumn("precision", share("hits", "predicted")).withColumn("recall", share("hits", "actual"))
    both = F.col("precision") + F.col("recall")
    return n.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def mean_reciprocal_rank(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """Mean over queries of 1 / rank of the first wanted item; results are (query, item, rank from 1)."""
    first = results.join(wanted.select("query", "item").distinct(), ["query", "item"], "left_semi").groupBy("query").agg(F.min("rank").alias("rank"))
    every = wanted.select("query").distinct().join(first, "query", "left")
    return every.agg(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def token_efficiency(rows: DataFrame) -> DataFrame:
    """Per row of (raw_tokens, graph_tokens): their ratio and the share saved, 0 where a side is empty."""
    ok = (F.col("raw_tokens") > 0) & (F.col("graph_tokens") > 0)
    return rows.withColumn("ratio", F.when(ok, F.col("raw_tokens") / F.col("graph_tokens")).otherwise(F.lit(0.0))).withColumn("reduction", F.when(ok, 1 - F.col("graph_tokens") / F.col("raw_tokens")).otherwise(F.lit(0.0)))


def bench_aggregate(rows: DataFrame) -> DataFrame:
    """Per mode: runs that went well, failed or were skipped, and the mean value of those that went well."""
    is_ = lambda s: F.when(F.col("status") == s, 1).otherwise(0)
    return rows.groupBy("mode").agg(F.sum(is_("ok")).alias("ok"), F.sum(is_("error")).alias("errors"), F.sum(is_("skipped")).alias("skipped"), F.avg(F.when(F.col("status") == "ok", F.col("value"))).alias("mean"))
