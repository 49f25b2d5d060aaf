"""Rank fusion, bounded results, budgets and ordered deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.plans.materialise import settle

Order = Sequence[str | Column]


def rrf_merge(lists: Sequence[DataFrame], k: int = 60) -> DataFrame:
    """(item, score) by reciprocal rank fusion of lists of (item, rank from 0)."""
    rows = lists[0].select("item", "rank")
    for more in lists[1:]:
        rows = rows.union(more.select("item", "rank"))
    return rows.groupBy("item").agg(F.sum(1.0 / (F.lit(k) + F.col("rank") + 1)).alias("score"))


def ranked(rows: DataFrame, order: Order, item: str) -> DataFrame:
    """(item, rank from 0); for lists that were already cut to their best."""
    return rows.select(F.col(item).alias("item"), (F.row_number().over(W.orderBy(*order)) - 1).alias("rank"))


def federated_rank(rows: DataFrame, order: Order, limit: int = 100) -> DataFrame:
    """Merge of per-repository results by local rank, then by the order of repositories (repo_index)."""
    local = rows.withColumn("local_rank", F.row_number().over(W.partitionBy("repo_index").orderBy(*order)))
    local = local.filter(F.col("local_rank") <= limit)  # cut in every task before a repository's rows meet
    return local.orderBy("local_rank", "repo_index").limit(limit)


def bounded(rows: DataFrame, order: Order, asked: int, ceiling: int) -> DataFrame:
    """At most min(asked, ceiling) rows, each with the number of all and whether any were left out."""
    most = min(asked, ceiling)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > most)


def sentinel_limit(rows: DataFrame, order: Order, limit: int) -> DataFrame:
    """At most ``limit`` rows and whether there are more, from one row beyond them: nothing is counted."""
    held = rows.orderBy(*order).limit(limit + 1)
    place = F.row_number().over(W.orderBy(*order))
    return held.withColumns({"_r": place, "_all": F.count(F.lit(1)).over(W.partitionBy())}).filter(F.col("_r") <= limit).withColumn("truncated", F.col("_all") > limit).drop("_r", "_all")


def top_k_per_group(rows: DataFrame, group: Sequence[str], order: Order, k: int) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("position") <= k)


def token_budget_prefix(rows: DataFrame, order: Order, tokens: Column, budget: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows in order while the running sum of tokens stays in the budget.

    Without groups the rows are dealt by ranges of the order, and only the
    ranges' sums pass through one task.
    """
    w = lambda *key: W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    if by:
        return rows.withColumn("used", F.sum(tokens).over(w(*by))).filter(F.col("used") <= budget)
    dealt = settle(rows.withColumn("_t", tokens).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum("_t").alias("_sum"))
    bases = sums.select("_range", F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    out = dealt.join(bases, "_range").withColumn("used", F.col("_base") + F.sum("_t").over(w("_range")))
    return out.filter(F.col("used") <= budget).select(*rows.columns, "used")


def ordered_dedupe(rows: DataFrame, key: Sequence[str], order: Order) -> DataFrame:
    """The first row of every key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def set_difference(after: DataFrame, before: DataFrame) -> DataFrame:
    return after.subtract(before)


def stale(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    return stored.join(current.select(key), key, "left_anti")
