"""Weighted rendezvous sharding with built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.llm.common import fresh

#: Parts that rows without a key are dealt into.
_DEALT = 1024
#: Width of the hash that becomes a uniform number: 13 hex digits, exact in a double.
_HEX, _SPAN = 13, float(2**52)


def _score(key: Column, shard: Column, weight: Column) -> Column:
    """-weight / ln(u), u uniform in (0, 1) and fixed by key and shard."""
    digest = F.md5(F.concat(key, F.lit(":"), shard.cast("string")))
    u = (F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("long").cast("double") + 0.5) / F.lit(_SPAN)
    return -weight / F.log(u)


def _scored(key: Column, shards: Sequence[tuple[int, float]]) -> Column:
    """The (score, shard) of highest score among some shards for a record key."""
    k = F.coalesce(key.cast("string"), F.lit(""))
    return F.array_max(F.array(*(F.struct(_score(k, F.lit(i), F.lit(w)).alias("score"), F.lit(i).alias("shard")) for i, w in shards)))


def _alive(weights: Sequence[float], first: int = 0) -> list[tuple[int, float]]:
    return [(i, float(w)) for i, w in enumerate(weights) if i >= first and w > 0]


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of highest weighted score for a record key.

    A shard that is added with some weight takes its share of the keys from all
    others and moves no other key; a shard that is removed (weight 0) hands out
    only its own keys.  Ties go to the higher shard number.  A null key counts
    as the empty key, so all null keys share a shard.
    """
    if not _alive(weights):
        raise ValueError("at least one shard needs a positive weight")
    return _scored(key, _alive(weights)).getField("shard")


def shard(docs: DataFrame, weights: Sequence[float], *, key: str = "doc_id", grown: Sequence[float] | None = None, prefix_digits: int = 3) -> DataFrame:
    """Add ``shard``, ``slot`` and ``grown_shard`` to rows keyed by ``key``; columns of these names are replaced, all others stay.

    ``slot`` numbers the rows of a shard from 0 without gaps, by hash of the key
    and the key: each shard is cut into 16^prefix_digits ranges of the hash that
    are numbered apart and offset by the counts before them, so no task ever
    holds a whole shard.  Rows without a key come last in their range and are
    dealt further by a hash of what they hold.  Rows that repeat a key share a
    shard and get slots of their own; an empty table gives no rows.
    """
    if not _alive(weights):
        raise ValueError("at least one shard needs a positive weight")
    docs = docs.drop("shard", "slot", "grown_shard")
    best, k, b, o, r = fresh([*docs.columns, "shard", "slot", "grown_shard"], "best", "k", "b", "o", "r").values()
    own = F.col(key)
    out = docs.withColumn(best, _scored(own, _alive(weights))).withColumn("shard", F.col(f"{best}.shard"))
    if grown and list(grown[: len(weights)]) == list(weights):  # the old shards' best is known: only new ones are scored
        new = _alive(grown, len(weights))
        moved = F.greatest(F.col(best), _scored(own, new)).getField("shard") if new else F.col("shard")
    else:
        moved = rendezvous(own, grown) if grown else F.lit(None).cast("int")
    out = out.withColumn("grown_shard", moved).drop(best)
    out = out.withColumn(k, F.md5(F.concat(F.lit("slot"), F.coalesce(own.cast("string"), F.lit("")))))
    rest = F.pmod(F.xxhash64(*(c for c in docs.columns if c != key), F.lit(0)), F.lit(_DEALT)).cast("string")
    part = F.when(own.isNull(), F.concat(F.lit("~"), F.lpad(rest, 4, "0"))).otherwise(F.lit(""))
    out = out.withColumn(b, F.concat(F.substring(k, 1, prefix_digits), part))
    before = W.partitionBy("shard").orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    offsets = out.groupBy("shard", b).agg(F.count(F.lit(1)).alias(o)).select("shard", b, F.coalesce(F.sum(o).over(before), F.lit(0)).alias(o))
    ranked = out.withColumn(r, F.row_number().over(W.partitionBy("shard", b).orderBy(k, own)).cast("long"))
    # Both sides are dealt by (shard, range) already, so the join moves no row.
    return ranked.join(offsets, ["shard", b]).withColumn("slot", F.col(o) + F.col(r) - 1).select(*docs.columns, "shard", "slot", "grown_shard")
