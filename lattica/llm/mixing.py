"""Mixing sources to target weights by hash-random order and exact budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.llm.common import fresh, small_batches, utf8


def _count_words(batches):
    import pyarrow as pa

    for b in batches:
        texts = b.columns[-1]
        n = [len(t.as_py().split()) for t in texts]  # bytes.split() parts at \x20 and \x09-\x0D only
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "size"])


def with_size(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` and ``size``, the words `[^\\x20\\x09-\\x0D]+` of ``text`` (null: 0)."""
    small_batches(docs.sparkSession)
    columns = [c for c in columns if c != "size"]
    picked = docs.select(*columns, utf8().alias(fresh(columns, "t")["t"]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(_count_words, f"{fields}, size long")


def source_targets(sizes: DataFrame, *, cycle: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets per source from (source, source_size): water filling under a cap.

    Sources in code point order, null last, weigh ``cycle`` again and again and
    share ``share`` times all sizes; a target stops at ``cap`` times its
    source's size and the excess goes to the others by weight until none is
    above.  That fixed point is: with sources in the order of cap by weight,
    the first k take their caps and the rest share what is left, for the
    smallest k that leaves none above.  One row per source comes in and goes out.
    """
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", F.element_at(weights, (F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle))) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(cap)).withColumn("_r", F.col("_cap") / F.col("weight"))
    everything = W.partitionBy()
    by_cap = W.orderBy("_r", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    s = (
        s.withColumn("_all", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_w", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_w"))
    )
    free = F.col("_level") <= F.col("_r")
    s = s.withColumn("_final", F.max(F.when(free, F.struct(-F.row_number().over(by_cap), F.col("_level").alias("level")))).over(everything).getField("level"))
    return s.select("source", "source_size", "weight", F.least(F.col("_cap"), F.coalesce(F.col("_final"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def random_key(seed: int, key: str = "doc_id") -> Column:
    """A hash-random order that any rerun repeats."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))


def mix(sized: DataFrame, *, seed: int = 17, key: str = "doc_id", cycle: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, prefix_digits: int = 3) -> DataFrame:
    """Add ``source_size``, ``target``, ``epochs`` and ``taken`` to rows with ``source`` and ``size``.

    Every source is put in hash-random order; whole epochs are taken while they
    fit the budget, then the last epoch is cut where the running sum meets it,
    so a source's ``taken`` sums to its target rounded down.  ``taken`` of a row
    is ``epochs * size`` plus what the cut epoch takes of it.  The order is cut
    into 16^prefix_digits key ranges per source whose sums are added up first,
    so a source that holds most rows is still many groups.  Sources of null are
    one source.  Rows that repeat a key follow one another.  A source of size 0
    takes nothing, an empty table gives no rows.  Columns of the names added here
    are replaced, all others stay.
    """
    own = ("source_size", "target", "epochs", "cut", "taken")
    sized = sized.drop(*own)
    k, p, i, o, source, part = fresh([*sized.columns, *own], "k", "p", "i", "o", "source", "part").values()
    rows = sized.withColumn(k, random_key(seed, key)).withColumn(p, F.substring(k, 1, prefix_digits))
    ranges = rows.groupBy("source", F.col(p).alias("part")).agg(F.sum("size").alias("sum"))
    sizes = ranges.groupBy("source").agg(F.sum("sum").alias("source_size"))
    targets = source_targets(sizes, cycle=cycle, share=share, cap=cap).select(F.col("source").alias(source), "source_size", "target")
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.select("source", F.col("part").alias(part), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias(o))
    meta = targets.join(offsets, F.col("source").eqNullSafe(F.col(source))).drop("source")
    inside = W.partitionBy("source", p).orderBy(k, "size").rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn(i, F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(meta, F.col("source").eqNullSafe(F.col(source)) & (F.col(p) == F.col(part)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col(o) - F.col(i))).cast("long")
    out = out.withColumn("epochs", epochs).withColumn("cut", cut)
    return out.withColumn("taken", F.col("epochs") * F.col("size") + F.col("cut")).drop(k, p, i, o, source, part)
