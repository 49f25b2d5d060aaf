"""Change streams: file versions arrive, are debounced, and update the stored graph batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.plans import maintenance
from lattica.plans.ledger import GraphStore


def debounce(events: DataFrame, gap: str = "1 second") -> DataFrame:
    """(file_path, start, end, n): bursts of changes of a path with no pause longer than ``gap``."""
    s = F.session_window("ts", gap)
    return events.groupBy("file_path", s.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("file_path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, event_type, n) of windows of event time; on a stream ``late`` is the watermark."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def last_events(changes: DataFrame) -> DataFrame:
    """One row per path, its last by ``seq`` where there is one: a move counts as the old path's end (``moved_from``) and the new one's change."""
    seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
    rows = changes.withColumn("_s", seq)
    if "moved_from" in changes.columns:
        ends = rows.filter("moved_from is not null").withColumn("file_path", F.col("moved_from")).withColumn("deleted", F.lit(True))
        # at one moment a path's end comes before what takes its place
        rows = rows.withColumn("_o", F.lit(1)).unionByName(ends.withColumn("_o", F.lit(0))).drop("moved_from")
    else:
        rows = rows.withColumn("_o", F.lit(1))
    last = rows.groupBy("file_path").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("file_path", "_s", "_o")]), F.struct("_s", "_o")).alias("r"))
    return last.select("file_path", "r.*")


def apply_batch(graph: GraphStore, changes: DataFrame, parse: maintenance.Parser, epoch: int | None = None, name: str = "watch", passes=maintenance.PASSES) -> DataFrame | None:
    """One update by rows (file_path, deleted, content, ...): changed files are parsed and replaced, deleted ones go with all that touches them.

    The number of a stream's batch is stored in the same commit, so one that
    is repeated after a failure changes nothing (None).  Work follows the
    batch: nothing is reconciled, only buckets that change are written.
    """
    key = f"batch:{name}"
    if epoch is not None and (done := graph.get(key)) is not None and int(done) >= epoch:
        return None
    rows = last_events(changes if "content" in changes.columns else changes.withColumn("content", F.lit(None).cast("string")))
    there = rows.filter(~F.coalesce("deleted", F.lit(False))).withColumn("content", F.coalesce("content", F.lit("")))
    return maintenance.incremental_update(graph, there, parse, rows.select("file_path"), passes=passes, reconcile=False, hops=0, note=None if epoch is None else {key: str(epoch)})


def watch(changes: DataFrame, graph: GraphStore, parse: maintenance.Parser, checkpoint: str, every: str | None = "1 second", name: str = "watch", passes=maintenance.PASSES) -> StreamingQuery:
    """Apply a stream of changes, or with ``every`` None what has arrived by now."""

    def one(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                apply_batch(graph, batch, parse, epoch, name, passes)
        finally:
            batch.unpersist()

    writer = changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
