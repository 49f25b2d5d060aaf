"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside composite keys, where null would not join.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and all runs on one machine."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = f"file://{tempfile.mkdtemp(prefix='lattica-')}"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/lattica/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    The files are committed once, so stages after it neither repeat the work
    before it nor lose rows when an executor goes; the shuffle files before it
    are free to be removed.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    release(spark)
    return out


def store_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """``store``, dealt into files by ``key``: a join on it moves the other side only.

    The table's entry in the catalogue goes at once; its files stay, as those of any table with a path of its own.
    """
    spark = df.sparkSession
    path, table = work_path(spark, name), f"lattica_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "none").option("path", path).bucketBy(shuffle_width(spark), key).saveAsTable(table)
    out = spark.table(table)
    out.stored_at = path
    spark.sql(f"DROP TABLE {table}")
    release(spark)
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table whose rows nothing needs any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_stored(df: DataFrame) -> None:
    """Delete what ``store`` wrote for ``df``."""
    path = getattr(df, "stored_at", None)
    if path:
        drop_path(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that are out of use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trimmed(run):
    """``run`` for mapInArrow, whose freed memory goes back to the system when a task ends, since workers live on."""

    def held(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: nothing to give back by hand
            pass

    return held


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Bound the rows and bytes of an Arrow batch, so that long texts and chunks fit a Python worker's memory."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key).removesuffix("b"))
        if now > most or now <= 0:
            spark.conf.set(key, str(most))


@contextlib.contextmanager
def session(spark: SparkSession, settings: dict[str, object]):
    """Settings that hold for what runs inside, and are as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def utf8(col: str = "text") -> Column:
    """A text's UTF-8 bytes, empty for null."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def text_key(col: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")))


def id_key(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def fresh(taken, *names: str) -> dict[str, str]:
    """For each helper name one that no column in ``taken`` has, whatever its letter case."""
    used, out = {c.lower() for c in taken if c}, {}
    for name in names:
        made = f"_{name}"
        while made.lower() in used:
            made += "_"
        used.add(made.lower())
        out[name] = made
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
