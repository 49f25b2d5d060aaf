"""A corpus packed into chunks, and questions that chunks ask about keys of the whole corpus.

Shuffling a row for every key of every document costs many times the input.
Here a chunk (some megabytes of whole texts, compressed) asks about each of its
distinct keys once: keys are dealt to buckets by hash, a bucket sees the keys of
all chunks and answers each chunk with one value per key, in order.  A key that
a third of all documents hold arrives once per chunk, not once per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import shuffle_width, small_batches, store, trimmed, utf8
from lattica.llm.sequences import distinct, mix, prefix_sums, spans_hash

_U = np.uint64
ASKS = "bucket int, chunk long, keys binary, extra binary"
ANSWERS = "bucket int, chunk long, answer binary"


def encode(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def decode(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def rows(schema: str | pa.Schema, *columns) -> pa.RecordBatch:
    """A batch of the columns of a DDL-like schema of long, int, double, string and binary fields."""
    if isinstance(schema, str):
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def tables(batches: Iterable[pa.RecordBatch], limit: int = 4_000_000, most: int = 2000) -> Iterator[tuple[int, pa.Table]]:
    """Whole rows in numbered tables of about ``limit`` bytes of text and ``most`` rows; a longer text is one alone."""
    from pyspark import TaskContext

    task = TaskContext.get()
    base, count = (task.partitionId() if task else 0) << 32, 0
    held, size, n = [], 0, 0
    for b in batches:
        start = 0
        for i, t in enumerate(b.column("_t")):
            m = t.as_buffer().size if t.is_valid else 0
            if n and (size + m > limit or n >= most):
                yield base | count, pa.Table.from_batches([*held, b.slice(start, i - start)])
                held, size, n, start, count = [], 0, 0, i, count + 1
            size += m
            n += 1
        if start < b.num_rows:
            held.append(b.slice(start))
    if n:
        yield base | count, pa.Table.from_batches(held)


def _pack(limit: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in tables(batches, limit, most):
            yield rows("chunk long, blob binary", [chunk], [encode(table.combine_chunks().to_batches()[0])])

    return run


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` as c0, c1, ... and ``_t``, the UTF-8 text (null: empty), in small batches."""
    small_batches(docs.sparkSession)
    return docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), utf8().alias("_t"))


def pack(docs: DataFrame, *columns: str, limit: int = 4_000_000, most: int = 2000) -> DataFrame:
    """(chunk, blob) rows in the shared folder; a blob holds ``columns`` as c0, c1, ... and ``_t``, the UTF-8 text (null: empty).

    The table is written once, so every later pass sees the same chunks.
    """
    return store(texts(docs, *columns).mapInArrow(_pack(limit, most), "chunk long, blob binary"), "chunks", compression="none")


def buckets(spark) -> int:
    return 4 * shuffle_width(spark)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys ^ _U(0x51ED270B)) % _U(n)).astype(np.int32)


class Question:
    """The distinct keys of a chunk in bucket order, and where each asked key is among them.

    A key is a value of 64 bits, or a row of two of them, of which the first deals it.
    ``route``, one value per key and equal for equal keys, deals keys to buckets
    in place of the keys themselves.  ``first`` is where a distinct key came first.
    """

    def __init__(self, keys: np.ndarray, n: int, route: np.ndarray | None = None):
        keys = keys.astype(_U, copy=False)
        unique, first, inverse, counts = distinct(keys)
        bucket = bucket_of((unique if unique.ndim == 1 else unique[:, 0]) if route is None else route[first], n)
        order = np.argsort(bucket, kind="stable")
        self.keys, self.counts, self.bucket, self.first = unique[order], np.minimum(counts[order], 255).astype(np.uint8), bucket[order], first[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.place = place[inverse]
        self.cuts = np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1])) if len(order) else np.zeros(0, np.int64)

    def parts(self) -> Iterable[tuple[int, slice]]:
        for a, b in zip(self.cuts, np.append(self.cuts[1:], len(self.keys))[: len(self.cuts)], strict=True):
            yield int(self.bucket[a]), slice(a, b)

    def answers(self, got: dict[int, bytes], width: int = 1) -> np.ndarray:
        """The answer to every asked key, from the answers by bucket: a byte, or a row of ``width`` bytes."""
        every = [np.frombuffer(got[b], np.uint8) for b, _ in self.parts()]
        flat = np.concatenate(every) if every else np.zeros(0, np.uint8)
        return (flat.reshape(-1, width) if width > 1 else flat)[self.place]


class Words:
    """The tokens of a chunk's texts as places in its list of distinct words, which is in bucket order.

    ``data`` is all texts end to end, with ``starts`` and ``ends`` of the tokens
    and ``lengths``, the tokens of each text.  Words are told apart by 64 bits
    of content hash.
    """

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray, lengths: np.ndarray, n: int):
        raw, keys, i = np.frombuffer(data, np.uint8), np.empty(len(starts), _U), 0
        while i < len(starts):  # some hundred kB at a time, so that sums stay small
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 18), "right")))
            keys[i:j] = spans_hash(prefix_sums(raw[starts[i] : ends[j - 1]] + _U(1)), starts[i:j] - starts[i], ends[i:j] - starts[i])
            i = j
        q = Question(keys, n)
        self.codes, self.lengths, self.bucket, self.parts = q.place, lengths, q.bucket, q.parts
        self.words = [data[a:b] for a, b in zip(starts[q.first].tolist(), ends[q.first].tolist(), strict=True)]

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """Sum of a value of each word over the tokens of each text."""
        owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        return np.bincount(owner, per_word[self.codes], len(self.lengths))


def ask(chunked: DataFrame, keys_of: Callable[..., np.ndarray], n: int) -> DataFrame:
    """Ask rows of every chunk: sorted distinct keys per bucket; ``extra`` has how often the chunk holds each, 255 at most.

    ``keys_of`` takes a chunk's table and its gathered answers (null where there are none).
    """

    def run(batches):
        for b in batches:
            for chunk, blob, got in zip(b.column("chunk").to_pylist(), b.column("blob"), b.column("got").to_pylist(), strict=True):
                q = Question(keys_of(decode(blob.as_py()), _by_bucket(got)), n)
                out = [(k, chunk, q.keys[s].tobytes(), q.counts[s].tobytes()) for k, s in q.parts()]
                if out:
                    yield rows(ASKS, *zip(*out, strict=True))

    frame = chunked if "got" in chunked.columns else chunked.withColumn("got", F.lit(None).cast("array<struct<bucket:int,answer:binary>>"))
    return frame.select("chunk", "blob", "got").mapInArrow(run, ASKS)


def _by_bucket(got) -> dict[int, bytes]:
    return {g["bucket"]: g["answer"] for g in got or ()}


def by_bucket(frame: DataFrame, run, schema: str, *order: str) -> DataFrame:
    """Apply ``run`` to rows that come bucket by bucket."""
    return frame.repartition(buckets(frame.sparkSession), "bucket").sortWithinPartitions("bucket", *order).mapInArrow(trimmed(run), schema)


def grouped(batches: Iterator[pa.RecordBatch], key: str = "bucket") -> Iterator[tuple[int, list[dict]]]:
    """Rows of one bucket at a time, from rows sorted by bucket."""
    now, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if held and r[key] != now:
                yield now, held
                held = []
            now = r[key]
            held.append(r)
    if held:
        yield now, held


def repeated_keys(hot: int = 0):
    """Answers each asked key: 0 if one chunk holds it once, 1 if it is found again, 2 if ``hot`` times or more."""

    def run(batches):
        for bucket, asks in grouped(batches):
            keys = [np.frombuffer(a["keys"], _U) for a in asks]
            weight = [np.frombuffer(a["extra"], np.uint8) for a in asks]
            unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, np.concatenate(weight))
            verdict = (total > 1).astype(np.uint8)
            if hot:
                verdict[total >= hot] = 2
            every = np.split(verdict[inverse], np.cumsum([len(k) for k in keys])[:-1])
            yield rows(ANSWERS, [bucket] * len(asks), [a["chunk"] for a in asks], [v.tobytes() for v in every])

    return run


def tell(chunked: DataFrame, answers: DataFrame, name: str = "got") -> DataFrame:
    """Each chunk with all answers to it."""
    gathered = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias(name))
    return chunked.join(gathered, "chunk", "left")
