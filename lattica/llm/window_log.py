"""Incremental removal of repeated word windows over a log-structured fingerprint index.

A batch of chunks becomes one immutable run: for every bucket the sorted
fingerprints of its windows' anchors, and whether each was seen twice.  A new
run is merge-joined with the runs before it, bucket by bucket; runs of a level
are compacted into one of the next level when enough have gathered.  A
fingerprint that recurs is only a hint: the windows that name it are then
compared by two hashes of their words, 128 bits together, before a word is
removed.  A log that outlives a call keeps these of all windows as runs of the
same kind, and the windows of later calls are merge-joined with them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import chunks
from lattica.llm.common import drop_stored, release, store
from lattica.llm.sequences import SECOND, anchors, distinct, merge_spans, prefix_sums, windows_hash, word_hashes, word_spans

_U = np.uint64
RUN = "bucket int, keys binary, many binary"


def merge_runs(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of several (keys, counts) pairs, which of them have counts of two or more together, and which each part's keys are, end to end."""
    keys, _, inverse, _ = distinct(np.concatenate([k for k, _ in parts]))
    total = np.bincount(inverse, np.concatenate([m for _, m in parts]), minlength=len(keys))
    return keys, total > 1, inverse


def _pair(row, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(row["keys"], _U)
    return keys.reshape(-1, 2) if wide else keys, np.frombuffer(row["many"], np.uint8)


def _as_run(wide: bool):
    def run(batches):
        """Rows of a bucket (asks of chunks, or rows of runs) as one row of a run."""
        for bucket, got in chunks.grouped(batches):
            keys, many, _ = merge_runs([_pair(r, wide) for r in got])
            yield chunks.rows(RUN, [bucket], [keys.tobytes()], [(1 + many.astype(np.uint8)).tobytes()])

    return run


def _merge_join(batches):
    """Rows of a bucket, the new run first: the keys of it that an older run has."""
    for bucket, got in chunks.grouped(batches):
        new = [r for r in got if r["age"] == 0]
        old = [r for r in got if r["age"] > 0]
        if not new:
            continue
        keys, many = _pair(new[0])
        found = many > 1
        for r in old:
            past, _ = _pair(r)
            at = np.searchsorted(past, keys)
            at[at == len(past)] = 0
            found = found | ((past[at] == keys) if len(past) else False)
        yield chunks.rows("bucket int, keys binary", [bucket], [keys[found].tobytes()])


def _flag(batches):
    """Rows of a bucket, keys found again first, then what chunks ask: 1 for keys among the former."""
    for bucket, got in chunks.grouped(batches):
        found = [np.frombuffer(r["keys"], _U) for r in got if r["chunk"] is None]
        asks = [r for r in got if r["chunk"] is not None]
        if not asks:
            continue
        again = np.unique(np.concatenate(found)) if found else np.zeros(0, _U)
        out = []
        for r in asks:
            k = np.frombuffer(r["keys"], _U)
            at = np.searchsorted(again, k)
            at[at == len(again)] = 0
            out.append(((again[at] == k) if len(again) else np.zeros(len(k), bool)).astype(np.uint8).tobytes())
        yield chunks.rows(chunks.ANSWERS, [bucket] * len(asks), [r["chunk"] for r in asks], out)


def _verdict(wide: bool):
    def run(batches):
        """Rows of a bucket, those of older runs first, then what chunks ask: 1 for keys that the asks hold twice or an older run has."""
        for bucket, got in chunks.grouped(batches):
            asks = [r for r in got if r["chunk"] is not None]
            if not asks:
                continue
            pairs = [_pair(r, wide) for r in asks]
            keys, many, place = merge_runs(pairs)
            for r in got:
                if r["chunk"] is None:
                    # Both are sets, so what comes twice in them together is in both.
                    _, _, inverse, counts = distinct(np.concatenate([keys, _pair(r, wide)[0]]))
                    many = many | (counts[inverse[: len(keys)]] > 1)
            out = np.split(many[place].astype(np.uint8), np.cumsum([len(k) for k, _ in pairs])[:-1])
            yield chunks.rows(chunks.ANSWERS, [bucket] * len(asks), [r["chunk"] for r in asks], [v.tobytes() for v in out])

    return run


@dataclass
class FingerprintLog:
    """Runs by level, all in the shared folder; ``fan_in`` runs of a level are compacted into the next.

    ``windows`` is the log of the windows themselves, whose keys are ``wide``
    (two hashes), and ``shape`` the (width, gram, buckets) that all calls share.
    """

    fan_in: int = 2
    levels: list[list[DataFrame]] = field(default_factory=list)
    windows: FingerprintLog | None = None
    shape: tuple[int, int, int] | None = None
    wide: bool = False

    def fix(self, width: int, gram: int, n: int) -> int:
        """The number of buckets, which the first call sets; other windows than the log's are refused."""
        self.shape = self.shape or (width, gram, n)
        if self.shape[:2] != (width, gram):
            raise ValueError(f"the log holds windows of {self.shape[0]} words by grams of {self.shape[1]}")
        return self.shape[2]

    @property
    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, asks: DataFrame) -> DataFrame:
        """Write a batch's asks as a run."""
        rows = asks.select("bucket", "keys", F.col("extra").alias("many"))
        run = store(chunks.by_bucket(rows, _as_run(self.wide), RUN), "run")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        return run

    def append(self, asks: DataFrame) -> DataFrame:
        """Write a batch's asks as a run; its (bucket, keys) that recur in the batch or in older runs."""
        older = self.runs
        run = self.add(asks)
        both = run.withColumn("age", F.lit(0))
        for i, r in enumerate(older):
            both = both.union(r.withColumn("age", F.lit(i + 1)))
        return chunks.by_bucket(both, _merge_join, "bucket int, keys binary", "age")

    def compact(self) -> None:
        """Merge full levels; the runs they came from are deleted once the merged one is written."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fan_in:
                old = self.levels[level]
                rows = old[0]
                for r in old[1:]:
                    rows = rows.union(r)
                merged = store(chunks.by_bucket(rows, _as_run(self.wide), RUN), "run")
                self.levels[level] = []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)
                for r in old:
                    drop_stored(r)
            level += 1

    def verdicts(self, asks: DataFrame) -> DataFrame:
        """Answers to asks that are not in the log: which of their keys are found twice in them or once in an older run."""
        rows = asks.select("bucket", "chunk", "keys", F.col("extra").alias("many"))
        for r in self.runs:
            rows = rows.unionByName(r.withColumn("chunk", F.lit(None).cast("long")))
        return chunks.by_bucket(rows, _verdict(self.wide), chunks.ANSWERS, "chunk")


def flagged(asks: DataFrame, found: list[DataFrame]) -> DataFrame:
    """Answers to asks: which of their keys the merge-joins of the batches found."""
    rows = asks.select("bucket", "chunk", "keys")
    for f in found:
        rows = rows.unionByName(f.withColumn("chunk", F.lit(None).cast("long")))
    return chunks.by_bucket(rows, _flag, chunks.ANSWERS, "chunk")


def _anchor_keys(width: int, gram: int):
    def keys(table, got):
        found = [anchors(word_hashes(t.as_py()), width, gram)[0] for t in table.column("_t")]
        return np.concatenate(found) if found else np.zeros(0, _U)

    return keys


def candidate_windows(table, got: dict, width: int, gram: int, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of every document: the windows whose anchors recur, and their keys."""
    words = [word_hashes(t.as_py()) for t in table.column("_t")]
    found = [anchors(w, width, gram) for w in words]
    q = chunks.Question(np.concatenate([f[0] for f in found]) if found else np.zeros(0, _U), n)
    flags = np.split(q.answers(got).astype(bool), np.cumsum([len(f[0]) for f in found])[:-1])
    out = []
    for t, w, (_, _, first, last), flag in zip(table.column("_t"), words, found, flags, strict=True):
        first, last = first[flag], last[flag]
        at = np.repeat(first - np.append(0, np.cumsum(last - first + 1)[:-1]), last - first + 1) + np.arange((last - first + 1).sum())
        out.append((at, window_keys(t.as_py(), w, width)[at] if len(at) else np.zeros((0, 2), _U)))
    return out


def window_keys(text: bytes, words: np.ndarray, width: int) -> np.ndarray:
    """Two hashes of every window of a text, whose word hashes are given; the second is made of the text anew, by another base."""
    return np.stack([windows_hash(prefix_sums(words), width), windows_hash(prefix_sums(word_hashes(text, base=SECOND), SECOND), width, SECOND)], axis=1)


def _every_window(width: int):
    def keys(table, got):
        out = [window_keys(t.as_py(), word_hashes(t.as_py()), width) for t in table.column("_t")]
        return np.concatenate(out) if out else np.zeros((0, 2), _U)

    return keys


def _candidate_keys(width: int, gram: int, n: int):
    def keys(table, got):
        out = [k for _, k in candidate_windows(table, got, width, gram, n)]
        return np.concatenate(out) if out else np.zeros((0, 2), _U)

    return keys


def repeated_spans(table, got: dict, verified: dict, width: int, gram: int, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of every document: the maximal runs of words that a repeated window covers."""
    parts = candidate_windows(table, got, width, gram, n)
    q = chunks.Question(np.concatenate([k for _, k in parts]) if parts else np.zeros((0, 2), _U), n)
    flags = np.split(q.answers(verified).astype(bool), np.cumsum([len(at) for at, _ in parts])[:-1])
    return [merge_spans(at[f], at[f] + width) for (at, _), f in zip(parts, flags, strict=True)]


def kept_words(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    """(words, words in the spans, the other words joined by one space)."""
    words = text.split()
    out, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        out += words[at:a]
        at = b
    return len(words), int((ends - starts).sum()), b" ".join(out + words[at:])


def remove_repeated_windows(docs: DataFrame, *, width: int = 35, gram: int = 18, batches: int = 3, fan_in: int = 2, log: FingerprintLog | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document, ``kept`` the remaining words joined by one space.

    A word goes if a window of ``width`` words covers it whose sequence also
    starts anywhere else, in this document or another, or in a document of an
    earlier call with the same ``log``.  Chunks enter the index in ``batches``,
    and a given log also takes the hashes of all windows; without one no later
    call can ask for them.  Null and empty texts have no words; texts shorter than a window lose none; repeated rows repeat
    each other and so lose what a window covers.  An empty table gives no rows; of the columns of ``docs`` only doc_id is
    kept, so clashing names cannot matter.
    """
    spark = docs.sparkSession
    lasting = log is not None
    log = log or FingerprintLog(fan_in)
    n = log.fix(width, gram, chunks.buckets(spark))
    log.windows = log.windows or FingerprintLog(log.fan_in, wide=True)
    packed = chunks.pack(docs, "doc_id")
    asks = store(chunks.ask(packed, _anchor_keys(width, gram), n), "asks")
    found = []
    for b in range(batches):
        new = asks.filter(F.pmod(F.xxhash64("chunk"), F.lit(batches)) == b)
        found.append(store(log.append(new), "found"))
        log.compact()
    # A key that comes twice is found by the join of the batch in which it comes again.
    hints = store(flagged(asks, found), "hints")
    for used in (asks, *found, *([] if lasting else log.runs)):
        drop_stored(used)
    told = chunks.tell(packed, hints)
    asked = chunks.ask(told, _candidate_keys(width, gram, n), n)
    verified = store(log.windows.verdicts(asked), "verified")
    if lasting:
        log.windows.add(chunks.ask(packed, _every_window(width), n))
        log.windows.compact()
    release(spark)

    def digest(batches):
        for b in batches:
            for blob, got, sure in zip(b.column("blob"), b.column("got").to_pylist(), b.column("sure").to_pylist(), strict=True):
                table = chunks.decode(blob.as_py())
                spans = repeated_spans(table, chunks._by_bucket(got), chunks._by_bucket(sure), width, gram, n)
                kept = [kept_words(t.as_py(), *s) for t, s in zip(table.column("_t"), spans, strict=True)]
                yield chunks.rows("doc_id long, n_words long, n_removed long, kept binary", table.column("c0").to_pylist(), *zip(*kept, strict=True))

    both = chunks.tell(told, verified, "sure")
    return both.select("blob", "got", "sure").mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept binary")


def digest_of(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
