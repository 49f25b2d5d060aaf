"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti, Kaushik 2006), exact at any threshold.

Sets of word shingles fall into size bands.  Two sets of a band (or of two
neighbouring bands) whose Jaccard similarity reaches the threshold differ in at
most k shingles.  The shingle domain is cut by hash into n1 first-level parts.
At most k / (k2+1) of them hold more than k2 differences, so of
n1 = k / (k2+1) + 1 + spare parts at least spare+1 hold k2 or fewer.  Each part is
cut again into n2 > k2, and one of the subsets of n2-k2 of those is then free of
differences: its hash is a signature that both sets share.

A signature of no shingles says nothing, so none is given: if at most ``spare``
first-level parts of a set have such a subset, one of its spare+1 good parts has
none, and its shared signature holds shingles.  The few sets with more of them
are also compared with each other, band by band.

Before anything is signed, sets that can't link leave.  Every set asks about its
least-hashed shingles, a share of twice the differences a link allows; of two
sets that link, enough of these are the same (prefix filtering with an overlap
of more than one).  Sets whose asked shingles are not found again often enough
link with nothing, and most of a corpus never signs.

Sets that share a signature, and those that such sets share others with, are a
family.  A family is parted by the rarest shingles of its sets, of which linked
sets share one, and what is left together is compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import floor

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import chunks
from lattica.llm.common import drop_stored, fresh, id_key, release, shuffle_width, small_batches, store, text_key, trimmed, utf8
from lattica.llm.components import connected
from lattica.llm.sequences import mix, word_hashes

_U = np.uint64


@dataclass(frozen=True)
class Likeness:
    """``words`` per shingle; sets link when 100 * intersection >= percent * union.

    ``within`` is k2, the differences a first-level part may hold; ``second`` is n2.
    """

    words: int = 5
    percent: int = 80
    within: int = 1
    second: int = 2

    def spare(self, k: int) -> int:
        return 0 if k < 4 else max(2, k // (16 if self.percent >= 90 else 8))

    def top(self, low: int) -> int:
        """The largest size of the band that begins at ``low``."""
        return max(low, low * 10000 // (80 * self.percent) if self.percent < 90 else low * 5 // 4)

    def linked(self, common, a, b):
        return 100 * common >= self.percent * (a + b - common)

    def least(self, n: int) -> int:
        """Shingles that a set of ``n`` shares at least with any it links with, and the least size of those."""
        return -(-self.percent * n // 100)

    def overlap(self, n: int) -> int:
        """Asked shingles that a set of ``n`` shares with any set it links with, if that is no smaller."""
        return min(self.least(n), max(1, n - self.least(n)))

    def asked(self, n: int) -> int:
        """How many of its least-hashed shingles a set of ``n`` asks about."""
        return n - self.least(n) + self.overlap(n)

    def needed(self, n: int) -> int:
        """Asked shingles of a set of ``n`` that any linked set, which may be smaller, asks about as well."""
        return self.overlap(self.least(n))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; with fewer words the whole sequence is one, with none the set is empty."""
    h = word_hashes(text, lower=True)
    n = min(words, len(h))
    if not n:
        return h
    acc = np.zeros(len(h) - n + 1, _U)
    with np.errstate(over="ignore"):
        for i in range(n):
            acc = acc * _U(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
        return np.unique(mix(acc + _U(n)))


def packed(text: bytes) -> bytes:
    """A text as it travels: a third of what its shingles take."""
    return zstandard.compress(text, 3)


def unpacked(body, like: Likeness) -> np.ndarray:
    """The shingles of a packed text."""
    return shingles(zstandard.decompress(body.as_buffer()), like.words)


def class_of(s: np.ndarray) -> int:
    """The 64-bit name of a shingle set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def bands(like: Likeness, n: int) -> list[tuple[int, int]]:
    """(band, k) under which a set of ``n`` shingles signs: its own, and the next if a partner may lie there."""
    low, band = 1, 0
    while (high := like.top(low)) < n:
        low, band = high + 1, band + 1
    out = [(band, high)]
    if floor(100 * n / like.percent + 1e-9) > high:
        out.append((band + 1, like.top(high + 1)))
    return [(b, floor(2 * h * (100 - like.percent) / (100 + like.percent) + 1e-9)) for b, h in out]


def signatures(s: np.ndarray, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """The PartEnum signatures of a shingle set, and one more per band in which it has many empty subsets."""
    out, sparse = [], []
    for band, k in bands(like, len(s)):
        k2 = min(like.within, k)
        spare = like.spare(k)
        n1, n2 = k // (k2 + 1) + 1 + spare, max(like.second, k2 + 1)
        scattered = mix(s ^ _U(0xA5A5A5A5 + band * 7919))
        part = (scattered % _U(n1 * n2)).astype(np.int64)
        counts = np.bincount(part, minlength=n1 * n2).reshape(n1, n2)
        sums = np.zeros(n1 * n2, _U)
        with np.errstate(over="ignore"):
            np.add.at(sums, part, scattered)
            grid = mix(sums.reshape(n1, n2) + counts.astype(_U) * _U(0xC2B2AE3D27D4EB4F))
            grid = mix(grid + np.arange(n2, dtype=_U) * _U(0x165667B19E3779F9))
            where = mix(np.arange(n1, dtype=_U) + _U(band << 32))
            bare = np.zeros(n1, bool)
            for pick in combinations(range(n2), n2 - k2):
                code = _U(sum(1 << p for p in pick))
                empty = counts[:, pick].sum(axis=1) == 0
                out.append(mix(grid[:, pick].sum(axis=1, dtype=_U) + where * (code * _U(2) + _U(1)))[~empty])
                bare |= empty
        if bare.sum() > spare:
            sparse.append(mix(_U(0xB5AD4ECEDA1CE2A9) + _U(band)))
    return np.concatenate(out), np.array(sparse, _U)


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _sets(like: Likeness, name: str):
    names = [name, "n_shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, sizes = [], []
            for t in b.columns[-1]:
                s = shingles(t.as_py(), like.words)
                cls.append(class_of(s))
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(cls, pa.int64()), pa.array(sizes, pa.int64())], names=[*b.schema.names[:-1], *names])

    return run


_ASKED = "bucket int, chunk long, names boolean, keys binary, runs binary"
_FOUND = "chunk long, names boolean, keys binary, runs binary"


def _runs(counts: np.ndarray) -> bytes:
    """Small numbers, one byte each where that does; the first byte tells."""
    wide = len(counts) and int(counts.max()) > 255
    return bytes([wide]) + counts.astype(np.uint32 if wide else np.uint8).tobytes()


def _counts(runs: bytes) -> np.ndarray:
    return np.frombuffer(runs, np.uint32 if runs[0] else np.uint8, offset=1).astype(np.int64)


def _ask(like: Likeness, n: int):
    """Of every chunk, 32 bits of the asked shingles of its sets by bucket, and the sets' names once.

    Different shingles of one bucket may agree in 32 bits, which only keeps a set too many.
    """

    def run(batches):
        for chunk, table in chunks.tables(batches):
            sets: dict[int, np.ndarray] = {}
            for t in table.column("_t"):
                s = shingles(t.as_py(), like.words)
                if len(s):
                    sets.setdefault(class_of(s), s)
            if not sets:
                continue
            sizes = [len(s) for s in sets.values()]
            asked = [s[: like.asked(m)] for s, m in zip(sets.values(), sizes, strict=True)]
            yield chunks.rows(_ASKED, [chunk % n], [chunk], [True], [np.fromiter(sets, np.int64, len(sets)).tobytes()], [_runs(np.array([like.needed(m) for m in sizes]))])
            owner = np.repeat(np.arange(len(asked)), [len(x) for x in asked])
            key = mix(np.concatenate(asked) ^ _U(0x6A09E667F3BCC909))
            bucket = ((key >> _U(32)) % _U(n)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            key, owner, bucket = key[order].astype(np.uint32), owner[order], bucket[order]
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            rows = [(int(bucket[x]), key[x:y].tobytes(), _runs(np.bincount(owner[x:y], minlength=len(asked)))) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            for at in range(0, len(rows), 64):
                b, k, r = zip(*rows[at : at + 64], strict=True)
                yield chunks.rows(_ASKED, b, [chunk] * len(b), [False] * len(b), k, r)

    return run


def _found_again(batches):
    """Rows of a bucket: of every chunk, how many of the keys of each of its sets are found again; names pass."""
    for _, got in chunks.grouped(batches):
        for r in got:
            if r["names"]:
                yield chunks.rows(_FOUND, [r["chunk"]], [True], [r["keys"]], [r["runs"]])
        asks = [r for r in got if not r["names"]]
        if not asks:
            continue
        keys = [np.frombuffer(r["keys"], np.uint32) for r in asks]
        _, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        again = np.split(counts[inverse] > 1, np.cumsum([len(k) for k in keys])[:-1])
        for r, found in zip(asks, again, strict=True):
            if found.any():
                runs = _counts(r["runs"])
                owner = np.repeat(np.arange(len(runs)), runs)
                yield chunks.rows(_FOUND, [r["chunk"]], [False], [b""], [_runs(np.bincount(owner[found], minlength=len(runs)))])


def _may_link(batches):
    """Rows of a chunk: the sets of which enough keys were found again."""
    for _, got in chunks.grouped(batches, "chunk"):
        (names,) = [r for r in got if r["names"]]
        need = _counts(names["runs"])
        total = np.zeros(len(need), np.int64)
        for r in got:
            if not r["names"]:
                total += _counts(r["runs"])
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(names["keys"], np.int64)[total >= need])], names=["cls"])


def may_link(texts: DataFrame, like: Likeness) -> DataFrame:
    """The classes (cls) of texts in ``_t`` that are not ruled out from linking with another."""
    spark = texts.sparkSession
    asked = texts.select("_t").mapInArrow(trimmed(_ask(like, chunks.buckets(spark))), _ASKED)
    found = chunks.by_bucket(asked, _found_again, _FOUND)
    return found.repartition(shuffle_width(spark), "chunk").sortWithinPartitions("chunk").mapInArrow(trimmed(_may_link), "cls long").distinct()


_SIGNED = "bucket int, sigs binary, who binary, names binary, sparse boolean"


def _by_signature(sig: np.ndarray, cls: np.ndarray, sparse: bool, n: int) -> Iterator[pa.RecordBatch]:
    """One row per bucket: sorted signatures, and for each the place of its set among the names of the row."""
    bucket = chunks.bucket_of(sig, n)
    order = np.lexsort((cls, sig, bucket))
    sig, cls, bucket = sig[order], cls[order], bucket[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    out = []
    for x, y in zip(cuts, np.append(cuts[1:], len(sig)), strict=True):
        names, who = np.unique(cls[x:y], return_inverse=True)
        out.append((int(bucket[x]), sig[x:y].tobytes(), who.astype(np.uint16).tobytes(), names.tobytes(), sparse))
    yield chunks.rows(_SIGNED, *zip(*out, strict=True))


def _signed(like: Likeness, n: int):
    """Signatures by bucket.  Sets of one batch that share a signature pass it on once: the others are tied
    to the first by a signature of their own, so a signature that very many sets share stays narrow."""

    def run(batches):
        for b in batches:
            seen: dict[int, np.ndarray] = {}
            few: list[tuple[int, int]] = []
            for c, t in zip(b.column("cls").to_pylist(), b.column("body"), strict=True):
                seen[c], sparse = signatures(unpacked(t, like), like)
                few += [(int(x), c) for x in sparse.view(np.int64)]
            cls = np.repeat(np.fromiter(seen, np.int64, len(seen)), [len(v) for v in seen.values()])
            yield from _narrow(np.concatenate(list(seen.values())), cls, n)
            if few:
                more = np.array(few, np.int64)
                yield from _by_signature(more[:, 0].copy().view(_U), more[:, 1], True, n)

    return run


def _narrow(sig: np.ndarray, cls: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((cls, sig))
    sig, cls = sig[order], cls[order]
    again = np.append(False, sig[1:] == sig[:-1])
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(sig))))
    tied = np.unique(np.stack([cls[again], cls[head[again]]]), axis=1)
    tied = tied[:, tied[0] != tied[1]]
    pair = mix(tied[0].view(_U) ^ mix(tied[1].view(_U)))
    yield from _by_signature(np.concatenate([sig[~again], pair, pair]), np.concatenate([cls[~again], tied[0], tied[1]]), False, n)


def _hub_edges(batches):
    """Ties every further set of a signature to its first, bucket by bucket.

    Sets that came as sparse are passed on with their signature instead.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sparse", pa.bool_())])
    for _, got in chunks.grouped(batches):
        for sparse in (False, True):
            rows = [r for r in got if r["sparse"] == sparse]
            if not rows:
                continue
            sig = np.concatenate([np.frombuffer(r["sigs"], _U) for r in rows])
            cls = np.concatenate([np.frombuffer(r["names"], np.int64)[np.frombuffer(r["who"], np.uint16)] for r in rows])
            if sparse:
                yield _batch(schema, cls, sig.view(np.int64), np.ones(len(cls), bool))
                continue
            order = np.lexsort((cls, sig))
            sig, cls = sig[order], cls[order]
            head = np.maximum.accumulate(np.where(np.append(True, sig[1:] != sig[:-1]), np.arange(len(sig)), 0))
            keep = cls != cls[head]
            if keep.any():
                pairs = np.unique(np.stack([cls[keep], cls[head[keep]]]), axis=1)
                yield _batch(schema, pairs[0], pairs[1], np.zeros(pairs.shape[1], bool))


class _Family:
    """Sets that may link, with rows of exact comparisons."""

    def __init__(self, sets: list[np.ndarray], like: Likeness):
        self.like, self.m = like, len(sets)
        self.sizes = np.array([len(s) for s in sets])
        _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        self.items = np.split(inverse, np.cumsum(self.sizes)[:-1])
        order = np.argsort(inverse, kind="stable")
        self.owner = np.repeat(np.arange(self.m), self.sizes)[order]
        self.bounds = np.append(0, np.cumsum(np.bincount(inverse)))

    def row(self, i: int) -> np.ndarray:
        """All members that link with member ``i``."""
        it = self.items[i]
        got = np.concatenate([self.owner[a:b] for a, b in zip(self.bounds[it], self.bounds[it + 1], strict=True)])
        common = np.bincount(got, minlength=self.m)
        return np.flatnonzero(self.like.linked(common, self.sizes, self.sizes[i]))


def link_members(sets: list[np.ndarray], like: Likeness, asked=None) -> np.ndarray:
    """Component label (least position) of every set under exact links.

    A member's comparisons cover all its pairs; once all members not yet
    compared lie in one component, no pair is left that could join two.  With
    ``asked``, only those positions are compared.
    """
    fam = _Family(sets, like)
    parent, size = list(range(fam.m)), [1] * fam.m

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = sorted(range(fam.m) if asked is None else set(asked), key=lambda i: (-int(fam.sizes[i]), i))
    todo, main = set(order), None
    while pending := [x for x in order if x in todo and (asked is not None or main is None or find(x) != find(main))]:
        for i in pending:
            if asked is None and main is not None and find(i) == find(main):
                continue
            todo.discard(i)
            for j in fam.row(i):
                a, b = sorted((find(i), find(int(j))))
                if a != b:
                    parent[b] = a
                    size[a] += size[b]
            if main is None or size[find(i)] > size[find(main)]:
                main = i
    return np.array([find(x) for x in range(fam.m)])


def _labels(like: Likeness):
    """Rows sorted by family: exact components of each family that is in one task."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def emit(cls, sets):
        labels = link_members(sets, like)
        c = np.array(cls, np.int64)
        moved = labels != np.arange(len(c))
        return _batch(schema, c[moved], c[labels[moved]])

    def run(batches):
        family, cls, sets = None, [], []
        for b in batches:
            for f, c, t in zip(b.column("family").to_pylist(), b.column("cls").to_pylist(), b.column("body"), strict=True):
                if f != family and cls:
                    yield emit(cls, sets)
                    cls, sets = [], []
                family = f
                cls.append(c)
                sets.append(unpacked(t, like))
        if cls:
            yield emit(cls, sets)

    return run


def _blocks(like: Likeness):
    """Rows sorted by (family, asked block, member block): compares the asked sets of a block with a block of members."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def emit(rows):
        cls = np.array([r[0] for r in rows], np.int64)
        labels = link_members([r[1] for r in rows], like, asked=[i for i, r in enumerate(rows) if r[2]])
        moved = labels != np.arange(len(cls))
        return _batch(schema, cls[moved], cls[labels[moved]])

    def run(batches):
        key, rows = None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("family", "qb", "mb", "cls", "asked")]
            for f, q, m, c, asked, t in zip(*cols, b.column("body"), strict=True):
                if (f, q, m) != key and rows:
                    yield emit(rows)
                    rows = []
                key = (f, q, m)
                rows.append((c, unpacked(t, like), asked))
        if rows:
            yield emit(rows)

    return run


_MEMBERS = "family long, cls long, n long, body binary"


def _bodies(like: Likeness):
    """Packed texts of the classes asked for, once a task, since a row may be repeated very often."""

    def run(batches):
        seen = set()
        for b in batches:
            rows = []
            for c, t in zip(b.column("cls").to_pylist(), b.column("_t"), strict=True):
                if c in seen:
                    continue
                text = t.as_py()
                s = shingles(text, like.words)
                if class_of(s) == c:
                    seen.add(c)
                    rows.append((c, len(s), packed(text)))
            if rows:
                yield chunks.rows("cls long, n long, body binary", *zip(*rows, strict=True))

    return run


#: Counters of the sketch that orders shingles by how common they are: a bounded table, whatever the input.
SKETCH, _PARTS = 1 << 20, 64


def _sketch(members: DataFrame, like: Likeness) -> np.ndarray:
    """Counts of shingles by the low bits of their hashes, summed part by part."""

    def run(batches):
        total = np.zeros(SKETCH, np.int64)
        for b in batches:
            for t in b.column("body"):
                np.add.at(total, (unpacked(t, like) & _U(SKETCH - 1)).astype(np.int64), 1)
        yield chunks.rows("bucket int, sums binary", range(_PARTS), [p.tobytes() for p in total.reshape(_PARTS, -1)])

    def add(batches):
        for part, got in chunks.grouped(batches):
            yield chunks.rows("bucket int, sums binary", [part], [np.sum([np.frombuffer(r["sums"], np.int64) for r in got], axis=0).tobytes()])

    out = np.zeros((_PARTS, SKETCH // _PARTS), np.int64)
    for r in chunks.by_bucket(members.select("body").mapInArrow(trimmed(run), "bucket int, sums binary"), add, "bucket int, sums binary").collect():
        out[r.bucket] = np.frombuffer(r.sums, np.int64)
    return out.ravel()


def _prefixes(like: Likeness, shared, n: int):
    """The rarest m - ceil(t m) + 1 of the m shingles of every set, within its family, as signatures.

    Two sets that link share one of these, in whatever order shingles are taken.
    """

    def run(batches):
        for b in batches:
            sig, cls = [], []
            for f, c, t in zip(b.column("family").to_pylist(), b.column("cls").to_pylist(), b.column("body"), strict=True):
                s = unpacked(t, like)
                m = len(s) - like.least(len(s)) + 1
                rare = np.lexsort((s, shared.value[(s & _U(SKETCH - 1)).astype(np.int64)]))[:m]
                sig.append(mix(s[rare] ^ mix(np.array([f], np.int64).view(_U))))
                cls.append(np.full(len(rare), c))
            if sig:
                yield from _narrow(np.concatenate(sig), np.concatenate(cls), n)

    return run


def _refine(members: DataFrame, able: DataFrame, like: Likeness) -> DataFrame:
    """Members regrouped by shared rare shingles: what shares only a common passage falls apart, what links stays together."""
    spark = members.sparkSession
    shared = spark.sparkContext.broadcast(_sketch(members, like))
    signed = members.mapInArrow(trimmed(_prefixes(like, shared, chunks.buckets(spark))), _SIGNED)
    tied = chunks.by_bucket(signed, _hub_edges, "a long, b long, sparse boolean").select("a", "b").distinct()
    close = connected(tied).select(F.col("node").alias("cls"), F.col("component").alias("family"))
    return able.join(close, "cls").select("family", "cls", "n", "body").mapInArrow(_banded(like), _MEMBERS)


def _banded(like: Likeness):
    """Members of a family by the size bands they sign for: sets that link share a band, and a large family becomes many."""

    def run(batches):
        for b in batches:
            rows = [(f, c, n, t, tag) for f, c, n, t in zip(*(b.column(x).to_pylist() for x in ("family", "cls", "n", "body")), strict=True) for tag, _ in bands(like, n)]
            if rows:
                family, cls, n, body, tag = zip(*rows, strict=True)
                yield chunks.rows(_MEMBERS, mix(np.array(family, np.int64).view(_U) ^ mix(np.array(tag, np.int64).view(_U))).view(np.int64), cls, n, body)

    return run


def _verify(members: DataFrame, like: Likeness, block: int) -> DataFrame:
    """Exact link edges (a, b) that span the components of every family in (family, cls, n, body)."""
    spark, width = members.sparkSession, shuffle_width(members.sparkSession)
    sizes = members.groupBy("family").agg(F.sum("n").alias("m"), F.max(F.struct("n", "cls")).alias("hub"))
    large = store(sizes.filter(F.col("m") > block).select("family", "m", F.col("hub.cls").alias("hub")), "large")
    small = members.join(large.select("family"), "family", "left_anti")
    edges = small.repartition(width, "family").sortWithinPartitions("family", "cls").mapInArrow(trimmed(_labels(like)), "a long, b long")
    if large.isEmpty():
        return edges
    # A family beyond one task: first all against its hub, then those that miss the hub against all, block by block.
    rows = members.join(large, "family")
    hubs = rows.filter(F.col("cls") == F.col("hub")).select(F.col("family").alias("_f"), F.col("body").alias("hub_body"))
    kept = ("family", "cls", "hub", "m", "body")

    def near(batches):
        for b in batches:
            flags, last, t = [], None, None
            for x, h in zip(b.column("body"), b.column("hub_body"), strict=True):
                if last is None or not h.equals(last):
                    last, t = h, unpacked(h, like)
                s = unpacked(x, like)
                flags.append(bool(like.linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(flags)], names=[*kept, "near"])

    judged = store(rows.join(hubs, F.col("family") == F.col("_f")).select(*kept, "hub_body").mapInArrow(trimmed(near), "family long, cls long, hub long, m long, body binary, near boolean"), "near")
    edges = edges.union(judged.filter(F.col("near") & (F.col("cls") != F.col("hub"))).select(F.col("cls").alias("a"), F.col("hub").alias("b")))
    n = F.ceil(F.col("m") / F.lit(block)).cast("int")
    cut = judged.withColumn("nb", n).withColumn("mb", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    asked = cut.filter(~F.col("near")).withColumn("qb", F.col("mb"))
    asks = asked.select("family", "qb").distinct()
    against = cut.select("family", "mb", "cls", "body").join(asks, "family").withColumn("asked", F.lit(False))
    queries = asked.withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("asked", F.lit(True))
    both = queries.select("family", "qb", "mb", "cls", "body", "asked").union(against.select("family", "qb", "mb", "cls", "body", "asked"))
    found = both.repartition(width, "family", "qb", "mb").sortWithinPartitions("family", "qb", "mb").mapInArrow(trimmed(_blocks(like)), "a long, b long")
    return edges.union(found)


def jaccard_components(docs: DataFrame, like: Likeness, *columns: str, block: int = 3_000_000, group: str | None = None) -> DataFrame:
    """(doc_id, ``columns``, n_shingles, component_id) of every document.

    Links are exact and no link between different sets is lost; component_id is
    the least doc_id reachable by links, the document's own included.  Null and
    empty texts have no shingles and link with nothing.  Documents with equal
    sets are one class from the start.  Repeated rows each get a row.  A family
    of sets that may link is compared in one task up to ``block`` shingles, and
    block by block beyond.  ``group`` names a further column, which tells
    components apart where their documents share ids or have none; it is null
    without shingles.  Columns of the names
    returned are replaced, others of any name may be kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    columns = tuple(c for c in columns if c not in ("doc_id", "n_shingles", "component_id", group))
    # Helper columns have names that no kept column has.
    cls, key, body, least_ = fresh(columns, "cls", "key", "body", "least").values()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns, text_key().alias(key), utf8().alias(body))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name in columns)
    known = store(texts.mapInArrow(_sets(like, cls), f"doc_id long, {kept}`{key}` long, `{cls}` long, n_shingles long"), "sets")
    sets = known.select(id_key().alias("_k"), F.col(key).alias("_h"), "doc_id", "n_shingles", F.col(cls).alias("cls")).filter("n_shingles > 0")
    classes = store(sets.groupBy("cls").agg(F.min(F.struct("_k", "_h")).alias("one"), F.min("doc_id").alias("least")), "classes")
    bare = texts.select(id_key().alias("_k"), F.col(key).alias("_h"), F.col(body).alias("_t"))
    wanted = store(may_link(bare, like).join(classes, "cls").select("cls", "one.*"), "wanted")
    # What is wanted grows with the corpus, so it is never broadcast.
    able = store(bare.join(wanted.hint("merge"), ["_k", "_h"]).select("cls", "_t").mapInArrow(trimmed(_bodies(like)), "cls long, n long, body binary"), "able", compression="none")
    drop_stored(wanted)
    signed = able.mapInArrow(trimmed(_signed(like, chunks.buckets(spark))), _SIGNED)
    tied = store(chunks.by_bucket(signed, _hub_edges, "a long, b long, sparse boolean").distinct(), "hubs")
    families = connected(tied.filter(~F.col("sparse")).select("a", "b")).select(F.col("node").alias("cls"), F.col("component").alias("family"))
    sparse = tied.filter("sparse").select(F.col("a").alias("cls"), F.col("b").alias("family"))
    members = store(families.union(sparse).join(able, "cls").select("family", "cls", "n", "body"), "members", compression="none")
    drop_stored(tied)
    close = store(_refine(members, able, like), "close", compression="none")
    drop_stored(members)
    drop_stored(able)
    links = connected(_verify(close, like, block))
    drop_stored(close)
    release(spark)
    # By class, so that a class or component of very many rows is one row here; each join is of two stored tables,
    # whose partitions are split where a key is hot.
    joined = store(links.withColumnRenamed("node", "cls").join(classes, "cls").select("cls", "component", "least"), "linked")
    lowest = store(joined.groupBy("component").agg(F.min("least").alias("least")), "lowest")
    linked = store(joined.drop("least").join(lowest, "component"), "linked")
    alone = classes.join(linked.select("cls"), "cls", "left_anti").select(F.col("cls").alias("component"), "cls", "least")
    placed = store(linked.select("component", "cls", "least").union(alone).select(F.col("cls").alias(cls), F.col("component").alias(body), F.col("least").alias(least_)), "placed")
    for used in (joined, lowest, linked, classes):
        drop_stored(used)
    out = known.join(placed.hint("merge"), cls, "left")
    has = F.col("n_shingles") > 0
    own = F.when(has, F.coalesce(least_, "doc_id")).otherwise(F.col("doc_id"))
    more = [F.when(has, F.col(body)).alias(group)] if group else []
    return out.select("doc_id", *columns, "n_shingles", own.alias("component_id"), *more)
