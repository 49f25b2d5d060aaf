"""Removal of repeated byte strings by suffix arrays of the places where texts may agree.

Every string of ``length`` bytes names an anchor gram in it by content alone, so
two equal strings name equal anchors at one offset.  Anchors that occur once in
the corpus are done with.  Around each other anchor lies a context: all strings
that name it.  The contexts of an anchor, aligned at it and cut into blocks, form
one text whose suffix array (linear grouping construction) and common prefixes
tell how many blocks each context shares with any other from each block on.
That settles the strings inside shared blocks and rules out those whose whole
blocks are not shared; the strings at the rims are compared in full.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import chunks
from lattica.llm.common import release, store
from lattica.llm.sequences import anchors, merge_spans, mix, prefix_sums, spans_hash, windows_hash
from lattica.llm.suffix_array import common_prefixes, suffix_array

_U = np.uint64
#: Bytes of a block of a context.
BLOCK = 50
#: Contexts that one suffix array covers, unless one anchor has more.
AT_ONCE = 3000


class Contexts:
    """A chunk's anchors that recur, as the distinct contexts it asks about, and its strings under hot anchors."""

    def __init__(self, table, got: dict, length: int, gram: int, n: int):
        self.texts = [np.frombuffer(t.as_py(), np.uint8) for t in table.column("_t")]
        found = [anchors(t + _U(1), length, gram) for t in self.texts]
        flags = chunks.Question(np.concatenate([f[0] for f in found]) if found else np.zeros(0, _U), n).answers(got)
        parts = np.split(flags, np.cumsum([len(f[0]) for f in found])[:-1])
        warm, hot = [], []
        keys, hot_keys = [], []
        with np.errstate(over="ignore"):
            for d, (f, flag) in enumerate(zip(found, parts, strict=True)):
                if not flag.any():
                    continue
                sums = prefix_sums(self.texts[d] + _U(1))
                fp, at, first, last = (x[flag == 1] for x in f)
                ends = last + length
                keys.append(mix(fp ^ mix(spans_hash(sums, first, ends) + (at - first).astype(_U))))
                warm.append((np.full(len(fp), d), fp, at - first, first, ends))
                if (flag == 2).any():
                    _, _, first, last = (x[flag == 2] for x in f)
                    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
                    hot_keys.append(windows_hash(sums, length)[starts])
                    hot.append((np.full(len(starts), d), starts))
        self.doc, self.fp, self.lead, self.start, self.end = (np.concatenate(c) for c in zip(*warm, strict=True)) if warm else (np.zeros(0, np.int64), np.zeros(0, _U), *[np.zeros(0, np.int64)] * 3)
        self.question = chunks.Question(np.concatenate(keys) if keys else np.zeros(0, _U), n, self.fp)
        self.hot_doc, self.hot_start = (np.concatenate(c) for c in zip(*hot, strict=True)) if hot else [np.zeros(0, np.int64)] * 2
        self.hot_question = chunks.Question(np.concatenate(hot_keys) if hot_keys else np.zeros(0, _U), n)

    def asks(self, chunk: int):
        """Rows of (bucket, chunk, kind, keys, extra): contexts are kind 0, hot strings kind 1."""
        q = self.question
        for k, s in q.parts():
            at = q.first[s]
            text = [self.texts[d][a:b].tobytes() for d, a, b in zip(self.doc[at], self.start[at], self.end[at], strict=True)]
            batch = chunks.rows("lead long, text binary", self.lead[at], text)
            batch = batch.append_column("fp", pa.array(self.fp[at])).append_column("key", pa.array(q.keys[s])).append_column("many", pa.array(q.counts[s]))
            yield k, chunk, 0, chunks.encode(batch), b""
        h = self.hot_question
        for k, s in h.parts():
            yield k, chunk, 1, h.keys[s].tobytes(), h.counts[s].tobytes()


def _bits(length: int, gram: int) -> int:
    """Bytes of a bitmap of the strings of a context."""
    return (length - gram + 1 + 7) // 8


def exact_codes(key: np.ndarray, rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Numbers that are equal for equal rows of bytes, and only for these.

    ``key`` is equal for equal rows; ``rows`` gives the bytes of some.  Every row
    is compared with the first of its key, and numbered apart where it differs.
    """
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    codes, others = inverse.astype(np.int64), {}
    at = np.flatnonzero(first[inverse] != np.arange(len(key)))
    for a in range(0, len(at), 1 << 16):
        part = at[a : a + (1 << 16)]
        for i in part[(rows(part) != rows(first[inverse[part]])).any(axis=1)]:  # another row of the same hash
            codes[i] = len(first) + others.setdefault(rows(np.array([i])).tobytes(), len(others))
    return codes


def _paired(*parts: np.ndarray) -> np.ndarray:
    """One number for each combination of small numbers."""
    out = np.zeros(len(parts[0]), np.int64)
    for p in parts:
        _, p = np.unique(p, return_inverse=True)
        _, out = np.unique(out * (p.max(initial=0) + 1) + p, return_inverse=True)
    return out


def shared_blocks(names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the suffix array over contexts as sequences of block names, each closed by a separator of its own:

    for every symbol the symbols it shares with another suffix from there on and its place in the array,
    the common prefixes along the array, and which symbols are blocks.  Names of different groups or
    places differ, so only aligned contexts of one anchor ever agree.
    """
    lengths = np.array([len(x) for x in names])
    _, rank = np.unique(np.concatenate(names), return_inverse=True)
    # Separators 1.. are all different and below every block, 0 ends the text.
    at = np.cumsum(lengths + 1)
    text = np.empty(at[-1] + 1, np.int64)
    inside = np.ones(at[-1] + 1, bool)
    inside[at - 1] = False
    inside[-1] = False
    text[inside] = rank + len(names) + 1
    text[at - 1] = np.arange(1, len(names) + 1)
    text[-1] = 0
    s = text.tolist()
    sa = suffix_array(s)
    lcp = np.array([*common_prefixes(s, sa), 0])
    place = np.empty(len(s), np.int64)
    place[np.array(sa)] = np.arange(len(s))
    return np.maximum(lcp[:-1], lcp[1:])[place], place, lcp, inside


def repeated_in_group(group: np.ndarray, lead: np.ndarray, texts: list[bytes], length: int) -> list[np.ndarray]:
    """Of every context, which of its strings another context of its group holds at the same offset.

    The suffix array decides wherever the blocks that hold a string are shared
    (found again) or those inside it are not (found nowhere else).  Strings of
    one interval of the array, which share all whole blocks but may differ in
    the rim of less than a block at either end, are told apart by the rim's bytes.
    """
    sizes = np.array([len(t) for t in texts])
    base = np.append(0, np.cumsum(sizes)[:-1])
    data = np.frombuffer(b"".join(texts), np.uint8)
    sums = prefix_sums(data + _U(1))
    lo = -(lead // BLOCK)  # first whole block, counted from the anchor
    hi = (sizes - lead) // BLOCK  # one after the last
    blocks = np.maximum(hi - lo, 0)
    owner = np.repeat(np.arange(len(texts)), blocks)
    block = np.arange(len(owner)) - np.repeat(np.append(0, np.cumsum(blocks)[:-1]), blocks) + lo[owner]
    starts = base[owner] + lead[owner] + block * BLOCK
    span = np.arange(BLOCK)
    with np.errstate(over="ignore"):
        content = exact_codes(spans_hash(sums, starts, starts + BLOCK), lambda i: data[starts[i][:, None] + span])
    name = _paired(group[owner], block, content)
    run, place, lcp, _ = shared_blocks(np.split(name, np.cumsum(blocks)[:-1]))
    number = sizes - length + 1
    who = np.repeat(np.arange(len(texts)), number)
    j = np.arange(len(who)) - np.repeat(np.append(0, np.cumsum(number)[:-1]), number)
    offset = j - lead[who]
    first, stop = -(-offset // BLOCK), (offset + length) // BLOCK  # whole blocks inside the string
    origin = np.append(0, np.cumsum(blocks + 1)[:-1])  # each context is its blocks and a separator

    def symbol(b):
        return origin[who] + np.clip(b - lo[who], 0, blocks[who])

    open_ = run[symbol(first)] >= stop - first
    outer, past = offset // BLOCK, -(-(offset + length) // BLOCK)  # blocks that hold the string
    settled = open_ & (outer >= lo[who]) & (past <= hi[who]) & (run[symbol(np.maximum(outer, lo[who]))] >= past - outer)
    # An interval of suffixes that share all whole blocks of a string is named by where it begins.
    interval = np.full(len(who), -1)
    for m in np.unique((stop - first)[open_]):
        begins = np.maximum.accumulate(np.where(lcp[:-1] < m, np.arange(len(lcp) - 1), 0))
        of = open_ & (stop - first == m)
        interval[of] = begins[place[symbol(first)[of]]] * BLOCK + offset[of] % BLOCK
    unsure = np.unique(interval[open_ & ~settled])
    at = np.flatnonzero(open_ & np.isin(interval, unsure))
    if not len(at):
        return np.split(settled, np.cumsum(number)[:-1])
    begin = base[who[at]] + j[at]
    front = (first[at] * BLOCK - offset[at])[:, None]
    rim = np.arange(2 * BLOCK)[None, :]

    def rims(i):
        """The bytes before the first and after the last whole block, as many as there are."""
        tail = (length - (stop[at[i]] - first[at[i]]) * BLOCK)[:, None] - front[i]
        from_ = begin[i][:, None]
        here = np.where(rim < front[i], from_ + rim, from_ + length - tail + rim - front[i])
        real = rim < front[i] + tail
        return np.where(real, data[np.where(real, here, 0)], 0)

    with np.errstate(over="ignore"):
        key = mix(spans_hash(sums, begin, begin + length) ^ mix(interval[at].astype(_U)))
    same = _paired(interval[at], exact_codes(key, rims))
    hit = settled
    hit[at] |= np.bincount(same)[same] > 1
    return np.split(hit, np.cumsum(number)[:-1])


def _resolve(length: int, gram: int):
    width = _bits(length, gram)

    def groups(rows_):
        """Distinct contexts of a bucket, whole anchors at a time: (entry numbers, fp, lead, texts)."""
        tables = [chunks.decode(r["keys"]) for r in rows_]
        table = pa.concat_tables(tables)
        fp, many = table.column("fp").to_numpy(), table.column("many").to_numpy()
        text = table.column("text").combine_chunks().dictionary_encode().indices.to_numpy()
        _, first, inverse = np.unique(_paired(fp, table.column("lead").to_numpy(), text), return_index=True, return_inverse=True)
        total = np.bincount(inverse, many)
        order = np.argsort(fp[first], kind="stable")
        return table, inverse, first[order], order, total, [len(t) for t in tables]

    def solve(rows_):
        table, inverse, first, order, total, sizes = groups(rows_)
        fp, lead = table.column("fp").to_numpy()[first], table.column("lead").to_numpy()[first]
        texts = table.column("text").take(pa.array(first)).to_pylist()
        bits = np.zeros((len(first), width), np.uint8)
        new = np.append(True, fp[1:] != fp[:-1])
        cut = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        alone = np.bincount(group)[group] == 1
        start = 0
        while start < len(first):  # whole groups, AT_ONCE contexts or one group
            more = cut[(cut > start) & (cut <= start + AT_ONCE)]
            stop = len(first) if start + AT_ONCE >= len(first) else int(more[-1]) if len(more) else int(next(iter(cut[cut > start]), len(first)))
            pick = start + np.flatnonzero(~alone[start:stop])
            if len(pick):
                found = repeated_in_group(group[pick], lead[pick], [texts[i] for i in pick], length)
                for i, hit in zip(pick, found, strict=True):
                    packed = np.packbits(hit)
                    bits[i, : len(packed)] = packed
            start = stop
        bits[total[order] > 1] = 255
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        every = bits[back][inverse]
        return np.split(every, np.cumsum(sizes)[:-1])

    def run(batches):
        for bucket, got in chunks.grouped(batches):
            contexts = [r for r in got if r["kind"] == 0]
            if contexts:
                answers = solve(contexts)
                yield chunks.rows("bucket int, chunk long, kind int, answer binary", [bucket] * len(contexts), [r["chunk"] for r in contexts], [0] * len(contexts), [a.tobytes() for a in answers])
            hot = [r for r in got if r["kind"] == 1]
            if hot:
                (answer,) = chunks.repeated_keys()(iter([chunks.rows(chunks.ASKS, [bucket] * len(hot), [r["chunk"] for r in hot], [r["keys"] for r in hot], [r["extra"] for r in hot])]))
                yield chunks.rows("bucket int, chunk long, kind int, answer binary", [bucket] * len(hot), [r["chunk"] for r in hot], [1] * len(hot), answer.column("answer"))

    return run


def cut(text: bytes, starts: np.ndarray, ends: np.ndarray, whole_chars: bool = False) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, remaining bytes); with ``whole_chars`` a run keeps the characters it would split."""
    out, at, gone, runs = [], 0, 0, 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if whole_chars:
            while a < b and text[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
                b -= 1
        if a < b:
            out.append(text[at:a])
            at, gone, runs = b, gone + b - a, runs + 1
    return gone, runs, b"".join([*out, text[at:]])


def remove_repeated_bytes(docs: DataFrame, *columns: str, length: int = 400, gram: int = 64, hot: int = 4000, whole_chars: bool = False) -> DataFrame:
    """``columns`` with n_bytes, n_removed, n_spans and kept, the remaining bytes, of every document.

    A byte goes if a string of ``length`` bytes covers it that also starts
    anywhere else, in this document or another.  Strings never cross documents
    and are judged on the input.  Null and empty texts have no bytes, texts
    below ``length`` lose none, repeated rows repeat each other.  Anchors found
    ``hot`` times or more are not gathered: their strings are dealt out and
    counted one by one, which gives the same result.  Columns of the names
    added here are replaced.
    """
    spark = docs.sparkSession
    n = chunks.buckets(spark)
    kept = [f for f in docs.schema.fields if f.name in columns and f.name not in ("n_bytes", "n_removed", "n_spans", "kept")]
    packed = chunks.pack(docs, *(f.name for f in kept))

    def anchor_keys(table, got):
        found = [anchors(np.frombuffer(t.as_py(), np.uint8) + _U(1), length, gram)[0] for t in table.column("_t")]
        return np.concatenate(found) if found else np.zeros(0, _U)

    hints = store(chunks.by_bucket(chunks.ask(packed, anchor_keys, n), chunks.repeated_keys(hot), chunks.ANSWERS), "hints")
    told = chunks.tell(packed, hints)

    def ask_contexts(batches):
        for b in batches:
            for chunk, blob, got in zip(b.column("chunk").to_pylist(), b.column("blob"), b.column("got").to_pylist(), strict=True):
                for r in Contexts(chunks.decode(blob.as_py()), chunks._by_bucket(got), length, gram, n).asks(chunk):
                    yield chunks.rows("bucket int, chunk long, kind int, keys binary, extra binary", *([v] for v in r))

    asked = told.select("chunk", "blob", "got").mapInArrow(ask_contexts, "bucket int, chunk long, kind int, keys binary, extra binary")
    solved = store(chunks.by_bucket(asked, _resolve(length, gram), "bucket int, chunk long, kind int, answer binary"), "repeats")
    release(spark)
    width = _bits(length, gram)
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_bytes long", "n_removed long", "n_spans long", "kept binary"])

    def finish(batches):
        for b in batches:
            for blob, got, warm, hot_ in zip(b.column("blob"), *(b.column(c).to_pylist() for c in ("got", "warm", "hot")), strict=True):
                table = chunks.decode(blob.as_py())
                c = Contexts(table, chunks._by_bucket(got), length, gram, n)
                bits = np.unpackbits(c.question.answers(chunks._by_bucket(warm), width), axis=-1).astype(bool)
                bits &= np.arange(bits.shape[1]) < (c.end - c.start - length + 1)[:, None]
                row, j = np.nonzero(bits)
                flags = c.hot_question.answers(chunks._by_bucket(hot_)).astype(bool)
                doc = np.concatenate([c.doc[row], c.hot_doc[flags]])
                start = np.concatenate([c.start[row] + j, c.hot_start[flags]])
                order = np.argsort(doc, kind="stable")
                doc, start = doc[order], start[order]
                bounds = np.searchsorted(doc, np.arange(len(c.texts) + 1))
                found = []
                for d, t in enumerate(table.column("_t")):
                    s = start[bounds[d] : bounds[d + 1]]
                    raw = t.as_py()
                    found.append((len(raw), *cut(raw, *merge_spans(s, s + length), whole_chars)))
                body = chunks.rows("n_bytes long, n_removed long, n_spans long, kept binary", *zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in table.columns[:-1]), *body.columns], names=[*(f.name for f in kept), *body.schema.names])

    both = chunks.tell(told, solved.filter("kind = 0"), "warm")
    both = chunks.tell(both, solved.filter("kind = 1"), "hot")
    return both.select("blob", "got", "warm", "hot").mapInArrow(finish, out_schema)
