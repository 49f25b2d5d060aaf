"""SentencePiece encoding by a relational lattice, and decoding.

Texts are cut where no piece goes on: between two characters that stand side by
side in no piece.  The distinct words between the cuts are exploded into
substrings of bounded length, joined to the piece table, grouped again by word,
and the best path is folded with Spark's higher-order ``aggregate``.  Documents
are kept as sequences of places in their chunk's list of distinct words, so that
a word's ids travel once per chunk and no token is ever a row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import chunks
from lattica.llm.common import drop_path, drop_stored, release, session, store, store_by, trimmed, work_path

_U = np.uint64
SPACE = "▁"
#: Words of more characters are folded outside the lattice: an array fold copies its state at each step.
LONG = 64
#: Bytes of text in a chunk.
CHUNK = 6_000_000
#: Words in a part of a bucket's list.
_PART = 20_000
#: Bits of the tables that tell where words may be cut.
_BITS = 22


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with ids and scores; ``byte_ids`` are those of the 256 byte pieces, if there are any."""

    pieces: tuple[str, ...]
    ids: tuple[int, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    unknown: int

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @property
    def unknown_score(self) -> float:
        """What a character without a piece costs: 10 below the least score."""
        return min(self.scores, default=0.0) - 10.0


def load_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    names = tuple(sp.id_to_piece(i) for i in plain)
    if any(SPACE in p.lstrip(SPACE) for p in names):
        raise ValueError("a piece has a space after another character, so words can't be encoded apart")
    bytes_ = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
    byte_ids = tuple(bytes_[f"<0x{b:02X}>"] for b in range(256)) if len(bytes_) == 256 else ()
    return Vocabulary(names, tuple(plain), tuple(sp.get_score(i) for i in plain), byte_ids, sp.unk_id())


@lru_cache(maxsize=2)
def useful(vocabulary: Vocabulary) -> tuple[int, ...]:
    """Places of the pieces that can lie on a best path: no other pieces spell them at a clearly better score."""
    scores = dict(zip(vocabulary.pieces, vocabulary.scores, strict=True))
    bare, out = vocabulary.unknown_score, []
    for at, (p, score) in enumerate(zip(vocabulary.pieces, vocabulary.scores, strict=True)):
        best = [0.0] + [-np.inf] * len(p)
        for stop in range(1, len(p) + 1):
            for a in range(stop == len(p), stop):
                got = scores.get(p[a:stop], bare if a == stop - 1 else None)
                if got is not None:
                    best[stop] = max(best[stop], best[a] + got)
        if len(p) == 1 or best[-1] <= score + 1e-6 * abs(score):
            out.append(at)
    return tuple(out)


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """(piece, id, score) of the useful pieces: no more rows than the vocabulary has, whatever the input."""
    at = useful(vocabulary)
    pieces, ids, scores = ([x[i] for i in at] for x in (vocabulary.pieces, vocabulary.ids, vocabulary.scores))
    return spark.createDataFrame(pa.table({"piece": pieces, "id": pa.array(ids, pa.int32()), "score": scores}))


class Joints:
    """What the vocabulary says about neighbouring characters.

    All tables are indexed by hashes of characters; where two agree, a word is
    only cut less or reaches further, which changes no best path.
    """

    def __init__(self, vocabulary: Vocabulary, places: tuple[int, ...]):
        self.inside = np.zeros(1 << _BITS, bool)
        self.reach2, self.reach3 = np.ones(1 << _BITS, np.uint8), np.zeros(1 << _BITS, np.uint8)
        both = np.array([[ord(p[i]), ord(p[i + 1])] for p in vocabulary.pieces for i in range(len(p) - 1)], np.uint32).reshape(-1, 2)
        self.inside[self._hash(both[:, 0], both[:, 1])] = True
        for i in places:
            c = [np.array([ord(x)], np.uint32) for x in vocabulary.pieces[i][:3]]
            if len(c) == 2:
                self.reach2[self._hash(*c)] = 2
            elif len(c) == 3:
                h = self._hash(self._hash(c[0], c[1]), c[2])
                self.reach3[h] = max(int(self.reach3[h][0]), min(len(vocabulary.pieces[i]), 255))

    @staticmethod
    def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (a >> np.uint32(7))) >> np.uint32(32 - _BITS)

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """Which characters begin a word: the first, and those that no piece has behind the one before."""
        return np.append(True, ~self.inside[self._hash(codes[:-1], codes[1:])])[: len(codes)]

    def reach(self, words: list[str]) -> pa.ListArray:
        """For every start in every word, the characters of the longest piece that may begin there."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
        out = np.ones(len(codes), np.uint8)
        if len(codes) > 1:
            pair = self._hash(codes[:-1], codes[1:])
            out[:-1] = np.where(left[:-1] >= 2, self.reach2[pair], 1)
            if len(codes) > 2:
                far = self.reach3[self._hash(pair[:-1], codes[2:])]
                out[:-2] = np.where(left[:-2] >= 3, np.maximum(out[:-2], np.minimum(far, left[:-2])), out[:-2])
        return _lists(out.astype(np.int8), lengths, pa.int8())


@lru_cache(maxsize=2)
def joints(vocabulary: Vocabulary, places: tuple[int, ...]) -> Joints:
    """One for each worker; ``places`` are those of the useful pieces, which the driver finds."""
    return Joints(vocabulary, places)


def encode_words(words: DataFrame, vocabulary: Vocabulary, *columns: str) -> DataFrame:
    """(word, ``columns``, ids) of distinct words of up to ``LONG`` characters in (word); no other column is named ``reach``.

    Of paths of one score the one whose last piece begins first wins, piece by
    piece from the end.  A character without a piece costs ``unknown_score`` and
    becomes its bytes' pieces, or the unknown id where the vocabulary has none.
    """
    shared = words.sparkSession.sparkContext.broadcast((vocabulary, useful(vocabulary)))
    kept = [f for f in words.schema.fields if f.name in columns]

    def reach(batches):
        for b in batches:
            yield b.append_column("reach", joints(*shared.value).reach(b.column("word").to_pylist()))

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    known = words.select(*columns, "word").mapInArrow(reach, f"{fields}word string, reach array<tinyint>")
    return best_paths(known.repartition(chunks.buckets(words.sparkSession), "word"), vocabulary, "word", *columns).select("word", *columns, "ids")


def best_paths(dealt: DataFrame, vocabulary: Vocabulary, *keys: str) -> DataFrame:
    """(``keys``, word, ids) of words whose ``reach`` is known.

    ``keys`` tell words apart and rows are dealt by some of them already, so
    neither the join nor the grouping moves a substring.
    """
    spark = dealt.sparkSession
    # Joined by a number and then by the piece itself: a table of numbers is probed faster than one of strings.
    pieces = F.broadcast(piece_table(spark, vocabulary).select(F.xxhash64("piece").alias("key"), F.col("piece").alias("known"), "id", "score"))
    carried = list(dict.fromkeys([*keys, "word"]))
    starts = dealt.select(*carried, F.size("reach").alias("n"), F.posexplode("reach").alias("start", "most"))
    spans = starts.select(*carried, "n", "start", F.explode(F.sequence(F.lit(1), F.col("most").cast("int"))).alias("m"))
    spans = spans.withColumn("piece", F.expr("substring(word, start + 1, m)")).withColumn("key", F.xxhash64("piece"))
    found = spans.join(pieces, "key", "left").withColumn("id", F.when(F.col("known") == F.col("piece"), F.col("id"))).filter("id is not null or m = 1")
    # An edge is (stop * 256 + start, score, id), id -1 for a character without a piece; words are shorter than 256.
    edge = F.struct(
        F.expr("shiftleft(start + m, 8) + start").alias("k"),
        F.when(F.col("id").isNull(), F.lit(vocabulary.unknown_score)).otherwise(F.col("score")).alias("s"),
        F.coalesce("id", F.lit(-1)).alias("id"),
    )
    lattice = found.groupBy(*keys).agg(F.sort_array(F.collect_list(edge)).alias("edges"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in carried if c not in keys))
    # By place: the best score of a path to it, and where its last piece starts.
    best = F.expr(
        """aggregate(edges, array(struct(0D as score, 0 as start, -1 as id)), (b, e) ->
             case when size(b) = shiftright(e.k, 8) then concat(b, array(struct(b[e.k & 255].score + e.s as score, e.k & 255 as start, e.id as id)))
                  when b[e.k & 255].score + e.s > b[shiftright(e.k, 8)].score
                  then concat(slice(b, 1, shiftright(e.k, 8)), array(struct(b[e.k & 255].score + e.s as score, e.k & 255 as start, e.id as id)))
                  else b end)"""
    )
    path = F.expr(
        """aggregate(sequence(1, n), struct(n as at, cast(array() as array<struct<start:int,id:int>>) as path), (r, i) ->
             case when r.at = 0 then r else struct(best[r.at].start as at, concat(array(struct(best[r.at].start as start, best[r.at].id as id)), r.path) as path) end, r -> r.path)"""
    )
    ids = F.when(F.exists("path", lambda e: e["id"] < 0), F.flatten(F.transform("path", lambda e: F.when(e["id"] >= 0, F.array(e["id"])).otherwise(_spelled(F.col("word"), e["start"], vocabulary))))).otherwise(F.transform("path", lambda e: e["id"]))
    return lattice.select(*carried, "n", best.alias("best")).select(*carried, path.alias("path")).select(*carried, ids.alias("ids"))


def _spelled(word: Column, at: Column, vocabulary: Vocabulary) -> Column:
    """Byte ids of the character at a place, or the unknown id where the vocabulary has no bytes."""
    if not vocabulary.byte_ids:
        return F.array(F.lit(vocabulary.unknown))
    char = F.substring(word, at + 1, F.lit(1))
    table = F.array(*[F.lit(i) for i in vocabulary.byte_ids])
    return F.transform(F.sequence(F.lit(0), F.octet_length(char) - 1), lambda i: F.get(table, F.conv(F.substring(F.hex(F.encode(char, "UTF-8")), i * 2 + 1, F.lit(2)), 16, 10).cast("int")))


def best_path(word: str, index: dict[str, tuple[int, float]], longest: int, unknown_score: float, byte_ids: tuple[int, ...], unknown: int) -> list[int]:
    """The same best path for one long word, without a lattice in memory."""
    n = len(word)
    score, start = [0.0] + [-np.inf] * n, [0] * (n + 1)
    for stop in range(1, n + 1):
        for a in range(max(0, stop - longest), stop):
            got = index.get(word[a:stop])
            s = got[1] if got else unknown_score if a == stop - 1 else None
            if s is not None and score[a] + s > score[stop]:
                score[stop], start[stop] = score[a] + s, a
    out, at = [], n
    while at:
        text = word[start[at] : at]
        ids = [index[text][0]] if text in index else [byte_ids[b] for b in text.encode("utf-8", "surrogatepass")] if byte_ids else [unknown]
        out.append(ids)
        at = start[at]
    return [i for ids in reversed(out) for i in ids]


def decode_ids(ids, names: dict[int, str], byte_of: dict[int, int]) -> bytes:
    """UTF-8 of a sequence of ids, spaces still marked as in the pieces."""
    out = bytearray()
    for i in ids:
        b = byte_of.get(i)
        if b is None:
            out += names.get(i, "").encode()
        else:
            out.append(b)
    return bytes(out)


def spellings(vocabulary: Vocabulary) -> pa.Array:
    """The bytes of every id, spaces as such."""
    out = [b""] * (max([*vocabulary.ids, *vocabulary.byte_ids, vocabulary.unknown]) + 1)
    for i, p in zip(vocabulary.ids, vocabulary.pieces, strict=True):
        out[i] = p.replace(SPACE, " ").encode()
    for b, i in enumerate(vocabulary.byte_ids):
        out[i] = bytes([b])
    return pa.array(out, pa.binary())


def _joined(lists: pa.ListArray) -> pa.Array:
    return pc.binary_join(lists, pa.scalar(b"", pa.binary()))


def chunk_words(table: pa.Table, n: int, at: Joints) -> chunks.Words:
    """Words of a chunk, spaces marked; every text that isn't empty gets one in front.  What isn't UTF-8 is replaced."""
    texts, starts, ends, lengths, base = [], [], [], [], 0
    for t in table.column("_t"):
        text = (SPACE + t.as_py().decode("utf-8", "replace").replace(" ", SPACE)) if len(t.as_buffer() or b"") else ""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        at_byte = np.append(0, np.cumsum(sizes, dtype=np.int64))
        begins = np.append(np.flatnonzero(at.cuts(codes)), len(codes))
        starts.append(base + at_byte[begins[:-1]])
        ends.append(base + at_byte[begins[1:]])
        lengths.append(len(begins) - 1)
        base += int(at_byte[-1])
        texts.append(text.encode())
    return chunks.Words(b"".join(texts), np.concatenate(starts), np.concatenate(ends), np.array(lengths), n)


def _planes(*arrays: np.ndarray) -> bytes:
    """Small numbers byte by byte and compressed: high bytes, mostly zero, take no room."""
    cut = [np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes() for x in arrays]
    head = np.array([len(arrays), *map(len, arrays)], np.uint32).tobytes()
    return zstandard.compress(head + b"".join(cut), 3)


def _numbers(body: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(body), np.uint8)
    count = int(raw[:4].view(np.uint32)[0])
    sizes = raw[4 : 4 + 4 * count].view(np.uint32).astype(np.int64)
    ends = 4 + 4 * count + np.cumsum(sizes * 4)
    return [np.ascontiguousarray(raw[e - 4 * n : e].reshape(4, -1).T).view(np.uint32).ravel() for e, n in zip(ends, sizes, strict=True)]


def _ranked(codes: np.ndarray) -> bytes:
    """Codes as ranks by how often they come, and the codes in order of rank."""
    counts = np.bincount(codes)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return _planes(rank[codes], order)


def _codes(body: bytes) -> np.ndarray:
    ranks, order = _numbers(body)
    return order[ranks] if len(ranks) else ranks


_DOC = "kind int, chunk long, bucket int, body binary, docs binary"
_LIST = "kind int, bucket int, chunk long, body binary"
_PATHS = "bucket int, chunk long, body binary"


def _lists(values: np.ndarray, lengths: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(values, kind))


def _coded(shared, n: int):
    """Per chunk: rows of kind 1 with its distinct words by bucket, and one of kind 0 with its documents."""

    def run(batches):
        at = joints(*shared.value)
        for chunk, table in chunks.tables(batches, CHUNK, 1 << 20):
            w = chunk_words(table, n, at)
            digests = [sha256(t.as_py()).digest() for t in table.column("_t")]
            kept = [c.combine_chunks() for c in table.columns[:-1]]
            docs = pa.RecordBatch.from_arrays([*kept, pa.array(digests, pa.binary()), pa.array(w.lengths, pa.int64())], names=[str(i) for i in range(len(kept) + 2)])
            yield chunks.rows(_DOC, [0], [chunk], [-1], [_ranked(w.codes)], [chunks.encode(docs)])
            for k, s in w.parts():
                yield chunks.rows(_DOC, [1], [chunk], [k], [chunks.encode(chunks.rows("word binary", w.words[s]))], [b""])

    return run


def _listed(batches):
    """Per bucket: its distinct words in parts (kind 0), and for every chunk the places of its words among them (kind 1)."""
    for bucket, got in chunks.grouped(batches):
        asked = [chunks.decode(r["body"]).column("word").combine_chunks() for r in got]
        words = pa.concat_arrays(asked).unique()
        for a in range(0, len(words), _PART):
            yield chunks.rows(_LIST, [0], [bucket], [a], [chunks.encode(pa.RecordBatch.from_arrays([words.slice(a, _PART)], names=["word"]))])
        for r, a in zip(got, asked, strict=True):
            yield chunks.rows(_LIST, [1], [bucket], [r["chunk"]], [_planes(pc.index_in(a, value_set=words).to_numpy())])


def _parts(batches):
    """(bucket, place of the first, words) of lists of words."""
    for b in batches:
        for bucket, first, body in zip(b.column("bucket").to_pylist(), b.column("chunk").to_pylist(), b.column("body").to_pylist(), strict=True):
            yield bucket, first, chunks.decode(body).column("word").combine_chunks().cast(pa.string())


def _reaching(shared):
    """Words for the lattice, and how far the pieces at each start may reach."""

    def run(batches):
        for bucket, first, words in _parts(batches):
            at = pc.less_equal(pc.utf8_length(words), LONG)
            places, short = pa.array(np.arange(first, first + len(words)), pa.int64()).filter(at), words.filter(at)
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(short), pa.int32()), places, short, joints(*shared.value).reach(short.to_pylist())], names=["bucket", "place", "word", "reach"])

    return run


def _long(shared):
    """Paths of words that are too long for an array fold."""

    def run(batches):
        v, index = shared.value[0], None
        for bucket, first, words in _parts(batches):
            at = np.flatnonzero(pc.greater(pc.utf8_length(words), LONG).to_numpy(zero_copy_only=False))
            if len(at):
                index = index or {p: (i, s) for p, i, s in zip(v.pieces, v.ids, v.scores, strict=True)}
                paths = [best_path(words[int(i)].as_py(), index, v.longest, v.unknown_score, v.byte_ids, v.unknown) for i in at]
                yield chunks.rows(_PATHS, [bucket], [None], [_planes(first + at, np.array(list(map(len, paths))), np.concatenate(paths))])

    return run


def _packed(batches):
    """Encoded words by bucket: places, lengths and ids."""
    for b in batches:
        bucket, place, ids = (b.column(c) for c in ("bucket", "place", "ids"))
        for k in pc.unique(bucket).to_pylist():
            at = pc.equal(bucket, k)
            part = ids.filter(at)
            yield chunks.rows(_PATHS, [k], [None], [_planes(place.filter(at).to_numpy(), np.diff(part.offsets.to_numpy()), part.flatten().to_numpy())])


def _spread(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists stored end to end: the lengths of those in ``codes``, and where their items are."""
    firsts = np.append(0, np.cumsum(lengths))[:-1]
    per = lengths[codes]
    return per, np.repeat(firsts[codes] - np.append(0, np.cumsum(per))[:-1], per) + np.arange(per.sum())


def _reply(batches):
    """Rows of a bucket, encoded words and places that chunks ask for: lengths and ids in each chunk's order."""
    for bucket, got in chunks.grouped(batches):
        known = [_numbers(r["body"]) for r in got if r["chunk"] is None]
        if not known:
            continue
        place, length, ids = (np.concatenate(x).astype(np.int64) for x in zip(*known, strict=True))
        where = np.empty(len(place), np.int64)
        where[place] = np.arange(len(place))
        for r in got:
            if r["chunk"] is not None:
                (asked,) = _numbers(r["body"])
                per, at = _spread(length, where[asked])
                yield chunks.rows(chunks.ANSWERS, [bucket], [r["chunk"]], [_planes(per, ids[at])])


def encode(docs: DataFrame, vocabulary: Vocabulary, *columns: str) -> DataFrame:
    """``columns`` with ``ids``, ``n_pieces``, ``decoded_sha256`` and ``lossless`` of every document.

    ``decoded_sha256`` is of the text that the ids decode to; ``lossless`` tells
    whether that is the text itself (a text that holds the space mark decodes to
    a space there).  Null and empty texts have no pieces, repeated rows each get
    a row.  Columns of the names added here are replaced.
    """
    spark = docs.sparkSession
    n = chunks.buckets(spark)
    kept = [f for f in docs.schema.fields if f.name in columns and f.name not in ("ids", "n_pieces", "decoded_sha256", "lossless")]
    path = work_path(spark, "coded")
    shared = spark.sparkContext.broadcast((vocabulary, useful(vocabulary)))  # as large as the vocabulary, whatever the input
    chunks.texts(docs, *(f.name for f in kept)).mapInArrow(trimmed(_coded(shared, n)), _DOC).write.partitionBy("kind").option("compression", "none").parquet(path)
    written = spark.read.schema("chunk long, bucket int, body binary, docs binary, kind int").parquet(path)
    coded, held = (written.filter(F.col("kind") == k).drop("kind") for k in (0, 1))
    coded = store_by(coded.select("chunk", "body", "docs"), "documents", "chunk")
    drop_path(spark, f"{path}/kind=0")
    lists = work_path(spark, "lists")
    chunks.by_bucket(held.select("bucket", "chunk", "body"), _listed, _LIST).write.partitionBy("kind").option("compression", "none").parquet(lists)
    release(spark)
    drop_path(spark, path)
    words, asked = (spark.read.schema("bucket int, chunk long, body binary, kind int").parquet(lists).filter(F.col("kind") == k).drop("kind") for k in (0, 1))
    # A partition's words are grouped in memory; past this many the grouping would sort substrings on disk.
    with session(spark, {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": 1 << 20}):
        known = words.mapInArrow(trimmed(_reaching(shared)), "bucket int, place long, word string, reach array<tinyint>")
        # A bucket's words in four parts, so that few lattices are in memory at once.
        dealt = known.withColumn("part", F.pmod("place", F.lit(4))).repartition(4 * n, "bucket", "part")
        paths = best_paths(dealt, vocabulary, "bucket", "part", "place").select("bucket", "place", "ids").mapInArrow(trimmed(_packed), _PATHS)
        found = store(paths.union(words.mapInArrow(trimmed(_long(shared)), _PATHS)), "encoded-words", compression="none")
    del known, dealt, paths
    drop_path(spark, f"{lists}/kind=0")
    release(spark)
    answers = store(chunks.by_bucket(found.unionByName(asked), _reply, chunks.ANSWERS), "encoded", compression="none")
    drop_stored(found)
    drop_path(spark, lists)
    release(spark)
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "ids array<int>", "n_pieces long", "decoded_sha256 string", "lossless boolean"])

    def finish(batches):
        spelling = spellings(shared.value[0])
        for b in batches:
            for body, listed, got in zip(b.column("body").to_pylist(), b.column("docs").to_pylist(), b.column("got").to_pylist(), strict=True):
                table, codes = chunks.decode(listed), _codes(body)
                told = chunks._by_bucket(got)
                parts = [_numbers(told[k]) for k in sorted(told)]
                sizes, flat = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 2
                spelled = _joined(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), spelling.take(pa.array(flat))))
                cuts = np.append(0, np.cumsum(table.column(len(kept) + 1).to_numpy()))
                per, at = _spread(sizes, codes)
                total = np.append(0, np.cumsum(per))
                lengths = total[cuts[1:]] - total[cuts[:-1]]
                texts = _joined(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spelled.take(pa.array(codes))))
                digests = [sha256(memoryview(t.as_buffer())[1:]).digest() for t in texts]
                same = [a == b for a, b in zip(digests, table.column(len(kept)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(table.column(i).combine_chunks() for i in range(len(kept))), _lists(flat[at], lengths, pa.int32()), pa.array(lengths, pa.int64()), pa.array([d.hex() for d in digests]), pa.array(same)], names=[*(f.name for f in kept), "ids", "n_pieces", "decoded_sha256", "lossless"])

    return chunks.tell(coded, answers).select("body", "docs", "got").mapInArrow(trimmed(finish), out_schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """Replace a column of ids by ``text``, the text they stand for; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    rest = [f for f in encoded.schema.fields if f.name not in (ids, "text")]

    def run(batches):
        v = shared.value
        names, byte_of = dict(zip(v.ids, v.pieces, strict=True)), {i: b for b, i in enumerate(v.byte_ids)}
        for b in batches:
            texts = [None if x is None else decode_ids(x, names, byte_of).decode("utf-8", "replace").replace(SPACE, " ")[1:] for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.array(texts, pa.string())], names=[*(f.name for f in rest), "text"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    return encoded.select(*(f.name for f in rest), ids).mapInArrow(run, f"{fields}text string")
