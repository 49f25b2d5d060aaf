"""Language-model scores: every segmentation of a text into vocabulary pieces counts.

The scores of an existing vocabulary weigh its pieces, and the sum over all
segmentations of a word, by a forward recursion in log space, is its probability
among pieces.  Words of the training documents are edges of the lattice of their
own, from the word's start to its end, by how often they came; the pieces share
what is left, the part of training words that came once (Good and Turing's
estimate of what is new).  No piece has a space inside, so the recursion runs
once per distinct word of the corpus, and a text is the product of its words and
of an end.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import chunks
from lattica.llm.common import release, store
from lattica.llm.sequences import BASE, INVERSE, mix, powers, word_spans

_U = np.uint64
SPACE = "▁"
#: Words of up to this many characters go through the vectorised recursion.
SHORT = 64


@dataclass
class Pieces:
    """A vocabulary with log weights: whole pieces, and one weight per byte for characters that have no piece."""

    names: list[str]
    weight: np.ndarray
    byte_weight: np.ndarray

    def __post_init__(self):
        self.longest = max(map(len, self.names), default=1)
        self.index = {p: i for i, p in enumerate(self.names)}
        keys = np.array([_hash(np.array([[ord(c) for c in p]], _U))[0] for p in self.names], _U)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order

    def __getstate__(self):
        return self.names, self.weight, self.byte_weight

    def __setstate__(self, state):
        self.names, self.weight, self.byte_weight = state
        self.__post_init__()

    def spelled(self, char: str) -> float:
        """Log weight of a character spelled in bytes."""
        return float(self.byte_weight[list(char.encode("utf-8", "surrogatepass"))].sum())


def _hash(codes: np.ndarray) -> np.ndarray:
    """One hash per row of code points."""
    with np.errstate(over="ignore"):
        return mix((codes * powers(codes.shape[1], BASE)).sum(axis=1, dtype=_U) + _U(codes.shape[1]))


def load_pieces(path: str) -> Pieces:
    """Pieces of a sentencepiece model file.

    Scores that are log probabilities are kept.  Where they are ranks (a merge
    vocabulary: 0, -1, -2, ...), a piece of rank r weighs 1 / (r + 10).
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = np.array([sp.get_score(i) for i in plain])
    logs = -np.log(10 - scores) if scores.min() < -1000 else scores
    logs = logs - np.logaddexp.reduce(logs)
    floor = float(logs.min())
    return Pieces([sp.id_to_piece(i) for i in plain], logs, np.full(256, floor - log(256)))


def _edges(words: list[str], pieces: Pieces) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For words of one length, ids and log weights of the piece at every start, by piece length."""
    n, size = len(words), len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(_U)
    with np.errstate(over="ignore"):
        sums = np.zeros((n, size + 1), _U)
        np.cumsum(codes * powers(size, BASE), axis=1, out=sums[:, 1:])
        ids, weights = [], []
        for m in range(1, min(pieces.longest, size) + 1):
            key = mix((sums[:, m:] - sums[:, :-m]) * powers(size + 1, INVERSE)[: size - m + 1] + _U(m))
            at = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
            found = pieces.keys[at] == key
            i = np.where(found, pieces.ids[at], -1)
            ids.append(i)
            weights.append(np.where(found, pieces.weight[i], -np.inf))
    bare = ids[0] < 0
    if bare.any():
        chars, back = np.unique(codes[bare], return_inverse=True)
        weights[0][bare] = np.array([pieces.spelled(chr(int(c))) for c in chars])[back]
    return ids, weights


def _forward(weights: list[np.ndarray], size: int) -> np.ndarray:
    out = np.full((weights[0].shape[0], size + 1), -np.inf)
    out[:, 0] = 0
    for j in range(1, size + 1):
        for m in range(1, min(len(weights), j) + 1):
            out[:, j] = np.logaddexp(out[:, j], out[:, j - m] + weights[m - 1][:, j - m])
    return out


def _long(word: str, pieces: Pieces) -> float:
    """The forward recursion for one long word, keeping as many sums as a piece has characters."""
    ahead = {0: 0.0}
    for i in range(len(word)):
        here = ahead.pop(i)
        for m in range(1, min(pieces.longest, len(word) - i) + 1):
            k = pieces.index.get(word[i : i + m])
            w = pieces.weight[k] if k is not None else pieces.spelled(word[i]) if m == 1 else None
            if w is not None:
                ahead[i + m] = float(np.logaddexp(ahead.get(i + m, -np.inf), here + w))
    return ahead[len(word)]


def _by_length(words: list[bytes], most: int = 1 << 18):
    """Indices and texts of words of one length, in parts of bounded area; texts begin with the space mark."""
    texts = [SPACE + w.decode("utf-8", "replace") for w in words]
    groups: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        groups.setdefault(len(t), []).append(i)
    for size, members in sorted(groups.items()):
        step = max(1, most // size)
        for a in range(0, len(members), step):
            part = members[a : a + step]
            yield size, np.array(part), [texts[i] for i in part]


def log_probabilities(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """Natural log of each word's probability, summed over all segmentations."""
    out = np.zeros(len(words))
    for size, at, texts in _by_length(words):
        if size > SHORT:
            out[at] = [_long(t, pieces) for t in texts]
        else:
            out[at] = _forward(_edges(texts, pieces)[1], size)[:, -1]
    return out


def _words(table: pa.Table, n: int) -> chunks.Words:
    """A chunk's words, A-Z lower-cased; texts are parted by newlines, which no word holds."""
    texts = [t.as_py() for t in table.column("_t")]
    data = b"\n".join(texts).lower()  # bytes: A-Z only
    starts, ends = word_spans(data)
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return chunks.Words(data, starts, ends, np.diff(np.searchsorted(starts, firsts)), n)


_ASK = "bucket int, chunk long, words binary"
_TABLE = "bucket int, words binary, n long, v long, ones long"
_WORDS = "word binary, train long"


def _ask(n: int):
    def run(batches):
        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("blob"), strict=True):
                table = chunks.decode(blob.as_py())
                w = _words(table, n)
                learned = np.repeat(~table.column("c1").to_numpy(), w.lengths)
                train = np.bincount(w.codes[learned], minlength=len(w.words))
                for k, s in w.parts():
                    yield chunks.rows(_ASK, [k], [chunk], [chunks.encode(chunks.rows(_WORDS, w.words[s], train[s]))])

    return run


def _count(batches):
    """All chunks' words of a bucket as one row of the word table."""
    for bucket, got in chunks.grouped(batches):
        table = pa.concat_tables([chunks.decode(r["words"]) for r in got]).group_by("word").aggregate([("train", "sum")])
        words, train = table.column("word").combine_chunks(), table.column("train_sum").to_numpy()
        yield chunks.rows(_TABLE, [bucket], [chunks.encode(chunks.rows(_WORDS, words, train))], [int(train.sum())], [int((train > 0).sum())], [int((train == 1).sum())])


def with_words(pieces_lp: np.ndarray, train: np.ndarray, total: int, ones: int) -> np.ndarray:
    """Log probabilities of words by an edge for each training word beside the lattice of pieces."""
    new = min(max(ones, 1) / (total + 1), 0.99) if total else 1.0
    with np.errstate(divide="ignore"):
        whole = np.log(train / max(total, 1)) + np.log1p(-new) if total else np.full(len(train), -np.inf)
    return np.logaddexp(whole, pieces_lp + log(new))


def _answer(shared, total: int, ones: int):
    def run(batches):
        pieces = shared.value
        for bucket, got in chunks.grouped(batches):
            asks = [r for r in got if r["chunk"] is not None]
            if not asks:
                continue
            (row,) = [r for r in got if r["chunk"] is None]
            table = chunks.decode(row["words"])
            words = table.column("word").combine_chunks()
            train = table.column("train").to_numpy()
            lp = with_words(log_probabilities(words.to_pylist(), pieces), train, total, ones)
            for r in asks:
                at = pc.index_in(chunks.decode(r["words"]).column("word").combine_chunks(), value_set=words).to_numpy()
                answer = pa.RecordBatch.from_arrays([pa.array(train[at]), pa.array(lp[at])], names=["c", "lp"])
                yield chunks.rows(chunks.ANSWERS, [bucket], [r["chunk"]], [chunks.encode(answer)])

    return run


def score(docs: DataFrame, held_out, vocabulary: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Rows whose ``held_out`` is false are learned from.  Tokens are the words
    `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and one end.  Null and empty texts are
    an end alone.  Repeated rows count each time and each get their scores, an
    empty table gives none; of the columns of ``docs`` only doc_id is kept, so
    clashing names cannot matter.  ``vocabulary`` is the path of a
    sentencepiece model, read on the driver.
    """
    spark = docs.sparkSession
    n = chunks.buckets(spark)
    packed = chunks.pack(docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))), "doc_id", "held_out")
    asks = store(packed.mapInArrow(_ask(n), _ASK), "words")
    table = store(chunks.by_bucket(asks, _count, _TABLE), "word-table")
    release(spark)
    ends = docs.filter(~F.coalesce(held_out, F.lit(False))).count()
    found = table.agg(F.sum("n"), F.sum("v"), F.sum("ones")).first()
    total, distinct = int(found[0] or 0) + ends, int(found[1] or 0) + (ends > 0)

    # An end comes once a text; words share the rest.
    end_lp = log((ends + 0.5) / (total + 1))
    word_lp = log((total - ends + 0.5) / (total + 1))
    shared = spark.sparkContext.broadcast(load_pieces(vocabulary))  # one entry per piece of the vocabulary, whatever the input
    both = asks.unionByName(table.select("bucket", F.lit(None).cast("long").alias("chunk"), "words"))
    answers = store(chunks.by_bucket(both, _answer(shared, total - ends, int(found[2] or 0)), chunks.ANSWERS), "word-scores")
    release(spark)
    bottom = total + 0.5 * (distinct + 1)
    end_base = log10((ends + 0.5) / bottom)

    def finish(batches):
        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        for b in batches:
            for blob, got in zip(b.column("blob"), b.column("got").to_pylist(), strict=True):
                t = chunks.decode(blob.as_py())
                w = _words(t, n)
                told = chunks._by_bucket(got)
                parts = [chunks.decode(told[k]) for k, _ in w.parts()]
                gathered = lambda name: np.concatenate([p.column(name).to_numpy() for p in parts]) if parts else np.zeros(0)  # noqa: B023, E731
                c, lp = gathered("c"), gathered("lp").astype(float)
                known, base, model = w.sums(c > 0).astype(np.int64), w.sums(np.log10((c + 0.5) / bottom)), w.sums(lp + word_lp)
                yield chunks.rows(schema, t.column("c0").to_pylist(), t.column("c1").to_pylist(), w.lengths + 1, known + (ends > 0), np.full(len(known), total), base + end_base, (model + end_lp) / log(10))

    return chunks.tell(packed, answers).select("blob", "got").mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
