"""Toxicity by a weighted finite-state grammar of clauses.

Words become symbols: a learned, weighted acceptor of stems knows the insults
of any language in the labels, short lists know threats, targets, negations
and verbs of speech.  Small letter transducers then rewrite the symbols of a
clause: reported speech turns what is told into told insults, negation denies
the insults just after it, a threat that meets a target becomes a menace, and
an insult in one clause with a target is aimed.  They are composed into one
machine of a few dozen states.  A matched clause adds the weights of its
insult stems to the kind of match it is, and a document's score is a logistic
sum over kinds, so a word counts as the clause it stands in says.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import drop_stored, fresh, small_batches, store

OTHER, TARGET, NOT, SAID, THREAT, QUOTE, END, PARA, INSULT, DENIED, TOLD, AIMED, MENACE = range(13)
INPUTS = (OTHER, TARGET, NOT, SAID, THREAT, QUOTE, END, PARA, INSULT)
#: Kinds of clauses that a score sums over.
KINDS = ("plain", "aimed", "menace", "denied", "told")
#: What the kinds weigh, and the score of a text without a match, where labels say nothing else.
PRIOR = (-4.0, 0.6, 0.7, 0.7, 0.1, 0.1)

#: Seeds in English, German, French and Spanish; a parameter of the grammar.
SEEDS: Mapping[int, frozenset[str]] = {
    TARGET: frozenset("you your yours he him she her they them people women men immigrants du dich dir dein ihr euch euer sie er tu toi te ton vous votre il elle ils elles usted tú ti tus vosotros él ella ellos ellas".split()),
    NOT: frozenset("not no never nobody hardly isn't aren't wasn't don't doesn't nicht kein keine keinen nie niemals ne pas jamais aucun aucune nunca jamás tampoco ningún ninguna".split()),
    SAID: frozenset("said says say told tells wrote writes called calls claimed claims reported reportedly quoted sagte sagt sagten schrieb nannte behauptete dit disait écrit appelé prétend dijo dice escribió llamó afirma".split()),
    THREAT: frozenset("kill hurt harm beat shoot stab burn destroy punish attack strangle töten umbringen schlagen verletzen vernichten tuer frapper blesser détruire brûler matar golpear herir destruir quemar".split()),
}
_TOKENS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n\"“”„«»]")
_MARKS = {".": END, "!": END, "?": END, ";": END, "\n": PARA} | dict.fromkeys('"“”„«»', QUOTE)
#: A long text is walked in parts of so many characters, cut between words.
PART = 1 << 20
_MENACE_WEIGHT = 4.0


@dataclass(frozen=True)
class Transducer:
    """Letter transducer: (state, symbol) to (state, symbol); what has no arc passes as it is."""

    arcs: Mapping[tuple[int, int], tuple[int, int]]
    start: int = 0

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol), (state, symbol))

    def run(self, symbols: Sequence[int]) -> list[int]:
        state, out = self.start, []
        for s in symbols:
            state, o = self.step(state, s)
            out.append(o)
        return out


def compose(*machines: Transducer, inputs: Sequence[int] = INPUTS) -> Transducer:
    """One machine that does what the given ones do one after the other: the states reached of their product."""
    names = {(first := tuple(m.start for m in machines)): 0}
    arcs, todo = {}, [first]
    while todo:
        states = todo.pop()
        for symbol in inputs:
            out, to = symbol, []
            for m, s in zip(machines, states, strict=True):
                s, out = m.step(s, out)
                to.append(s)
            if (at := tuple(to)) not in names:
                names[at] = len(names)
                todo.append(at)
            arcs[names[states], symbol] = (names[at], out)
    return Transducer(arcs)


def reported() -> Transducer:
    """A verb of speech covers the rest of its clause, quotation marks what is between them, on one line."""
    arcs = {(0, SAID): (1, SAID), (1, END): (0, END), (1, PARA): (0, PARA), (2, PARA): (0, PARA), (0, QUOTE): (2, OTHER), (1, QUOTE): (2, OTHER), (2, QUOTE): (0, OTHER)}
    return Transducer(arcs | {(s, INSULT): (s, TOLD) for s in (1, 2)} | {(s, THREAT): (s, OTHER) for s in (1, 2)})


def negation(reach: int = 3) -> Transducer:
    """A negation denies insults and threats among the ``reach`` words after it."""
    arcs = {}
    for s in range(reach + 1):
        arcs |= {(s, x): (max(0, s - 1), x) for x in (OTHER, TARGET, SAID, TOLD)}
        arcs |= {(s, NOT): (reach, NOT), (s, END): (0, END), (s, PARA): (0, PARA)}
        if s:
            arcs |= {(s, INSULT): (s - 1, DENIED), (s, THREAT): (s - 1, OTHER)}
    return Transducer(arcs)


def threat() -> Transducer:
    """A threat makes a menace of a target later in its clause."""
    return Transducer({(0, THREAT): (1, THREAT), (1, TARGET): (0, MENACE), (1, END): (0, END), (1, PARA): (0, PARA)})


def target() -> Transducer:
    """An insult and a target in one clause, whichever comes first, aim the clause."""
    arcs = {(0, TARGET): (1, TARGET), (1, INSULT): (1, AIMED), (0, INSULT): (2, INSULT), (2, TARGET): (1, AIMED)}
    return Transducer(arcs | {(s, x): (0, x) for s in (1, 2) for x in (END, PARA)})


class Grammar:
    """The composed machine with a weighted acceptor of insult stems; a word is an insult if a stem begins it."""

    def __init__(self, stems: Mapping[str, float], seeds: Mapping[int, frozenset[str]] = SEEDS):
        self.stems, self.seeds = dict(stems), {k: frozenset(v) for k, v in seeds.items()}
        self.machine = compose(reported(), negation(), threat(), target())
        n = 1 + max(s for s, _ in self.machine.arcs)
        self._table = [[self.machine.arcs[s, x] for x in INPUTS] for s in range(n)]
        self._weights = list(self.stems.values())
        self._index = {s: INSULT + i for i, s in enumerate(self.stems)}
        self._lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self._memo: dict[str, int] = dict(_MARKS)

    def __reduce__(self):
        return Grammar, (self.stems, self.seeds)

    def symbol(self, word: str) -> int:
        """The word's symbol; from INSULT on, INSULT plus the number of its longest stem."""
        for k in self._lengths:
            if k <= len(word) and (at := self._index.get(word[:k])) is not None:
                return at
        return next((s for s, words in self.seeds.items() if word in words), OTHER)

    def _symbols(self, part: str) -> list[int]:
        memo = self._memo
        if len(memo) > 400_000:
            memo.clear()
            memo.update(_MARKS)
        out = []
        for w in _TOKENS.findall(part):
            s = memo.get(w)
            if s is None:
                s = memo[w] = self.symbol(w)
            out.append(s)
        return out

    def matches(self, text: str) -> dict[str, float]:
        """Weights of the text's matched clauses by kind; the whole text is read, in parts."""
        total = dict.fromkeys(KINDS, 0.0)
        state, plain, aimed = self.machine.start, 0.0, False
        at = 0
        while at < len(text):
            end = at + PART
            if end < len(text):
                while end < len(text) and not text[end].isspace():
                    end += 1
            symbols = self._symbols(text[at:end].lower())
            at = end
            if not aimed and not plain and not state and max(symbols, default=0) < INSULT and THREAT not in symbols and at >= len(text):
                continue  # nothing in this last part can match
            for s in symbols:
                state, out = self._table[state][min(s, INSULT)]
                if s >= INSULT:
                    w = self._weights[s - INSULT]
                    if out == DENIED:
                        total["denied"] += w
                    elif out == TOLD:
                        total["told"] += w
                    else:
                        plain += w
                        aimed = aimed or out == AIMED
                elif out == AIMED:
                    aimed = True
                elif out == MENACE:
                    total["menace"] += _MENACE_WEIGHT
                elif s in (END, PARA) and (plain or aimed):
                    total["aimed" if aimed else "plain"] += plain
                    plain, aimed = 0.0, False
        total["aimed" if aimed else "plain"] += plain
        return total

    def features(self, text: str | None) -> tuple[int, ...]:
        """Weights by kind on a scale of half doublings."""
        m = self.matches(text) if text else {}
        return tuple(round(2 * math.log2(1 + m.get(k, 0.0))) for k in KINDS)


@dataclass(frozen=True)
class Toxicity:
    """A fitted grammar: stems with weights, then a bias and a weight per kind."""

    stems: Mapping[str, float]
    weights: tuple[float, ...] = PRIOR
    seeds: Mapping[int, frozenset[str]] = field(default_factory=lambda: SEEDS)

    def score(self, features: Sequence[int]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def logistic(rows: Mapping[tuple[tuple[int, ...], int], int], prior: Sequence[float] = PRIOR, spread: float = 2.0) -> tuple[float, ...]:
    """Weights of largest posterior from counted (features, label), by Newton's steps; ``prior`` holds where rows say nothing."""
    import numpy as np

    mean = np.asarray(prior, float)
    if not rows:
        return tuple(mean)
    x = np.array([(1, *f) for (f, _) in rows], float)
    y = np.array([label for (_, label) in rows], float)
    n = np.array(list(rows.values()), float)
    w = mean.copy()
    loss = lambda w: float((n * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w))).sum() + ((w - mean) ** 2).sum() / (2 * spread**2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (n * (p - y)) + (w - mean) / spread**2
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / spread**2
        step = np.linalg.solve(curve, slope)
        scale = 1.0
        while scale > 1e-6 and loss(w - scale * step) > loss(w):
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _prefixes(words, shortest: int, longest: int) -> set[str]:
    return {w[:k] for w in words for k in range(shortest, min(len(w), longest) + 1)}


def _counted(sample: DataFrame, of, name: str) -> DataFrame:
    """Sums over the sample of the counts that ``of(text)`` names, by label; a task's counts leave it in bounded lots."""

    def run(batches):
        import pyarrow as pa

        counts: dict[tuple[str, int], int] = {}

        def lot():
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([y for _, y in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=[name, "toxic", "n"])

        for b in batches:
            for text, y in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
                for k in of(text.as_py() or ""):
                    counts[k, y] = counts.get((k, y), 0) + 1
                if len(counts) > 300_000:
                    yield lot()
                    counts.clear()
        if counts:
            yield lot()

    return sample.mapInArrow(run, f"{name} string, toxic int, n long").groupBy(name, "toxic").agg(F.sum("n").alias("n"))


def _words(text: str) -> list[str]:
    return [w for w in _TOKENS.findall(text.lower()) if w not in _MARKS]


def evidence(t: float, of_t: float, c: float, of_c: float) -> float:
    """Twice the log likelihood ratio of ``t`` of ``of_t`` against ``c`` of ``of_c`` having something, if the first have it more often."""
    if of_t <= 0 or of_c <= 0 or t / of_t <= c / of_c:
        return 0.0
    both = (t + c) / (of_t + of_c)
    part = lambda k, n, p: (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n - k else 0.0)
    return 2 * (part(t, of_t, t / of_t) + part(c, of_c, c / of_c) - part(t, of_t, both) - part(c, of_c, both))


def stems_of(support: Mapping[str, int], contexts: Mapping[str, int], clean: Mapping[str, int], toxic_docs: int, clean_docs: int, *, sure: float = 24.0, ratio: float = 3.0) -> dict[str, float]:
    """The acceptor's stems: prefixes that mark toxic texts, by most evidence and then length, none of which begins another.

    A prefix marks if its log odds reach ``ratio`` and its evidence ``sure``,
    counted by distinct contexts, so that copies of one text count once.
    """
    marks = {}
    for p, docs in support.items():
        t, c = min(docs, contexts.get(p, 0)), clean.get(p, 0)
        weight = math.log((t + 0.5) / (toxic_docs + 1)) - math.log((c + 0.5) / (clean_docs + 1))
        sign = evidence(t, toxic_docs, c, clean_docs)
        if weight >= ratio and sign >= sure:
            marks[p] = (sign, len(p), weight)
    out: dict[str, float] = {}
    begun: set[str] = set()  # all beginnings of accepted stems
    for p in sorted(marks, key=lambda p: (-marks[p][0], -marks[p][1], p)):
        heads = {p[:k] for k in range(1, len(p) + 1)}
        if p not in begun and not heads & out.keys():
            out[p] = marks[p][2]
            begun |= heads
    return out


def learn_stems(sample: DataFrame, *, shortest: int = 3, longest: int = 12, least: int = 5) -> dict[str, float]:
    """Insult stems from rows (text, toxic) of a bounded sample, in three passes over it.

    Prefixes of words in toxic rows first, then how many clean rows have those,
    then in how many contexts (words before and after) the telling ones stand.
    """
    docs = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    of_t, of_c = docs.get(1, 0), docs.get(0, 0)
    if not of_t or not of_c:
        return {}
    spark = sample.sparkSession
    found = _counted(sample.filter("toxic = 1"), lambda text: _prefixes(set(_words(text)), shortest, longest), "prefix").filter(F.col("n") >= least)
    support = {r["prefix"]: r["n"] for r in found.select("prefix", "n").collect()}  # prefixes of a sample of bounded rows
    told = spark.sparkContext.broadcast(frozenset(support))
    in_clean = _counted(sample.filter("toxic = 0"), lambda text: _prefixes(set(_words(text)), shortest, longest) & told.value, "prefix")
    clean = {r["prefix"]: r["n"] for r in in_clean.collect()}
    telling = {p for p, t in support.items() if math.log((t + 0.5) / (of_t + 1)) - math.log((clean.get(p, 0) + 0.5) / (of_c + 1)) >= 2.0}
    asked = spark.sparkContext.broadcast(frozenset(telling))

    def contexts(text):
        words = ["", *_words(text), ""]
        return {f"{p}\t{a}\t{b}" for a, w, b in zip(words, words[1:], words[2:], strict=False) for p in (w[:k] for k in range(shortest, min(len(w), longest) + 1)) if p in asked.value}

    seen = _counted(sample.filter("toxic = 1"), contexts, "context").groupBy(F.substring_index("context", "\t", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return stems_of({p: support[p] for p in telling}, {r["prefix"]: r["n"] for r in seen.collect()}, clean, of_t, of_c)


def labelled(docs: DataFrame, labels: DataFrame, train: Column, *, most: int = 8_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (text, toxic) to learn from: for either label about ``most`` of the labelled keys that ``train`` allows, by hash.

    A key labelled more than once is toxic if any label says so, a key of
    several texts gives the least.  Null keys, labels and texts teach nothing.
    """
    marked = labels.filter(train & F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = store(marked, "marked")
    n = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, F.lit(most / max(1, n.get(1, 0)))).otherwise(F.lit(most / max(1, n.get(0, 0))))
    picked = marked.filter(F.pmod(F.xxhash64(F.lit(12), "k"), F.lit(1 << 30)) < share * (1 << 30))
    # both labels together: about 2 x most keys, whatever the input
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(picked), "k")
    out = store(rows.groupBy("k").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "labelled")
    drop_stored(marked)
    return out


def fit(sample: DataFrame, *, seeds: Mapping[int, frozenset[str]] = SEEDS) -> Toxicity:
    """Learn stems, then the weights of the kinds of clauses, from rows (text, toxic); without both labels the prior stays."""
    small_batches(sample.sparkSession)
    stems = learn_stems(sample)
    grammar = Grammar(stems, seeds)
    counts = {}
    for r in _counted(sample, lambda text: [" ".join(map(str, grammar.features(text)))], "features").collect():
        counts[tuple(map(int, r["features"].split())), r["toxic"]] = r["n"]
    both = len({y for _, y in counts}) == 2
    return Toxicity(stems, logistic(counts) if both else PRIOR, seeds)


def scored(docs: DataFrame, model: Toxicity, *, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, score, predicted and the weight of clauses by kind for every whole text.

    Null and empty texts match nothing and get the score of that.  Repeated
    rows each get a row, an empty table gives none; columns not in ``keep`` go.
    """
    spark = docs.sparkSession
    small_batches(spark)
    t = fresh(keep, "t")["t"]
    picked = docs.select(*keep, F.col(text).alias(t))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    shared = spark.sparkContext.broadcast((Grammar(model.stems, model.seeds), model))  # stems of a bounded sample

    def run(batches):
        import pyarrow as pa

        grammar, model = shared.value
        for b in batches:
            rows = [grammar.features(text.as_py()) for text in b.columns[-1]]
            s = [model.score(r) for r in rows]
            cols = [*b.columns[:-1], pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32()), pa.array([list(r) for r in rows], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "score", "predicted", "clauses"])

    return picked.mapInArrow(run, f"{fields}{', ' if fields else ''}score double, predicted int, clauses array<int>")
