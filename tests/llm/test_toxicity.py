"""The clause grammar: its machines one by one and composed, what it learns, and how well it tells toxic texts."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lattica.llm import clause_grammar as g

STEMS = {"clown": 3.0, "fool": 2.0}


def test_composed_machine_is_the_machines_in_turn():
    rng = random.Random(4)
    machines = (g.reported(), g.negation(), g.threat(), g.target())
    whole = g.compose(*machines)
    assert 4 < len({s for s, _ in whole.arcs}) < 200
    for _ in range(500):
        symbols = [rng.choice(g.INPUTS) for _ in range(rng.randrange(30))]
        want = symbols
        for m in machines:
            want = m.run(want)
        assert whole.run(symbols) == want


@pytest.mark.parametrize(
    ("text", "kind", "weight"),
    [
        ("What a clown.", "plain", 3.0),
        ("CLOWNS, the lot; fools too.", "plain", 5.0),
        ("You are a clown.", "aimed", 3.0),
        ("A clown and a fool you are.", "aimed", 5.0),
        ("You said so. A clown, that is.", "told", 0.0),
        ("She is not a clown.", "denied", 3.0),
        ("It is not so that a big clown came.", "plain", 3.0),
        ("He wrote that a clown came", "told", 3.0),
        ('The "clown" came. clown', "told", 3.0),
        ("I will hurt you", "menace", 4.0),
        ("I will never hurt you", "menace", 0.0),
        ("hurt. you", "menace", 0.0),
        ("clown", "plain", 3.0),
    ],
)
def test_clauses(text, kind, weight):
    assert g.Grammar(STEMS).matches(text)[kind] == weight


def test_clauses_are_scored_not_words():
    model = g.Toxicity(STEMS)
    of = lambda text: model.score(g.Grammar(STEMS).features(text))
    assert of("you are a clown") > of("a clown") > of("they wrote: not a clown") >= of("a crown")


def test_long_texts_are_walked_whole(monkeypatch):
    rng = random.Random(9)
    text = " ".join(rng.choice(["you", "clown", "not", "said", "word", '"', "fool.", "\n", "hurt", "end."]) for _ in range(900))
    grammar = g.Grammar(STEMS)
    whole = grammar.matches(text)
    for part in (1, 7, 100, 4000):
        monkeypatch.setattr(g, "PART", part)
        assert grammar.matches(text) == pytest.approx(whole)


def test_evidence():
    assert g.evidence(30, 30, 0, 300) > 100 > g.evidence(3, 30, 0, 300) > 0 == g.evidence(1, 30, 20, 300)


def corpus(seed=6, n=400):
    rng = random.Random(seed)
    syllables = ["ba", "do", "ki", "lu", "me", "no", "ra", "si", "tu", "ve"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    ends = ["", "ra", "si", "tu", "me", "do"]
    rows = []
    for i in range(n):
        body = [word() for _ in range(rng.randint(20, 80))]
        toxic = int(i % 5 == 0)
        for _ in range(rng.randint(2, 4) * toxic):
            body.insert(rng.randrange(len(body)), rng.choice(["grimpf", "zzork"]) + rng.choice(ends))
        rows.append((i, " ".join(body), toxic))
    copied = "qwexy " + " ".join(word() for _ in range(30))  # one toxic text again and again teaches nothing of its other words
    return rows + [(n + i, copied + " grimpfra zzork", 1) for i in range(60)]


@pytest.fixture(scope="module")
def taught(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "grimpf zzork"), (5, None), (9000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (3, 1), (9000, 1)], "doc_id long, toxic int")
    sample = g.labelled(docs, labels, F.col("doc_id") % 4 != 0)
    return docs, sample, g.fit(sample)


def test_sample_is_the_labelled_training_rows(taught):
    rows = corpus()
    want = Counter((t, 1 if i == 3 else y) for i, t, y in rows if i % 4)
    assert Counter(map(tuple, taught[1].collect())) == want


def test_stems_are_those_that_mark(taught):
    stems = set(taught[2].stems)
    assert stems == {"grimpf", "zzork"}


def test_scores_tell_held_out_texts(taught):
    docs, _, model = taught
    toxic = {i: y for i, _, y in corpus()}
    got = g.scored(docs.filter("doc_id % 4 = 0"), model).collect()
    judged = [(r.predicted, toxic[r.doc_id]) for r in got if r.doc_id in toxic]
    assert len(judged) > 100 and all(p == y for p, y in judged)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_null_empty_repeated_rows_and_clashing_names(spark, taught):
    model = taught[2]
    rows = [(1, None), (2, ""), (3, "grimpf zzork"), (3, "grimpf zzork"), (None, "word")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "predicted": F.lit(3), "_t": F.lit(4)})
    got = g.scored(df, model, keep=("doc_id", "_t"))
    assert got.columns == ["doc_id", "_t", "score", "predicted", "clauses"]
    got = Counter((r.doc_id, r.predicted) for r in got.collect())
    assert got == {(1, 0): 1, (2, 0): 1, (3, 1): 2, (None, 0): 1}
    assert g.scored(df.limit(0), model).collect() == []


def test_without_labels_the_prior_stays(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    for rows in ([], [(1, 0)], [(1, 1)], [(2, 1)]):
        model = g.fit(g.labelled(docs, spark.createDataFrame(rows, "doc_id long, toxic int"), F.lit(True)))
        assert model.weights == g.PRIOR and not model.stems
        assert [r.predicted for r in g.scored(docs, model).collect()] == [0]


def test_weights_have_the_largest_posterior():
    rows = {((0, 0, 0, 0, 0), 0): 90, ((6, 0, 0, 0, 0), 0): 5, ((8, 0, 0, 0, 0), 1): 20, ((0, 9, 0, 0, 0), 1): 4, ((6, 0, 0, 0, 0), 1): 2}

    def loss(w):
        z = lambda f: w[0] + sum(a * b for a, b in zip(w[1:], f, strict=True))
        return sum(n * math.log1p(math.exp(-z(f) if y else z(f))) for (f, y), n in rows.items()) + sum((a - b) ** 2 for a, b in zip(w, g.PRIOR, strict=True)) / 8

    w = g.logistic(rows)
    for i in range(6):
        for d in (-0.01, 0.01):
            assert loss([x + d * (i == j) for j, x in enumerate(w)]) > loss(w)


def test_query_tells_held_out_documents(spark, sf_dir):
    from lattica.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op12_clause_grammar"](spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    judged = [got[r.doc_id].predicted == r.toxic for r in labels if got[r.doc_id].held_out]
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert sum(judged) >= 0.9 * len(judged)
