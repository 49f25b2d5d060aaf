"""Ball k-means, rolling window ranks and the clause grammar against plain loops."""

import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import ball_kmeans, rolling_ranks
from lattica.llm.queries import ORACLES, QUERIES


def vectors(n=300, dims=4, seed=5, spread=3):
    rng = random.Random(seed)
    rows = [(i, [float(rng.randint(-2, 2) * spread + rng.randint(0, 3)) / 4 for _ in range(dims)]) for i in range(n)]
    rows += [rows[0], rows[0], (7, rows[9][1]), (None, rows[1][1]), (900, None), (901, [1.0] * (dims - 1)), (902, [math.nan] * dims), (903, [math.inf] + [0.0] * (dims - 1)), (904, [None] + [0.0] * (dims - 1)), (905, [])]
    return rows


def plain_kmeans(rows, k, rounds, scale, seed, dims):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted((sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        got = [nearest(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), g in zip(kept, got, strict=True) if g == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [(i, *nearest(v)) for i, v in kept]
    total = Counter()
    for _, d, j in last:
        total[j] += d
    return Counter((i, j, d, total[j], sum(total.values()), sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in last)


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (3, 2), (1, 1), (500, 3)])
def test_ball_kmeans_is_plain_kmeans(spark, k, rounds):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "q": F.lit(1), "key": F.lit("k"), "distance": F.lit(2)}).repartition(3)
    got = ball_kmeans.centroid_clusters(df, k=k, rounds=rounds, dims=4, scale=4)
    assert Counter(map(tuple, got.collect())) == plain_kmeans(rows, k, rounds, 4, 3, 4)


def test_ball_kmeans_compares_few(spark):
    rng = np.random.default_rng(1)
    middles = rng.integers(-4000, 4000, (8, 16))
    rows = [(i, [int(x) for x in middles[i % 8] + rng.integers(-60, 60, 16)]) for i in range(1600)]
    df = spark.createDataFrame(rows, "key long, q array<int>")
    done = ball_kmeans.cluster(df, [r[1] for r in rows[:8]], rounds=6)
    assert done.compared[0] == 1600 * 8
    assert all(n <= 1600 for n in done.compared[1:])  # cores meet their own centroid, balls at rest nothing
    assert done.rows.filter("cluster != key % 8").count() == 0


def test_balls_keep_every_near_centroid():
    rng = np.random.default_rng(2)
    for _ in range(40):
        q = rng.integers(-9, 9, (60, 2)).astype(np.int64)
        old = [tuple(map(int, c)) for c in rng.integers(-9, 9, (5, 2))]
        best, dist, _ = ball_kmeans.assign(q, None, None, ball_kmeans.Balls(tuple(old)))
        new = [tuple(int(x) for x in q[best == j].sum(axis=0) // (best == j).sum()) if (best == j).any() else old[j] for j in range(5)]
        plan = ball_kmeans.balls(old, new, [int(dist[best == j].max(initial=0)) for j in range(5)])
        got, far, _ = ball_kmeans.assign(q, best, dist, plan)
        want = [min((ball_kmeans.squared(list(map(int, x)), c), j) for j, c in enumerate(new)) for x in q]
        assert [(int(d), int(j)) for d, j in zip(far, got, strict=True)] == want


def test_vectors_out_of_range_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond the range"):
        ball_kmeans.centroid_clusters(df, k=1, dims=2).collect()


def test_no_vectors(spark):
    for rows in ([], [(1, None)]):
        got = ball_kmeans.centroid_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=8)
        assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def moments(n=400, seed=8):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, rng.randint(-300, 900)]) if i % 9 == 0 else rng.randint(-300, 900), rng.choice([0, 5, 7, 7, 12, None, rng.randint(0, 4000)]), rng.choice(["en", "de", "fr", None])) for i in range(n)]
    return rows + [rows[3], rows[3], (None, "a", 40, 9, "es"), (5000, None, None, 3, None)]


def plain_windows(rows, widths):
    out = Counter()
    for i, s, e, _, _ in rows:
        for w in widths:
            seen = [] if e is None else [r for r in rows if r[1] == s and r[2] is not None and e - w <= r[2] < e]
            v = sorted(r[3] for r in seen if r[3] is not None)
            rank = lambda num, den: v[-(-len(v) * num // den) - 1] if v else None  # noqa: B023, E731
            out[(i, w, e, len(seen), sum(v), len({r[4] for r in seen} - {None}), rank(1, 2), rank(90, 100))] += 1
    return out


@pytest.mark.parametrize("most", [200_000, 60, 5])
def test_rolling_features_against_plain_windows(spark, most):
    rows = moments()
    df = spark.createDataFrame(rows, "doc_id long, source string, event_s long, length long, lang string").withColumns({"w": F.lit("x"), "key": F.lit(1), "t": F.lit(2), "each": F.lit(3), "_w": F.lit(4)}).repartition(3)
    got = rolling_ranks.rolling_features(df, (50, 600), most=most)
    assert got.columns == ["doc_id", "window_s", "event_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars"]
    assert Counter(map(tuple, got.collect())) == plain_windows(rows, (50, 600))


def test_two_trees_select_every_rank():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        tree = np.sort(rng.integers(0, 2, n))
        code, count = rng.integers(0, 8, n), rng.integers(1, 4, n)
        counts, sides = rolling_ranks.forest(tree, code, count, 3)
        ends = [np.flatnonzero(tree == t) for t in (0, 1)]
        one, two = (int(rng.choice(np.r_[e, -1])) for e in ends)
        held = np.sort(np.concatenate([np.repeat(code[e[: np.searchsorted(e, v, "right")]], count[e[: np.searchsorted(e, v, "right")]]) for e, v in zip(ends, (one, two), strict=True)]))
        ranks = np.arange(1, len(held) + 1)
        got = rolling_ranks.select(counts, sides, np.full(len(held), one), np.full(len(held), two), ranks)
        assert got.tolist() == held.tolist()


def test_no_moments(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, event_s long, length long, lang string")
    assert rolling_ranks.rolling_features(empty, (50, 600)).collect() == []


def test_times_are_those_of_the_contract(spark, sf_dir):
    got = {(r.doc_id, r.event_s) for r in QUERIES["op13_rolling_ranks"](spark, sf_dir).collect()}
    ids = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    assert got == {(i, 60 * ((i + zlib.crc32(str(i).encode()) % 10_000) // 6)) for i in ids}


def test_twins_are_registered():
    assert {"op11_ball_kmeans", "op13_rolling_ranks"} <= ORACLES.keys()
