"""Whole jobs on training text against brute force."""

import random
from collections import Counter

import pytest

from lattica.llm import window_log


def test_calls_that_share_a_log_find_what_earlier_ones_held(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    once = [[word() for _ in range(50)] for _ in range(4)]
    doc = lambda *parts: " ".join(w for p in parts for w in [word() for _ in range(40)] + p)
    calls = [
        [(1, doc(once[0])), (2, doc(once[1])), (3, None), (4, doc([]))],
        [(5, doc(once[0], once[2])), (6, doc(once[2])), (7, doc(once[3]))],
        [(8, doc(once[1], once[3])), (9, doc([])), (10, "short")],
        [(11, doc(once[3][:34])), (12, doc(once[0][10:45]))],
    ]
    log, past, width = window_log.FingerprintLog(), Counter(), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for at, rows in enumerate(calls):
            spark.conf.set("spark.sql.shuffle.partitions", str(3 + at))  # buckets stay those of the first call
            split = {i: (t or "").split() for i, t in rows}
            here = Counter(tuple(w[k : k + 35]) for w in split.values() for k in range(len(w) - 34))
            want = {}
            for i, w in split.items():
                gone = {k + j for k in range(len(w) - 34) if (here + past)[tuple(w[k : k + 35])] > 1 for j in range(35)}
                want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
            got = window_log.remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), log=log).collect()
            assert {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in got} == want
            assert at == 0 or sum(n for _, n, _ in want.values()) >= 35
            past += here
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert [len(level) for level in log.windows.levels] == [0, 0, 1]
    with pytest.raises(ValueError):
        window_log.remove_repeated_windows(spark.createDataFrame([], "doc_id long, text string"), width=20, gram=10, log=log)


def test_one_document_of_every_group_stays(spark):
    import corpus_pipeline as cp

    text = lambda key, *odd: " ".join(f"{key}{k}" for k in range(200)) + "".join(f" {x}" for x in odd)
    rows = [(1, text("a")), (1, text("a", "x")), (1, text("b")), (2, text("b", "y")), (None, text("c")), (None, text("c", "z")), (None, text("c", "w")), (None, text("d")), (3, text("d", "v")), (1, "too short"), (None, None), (None, "short"), (None, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, "").collect()]
    group = Counter((t or "").split("0")[0] for _, t in kept)
    assert group == {"a": 1, "b": 1, "c": 1, "d": 1, "too short": 1, "": 1, "short": 1}
    assert {i for i, t in kept if t and t[0] in "abd"} == {1, 3} and len(kept) == 7


def test_windows_that_share_one_hash_stay_apart():
    """Keys are two hashes: of windows whose first ones meet, only those whose second ones do are the same."""
    import numpy as np
    import pyarrow as pa

    from lattica.llm import chunks

    keys = np.array([[7, 1], [3, 9], [7, 2], [7, 1], [3, 9]], np.uint64)
    q = chunks.Question(keys, 4)
    assert len(q.keys) == 3 and (q.keys[q.place] == keys).all()
    assert sorted(zip(q.keys.tolist(), q.counts.tolist())) == [([3, 9], 2), ([7, 1], 2), ([7, 2], 1)]
    assert (q.first[q.place] == [0, 1, 2, 0, 1]).all()

    def verdict(rows):
        found = [r for b in window_log._verdict(True)(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]
        return {r["chunk"]: list(r["answer"]) for r in found}

    row = lambda chunk, *k: {"bucket": 0, "chunk": chunk, "keys": np.array(k, np.uint64).tobytes(), "many": bytes([1] * len(k))}
    assert verdict([row(1, (7, 1), (8, 1)), row(2, (7, 2), (8, 1))]) == {1: [0, 1], 2: [0, 1]}
    assert verdict([row(None, (7, 2), (9, 9)), row(1, (7, 1), (7, 2))]) == {1: [0, 1]}


def test_both_hashes_of_a_window_follow_its_words():
    import numpy as np

    from lattica.llm.sequences import word_hashes

    a, b = b"x y  the same five words here z", b"the\tsame five words here\nand more"
    ka, kb = (window_log.window_keys(t, word_hashes(t), 5) for t in (a, b))
    same = {tuple(k) for k in ka.tolist()} & {tuple(k) for k in kb.tolist()}
    assert same == {tuple(ka[2].tolist())} == {tuple(kb[0].tolist())}
    assert len(np.unique(np.concatenate([ka, kb])[:, 0])) == len(np.unique(np.concatenate([ka, kb])[:, 1])) == len(ka) + len(kb) - 1
    assert window_log.window_keys(b"", word_hashes(b""), 5).shape == (0, 2)
