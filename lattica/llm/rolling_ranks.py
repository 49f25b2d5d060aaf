"""Counts, sums, distinct labels and rank statistics of rolling time windows, by blocks aligned to the window's width.

Time is cut into blocks as wide as the window, so a window [e - W, e) is a
suffix of one block and a prefix of the next.  Every block has two persistent
sorted trees over its values: one grows with time (each version is a prefix),
one against it (each version is a suffix).  The value of a rank in a window is
found by going down both trees at once, always to the side that holds the
rank.  A row is therefore in two trees a width, however many windows hold it.

Rows that share key, time and value are counted before they move.  A group is
one key and two neighbouring blocks, so a key that holds most rows is many
groups.  A group above ``most`` counted rows is dealt out once more by ranges
of its values: each part tells how much of every window it holds, that places
each rank in one part, and only this part's trees are searched for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import fresh, store

SUFFIX, PREFIX, LABELS, QUERY = range(4)
GROUP = ("w", "key", "block", "part")


def forest(tree, code, count, depth: int):
    """Persistent binary trees over ``code`` < 2^depth, one per ``tree``; item i, in insertion order by tree, makes version i.

    An insertion makes one node per level and shares all others with the
    version before.  Returns for each level d the counts below node (d, i), and
    for levels before the last the node of level d + 1 on either side (-1: none).
    """
    import numpy as np

    n = len(tree)
    at = np.arange(n)
    counts, sides = [], []
    for d in range(depth + 1):
        prefix = (tree << d) | (code >> (depth - d))
        order = np.argsort(prefix, kind="stable")
        ran = np.cumsum(count[order])
        new = np.flatnonzero(np.r_[True, prefix[order][1:] != prefix[order][:-1]]) if n else at
        before = np.zeros(n, np.int64)
        before[order] = ran - np.repeat((ran - count[order])[new], np.diff(np.r_[new, n]))
        counts.append(before)
        if d:
            keyed = prefix[order] * n + order  # ascending: by prefix, then by age
            other = prefix ^ 1
            found = np.searchsorted(keyed, other * n + at) - 1
            hit = (found >= 0) & (keyed[np.maximum(found, 0)] // max(n, 1) == other)
            far = np.where(hit, order[np.maximum(found, 0)], -1)
            right = (prefix & 1).astype(bool)
            sides.append((np.where(right, far, at), np.where(right, at, far)))
    return counts, sides


def select(counts, sides, one, two, rank):
    """The code of each ``rank`` (from 1) in the union of versions ``one`` and ``two`` (-1: empty), both trees at once."""
    import numpy as np

    code, one, two, rank = np.zeros(len(rank), np.int64), one.copy(), two.copy(), rank.copy()
    step = lambda child, node: np.where(node >= 0, child[np.maximum(node, 0)], -1)
    held = lambda count, node: np.where(node >= 0, count[np.maximum(node, 0)], 0)
    for d, (left, right) in enumerate(sides):
        l1, l2 = step(left, one), step(left, two)
        below = held(counts[d + 1], l1) + held(counts[d + 1], l2)
        go = rank > below
        rank = np.where(go, rank - below, rank)
        one, two = np.where(go, step(right, one), l1), np.where(go, step(right, two), l2)
        code = (code << 1) | go
    return code


def _windows(g, w, parts, side, place, value, has, n, r1, r2, has1, has2, ranks):
    """Per query row: counts, sums, labels and ranks; rows come by group ``g``, side and place."""
    import numpy as np

    item = side <= PREFIX
    q = np.flatnonzero(side == QUERY)
    wide = int(w.max()) + 2
    items = np.flatnonzero(item)
    tree = 2 * g[items] + side[items]
    keyed = tree * wide + place[items]

    def version(which, upto, tree, keyed, how):
        at = 2 * g[q] + which
        i = np.searchsorted(keyed, at * wide + upto, how) - 1
        return np.where((i >= 0) & (tree[np.maximum(i, 0)] == at), i, -1) if len(tree) else np.full(len(q), -1)

    def both(tree, keyed):  # places of the suffix tree run against time
        return version(SUFFIX, w[q] - 1 - place[q], tree, keyed, "right"), version(PREFIX, place[q], tree, keyed, "left")

    def total(x, tree, roots):
        if not len(x):
            return np.zeros(len(q), np.int64)
        ran = np.cumsum(x)
        first = np.r_[True, tree[1:] != tree[:-1]]
        base = np.repeat((ran - x)[first], np.diff(np.r_[np.flatnonzero(first), len(x)]))
        return sum(np.where(i >= 0, (ran - base)[np.maximum(i, 0)], 0) for i in roots)

    roots = both(tree, keyed)
    n_events = total(n[items], tree, roots)
    valued = items[has[items]]
    tree = 2 * g[valued] + side[valued]
    keyed = tree * wide + place[valued]
    roots = both(tree, keyed)
    m = total(n[valued], tree, roots)
    sums = total(n[valued] * value[valued], tree, roots)
    codes, code = np.unique(value[valued], return_inverse=True)
    built = forest(tree, code.astype(np.int64), n[valued], max(1, int(len(codes) - 1).bit_length())) if len(valued) else None
    found = []
    for (num, den), asked, given in zip(ranks, (r1, r2), (has1, has2), strict=True):
        r = np.where(given[q], asked[q], np.where(parts[q] == 1, -(-m * num // den), 0))
        ok = (r > 0) & (r <= m)
        out = np.zeros(len(q), np.int64)
        if built is not None and ok.any():
            out[ok] = codes[select(*built, roots[0][ok], roots[1][ok], r[ok])]
        found.append((out, ok))
    deltas = np.flatnonzero(side == LABELS)
    tree = 2 * g[deltas]
    at = version(SUFFIX, place[q], tree, tree * wide + place[deltas], "right")
    return q, n_events, m, sums, total(n[deltas], tree, [at]), found


def _searched(stream: DataFrame, ranks) -> DataFrame:
    """Answers of the query rows in ``stream``, each group's rows together in one task, by batches of whole groups."""
    dealt = stream.repartition(*GROUP).sortWithinPartitions(*GROUP, "side", "place", "value")
    key = stream.schema["key"].dataType.simpleString()
    ranks = tuple(ranks)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def bounds(t):
            codes = t.column("key").combine_chunks().dictionary_encode()
            codes = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for c in (codes, *(t.column(f).to_numpy() for f in ("w", "block", "part"))):
                new[1:] |= c[1:] != c[:-1]
            return new

        def answers(t, new):
            full = lambda f: t.column(f).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            there = lambda f: t.column(f).combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            q, n, m, s, labels, found = _windows(np.cumsum(new) - 1, full("w"), full("parts"), full("side"), full("place"), full("value"), there("value"), full("n"), full("r1"), full("r2"), there("r1"), there("r2"), ranks)
            if not len(q):
                return None
            asked = t.take(pa.array(q))
            cols = [asked.column(f).combine_chunks() for f in ("key", "w", "block", "part", "parts")]
            cols += [pa.array(asked.column("block").to_numpy() * asked.column("w").to_numpy() + asked.column("place").to_numpy())]
            cols += [pa.array(x, pa.int64()) for x in (n, m, s, labels)] + [pa.array(v, pa.int64(), mask=~ok) for v, ok in found]
            return pa.RecordBatch.from_arrays(cols, names=["key", "w", "block", "part", "parts", "t", "n", "m", "sum", "labels", "v1", "v2"])

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            new = bounds(t)
            last = int(np.flatnonzero(new)[-1])
            held = t.slice(last)
            if last and (out := answers(t.slice(0, last), new[:last])):
                yield out
        if held is not None and (out := answers(held, bounds(held))):
            yield out

    return dealt.mapInArrow(run, f"key {key}, w long, block long, part int, parts int, t long, n long, m long, sum long, labels long, v1 long, v2 long")


def _laid(rows: DataFrame, widths: Sequence[int]) -> DataFrame:
    """Each row once per width: w, its block and the offset in it."""
    out = rows.withColumn("w", F.explode(F.array(*[F.lit(int(w)).cast("long") for w in widths])))
    out = out.withColumn("off", F.pmod("t", "w"))
    return out.withColumn("block", F.expr("(t - off) div w"))


def _items(rows: DataFrame, widths) -> DataFrame:
    """Counted rows in the group of their own block, as prefix, and in the next one's, as suffix."""
    laid = _laid(rows, widths)
    sides = F.explode(F.array(F.struct(F.lit(PREFIX).alias("side"), F.col("block").alias("b"), F.col("off").alias("place")), F.struct(F.lit(SUFFIX).alias("side"), (F.col("block") + 1).alias("b"), (F.col("w") - 1 - F.col("off")).alias("place"))))
    return laid.withColumn("s", sides).select("w", "key", F.col("s.b").alias("block"), F.col("s.side").alias("side"), F.col("s.place").alias("place"), "value", "n")


def _label_changes(rows: DataFrame, widths) -> DataFrame:
    """How the number of distinct labels changes with the query's place in its block.

    A label of the block before counts up to its last place there, one of the
    own block from its first place on, so two numbers a label do.
    """
    laid = _laid(rows.filter(F.col("label").isNotNull()).select("key", "t", "label"), widths)
    sides = F.explode(F.array(F.struct(F.col("block").alias("b"), F.col("off").alias("first"), F.lit(None).cast("long").alias("last")), F.struct((F.col("block") + 1).alias("b"), F.lit(None).cast("long").alias("first"), F.col("off").alias("last"))))
    each = laid.withColumn("s", sides).groupBy("w", "key", F.col("s.b").alias("block"), "label").agg(F.min("s.first").alias("first"), F.max("s.last").alias("last"))
    change = lambda place, by: F.struct(place.alias("place"), F.lit(by).cast("long").alias("n"))
    through = F.col("last") >= F.col("first")
    changes = F.concat(
        F.when(F.col("last").isNotNull(), F.array(change(F.lit(0).cast("long"), 1))).otherwise(F.array()),
        F.when(F.col("last").isNotNull() & ~F.coalesce(through, F.lit(False)), F.array(change(F.col("last") + 1, -1))).otherwise(F.array()),
        F.when(F.col("first").isNotNull() & ~F.coalesce(through, F.lit(False)), F.array(change(F.col("first") + 1, 1))).otherwise(F.array()),
    )
    return each.withColumn("c", F.explode(changes)).groupBy("w", "key", "block", F.col("c.place").alias("place")).agg(F.sum("c.n").alias("n"))


def _stream(items: DataFrame | None, changes: DataFrame | None, queries: DataFrame) -> DataFrame:
    none = lambda kind="long": F.lit(None).cast(kind)
    out = queries.select("w", "key", "block", "part", "parts", F.lit(QUERY).alias("side"), "place", none().alias("value"), F.lit(0).cast("long").alias("n"), "r1", "r2")
    for kind in (items, changes):
        if kind is not None:
            out = out.unionByName(kind.withColumn("r1", none()).withColumn("r2", none()))
    return out


def window_ranks(rows: DataFrame, widths: Sequence[int], *, ranks: Sequence[tuple[int, int]] = ((1, 2), (90, 100)), most: int = 200_000) -> DataFrame:
    """For each distinct (key, t) of rows (key, t, value, label) and each width w: n, m, sum, labels, v1, v2 of the window t - w <= time < t.

    n counts all rows, m those with a value, sum adds values (0 without any),
    labels counts distinct non-null labels, and v1, v2 are the values of ranks
    ceil(m * num / den), counted from 1 (null without values).  A null key is a
    key; rows without a time are in no window and get none.  t, value and w are
    whole numbers; t may be negative.
    """
    rows = rows.filter(F.col("t").isNotNull())
    counted = store(rows.groupBy("key", "t", "value").agg(F.count(F.lit(1)).alias("n")), "counted")
    items = _items(counted, widths)
    one = lambda df: df.withColumn("part", F.lit(0)).withColumn("parts", F.lit(1))
    asked = _laid(counted.select("key", "t").distinct(), widths).select("w", "key", "block", F.col("off").alias("place")).withColumn("r1", F.lit(None).cast("long")).withColumn("r2", F.lit(None).cast("long"))
    changes = _label_changes(rows, widths).withColumn("side", F.lit(LABELS)).withColumn("value", F.lit(None).cast("long"))
    large = store(_large(items, most), "large")
    if large.isEmpty():
        found = _searched(_stream(one(items), one(changes), one(asked)), ranks)
        return found.select("key", "w", "t", "n", "m", "sum", "labels", "v1", "v2")

    dealt = _dealt(items, large)
    parts = lambda df: _with_cuts(df, large).withColumn("parts", F.size("cuts") + 1)
    everywhere = parts(asked).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("cuts")
    first = store(_searched(_stream(dealt, parts(changes).withColumn("part", F.lit(0)).drop("cuts"), everywhere), ranks), "held")
    whole = first.filter("parts = 1").select("key", "w", "t", "n", "m", "sum", "labels", "v1", "v2")
    placed = _placed(first.filter("parts > 1"), ranks)
    sought = placed.withColumn("s", F.explode("sought")).select("w", "key", "block", F.col("s.part").alias("part"), F.lit(2).alias("parts"), F.expr("t - block * w").alias("place"), F.col("s.r1").alias("r1"), F.col("s.r2").alias("r2"))
    again = _searched(_stream(dealt.filter("parts > 1"), None, sought), ranks)
    values = again.groupBy("key", "w", "t").agg(F.max("v1").alias("v1"), F.max("v2").alias("v2")).select(F.col("key").alias("k"), F.col("w").alias("kw"), F.col("t").alias("kt"), "v1", "v2")
    cut = placed.join(values, F.col("key").eqNullSafe(F.col("k")) & (F.col("w") == F.col("kw")) & (F.col("t") == F.col("kt")), "left")
    return whole.unionByName(cut.select("key", "w", "t", "n", "m", "sum", "labels", "v1", "v2"))


def _large(items: DataFrame, most: int) -> DataFrame:
    """Groups above ``most`` counted rows, with the values that cut them into parts of about that size."""
    sized = items.groupBy("w", "key", "block").agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx("value", [i / 64 for i in range(1, 64)], 10_000).alias("marks"))
    step = F.greatest(F.lit(1), F.floor(F.lit(64) * most / F.col("rows"))).cast("int")
    cuts = F.array_distinct(F.filter(F.coalesce("marks", F.array().cast("array<long>")), lambda x, i: F.pmod(i + 1, step) == 0))
    return sized.filter(F.col("rows") > most).select("w", "key", "block", cuts.alias("cuts"))


def _with_cuts(df: DataFrame, large: DataFrame) -> DataFrame:
    l = large.select(F.col("w").alias("lw"), F.col("key").alias("lk"), F.col("block").alias("lb"), "cuts")  # noqa: E741
    out = df.join(l, (F.col("w") == F.col("lw")) & F.col("key").eqNullSafe(F.col("lk")) & (F.col("block") == F.col("lb")), "left").drop("lw", "lk", "lb")
    return out.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<long>")))


def _dealt(items: DataFrame, large: DataFrame) -> DataFrame:
    """Items with the part their value lies in; rows without a value go to the first."""
    cut = _with_cuts(items, large)
    part = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("value"))), F.lit(0))
    return cut.withColumn("part", F.when(F.col("value").isNull(), 0).otherwise(part)).withColumn("parts", F.size("cuts") + 1).drop("cuts")


def _placed(held: DataFrame, ranks) -> DataFrame:
    """Totals of windows cut into parts, and for each rank the part that holds it and the rank in there."""
    summed = held.groupBy("key", "w", "block", "t").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("sum").alias("sum"), F.sum("labels").alias("labels"), F.sort_array(F.collect_list(F.struct("part", F.col("m").alias("own")))).alias("own"))
    each = []
    for k, (num, den) in enumerate(ranks, 1):
        rank = f"((m * {num} + {den - 1}) div {den})"
        steps = f"aggregate(own, named_struct('left', {rank}, 'part', -1, 'rank', 0L), (a, x) -> CASE WHEN a.part >= 0 THEN a WHEN a.left <= x.own AND a.left > 0 THEN named_struct('left', a.left, 'part', x.part, 'rank', a.left) ELSE named_struct('left', a.left - x.own, 'part', -1, 'rank', 0L) END)"
        summed = summed.withColumn(f"p{k}", F.expr(steps))
        each.append(F.struct(F.col(f"p{k}.part").alias("part"), *[(F.col(f"p{k}.rank") if j == k else F.lit(None).cast("long")).alias(f"r{j}") for j in (1, 2)]))
    return summed.withColumn("sought", F.filter(F.array(*each), lambda s: s["part"] >= 0))


def rolling_features(docs: DataFrame, widths: Sequence[int], *, key: str = "source", time: str = "event_s", value: str = "length", label: str = "lang", keep: Sequence[str] = ("doc_id",), most: int = 200_000) -> DataFrame:
    """One row per row of ``docs`` and width: ``keep``, window_s, ``time``, n_events, sum_chars, n_langs, median_chars, high_chars.

    Windows end before the row's own time (``window_ranks``).  A row without a
    time has empty windows: counts 0, ranks null.  Repeated rows each count and
    each get their rows, an empty table gives none; columns not named go, so
    clashing names cannot matter.
    """
    names = fresh([*keep, time], "k", "v", "l")
    slim = store(docs.select(*keep, F.col(time).cast("long").alias(time), F.col(key).alias(names["k"]), F.col(value).cast("long").alias(names["v"]), F.col(label).alias(names["l"])), "slim")
    rows = slim.select(F.col(names["k"]).alias("key"), F.col(time).alias("t"), F.col(names["v"]).alias("value"), F.col(names["l"]).alias("label"))
    got = window_ranks(rows, widths, most=most)
    as_array = got.groupBy("key", "t").agg(F.sort_array(F.collect_list(F.struct("w", "n", "sum", "labels", "v1", "v2"))).alias("each"))
    g = as_array.select(F.col("key").alias("_key"), F.col("t").alias("_t"), "each")
    empty = F.array(*[F.struct(F.lit(int(w)).cast("long").alias("w"), *[F.lit(0).cast("long").alias(c) for c in ("n", "sum", "labels")], *[F.lit(None).cast("long").alias(c) for c in ("v1", "v2")]) for w in widths])
    out = slim.join(g, F.col(names["k"]).eqNullSafe(F.col("_key")) & (F.col(time) == F.col("_t")), "left").withColumn("_w", F.explode(F.coalesce("each", empty)))
    pick = {"n_events": "n", "sum_chars": "sum", "n_langs": "labels", "median_chars": "v1", "high_chars": "v2"}
    return out.select(*keep, F.col("_w.w").alias("window_s"), time, *[F.col(f"_w.{f}").alias(c) for c, f in pick.items()])
