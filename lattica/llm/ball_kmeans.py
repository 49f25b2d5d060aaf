"""Ball k-means over whole-number vectors: exact assignments by few comparisons.

A cluster is a ball: its centroid, and a radius no member lies beyond.  Only
centroids at most twice the radius away can take a member, so they alone are
its neighbours.  A member at less than half the way to the nearest neighbour
is in the stable core and is compared with nothing; the others lie in annuli,
and one in the m-th annulus is compared with the m nearest neighbours.  All
tests are on squared whole numbers, so nothing depends on rounding or on how
rows are dealt to tasks.

A round is one pass over stored rows: every task moves its rows and adds up
its own sums, both go into one written table, and the driver gets k x d sums
from however many rows.  A lost executor repeats its part of one round.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import drop_stored, store

#: Components reach no further, so that a squared distance of up to 256 of them fits a long.
REACH = 2**27


@dataclass(frozen=True)
class Balls:
    """Centroids, and for each ball the neighbours by distance; ``stay`` marks balls that no member can leave or be farther from.

    ``near`` is None before the first round, when every row meets every centroid.
    """

    centroids: tuple[tuple[int, ...], ...]
    near: tuple[tuple[tuple[int, int], ...], ...] | None = None
    stay: tuple[bool, ...] = ()


@dataclass(frozen=True)
class Clustering:
    """Rows (id, q, cluster, distance) and what holds for each cluster."""

    rows: DataFrame
    centroids: tuple[tuple[int, ...], ...]
    inertia: tuple[int, ...]
    compared: tuple[int, ...] = field(default=())

    def digest(self, j: int) -> str:
        return sha256(",".join(map(str, self.centroids[j])).encode()).hexdigest()


def quantised(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 1024) -> DataFrame:
    """Rows (key, q) of the vectors with ``dims`` components, none null or non-finite; q holds floor(scale * x) of each.

    Repeated rows stay, a null key is kept, all other columns go.  A component
    beyond ``REACH`` after scaling ends the job with an error, since squared
    distances would not fit a long.
    """
    v = F.col(vector)
    usable = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    small = F.forall(v, lambda x: F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(float(REACH)))
    q = F.when(small, whole.cast("array<int>")).otherwise(F.raise_error(F.lit("a component is beyond the range of whole-number distances")).cast("array<int>"))
    return vectors.filter(usable).select(F.col(key).alias("key"), q.alias("q"))


def starts(rows: DataFrame, k: int, order: Column) -> list[tuple[int, ...]]:
    """The ``k`` vectors that come first by ``order``, ties by their components."""
    first = rows.withColumn("_o", order).orderBy(F.col("_o").asc_nulls_last(), "q").limit(k)
    return [tuple(r["q"]) for r in sorted(first.collect(), key=lambda r: (r["_o"] is None, r["_o"], r["q"]))]


def squared(a: Sequence[int], b: Sequence[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def _ceil_root(n: int) -> int:
    return math.isqrt(n - 1) + 1 if n else 0


def balls(old: Sequence[Sequence[int]], new: Sequence[Sequence[int]], farthest: Sequence[int]) -> Balls:
    """The balls around ``new`` centroids, from the squared radii that members had around the ``old`` ones.

    A radius grows by no more than its centroid moves; roots are rounded up.
    """
    moved = [squared(a, b) for a, b in zip(old, new, strict=True)]
    near = []
    for i, c in enumerate(new):
        radius = _ceil_root(farthest[i]) + _ceil_root(moved[i])
        gaps = sorted((squared(c, o), j) for j, o in enumerate(new) if j != i)
        near.append(tuple(g for g in gaps if g[0] <= 4 * radius * radius))
    still = [not moved[i] and all(not moved[j] for _, j in near[i]) for i in range(len(new))]
    return Balls(tuple(map(tuple, new)), tuple(near), tuple(still))


def assign(q, cluster, distance, plan: Balls):
    """New (cluster, squared distance) of rows ``q`` and the number of distances computed; ties go to the smaller number."""
    import numpy as np

    cents = np.asarray(plan.centroids, np.int64)

    def to(rows, j):
        return ((q[rows] - cents[j]) ** 2).sum(axis=1)

    best, dist = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    if plan.near is None:
        rows = np.arange(len(q))
        for j in range(len(cents)):
            d = to(rows, j)
            better = (d < dist) if j else np.ones(len(q), bool)
            best[better], dist[better] = j, d[better]
        return best, dist, len(q) * len(cents)
    compared = 0
    for i in range(len(cents)):
        mine = np.flatnonzero(cluster == i)
        if not len(mine):
            continue
        best[mine] = i
        if plan.stay[i]:
            dist[mine] = distance[mine]
            continue
        own = to(mine, i)
        compared += len(mine)
        dist[mine] = own
        for gap, j in plan.near[i]:  # nearer neighbours first: each annulus lies inside the one before
            reach = 4 * own >= gap
            mine, own = mine[reach], own[reach]
            if not len(mine):
                break
            d = to(mine, j)
            compared += len(mine)
            better = (d < dist[mine]) | ((d == dist[mine]) & (j < best[mine]))
            at = mine[better]
            best[at], dist[at] = j, d[better]
    return best, dist, compared


def _pass(rows: DataFrame, plan: Balls, dims: int) -> DataFrame:
    """Rows with their new cluster and distance, and one row of sums per task and cluster (``part`` is true)."""
    shared = rows.sparkSession.sparkContext.broadcast(plan)  # k centroids and at most k x k gaps
    k, first = len(plan.centroids), plan.near is None
    key = rows.schema["key"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        plan = shared.value
        n, far, inertia, compared = [0] * k, [0] * k, [0] * k, 0
        sums = np.zeros((k, dims), np.int64)
        schema = None
        for b in batches:
            if not b.num_rows:
                continue
            q = b.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            was = (None, None) if first else (b.column("cluster").to_numpy(), b.column("distance").to_numpy())
            best, dist, done = assign(q, *was, plan)
            compared += done
            for j in np.unique(best):
                mine = best == j
                d = dist[mine]
                n[j] += len(d)
                far[j] = max(far[j], int(d.max()))
                inertia[j] += int(d.sum()) if int(d.max()) * len(d) < 2**62 else sum(map(int, d))
                sums[j] += q[mine].sum(axis=0)
            schema = schema or pa.schema([("part", pa.bool_()), ("key", b.schema.field("key").type), ("q", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("n", pa.int64()), ("inertia", pa.decimal128(38, 0)), ("sums", pa.list_(pa.int64())), ("compared", pa.int64())])
            nulls = lambda t, m=b.num_rows: pa.nulls(m, t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(b.num_rows, bool)), b.column("key"), b.column("q").cast(pa.list_(pa.int32())), pa.array(best, pa.int32()), pa.array(dist), *(nulls(schema.field(f).type) for f in ("n", "inertia", "sums", "compared"))],
                schema=schema,
            )
        if schema is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([True] * k), pa.nulls(k, schema.field("key").type), pa.nulls(k, schema.field("q").type), pa.array(range(k), pa.int32()), pa.array(far, pa.int64()), pa.array(n, pa.int64()), pa.array([Decimal(x) for x in inertia], pa.decimal128(38, 0)), pa.array(sums.tolist(), pa.list_(pa.int64())), pa.array([compared if j == 0 else 0 for j in range(k)], pa.int64())],
                schema=schema,
            )

    return rows.mapInArrow(run, f"part boolean, key {key}, q array<int>, cluster int, distance long, n long, inertia decimal(38,0), sums array<long>, compared long")


def _totals(done: DataFrame, k: int, dims: int) -> tuple[list, list, list, list, int]:
    """Counts, squared radii, inertias and sums of the clusters, from the sums of the tasks."""
    each = done.filter("part").select("cluster", "n", "distance", "inertia", "compared", F.posexplode("sums").alias("at", "s"))
    n, far, inertia, compared = [0] * k, [0] * k, [0] * k, 0
    sums = [[0] * dims for _ in range(k)]
    totals = each.groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"), F.sum("n").alias("n"), F.max("distance").alias("far"), F.sum("inertia").alias("inertia"), F.sum("compared").alias("compared"))
    for r in totals.collect():
        j = r["cluster"]
        sums[j][r["at"]] = int(r["s"])
        if r["at"] == 0:
            n[j], far[j], inertia[j], compared = r["n"], r["far"], int(r["inertia"]), compared + r["compared"]
    return n, far, inertia, sums, compared


def cluster(rows: DataFrame, centroids: Sequence[Sequence[int]], *, rounds: int = 10) -> Clustering:
    """``rounds`` times assign rows (key, q) to the nearest centroid and move every non-empty centroid to the floor of its rows' mean, then assign once more.

    Squared Euclidean distance, ties to the smaller number, empty centroids
    stay.  Equal rows get equal clusters.  Rounds end early once no centroid
    moves, since nothing changes from then on.  Without rows or centroids the
    result is empty.
    """
    spark = rows.sparkSession
    k, dims = len(centroids), len(centroids[0]) if centroids else 0
    if not k:
        none = rows.limit(0).select("key", "q", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clustering(none, (), ())
    plan, held, compared = Balls(tuple(map(tuple, centroids))), None, []
    for turn in range(rounds + 1):
        at = rows if held is None else held.filter("not part").select("key", "q", "cluster", "distance")
        done = store(_pass(at, plan, dims), "balls")
        if held is not None:
            drop_stored(held)
        held = done
        n, far, inertia, sums, met = _totals(done, k, dims)
        compared.append(met)
        if turn == rounds:
            break
        new = [tuple(s // n[j] for s in sums[j]) if n[j] else plan.centroids[j] for j in range(k)]
        if tuple(new) == plan.centroids:
            break
        plan = balls(plan.centroids, new, far)
    out = spark.read.schema(held.schema).parquet(held.stored_at).filter("not part").select("key", "q", "cluster", "distance")
    return Clustering(out, plan.centroids, tuple(inertia), tuple(compared))


def centroid_clusters(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """Each usable vector's cluster: key, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length, or hold a null or non-finite
    component are left out (``quantised``).  The first centroids are the ``k``
    vectors of least sha256 of ``seed:key`` (a null key counts as no text),
    ties by components; with fewer vectors there are fewer clusters.  Repeated
    rows each get a row, an empty table gives none, other columns are dropped.
    """
    rows = store(quantised(vectors, key=key, vector=vector, dims=dims, scale=scale), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    found = cluster(rows, starts(rows, k, order), rounds=rounds)
    drop_stored(rows)
    if not found.centroids:
        return found.rows.select(F.col("key").alias(key), F.col("cluster").cast("int"), "distance", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    each = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    return found.rows.select(
        F.col("key").alias(key),
        "cluster",
        "distance",
        each(found.inertia).cast("long").alias("cluster_inertia"),
        F.lit(sum(found.inertia)).cast("long").alias("inertia"),
        each([found.digest(j) for j in range(len(found.centroids))]).alias("centroid_sha256"),
    )
