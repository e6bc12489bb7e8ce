"""Exact centroid clustering with Shallot search.

Lloyd's rounds on whole-number vectors. A vector remembers its nearest and its second-nearest centroid, an
upper bound of the distance to the first and a lower bound of the distance to all others; both are shifted
by how far centroids moved. While the upper bound lies under the lower one, or under half the way to the
next centroid, the nearest one cannot have changed. Otherwise the distances to the two remembered centroids
are worked out, the closer one is the middle of the search, and its neighbours are visited from near to far:
a centroid further from the middle than the vector's distance to the middle plus that to the second-nearest
one found so far cannot matter, and neither can those after it. The ball shrinks with every better second.
What survives the bounds is compared in whole numbers, squared distance first and centroid number next; the
bounds are rounded away from a decision, so a tie is never pruned.

On Spark: one row per vector with its bounds, rewritten to the shared folder each round (the table of the
round before is dropped); a round sends the centroids, which are few and fixed in number, to the tasks and
takes back one sum per centroid, component and partition. No shuffle carries vectors.

Edge cases. Rows go whose vector is null, has another number of components, or has null, non-finite or
huge entries (``vectors.integer_vectors``). A null id is kept but starts no centroid. Repeated rows are vectors of their own;
repeated ids order by their vectors when centroids start, so equal ones may start as equal centroids, of
which the smaller number gets the vectors. With fewer vectors than centroids there are as many centroids
as vectors. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlelens.llm.common import drop, written
from settlelens.llm.vectors import integer_vectors, matrix, partition_sums

CENTROIDS = 40
ROUNDS = 5
DIMENSIONS = 64
SEED = 2
UP, DOWN = 1 + 1e-12, 1 - 1e-12

STATE = "vec_id bigint, x array<int>, a int, b int, upper double, lower double"


class Geometry:
    """What a round needs to know of its centroids: they, their sorted neighbours, and how far each one moved."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None):
        self.now = now
        k = len(now)
        squared = np.array([[sum(int(v) ** 2 for v in p - q) for q in now] for p in now], dtype=np.float64)
        away = np.sqrt(squared)
        # Each centroid's neighbours from near to far, without itself.
        order = [sorted((j for j in range(k) if j != i), key=lambda j, i=i: (away[i, j], j)) for i in range(k)]
        self.order = np.array(order, dtype=np.int64).reshape(k, k - 1)
        self.reach = np.take_along_axis(away, self.order, axis=1) * DOWN
        self.half = self.reach[:, 0] / 2 * DOWN if k > 1 else np.full(k, np.inf)
        step = np.zeros(k) if before is None else np.sqrt(((now - before).astype(np.float64) ** 2).sum(axis=1)) * UP
        self.step = step
        self.others = np.array([max((step[j] for j in range(k) if j != i), default=0.0) for i in range(k)])


def squared_distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


def assign(x: np.ndarray, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray, g: Geometry):
    """The new (a, b, upper, lower) of the vectors ``x``. A negative ``a`` is a vector without a past."""
    a, b, upper, lower = a.copy(), b.copy(), upper.copy(), lower.copy()
    k = len(g.now)
    if k == 1:
        return np.zeros_like(a), np.full_like(b, -1), upper, lower
    new = a < 0
    a[new], b[new], upper[new], lower[new] = 0, 1, np.inf, 0.0
    upper = (upper + g.step[a]) * UP
    lower = np.maximum(lower - g.others[a], 0.0) * DOWN
    open_ = np.flatnonzero(upper >= np.maximum(lower, g.half[a]))
    if not len(open_):
        return a, b, upper, lower
    first = squared_distance(x[open_], g.now[a[open_]])
    upper[open_] = np.sqrt(first.astype(np.float64)) * UP
    still = upper[open_] >= np.maximum(lower[open_], g.half[a[open_]])
    open_, first = open_[still], first[still]
    if not len(open_):
        return a, b, upper, lower
    points = x[open_]
    best, second = a[open_].astype(np.int64), b[open_].astype(np.int64)
    best_d, second_d = first, squared_distance(points, g.now[second])
    swap = (second_d < best_d) | ((second_d == best_d) & (second < best))
    best, second = np.where(swap, second, best), np.where(swap, best, second)
    best_d, second_d = np.where(swap, second_d, best_d), np.where(swap, best_d, second_d)
    middle = best.copy()
    radius = np.sqrt(best_d.astype(np.float64)) * UP
    live = np.arange(len(open_))
    for p in range(k - 1):
        ball = (radius[live] + np.sqrt(second_d[live].astype(np.float64)) * UP) * UP
        live = live[g.reach[middle[live], p] <= ball]
        if not len(live):
            break
        c = g.order[middle[live], p]
        fresh = (c != best[live]) & (c != second[live])
        at, c = live[fresh], c[fresh]
        d = squared_distance(points[at], g.now[c])
        first_now = (d < best_d[at]) | ((d == best_d[at]) & (c < best[at]))
        second_now = ~first_now & ((d < second_d[at]) | ((d == second_d[at]) & (c < second[at])))
        up = at[first_now]
        second[up], second_d[up] = best[up], best_d[up]
        best[up], best_d[up] = c[first_now], d[first_now]
        side = at[second_now]
        second[side], second_d[side] = c[second_now], d[second_now]
    a[open_], b[open_] = best, second
    upper[open_] = np.sqrt(best_d.astype(np.float64)) * UP
    lower[open_] = np.sqrt(second_d.astype(np.float64)) * DOWN
    return a, b, upper, lower


def _round(g: Geometry, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch["x"], dimensions)
            past = [batch[c].to_numpy(zero_copy_only=False) for c in ("a", "b", "upper", "lower")]
            a, b, upper, lower = assign(x, *past, g)
            fields = [batch["vec_id"], batch["x"], pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays(fields, ["vec_id", "x", "a", "b", "upper", "lower"])

    return run


def _cluster_sums(dimensions: int):
    """Adds (cluster, component) sums and, under component -1, counts."""

    def add(totals: dict, batch: pa.RecordBatch) -> None:
        x, a = matrix(batch["x"], dimensions), batch["a"].to_numpy()
        order = np.argsort(a, kind="stable")
        clusters, starts, counts = np.unique(a[order], return_index=True, return_counts=True)
        sums = np.add.reduceat(x[order], starts, axis=0)
        for c, n, row in zip(clusters.tolist(), counts.tolist(), sums.tolist(), strict=True):
            totals[c, -1] = totals.get((c, -1), 0) + n
            for i, v in enumerate(row):
                totals[c, i] = totals.get((c, i), 0) + v

    return add


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each cluster; a centroid without vectors stays."""
    k, dimensions = centroids.shape
    totals = partition_sums(state.select("x", "a"), dimensions, _cluster_sums(dimensions)).collect()  # k * (d + 1) rows
    by_key = {(r["a"], r["b"]): int(r["total"]) for r in totals}
    out = centroids.copy()
    for c in range(k):
        if n := by_key.get((c, -1), 0):
            out[c] = [by_key[c, i] // n for i in range(dimensions)]
    return out


def _final(g: Geometry, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch["x"], dimensions)
            past = [batch[c].to_numpy(zero_copy_only=False) for c in ("a", "b", "upper", "lower")]
            a = assign(x, *past, g)[0].astype(np.int64)
            fields = [batch["vec_id"], pa.array(a.astype(np.int32)), pa.array(squared_distance(x, g.now[a]))]
            yield pa.RecordBatch.from_arrays(fields, ["vec_id", "cluster", "distance"])

    return run


def clusters(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every usable vector, distances squared, and the final centroids."""
    spark = vectors.sparkSession
    past = [F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower")]
    usable = integer_vectors(vectors, id_col, vector_col).where(F.size("x") == dimensions)
    state, path = written(usable.select("vec_id", "x", *past), "shallot-start")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    starts = state.where("vec_id IS NOT NULL").orderBy(key, "x").limit(centroids).select("x").collect()
    now = np.array([r["x"] for r in starts], dtype=np.int64).reshape(-1, dimensions)
    if not len(now):
        drop(spark, path)
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), now
    before = None
    for i in range(rounds):
        old = path
        state, path = written(state.mapInArrow(_round(Geometry(now, before), dimensions), STATE), f"shallot-{i}")
        drop(spark, old)
        before, now = now, _moved(state, now)
    last = state.mapInArrow(_final(Geometry(now, before), dimensions), "vec_id bigint, cluster int, distance bigint")
    out, _ = written(last, "shallot-clusters")
    drop(spark, path)
    return out, now


def centroid_digest(centroid) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def cluster_table(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    An inertia beyond the range of a long is null.
    """
    found, final = clusters(vectors, **options)
    spark = vectors.sparkSession
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row per centroid
    whole = sum(int(r["s"]) for r in sums)
    fit = lambda v: v if v < 2**63 else None
    rows = [(r["cluster"], fit(int(r["s"])), fit(whole), centroid_digest(final[r["cluster"]])) for r in sums]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
