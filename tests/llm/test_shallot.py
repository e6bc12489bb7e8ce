import hashlib

import numpy as np
import pandas as pd
import pytest

from settlelens.llm.queries import queries
from settlelens.llm.shallot import Geometry, assign, cluster_table, squared_distance
from tests.llm.conftest import SMALL

SCHEMA = "vec_id bigint, embedding array<double>, x int, a int, cluster int, label int"


def plain_clusters(ids, x, k=40, rounds=5, seed=2):
    """Lloyd's rounds over all distances."""
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), tuple(v)) for i, v in zip(ids, x.tolist(), strict=True) if i is not None)
    c = np.array([v for _, v in order[:k]], dtype=np.int64)
    for _ in range(rounds):
        a = np.array([squared_distance(np.broadcast_to(v, c.shape), c).argmin() for v in x])
        for j in range(len(c)):
            if (a == j).any():
                c[j] = x[a == j].sum(axis=0) // (a == j).sum()
    d = np.array([squared_distance(np.broadcast_to(v, c.shape), c) for v in x])
    return d.argmin(axis=1), d.min(axis=1), c


def check(out: pd.DataFrame, ids, x, **options):
    a, d, c = plain_clusters(ids, x, **options)
    want = pd.DataFrame({"vec_id": ids, "cluster": a, "distance": d})
    want["cluster_inertia"] = want.groupby("cluster")["distance"].transform("sum")
    want["inertia"] = d.sum()
    want["centroid_sha256"] = [hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest() for j in a]
    key = list(want.columns)
    plain = lambda f: sorted(repr([None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r]) for r in f[key].itertuples(index=False))
    assert plain(out) == plain(want)


def test_query_matches_plain_rounds(spark):
    data = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    x = np.floor(256 * np.stack(data["embedding"].to_numpy()).astype(float)).astype(np.int64)
    check(queries()["op13_centroid_clusters"](spark, SMALL).toPandas(), data["vec_id"].tolist(), x)


def test_ties_and_repeated_vectors(spark):
    # A grid of few whole numbers: many equal distances, repeated vectors and repeated ids.
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (300, 3))
    ids = [int(i) for i in rng.integers(0, 250, 299)] + [None]
    rows = [(i, [float(v) / 256 for v in r], 1, 2, 3, 4) for i, r in zip(ids, x.tolist(), strict=True)]
    out = cluster_table(spark.createDataFrame(rows, SCHEMA), centroids=7, rounds=4, dimensions=3).toPandas()
    check(out, ids, x, k=7, rounds=4)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_few_centroids(spark, k):
    x = np.arange(12).reshape(6, 2) ** 2
    rows = [(i, [float(v) / 256 for v in r], 1, 2, 3, 4) for i, r in enumerate(x.tolist())]
    out = cluster_table(spark.createDataFrame(rows, SCHEMA), centroids=k, rounds=3, dimensions=2).toPandas()
    check(out, list(range(6)), x, k=k, rounds=3)


def test_unusable_rows_go_and_an_empty_table_is_empty(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [1.0], [1.0, None], [nan, 1.0], [inf, 0.0], [-inf, 0.0], [1e300, 0.0], []]
    rows = [(i, v, 1, 2, 3, 4) for i, v in enumerate(bad)]
    both = spark.createDataFrame([*rows, (50, [0.5, 0.25], 1, 2, 3, 4), (51, [1.5, 0.25], 1, 2, 3, 4)], SCHEMA)
    out = cluster_table(both, dimensions=2).toPandas()
    assert sorted(out["vec_id"]) == [50, 51] and out["inertia"].tolist() == [0, 0]  # fewer vectors than centroids
    assert cluster_table(spark.createDataFrame(rows, SCHEMA), dimensions=2).count() == 0


def test_bounds_prune_most_distances_of_later_rounds():
    rng = np.random.default_rng(1)
    middles = rng.integers(-4000, 4000, (20, 16))
    x = (middles[rng.integers(0, 20, 5000)] + rng.integers(-30, 30, (5000, 16))).astype(np.int64)
    start = np.full(len(x), -1)
    state = assign(x, start, start, np.full(len(x), np.inf), np.zeros(len(x)), Geometry(middles, None))
    nearest = np.array([squared_distance(np.broadcast_to(v, middles.shape), middles).argmin() for v in x])
    assert (state[0] == nearest).all()
    moved = middles + 1
    g = Geometry(moved, middles)
    upper, lower = state[2] + g.step[state[0]], state[3] - g.others[state[0]]
    assert (upper < np.maximum(lower, g.half[state[0]])).mean() > 0.99
    again = assign(x, *state, g)
    assert (again[0] == np.array([squared_distance(np.broadcast_to(v, moved.shape), moved).argmin() for v in x])).all()
