from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from settlelens.llm.feast import bracket, contour_pairs, count_above, largest_pairs
from settlelens.llm.queries import queries
from settlelens.llm.whitening import whitened
from tests.llm.conftest import SMALL

SCHEMA = "vec_id bigint, embedding array<double>, x int, n int, component int, label int"


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, [float(v) / 256 for v in r], 1, 2, 3, 4) for i, r in zip(ids, x, strict=True)], SCHEMA)


def check(out: pd.DataFrame, ids, x, components=4):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    v = np.cov(fit.T.astype(float), bias=True).reshape(x.shape[1], x.shape[1])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    e, q = e[e > 1e-9 * v.trace()], q[:, : (e > 1e-9 * v.trace()).sum()]
    assert len(out) == len(x) * len(e) and (out["n"] == n).all()
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9
    w = (x - sums / n) @ q / np.sqrt(e)
    for k in range(len(e)):
        part = out[out["component"] == k + 1].set_index("vec_id")
        assert np.allclose(part["explained"], e[k] / v.trace(), rtol=1e-9)
        got = part.loc[ids, "whitened"].to_numpy()
        sign = np.sign(got @ w[:, k])
        assert np.abs(got - sign * w[:, k]).max() < 1e-6
        exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
        assert part.loc[ids, "deviation"].tolist() == exact
        assert part.loc[ids, "deviation_digits"].tolist() == [str(d) for d in exact]


def test_query_matches_dense_solver(spark):
    data = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    x = np.floor(256 * np.stack(data["embedding"].to_numpy()).astype(float)).astype(np.int64)
    check(queries()["op11_embedding_whitening"](spark, SMALL).toPandas(), data["vec_id"].tolist(), x)


def test_repeated_vectors_count_once_in_the_fit(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-300, 300, (40, 6))
    x = np.concatenate((base, base[:7], base[:1], base[:1]))
    check(whitened(frame(spark, x.tolist())).toPandas(), list(range(len(x))), x)


def test_fewer_dimensions_and_no_variance(spark):
    x = np.array([[1, 5, 2], [3, 5, 4], [7, 5, 8], [2, 5, 3]])  # rank one: two components without variance
    check(whitened(frame(spark, x.tolist())).toPandas(), [0, 1, 2, 3], x)
    assert whitened(frame(spark, [[1, 2], [1, 2]])).count() == 0


def test_unusable_rows_and_other_lengths_go(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(6)
    x = rng.integers(-300, 300, (20, 4))
    bad = [None, [1.0], [None, 1.0, 1.0, 1.0], [nan, 1.0, 1.0, 1.0], [inf, 0.0, 1.0, 1.0], [1e300, 0.0, 1.0, 1.0], []]
    rows = spark.createDataFrame([(100 + i, b, 1, 2, 3, 4) for i, b in enumerate(bad)], SCHEMA)
    check(whitened(frame(spark, x.tolist()).union(rows)).toPandas(), list(range(20)), x)
    assert whitened(rows.where("vec_id < 101")).count() == 0
    assert whitened(rows.limit(0)).count() == 0


def test_deviation_beyond_a_long_is_null_and_whole_as_digits(spark):
    x = [[2**27 - 1, 0], [-(2**27), 1], [5, 7]] + [[i, -i] for i in range(40)]
    out = whitened(frame(spark, x)).toPandas()
    n, sums = 43, np.array(x).sum(axis=0)
    first = out[out["vec_id"] == 0].iloc[0]
    exact = sum((n * c - int(s)) ** 2 for c, s in zip(x[0], sums, strict=True))
    assert exact >= 2**63 and pd.isna(first["deviation"]) and first["deviation_digits"] == str(exact)


@pytest.mark.parametrize("kind", ["random", "flat", "twins", "close"])
def test_contour_integration_finds_all_pairs(kind):
    rng = np.random.default_rng(2)
    n = 30
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    e = {
        "random": np.sort(rng.uniform(0, 10, n))[::-1],
        "flat": np.full(n, 3.0),
        "twins": np.r_[5, 5, 5, 5, 5, np.linspace(1, 0, n - 5)],
        "close": 1000 + np.linspace(1, 0, n),
    }[kind]
    v = q @ np.diag(e) @ q.T
    v = (v + v.T) / 2
    values, vectors = largest_pairs(v, 4)
    assert np.allclose(values, np.sort(e)[::-1][:4], rtol=1e-12)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * np.abs(v).max() * n
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-13


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 25):
        a = rng.standard_normal((n, n))
        v = a + a.T
        v[rng.integers(n), :] *= 1e-3
        v = (v + v.T) / 2
        e = np.linalg.eigvalsh(v)
        for s in rng.uniform(e[0] - 1, e[-1] + 1, 20):
            assert count_above(v, s) == (e > s).sum()
    hollow = np.array([[0.0, 1.0], [1.0, 0.0]])  # needs a 2x2 pivot
    assert count_above(hollow, 0.0) == 1


def test_a_block_that_misses_some_is_seen_by_the_inertia():
    v = np.diag(np.r_[9.0, 8.0, 7.0, 6.0, np.linspace(1, 0, 20)])
    low, high, count = bracket(v, 4)
    found, _ = contour_pairs(v, low, high, 2, np.random.default_rng(0))
    assert count == 4 and len(found) < 4
    assert np.allclose(largest_pairs(v, 4)[0], [9, 8, 7, 6])


def test_covariance_is_the_exact_one(spark):
    from settlelens.llm.whitening import moments

    rng = np.random.default_rng(8)
    x = rng.integers(-(2**27), 2**27, (50, 3))
    fit = frame(spark, [[0]]).sparkSession.createDataFrame([(r,) for r in x.tolist()], "x array<int>")
    n, sums, v = moments(fit, 3)
    assert n == 50 and sums == x.sum(axis=0).tolist()
    for i in range(3):
        for j in range(3):
            exact = sum((Fraction(int(r[i])) - Fraction(sums[i], n)) * (Fraction(int(r[j])) - Fraction(sums[j], n)) for r in x) / n
            assert v[i, j] == float(exact)
