"""Statistics against brute force on short series."""

import itertools
import math
import random

import numpy as np
import pytest

from settlelens.functions.joins import exact_percentiles
from settlelens.operators import stats as ST
from settlelens.plans import registered, stat_queries

SCHEMA = "series_id string, t long, y double"


def make(spark, **series):
    return spark.createDataFrame([(k, i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)], SCHEMA)


def test_pair_signs_match_all_pairs(spark):
    rng = random.Random(3)
    data = {f"s{n}": [rng.randint(0, max(1, n // 2)) for _ in range(n)] for n in (2, 3, 17, 64, 130)}
    got = {r.series_id: (r.rising, r.falling, r.tied) for r in ST.pair_signs(make(spark, **data)).collect()}
    for k, v in data.items():
        d = [b - a for a, b in itertools.combinations(v, 2)]
        assert got[k] == (sum(x > 0 for x in d), sum(x < 0 for x in d), sum(x == 0 for x in d))


def test_mann_kendall_edges(spark):
    got = {r.series_id: r for r in ST.mann_kendall(make(spark, flat=[1] * 10, up=range(10), ties=[1, 1, 2, 2, 3])).collect()}
    assert got["flat"].z == 0 and got["flat"].p_value == pytest.approx(1, abs=1e-6)
    assert got["up"].s == 45 and got["up"].z == pytest.approx(44 / math.sqrt(10 * 9 * 25 / 18))
    assert got["ties"].var_s == pytest.approx((5 * 4 * 15 - 2 * 2 * 9) / 18)
    assert got["up"].p_value == pytest.approx(math.erfc(got["up"].z / math.sqrt(2)), abs=1e-6)


def test_newey_west_matches_matrix_form(spark):
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(size=60)) + 0.1 * np.arange(60)
    r = ST.newey_west(make(spark, a=y), 5).first()
    x = np.column_stack([np.ones(60), np.arange(60)])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    g = x * e[:, None]
    s = g.T @ g
    for lag in range(1, 6):
        c = g[lag:].T @ g[:-lag]
        s += (1 - lag / 6) * (c + c.T)
    inv = np.linalg.inv(x.T @ x)
    v = inv @ s @ inv
    assert r.slope == pytest.approx(b[1]) and r.slope_se == pytest.approx(math.sqrt(v[1, 1]))
    assert r.intercept_se == pytest.approx(math.sqrt(v[0, 0]))


def brute_breaks(y, m, h):
    best = (math.inf, None)
    for cuts in itertools.combinations(range(h, len(y) - h + 1), m):
        edges = (0, *cuts, len(y))
        if all(b - a >= h for a, b in zip(edges, edges[1:])):
            ssr = sum(float(((y[a:b] - y[a:b].mean()) ** 2).sum()) for a, b in zip(edges, edges[1:]))
            best = min(best, (ssr, cuts))
    return best


def test_break_dates_match_brute_force(spark):
    rng = np.random.default_rng(5)
    y = np.concatenate([rng.normal(0, 1, 15), rng.normal(4, 1, 12), rng.normal(1, 1, 14)])
    out = ST.break_dates(make(spark, a=y), 3, 5).collect()
    for m in (1, 2, 3):
        ssr, cuts = brute_breaks(y, m, 5)
        mine = sorted((r.break_no, r.break_t, r.ssr) for r in out if r.n_breaks == m)
        assert [t for _, t, _ in mine] == list(cuts) and mine[0][2] == pytest.approx(ssr)


def test_chosen_breaks_find_a_step_and_none_in_noise(spark):
    rng = np.random.default_rng(2)
    noise = rng.normal(0, 0.1, 80)
    s = make(spark, step=np.where(np.arange(80) < 33, 0, 5) + noise, flat=noise)
    got = {r.series_id: (r.n_breaks, r.break_t) for r in ST.chosen_breaks(ST.break_dates(s, 2, 10)).collect()}
    assert got["step"][0] == 1 and got["step"][1] == 33 and got["flat"][0] == 0


def test_registered_query_finds_up_to_five_breaks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    levels = {"three": [0, 5, 1, 6], "five": [0, 5, 1, 6, 2, 7], "flat": [0, 0]}
    made = make(spark, **{k: np.repeat(v, 35) + rng.normal(0, 0.1, 35 * len(v)) for k, v in levels.items()})
    monkeypatch.setattr(stat_queries.fx, "series", lambda spark, d: made)
    rows = registered()["x5_chosen_breaks"].run(spark, "").collect()
    got = {k: sorted(r.break_t for r in rows if r.series_id == k and r.break_t is not None) for k in levels}
    assert got == {"three": [35, 70, 105], "five": [35, 70, 105, 140, 175], "flat": []}


def test_chow(spark):
    y = np.concatenate([np.arange(20.0), np.arange(20.0) * -1 + 60]) + np.random.default_rng(0).normal(size=40)
    r = ST.chow(make(spark, a=y), 20).first()

    def ssr(i, j):
        x = np.column_stack([np.ones(j - i), np.arange(i, j)])
        return float(np.linalg.lstsq(x, y[i:j], rcond=None)[1][0])

    split = ssr(0, 20) + ssr(20, 40)
    assert r.f_stat == pytest.approx((ssr(0, 40) - split) / 2 / (split / 36))


def test_regression_and_elasticity(spark):
    rng = np.random.default_rng(4)
    a, b = rng.uniform(1, 5, 50), rng.uniform(1, 5, 50)
    y = 2 + 3 * a - b + rng.normal(0, 0.1, 50)
    df = spark.createDataFrame([("s", float(i), float(j), float(k)) for i, j, k in zip(a, b, y)], "series_id string, a double, b double, y double")
    want = np.linalg.lstsq(np.column_stack([np.ones(50), a, b]), y, rcond=None)[0]
    r = ST.multiple_regression(df, "y", ["a", "b"], ["series_id"]).first()
    assert [r.intercept, r.b_a, r.b_b] == pytest.approx(list(want))
    points = [("s", float(x), 3.0 * max(x, 0) ** 0.7) for x in range(-1, 20)]
    e = spark.createDataFrame(points, "series_id string, x double, y double")
    r = ST.elasticity(e, "y", "x").first()
    assert r.beta == pytest.approx(0.7) and r.n == 19


def test_bootstrap_is_repeatable_and_narrows(spark):
    rng = np.random.default_rng(6)
    data = [(f"n{n}", i, float(rng.uniform(1, 3)), 10.0) for n in (60, 960) for i in range(n)]
    s = spark.createDataFrame(data, "series_id string, t long, rent double, fees double")
    one, two = ({r.series_id: (r.low, r.high) for r in ST.block_bootstrap(s, 10, 100).collect()} for _ in range(2))
    assert one == two
    assert one["n960"][1] - one["n960"][0] < one["n60"][1] - one["n60"][0]


def test_pair_signs_of_more_than_2_to_the_17_ranks(spark):
    n = (1 << 17) + 3
    s = spark.range(n).selectExpr("'s' AS series_id", "id AS t", "CAST(CASE WHEN id = 0 THEN -1 ELSE id END AS DOUBLE) AS y")
    r = ST.pair_signs(s).first()
    assert (r.rising, r.falling, r.tied) == (n * (n - 1) // 2, 0, 0)


def test_percentiles_of_a_heavy_tail_and_of_large_whole_numbers(spark):
    rng = np.random.default_rng(8)
    v = 10 ** rng.uniform(0, 10, 60_000)
    v[:20_000] = 7.0
    df = spark.createDataFrame([("hot", float(x)) for x in v] + [("few", 3.0), ("few", 1.0), ("one", 5.0)], "k string, v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.999, "f": 1.0}
    got = {r.k: [r[n] for n in probs] for r in exact_percentiles(df, ["k"], "v", probs).collect()}
    for k, values in (("hot", v), ("few", [1.0, 3.0]), ("one", [5.0])):
        assert got[k] == pytest.approx([float(np.quantile(values, p)) for p in probs.values()], rel=1e-12)
    whole = spark.range(3).selectExpr("CAST(90071992547409930 + id AS DECIMAL(17,0)) AS v")
    assert exact_percentiles(whole, [], "v", {"m": 0.5}).first().m == float(90071992547409931)


def test_grade(spark):
    t = spark.createDataFrame([("a", 1.0, 0.5), ("b", 1.0, 0.5), ("c", -1.0, -3.0), ("d", 1.0, 0.5)], "series_id string, slope double, t_stat double")
    e = spark.createDataFrame([("a", 0.9), ("b", 0.3), ("c", 0.9), ("d", 0.0)], "series_id string, beta double")
    assert {r.series_id: r.grade for r in ST.grade(t, e).collect()} == {"a": "A", "b": "B", "c": "C", "d": "C"}
