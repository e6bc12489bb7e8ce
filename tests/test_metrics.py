"""Rules of the take rate, the panel, regimes, gaps and ranking."""

import datetime as dt
import math

from pyspark.sql import functions as F

from settlelens import contracts as C
from settlelens.functions import columns as X
from settlelens.functions.joins import exact_percentiles
from settlelens.operators import checks as Q
from settlelens.operators import metrics as M
from settlelens.operators import normalize as N
from settlelens.operators import sets as S

D = dt.date
PANEL = "date_utc date, rollup_id string, l2_fees_eth double, rent_paid_eth double"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_zero_denominator_is_nan_and_missing_leaves_both_sums(spark):
    p = spark.createDataFrame(
        [
            (D(2024, 1, 1), "a", 0.0, 1.0),
            (D(2024, 1, 2), "a", 10.0, None),
            (D(2024, 1, 2), "b", 4.0, 1.0),
            (D(2024, 1, 3), "a", None, 2.0),
        ],
        PANEL,
    )
    got = {r.date_utc: r for r in M.str_daily(p).collect()}
    assert math.isnan(got[D(2024, 1, 1)].str)
    assert got[D(2024, 1, 2)].str == 0.25 and got[D(2024, 1, 2)].n_rollups == 1
    assert D(2024, 1, 3) not in got
    assert M.nonzero_denominator_days(p).first().n_nonzero_days == 1


def test_row_rule_keeps_nan_and_drops_null(spark):
    p = spark.createDataFrame([(D(2024, 1, 1), "a", float("nan"), 1.0), (D(2024, 1, 1), "b", 1.0, None)], PANEL)
    assert [r.rollup_id for r in N.panel_rows(p).collect()] == ["a"]


def test_scope_bounds_are_inclusive(spark):
    p = spark.createDataFrame([(D(2024, 1, d), "a", 1.0, 1.0) for d in range(1, 6)] + [(D(2024, 1, 2), "x", 1.0, 1.0)], PANEL)
    reg = spark.createDataFrame(
        [("a", True, D(2024, 1, 2), D(2024, 1, 4)), ("x", False, None, None)],
        "rollup_id string, in_scope boolean, start_date_utc date, end_date_utc date",
    )
    assert [r[0].day for r in rows(N.active_in_scope(p, reg), "date_utc")] == [2, 3, 4]


def test_regime_boundary(spark):
    d = spark.createDataFrame([(D(2024, 3, 12),), (D(2024, 3, 13),)], "d date")
    assert rows(d, "d", X.post_regime("d").alias("p")) == [(D(2024, 3, 12), False), (D(2024, 3, 13), True)]


def fees(spark, values, start=D(2024, 4, 1)):
    data = [(start + dt.timedelta(days=i), v) for i, v in enumerate(values) if v != "gap"]
    return spark.createDataFrame(data, "date_utc date, l1_blob_base_fee_gwei double")


def test_floor_runs(spark):
    one = 1.0
    assert M.floor_runs(fees(spark, [one] * 6 + [9.0])).count() == 0
    seven = M.floor_runs(fees(spark, [one] * 6 + [1.05, 9.0])).collect()
    assert len(seven) == 1 and seven[0].n_days == 7
    assert M.floor_runs(fees(spark, [one] * 3 + ["gap"] + [one] * 4)).count() == 0
    assert M.floor_runs(fees(spark, [one] * 3 + [None] + [one] * 4)).count() == 0


def test_missing_days_and_block_gaps(spark):
    days = spark.createDataFrame([(D(2024, 1, d),) for d in (1, 4, 8)], "date_utc date")
    assert rows(M.missing_day_runs(days), "run_start", "run_end", "n_days") == [(D(2024, 1, 5), D(2024, 1, 7), 3)]
    blocks = spark.createDataFrame([(n,) for n in (1, 2, 5, 9, 10, 31)], "n long")
    assert rows(M.missing_numbers(blocks, "n", shard=10), "gap_start", "gap_end") == [(3, 4), (6, 8), (11, 30)]


def test_smoothing_uses_calendar_days_and_skips_nan(spark):
    s = spark.createDataFrame([("a", 1, 1.0), ("a", 2, float("nan")), ("a", 3, 3.0), ("a", 20, 5.0)], "series_id string, t long, y double")
    got = {r.t: r.mean_7d for r in M.smoothed(s, "y").collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 2.0, 20: 5.0}


def test_latest_version_and_revisions(spark):
    v = spark.createDataFrame([("k", 1, 5.0), ("k", 2, 5.0), ("k", 3, None), ("z", 1, 1.0)], "key string, run long, value double")
    assert rows(M.latest_version(v, ["key"], "run"), "key", "run") == [("k", 3), ("z", 1)]
    assert rows(M.revisions(v, ["key"], "run", "value"), "key", "run") == [("k", 3)]


def test_catalog_diff_and_unknown_origin(spark):
    old, new = (spark.createDataFrame([(k,) for k in ks], "origin_key string") for ks in ("ab", "bc"))
    assert rows(S.catalog_diff(old, new, "origin_key"), "origin_key", "change") == [("a", "removed"), ("c", "added")]
    u = spark.createDataFrame([("b", "rb", True)], "origin_key string, rollup_id string, in_scope boolean")
    assert rows(N.map_origins(new, u), "origin_key", "in_scope") == [("b", True), ("c", False)]


def test_source_priority(spark):
    df = spark.createDataFrame([(1, None, 2.0, 3.0), (2, 1.0, 2.0, None), (3, None, None, None)], "i int, a double, b double, c double")
    got = rows(N.pick_source(df, [("onchain", "a"), ("vendor", "b"), ("second", "c")], "v", "s"), "i", "v", "s")
    assert got == [(1, 2.0, "vendor"), (2, 1.0, "onchain"), (3, None, None)]


def test_profit_identity_tolerance(spark):
    p = spark.createDataFrame(
        [
            (D(2024, 1, 1), "at", 100.0, 0.0, 99.0),
            (D(2024, 1, 1), "in", 100.0, 0.0, 99.5),
            (D(2024, 1, 1), "out", 100.0, 0.0, 98.9),
            (D(2024, 1, 1), "zero", 0.0, 0.0, 1e-9),
            (D(2024, 1, 1), "zero2", 0.0, 0.0, 1e-8),
            (D(2024, 1, 1), "none", 1.0, 0.0, None),
        ],
        PANEL + ", profit_eth double",
    )
    got = {r.key.split("|")[1]: r.status for r in Q.profit_identity(p).collect()}
    assert got == {"at": "pass", "in": "pass", "out": "fail", "zero": "pass", "zero2": "fail"}


def test_contract_cast_and_conformance(spark):
    text = spark.createDataFrame(
        [("2024-01-01", "a", "1_000", "2", "7"), ("2024-01-01", "a", "1d", "2", "x"), ("2024-02-30", "b", "1", "2", None)],
        "date_utc string, rollup_id string, l2_fees_eth string, rent_paid_eth string, txcount string",
    )
    p = N.to_contract(text, C.PANEL_CONTRACT)
    assert [f.name for f in p.schema.fields] == [f["name"] for f in C.PANEL_CONTRACT["fields"]]
    got = {r.key: (r.observed, r.status) for r in Q.schema_conformance(p, C.PANEL_CONTRACT).collect()}
    assert got["date_utc"] == (1.0, "fail") and got["l2_fees_eth"] == (1.0, "fail")
    assert got["txcount"] == (0.0, "pass") and got["date_utc,rollup_id"] == (1.0, "fail")
    assert not Q.overall(Q.schema_conformance(p, C.PANEL_CONTRACT)).first().ok


def test_exact_percentiles_match_builtin_with_a_hot_key(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"),
    )
    # A coarse sketch, so that the hot key's ranks are found by its brackets and their neighbours.
    ours = exact_percentiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, accuracy=64)
    want = df.groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99))])
    for a, b in zip(rows(ours, "k", "p10", "p50", "p99"), rows(want, "k", "p10", "p50", "p99")):
        assert a[0] == b[0] and all(abs(x - y) < 1e-9 for x, y in zip(a[1:], b[1:]))
    whole = exact_percentiles(df, [], "v", {"p50": 0.5}).first()[0]
    assert abs(whole - df.agg(F.percentile("v", F.lit(0.5))).first()[0]) < 1e-9


def test_digest_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "i int, s string")
    b = a.select("s", "i").repartition(3)
    c = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "i int, s string")
    assert Q.compare_builds(a, b).first().status == "pass"
    assert Q.compare_builds(a, c).first().status == "fail"


def test_lineage_closure_survives_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "artifact string, input string")
    got = {(r.artifact, r.input) for r in Q.lineage_closure(e).collect()}
    assert got == {(x, y) for x in "abc" for y in "abcd"}
    bad = spark.createDataFrame([("a", "a"), ("a", "q")], "artifact string, input string")
    assert rows(Q.lineage_check(bad, bad), "key", "detail") == [("a", "self_reference"), ("a<-q", "unknown_input")]
