"""Attribution, fee parts and exact wei arithmetic."""

import datetime as dt
import random
from decimal import Decimal, localcontext

from pyspark.sql import functions as F

from settlelens.functions import columns as X
from settlelens.operators import attribution as A
from settlelens.operators import checks as Q
from settlelens.operators import costs as K
from settlelens.operators import counterfactual as CF

T = lambda *a: dt.datetime(*a)
MAP = "rollup_id string, address string, valid_from_utc timestamp, valid_to_utc timestamp, source_url string, confidence string"
CON = MAP.replace("address", "contract_address")
TX = "tx_hash string, from_address string, to_address string, ts timestamp"


def attribute(spark, tx, maps, cons):
    df = A.attribute(spark.createDataFrame(tx, TX), spark.createDataFrame(maps, MAP), spark.createDataFrame(cons, CON))
    return {r.tx_hash: r for r in df.collect()}


def test_attribution_rules(spark):
    maps = [
        ("n1", "s1", T(2024, 1, 1), T(2024, 2, 1), "u", "high"),
        ("n2", "s2", T(2024, 1, 1), None, "u", "med"),
        ("n1", "s2", T(2024, 1, 5), None, "u", "high"),
        ("n10", "s3", T(2024, 1, 1), None, "u", "low"),
        ("n9", "s3", T(2024, 1, 1), None, "u", "low"),
    ]
    cons = [("n7", "c1", T(2024, 1, 1), None, "u", "low")]
    tx = [
        ("sender", "s1", "zz", T(2024, 1, 10)),
        ("start", "s1", "zz", T(2024, 1, 1)),
        ("expired", "s1", "zz", T(2024, 2, 1)),
        ("contract", "q", "c1", T(2024, 1, 10)),
        ("neither", "q", "zz", T(2024, 1, 10)),
        ("before_overlap", "s2", "zz", T(2024, 1, 2)),
        ("overlap", "s2", "c1", T(2024, 1, 6)),
        ("tie", "s3", "zz", T(2024, 1, 6)),
    ]
    got = attribute(spark, tx, maps, cons)
    assert len(got) == len(tx)
    assert (got["sender"].rollup_id, got["sender"].attribution_confidence) == ("n1", "high")
    assert got["start"].rollup_id == "n1" and got["expired"].rollup_id == "other"
    assert got["contract"].rollup_id == "unattributed_rollup_like"
    assert (got["contract"].audit_rollup_id, got["contract"].attribution_confidence) == ("n7", "low")
    assert got["neither"].attribution_rule == "none"
    assert got["before_overlap"].rollup_id == "n2" and got["overlap"].rollup_id == "n1"
    assert got["tie"].rollup_id == "n9"


def test_overlaps_are_reported(spark):
    maps = spark.createDataFrame(
        [
            ("a", "x", T(2024, 1, 1), T(2024, 12, 1), "u", "high"),
            ("b", "x", T(2024, 2, 1), T(2024, 3, 1), "u", "high"),
            ("c", "x", T(2024, 4, 1), T(2024, 5, 1), "u", "high"),
            ("d", "x", T(2024, 12, 1), None, "u", "high"),
        ],
        MAP,
    )
    assert sorted(r.rollup_id for r in A.overlapping_windows(maps, "address").collect()) == ["b", "c"]


def parts(spark, rows):
    schema = "tx_hash string, tx_type int, gas_used decimal(12,0), effective_gas_price_wei decimal(17,0), base_fee_per_gas_wei decimal(17,0), base_fee_per_blob_gas_wei decimal(17,0), blob_count int, status int, date_utc date, rollup_id string"
    return K.fee_parts(spark.createDataFrame(rows, schema))


def row(h, kind=2, gas=21000, price=10, base=7, blob=1, count=None, status=1):
    return (h, kind, Decimal(gas), Decimal(price), Decimal(base), Decimal(blob), count, status, dt.date(2024, 4, 1), "n1")


def test_fee_parts(spark):
    tx = parts(
        spark,
        [
            row("plain"),
            row("failed", status=0),
            row("blob", kind=3, count=2, blob=3),
            row("unknown", kind=3),
            row("below", price=5),
            row("huge", gas=30_000_000, price=10**12, base=10**12 - 1),
        ],
    )
    got = {r.tx_hash: r for r in tx.collect()}
    assert got["plain"].burn_base_wei == 147000 and got["plain"].tips_wei == 63000 and got["failed"].tips_wei == 63000
    assert got["blob"].burn_blob_wei == 2 * 131072 * 3 and got["plain"].burn_blob_wei == 0
    assert got["unknown"].burn_blob_wei is None and got["unknown"].blob_burn_unknown
    assert got["huge"].execution_fee_wei == 30_000_000 * 10**12 > 2**63
    ok, bad = K.quarantine(tx)
    assert [r.tx_hash for r in bad.collect()] == ["below"] and ok.count() == 5
    assert all(r.status == "pass" for r in Q.execution_identity(tx).collect())
    day = K.daily_costs(tx).first()
    assert day.missing_blob_tx == 1 and day.missing_blob_execution_eth == Decimal(210000).scaleb(-18)
    total = sum(r.execution_fee_wei for r in got.values()) + got["blob"].burn_blob_wei
    assert day.l1_total_cost_eth == Decimal(int(total)).scaleb(-18)


def test_identity_fails_by_one_wei(spark):
    state = spark.createDataFrame([], "date_utc date, blob_base_fee_wei_avg double")
    d = K.decomposition(parts(spark, [row("a"), row("b", kind=3, count=1)]), state)
    assert Q.total_identity(d).first().status == "pass"
    off = d.withColumn("l1_total_rent_eth", F.col("l1_total_rent_eth").cast("decimal(36,18)") + F.lit(Decimal("1E-18")))
    assert Q.total_identity(off).first().status == "fail"


def test_wei_conversions_are_exact(spark):
    big = 10**30 + 10**18 + 1
    df = spark.createDataFrame([(Decimal(v),) for v in (0, 1, -1, big, -big)], "w decimal(38,0)")
    got = [r[0] for r in df.select(X.wei_to_eth("w")).collect()]
    with localcontext() as ctx:
        ctx.prec = 60
        assert got == [Decimal(v).scaleb(-18) for v in (0, 1, -1, big, -big)]
    assert df.select(X.gwei_to_wei(X.wei_to_gwei(F.lit(Decimal(123456789012))))).first()[0] == 123456789012


def test_blob_counts(spark):
    tx = spark.createDataFrame([("a", 3), ("b", 3), ("c", 3), ("d", 2)], "tx_hash string, tx_type int")
    detail = spark.createDataFrame(
        [("a", 4, None), ("b", None, ["x", "y"]), ("c", None, None)], "tx_hash string, blob_count int, blob_versioned_hashes array<string>"
    )
    index = spark.createDataFrame([("c", 6), ("a", 9)], "tx_hash string, index_blob_count int")
    filled = K.fill_blob_count(K.with_blob_detail(tx, detail), index)
    got = {r.tx_hash: (r.blob_count, r.blob_count_source) for r in filled.collect()}
    assert got == {"a": (4, "chain"), "b": (2, "chain"), "c": (6, "index"), "d": (None, None)}


def test_header_presence(spark):
    at = 1710338100  # the activation instant
    b = spark.createDataFrame(
        [(1, at - 1, None, None), (2, at - 1, 5, None), (3, at, 5, 0), (4, at, None, None)],
        "block_number long, timestamp long, blob_gas_used long, excess_blob_gas long",
    )
    assert {r.block_number: r.header_ok for r in K.header_presence(b).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_derived_blob_fee(spark):
    df = spark.createDataFrame([(None, 0, 3338477), (None, 33384770, 3338477), (Decimal(9), 33384770, 3338477)], "g decimal(17,0), e long, f long")
    assert [int(r[0]) for r in df.select(X.blob_base_fee("g", "e", "f")).collect()] == [1, 22026, 9]


def test_counterfactual_never_lowers_a_fee(spark):
    tx = parts(spark, [row("a", kind=3, count=1, base=1600, price=1700, blob=1), row("b", kind=3, count=1, base=16, price=17, blob=500)])
    cf = {r.tx_hash: int(r.base_fee_per_blob_gas_wei) for r in CF.with_floor(tx).collect()}
    assert cf == {"a": 100, "b": 500}
    grid = {r.floor_ratio: r.burn_blob_cf_eth for r in CF.floor_grid(tx, [Decimal("0"), Decimal("0.0625")]).collect()}
    assert grid[0.0] < grid[0.0625]


def test_addresses(spark):
    a = "0x" + "Ab" * 20
    df = spark.createDataFrame([(a,), (f" {a} ",), ("0x12",), (a + "\n",), (None,)], "a string")
    got = [r[0] for r in df.select(X.normalize_address("a")).collect()]
    assert got[0] == got[1] == a.lower() and got[2] is None and got[4] is None


def test_blob_fee_rule_is_exact(spark):
    def series(excess, fraction):
        i, total, term = 1, 0, fraction
        while term > 0:
            total += term
            term = term * excess // (fraction * i)
            i += 1
        return total // fraction

    values = [0, 1, 131072, 10_000_000, 52_298_752, 120_000_000, 150_000_000]
    df = spark.createDataFrame([(v, f) for v in values for f in (3338477, 5007716)], "excess long, fraction long")
    rows = df.select("excess", "fraction", X.blob_base_fee(F.lit(None), "excess", "fraction").alias("fee")).collect()
    assert {(r.excess, r.fraction): int(r.fee) for r in rows} == {(v, f): series(v, f) for v in values for f in (3338477, 5007716)}
    assert spark.range(1).select(X.blob_base_fee(F.lit(None), F.lit(None).cast("long"), F.lit(3338477))).first()[0] is None


def test_a_transaction_without_its_block_stays_apart(spark):
    tx = spark.createDataFrame([("a", 1, 3, Decimal(10), Decimal(7), 2), ("b", 2, 2, Decimal(10), Decimal(7), None)],
                               "tx_hash string, block_number long, tx_type int, gas_used decimal(12,0), effective_gas_price_wei decimal(17,0), blob_count int")
    blocks = spark.createDataFrame([(1, 1710500000, Decimal(5), None, None)],
                                   "block_number long, timestamp long, base_fee_per_gas_wei decimal(17,0), base_fee_per_blob_gas_wei decimal(17,0), excess_blob_gas long")
    usable, bad = K.quarantine(K.fee_parts(K.with_block_fees(tx, blocks)))
    assert [r.tx_hash for r in bad.collect()] == ["b"]
    row = usable.first()
    assert row.blob_burn_unknown and row.burn_blob_wei is None  # neither a fee nor excess gas to derive it from


def plain_pieces(windows):
    """Every piece between two neighbouring bounds and the first window in winning order that covers it."""
    rank = {"high": 0, "med": 1, "low": 2}
    out = []
    for key in {w[0] for w in windows}:
        own = [w for w in windows if w[0] == key and (w[2] is None or w[1] < w[2])]
        far = dt.datetime(9999, 12, 31)
        bounds = sorted({w[1] for w in own} | {w[2] or far for w in own})
        for a, b in zip(bounds, bounds[1:]):
            open_ = [w for w in own if w[1] <= a < (w[2] or far)]
            if open_:
                best = min(open_, key=lambda w: (rank[w[4]], int(w[3][1:])))
                out.append((key, str(a), str(b), best[3], best[4]))
    return sorted(out)


def registry(spark, windows):
    schema = "address string, valid_from_utc timestamp, valid_to_utc timestamp, rollup_id string, confidence string"
    return spark.createDataFrame(windows, schema)


def test_window_sweep_against_all_pieces(spark):
    rng = random.Random(11)
    day = lambda n: dt.datetime(2019, 1, 1) + dt.timedelta(days=n)
    windows = []
    for _ in range(300):
        start = rng.randrange(1500)
        stop = rng.choice([None, start + rng.randrange(0, 900), start + rng.randrange(0, 30)])
        windows.append((f"0x{rng.randrange(12)}", day(start), None if stop is None else day(stop), f"n{rng.randrange(12)}", rng.choice(["high", "med", "low"])))
    # Bounds at the turn of a year, and a window over several years in which nothing else happens.
    windows += [("y", dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1), "n1", "med"), ("y", dt.datetime(2019, 5, 1), None, "n2", "low")]
    windows += [("z", dt.datetime(2019, 5, 1), dt.datetime(2024, 3, 1), "n2", "low")]
    found = A.disjoint_windows(registry(spark, windows), "address").collect()
    got = sorted((r["address"], str(r["_start"]), str(r["_stop"]), r["rollup_id"], r["confidence"]) for r in found)
    assert got == plain_pieces(windows)


def test_window_sweep_of_one_address_with_very_many_windows(spark):
    n = 100_000
    start = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 600)
    windows = spark.range(n).select(
        F.lit("0xhot").alias("address"), start.alias("valid_from_utc"), F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 600 + 1500).alias("valid_to_utc"),
        F.concat(F.lit("n"), (F.col("id") % 7).cast("string")).alias("rollup_id"), F.lit("high").alias("confidence"),
    )
    out = A.disjoint_windows(windows, "address")
    # Starts every 600 s, stops 300 s after starts: pieces of 300 s each, from the third start on.
    total = out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.unix_timestamp("_stop") - F.unix_timestamp("_start")).alias("s")).first()
    assert total["s"] == (n - 1) * 600 + 1500 and total["n"] == 2 * n - 1
    assert out.groupBy("_start").count().where("count > 1").isEmpty()
