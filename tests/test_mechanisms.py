"""As-of join, stored sketches, versioned tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlelens.functions import joins
from settlelens.operators.asof import asof_join
from settlelens.operators.costs import with_blob_fee
from settlelens.sinks import sketches as SK
from settlelens.sinks.versioned import Conflict, VersionedTable

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return None if seconds is None else START + dt.timedelta(seconds=seconds)


def plain_asof(facts, versions, max_age=None):
    out = []
    for i, k, t in facts:
        known = [(vt, v) for vk, vt, v in versions if vk == k and vt is not None and t is not None and k is not None and vt <= t]
        best = max(known, key=lambda x: (x[0], x[1] is not None, x[1] or 0), default=None)
        if best is not None and max_age is not None and t - best[0] > max_age:
            best = None
        out.append((i, None if best is None else best[1]))
    return sorted(out)


@pytest.mark.parametrize("width,max_age", [(10, None), (1000, None), (86_400, 300)])
def test_asof_join_against_all_pairs(spark, width, max_age):
    rng = random.Random(5)
    keys = ["hot"] * 6 + ["a", "b", None]
    facts = [(i, rng.choice(keys), rng.choice([None, *range(-50, 3000, 7)])) for i in range(400)]
    versions = [(rng.choice(keys), rng.choice([None, *range(0, 3000, 5)]), rng.choice([None, 1, 2, 3])) for _ in range(60)]
    versions += [("a", 70, 1), ("a", 70, 3), ("a", 70, 2)]
    left = spark.createDataFrame([(i, k, at(t)) for i, k, t in facts], "i int, k string, t timestamp")
    right = spark.createDataFrame([(k, at(t), v) for k, t, v in versions], "k string, since timestamp, v int")
    got = asof_join(left, right, ["k"], "t", "since", ["v"], width, max_age)
    assert sorted((r["i"], r["v"]) for r in got.collect()) == plain_asof(facts, versions, max_age)
    some = asof_join(left, right.where("v IS NOT NULL"), ["k"], "t", "since", ["v"], width, max_age, unmatched=False)
    want = plain_asof(facts, [v for v in versions if v[2] is not None], max_age)
    assert sorted((r["i"], r["v"]) for r in some.collect()) == [x for x in want if x[1] is not None]
    assert asof_join(left.limit(0), right, ["k"], "t", "since", ["v"]).count() == 0


def test_asof_join_of_one_key_is_spread_over_tasks(spark):
    """All rows have one key: after the shuffles no partition holds more than a small share of them."""
    facts = spark.range(20_000).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("t"))
    versions = spark.range(2_000).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") * 600).alias("since"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = asof_join(facts, versions, ["k"], "t", "since", ["v"], width=3600 * 6)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 0.2 * 20_000
        assert out.where("v <> floor(unix_timestamp(t) / 600)").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def transactions(spark, n=60_000):
    day = F.date_add(F.lit(dt.date(2024, 3, 1)), (F.col("id") % 20).cast("int"))
    return spark.range(n).select(
        day.alias("date_utc"),
        F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("rollup_id"),
        F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id"), F.lit(9000)).cast("string")).alias("from_address"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10**6)) * 10**9).cast("decimal(30,0)").alias("execution_fee_wei"),
    )


def test_merged_sketches_hold_their_bounds_without_the_fact(spark, tmp_path):
    tx = transactions(spark)
    SK.write_sketches(tx, f"{tmp_path}/cells")
    for first, last in ((dt.date(2024, 3, 1), dt.date(2024, 3, 20)), (dt.date(2024, 3, 5), dt.date(2024, 3, 6))):
        cells = SK.read_sketches(spark, f"{tmp_path}/cells", first, last)
        est = SK.merged(cells)
        plan = est._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(date_utc" in plan and "Range" not in plan and "from_address" not in plan
        part = tx.where(F.col("date_utc").between(F.lit(first), F.lit(last)))
        exact = part.agg(F.countDistinct("from_address").alias("s"), F.count(F.lit(1)).alias("n")).first()
        got = est.first()
        assert got["n_tx"] == exact["n"] and abs(got["senders"] - exact["s"]) <= SK.SENDER_BOUND * exact["s"]
        for q in (10, 50, 90):
            rank = part.agg(F.avg((F.col("execution_fee_wei") / 10**9 <= F.lit(got[f"fee_gwei_p{q}"])).cast("double"))).first()[0]
            assert abs(rank - q / 100) <= SK.RANK_BOUND
    per = SK.merged(SK.read_sketches(spark, f"{tmp_path}/cells"), "rollup_id")
    assert per.count() == 3
    empty = tx.where("date_utc = '2024-03-02' AND rollup_id = 'r1'").withColumns({"from_address": F.lit(None).cast("string"), "execution_fee_wei": F.lit(None).cast("decimal(30,0)")})
    SK.write_sketches(empty, f"{tmp_path}/empty")
    row = SK.merged(SK.read_sketches(spark, f"{tmp_path}/empty"), "rollup_id").first()
    assert row["n_fees"] == 0 and row["fee_gwei_p50"] is None


SCHEMA = T.StructType().add("v", T.IntegerType()).add("date_utc", T.DateType())


def days(spark, values):
    rows = [(v, dt.date(2024, 5, d)) for d, vs in values.items() for v in vs]
    return spark.createDataFrame(rows, SCHEMA)


def content(df):
    return sorted((r["date_utc"].day, r["v"]) for r in df.collect())


def test_versions_are_whole_and_old_ones_stay_readable(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", SCHEMA)
    assert t.latest() is None
    with pytest.raises(ValueError):
        t.read()
    assert t.publish_whole(days(spark, {1: [1], 2: [2, 2], 3: [3]})) == 1
    span = (dt.date(2024, 5, 2), dt.date(2024, 5, 4))
    assert t.publish_days(days(spark, {1: [99], 3: [30], 4: [40]}), *span) == 2  # day 2 has no rows any more; day 1 is outside
    assert content(t.read()) == [(1, 1), (3, 30), (4, 40)]
    assert content(t.read(1)) == [(1, 1), (2, 2), (2, 2), (3, 3)]
    assert t.changed_days(1, 2) == ["2024-05-02", "2024-05-03", "2024-05-04"]
    assert content(t.read(2, first=dt.date(2024, 5, 4))) == [(4, 40)]
    assert len(t.read(2, first=dt.date(2024, 5, 4)).inputFiles()) == 1
    assert t.publish_whole(days(spark, {})) == 3 and t.read().count() == 0
    assert t.publish_whole(days(spark, {7: [7]})) == 4
    gone = t.vacuum(keep=1)
    assert len(gone) == 3 and t.versions() == [4] and content(t.read()) == [(7, 7)]
    with pytest.raises(ValueError):
        t.read(1)


def test_a_rebuild_that_dies_leaves_the_old_version(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", SCHEMA)
    t.publish_whole(days(spark, {1: [1], 2: [2]}))
    # Some of the days are on disk when the job dies.
    broken = days(spark, {d: [d * 10] for d in range(1, 9)}).repartition(8, "v").withColumn(
        "v", F.when(F.col("v") == 50, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        t.publish_whole(broken)
    assert t.versions() == [1] and content(t.read()) == [(1, 1), (2, 2)]
    with pytest.raises(Exception, match="without date_utc"):
        t.publish_whole(spark.createDataFrame([(1, None)], SCHEMA))
    assert t.publish_whole(days(spark, {5: [5]})) == 2 and content(t.read()) == [(5, 5)]
    t._write(days(spark, {6: [6]}))  # a driver that dies between its data and its manifest
    assert content(t.read()) == [(5, 5)] and len(t.vacuum(keep=2)) == 1 and content(t.read(1)) == [(1, 1), (2, 2)]


def test_of_two_publishes_on_one_version_the_second_is_refused(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", SCHEMA)
    t.publish_whole(days(spark, {1: [1]}))
    base, mine = t.latest(), t._write(days(spark, {2: [2]}))
    t.publish_whole(days(spark, {3: [3]}))
    with pytest.raises(Conflict):
        t._commit(base, mine)
    assert content(t.read()) == [(3, 3)]


def test_new_senders_look_up_contracts_before_senders(spark):
    """Transactions to no known contract are gone before any is joined by its sender."""
    from settlelens.operators import attribution as A

    window = "timestamp'2024-01-01' AS valid_from_utc, CAST(NULL AS timestamp) AS valid_to_utc, 'high' AS confidence"
    known = spark.sql(f"SELECT 'r1' AS rollup_id, 's1' AS address, {window}")
    contracts = spark.sql(f"SELECT 'r2' AS rollup_id, 'c1' AS contract_address, {window}")
    rows = [(s, c, at(day * 86_400)) for s in ("s1", "s2", None) for c in ("c1", "c2", None) for day in (1, 2)] + [("s3", "c1", at(86_400))]
    tx = spark.createDataFrame(rows, "from_address string, to_address string, ts timestamp").where("ts IS NOT NULL").withColumns(
        {"ts": F.col("ts") + F.expr("interval 60 days"), "execution_fee_wei": F.lit(5).cast("decimal(30,0)"), "burn_blob_wei": F.lit(None).cast("decimal(30,0)")}
    ).withColumn("date_utc", F.col("ts").cast("date"))
    found = A.new_sender_candidates(A.attribute(tx, known, contracts))
    got = sorted((str(r["from_address"]), r["rollup_id"], r["active_days"], r["n_tx"], int(r["spend_wei"])) for r in found.collect())
    assert got == [("None", "r2", 2, 2, 10), ("s2", "r2", 2, 2, 10)]
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    contract = next(line for line in joins if "_to_key" in line)
    sender = next(line for line in joins if "_from_key" in line)
    assert "Join Inner" in contract and joins.index(sender) < joins.index(contract)


def test_asof_join_works_out_its_facts_once(spark, tmp_path):
    """Facts without a key or a time come back with nulls from the one pass that carries the rows."""
    rows = [(1, "a", 5, "n1"), (2, "a", None, "n2"), (3, None, 5, "n3"), (4, None, None, "n4"), (5, "b", 9, "n5"), (2, "a", None, "n2"), (6, "a", 0, "n6")]
    spark.createDataFrame(rows, "i int, k string, s bigint, note string").write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts")).select("i", "k", F.timestamp_seconds("s").alias("at"), "note", F.create_map("note", "i").alias("m"))
    versions = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), (None, 1, "z"), ("a", None, "w")], "k string, s bigint, v string").select(
        "k", F.timestamp_seconds("s").alias("since"), "v")
    out = asof_join(facts, versions, ["k"], "at", "since", ["v"], width=2)
    got = sorted((r.i, r.note, r.v) for r in out.collect())
    assert got == [(1, "n1", "y"), (2, "n2", None), (2, "n2", None), (3, "n3", None), (4, "n4", None), (5, "n5", None), (6, "n6", None)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert sum("FileScan" in line and "note#" in line.split("FileScan")[1] for line in plan.splitlines()) == 1


def test_exact_percentiles_deal_a_large_key(spark, monkeypatch):
    """The rows of a key that are over the size of a part meet its brackets in several tasks."""
    monkeypatch.setattr(joins, "PART_ROWS", 500, raising=False)
    monkeypatch.setattr(joins, "TASK_ROWS", 2_000, raising=False)
    rows = spark.range(20_000).select(F.when(F.col("id") < 16_000, "a").when(F.col("id") < 19_990, "b").alias("k"), ((F.col("id") * 7919) % 20_011).alias("v"))
    plans = []
    plain = joins.lookup
    monkeypatch.setattr(joins, "lookup", lambda fact, dim, on, how="left": plans.append(list(on)) or plain(fact, dim, on, how))
    got = {r.k: (r.low, r.mid) for r in joins.exact_percentiles(rows, ["k"], "v", {"low": 0.1, "mid": 0.5}).collect()}
    want = {}
    for k, span in (("a", range(16_000)), ("b", range(16_000, 19_990))):
        values = sorted(i * 7919 % 20_011 for i in span)
        at = lambda p, v=values: v[int((len(v) - 1) * p)] + (v[min(int((len(v) - 1) * p) + 1, len(v) - 1)] - v[int((len(v) - 1) * p)]) * ((len(v) - 1) * p % 1)
        want[k] = (pytest.approx(at(0.1)), pytest.approx(at(0.5)))
    assert {k: v for k, v in got.items() if k is not None} == want
    assert plans[0] == ["k", "_part"]


def test_blocks_that_look_for_no_fee_level_are_spread(spark):
    """Blocks before activation have no excess gas; they do not meet in one task of the look-up."""
    blocks = spark.range(4_000).select(F.col("id").alias("block_number"), (F.col("id") * 12).alias("timestamp"), F.lit(None).cast("bigint").alias("excess_blob_gas"))
    last = spark.createDataFrame([(4_000, 1_720_000_000, 131_072 * 300)], blocks.schema)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, ("-1", "false", "16"), strict=True):
            spark.conf.set(k, v)
        out = with_blob_fee(blocks.unionByName(last))
        got = out.select("block_number", "blob_fee_derived", "base_fee_per_blob_gas_wei", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    tasks = [r.task for r in got]
    assert len(tasks) == 4_001 and max(map(tasks.count, set(tasks))) < 800
    assert [(r.block_number, r.blob_fee_derived) for r in got if r.base_fee_per_blob_gas_wei is not None] == [(4_000, True)]
