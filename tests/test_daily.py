"""The daily run on the supplied tables: incremental equals full, and parts sum to the total."""

import dataclasses
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from settlelens.operators import checks as Q
from settlelens import contracts as C
from settlelens.plans import daily, landed
from settlelens.plans import fixtures as fx

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables not present")


@pytest.fixture(scope="module")
def inputs(spark):
    u = fx.universe(spark, SF)
    return daily.Inputs(
        blocks=fx.raw_blocks(spark, SF),
        receipts=fx.receipts(spark, SF).drop("blob_count", "part_key"),
        blob_tx=fx.blob_tx(spark, SF),
        blob_index=fx.blob_index(spark, SF),
        addresses=fx.address_mappings(spark, SF),
        contracts=fx.contract_mappings(spark, SF),
        metrics=fx.metrics(spark, SF),
        universe=u,
        prices=fx.prices(spark, SF),
        issuance=fx.issuance(spark, SF),
        registry_version="v1",
    )


def test_costs_add_up(inputs):
    c = daily.costs(daily.K.quarantine(daily.transactions(inputs))[0], "v1")
    total = c.agg(
        F.sum("l1_total_cost_eth").alias("a"), (F.sum("burn_base_eth") + F.sum("burn_blob_eth") + F.sum("tips_eth")).alias("b"), F.sum("n_tx").alias("n")
    ).first()
    assert abs(total.a - total.b) < 1e-15 and total.n == inputs.receipts.count()


def test_incremental_equals_full(spark, inputs, tmp_path):
    end = dt.date(2024, 1, 30)
    full = daily.run(inputs, str(tmp_path / "full"), end, full=True)
    again = daily.run(inputs, str(tmp_path / "full"), end)
    assert full == again
    panel = spark.read.parquet(full["daily_rollup_panel"])
    want = daily.contract_panel(inputs, end)
    assert Q.compare_builds(want, panel.select(*want.columns)).first().status == "pass"
    assert spark.read.json(f"{full['qa']}/validation_{end}/summary.json").filter("check = 'primary_key'").first().n_fail == 0


def test_a_vanished_day_goes_and_the_chain_outputs_follow(spark, inputs, tmp_path):
    end, gone = dt.date(1998, 9, 2), dt.date(1998, 8, 31)
    day = F.floor(F.col("timestamp") / 86400)
    number = (gone - dt.date(1970, 1, 1)).days
    late = inputs.blocks.filter(day > number - 20)
    inputs = dataclasses.replace(
        inputs, blocks=late, receipts=inputs.receipts.join(late.select("block_number"), "block_number", "left_semi")
    )
    daily.run(inputs, str(tmp_path), end, full=True)
    less = dataclasses.replace(inputs, blocks=inputs.blocks.filter(day != number))
    lost = inputs.blocks.filter(day == number).select("block_number")
    less = dataclasses.replace(less, receipts=inputs.receipts.join(lost, "block_number", "left_anti"))
    paths = daily.run(less, str(tmp_path), end)
    for name in ("onchain_daily_rollup_costs", "daily_l1_rent_decomposition"):
        stored = spark.read.parquet(paths[name])
        assert stored.filter(F.col("date_utc") == F.lit(gone)).isEmpty() and not stored.filter(F.col("date_utc") == F.lit(end)).isEmpty()
    usable = daily.K.quarantine(daily.transactions(less))[0]
    fresh = daily.costs(usable, "v1").filter(F.col("date_utc").between(F.lit(dt.date(1998, 8, 27)), F.lit(end)))
    stored = spark.read.parquet(paths["onchain_daily_rollup_costs"]).filter(F.col("date_utc").between(F.lit(dt.date(1998, 8, 27)), F.lit(end)))
    assert Q.compare_builds(fresh, stored.select(*fresh.columns)).first().status == "pass"


def test_a_bounded_run_prunes_the_facts(spark, inputs, tmp_path):
    """Receipts landed by day are cut at the scan."""
    days = inputs.blocks.select("block_number", F.to_date(F.timestamp_seconds("timestamp")).alias("date_utc"))
    inputs.receipts.join(days, "block_number").write.partitionBy("date_utc").parquet(f"{tmp_path}/receipts")
    landed = dataclasses.replace(inputs, receipts=spark.read.parquet(f"{tmp_path}/receipts"))
    cut = daily.recent_chain(landed, dt.date(1998, 8, 27), dt.date(1998, 9, 2))
    plan = daily.transactions(cut)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "effective_gas_price_wei" in line and "FileScan" in line]
    assert scans and all("PartitionFilters: [isnotnull(date_utc" in line for line in scans)


def test_the_latest_run_date_wins(spark, inputs):
    m = inputs.metrics.withColumn("run_date", F.lit(dt.date(2024, 2, 1)))
    older = m.withColumns({"value": F.col("value") * 9, "run_date": F.lit(dt.date(2024, 1, 31))})
    both = dataclasses.replace(inputs, metrics=m.unionByName(older))
    assert Q.compare_builds(daily.vendor_rows(inputs), daily.vendor_rows(both)).first().status == "pass"


def test_landed_folders_give_the_inputs(spark, inputs, tmp_path):
    root, run = f"{tmp_path}", F.lit(dt.date(2024, 2, 1)).alias("run_date")
    first = inputs.blocks.agg(F.max("timestamp")).first()[0] - 20 * 86_400
    blocks = inputs.blocks.filter(F.col("timestamp") >= first)
    receipts = inputs.receipts.join(blocks.select("block_number"), "block_number", "left_semi")
    for name, df in (("blocks", blocks), ("receipts", receipts), ("blob_tx", inputs.blob_tx), ("blob_index", inputs.blob_index)):
        df.select("*", run).write.partitionBy("run_date").parquet(f"{root}/l1/{name}")
    text = lambda df: df.withColumnRenamed("date_utc", "date").withColumn("date", F.col("date").cast("string"))
    text(inputs.metrics).write.json(f"{root}/vendor/export/2024-02-01")
    text(inputs.prices).write.json(f"{root}/vendor/prices/2024-02-01")
    text(inputs.issuance).write.json(f"{root}/vendor/issuance/2024-02-01")
    day = lambda c: F.col(c).cast("date").cast("string")
    senders = inputs.addresses.filter("confidence = 'high'").groupBy("rollup_id", "valid_from_utc", "valid_to_utc").agg(
        F.to_json(F.collect_list("address")).alias("batcher_addresses_json"))
    cells = {
        "rollup_id": F.col("rollup_id"), "batcher_addresses_json": F.col("batcher_addresses_json"), "status": F.lit("active"),
        "start_date_utc": day("valid_from_utc"), "end_date_utc": F.date_sub("valid_to_utc", 1).cast("string"), "verified_utc": F.lit("2024-01-15"),
    }
    columns = [cells.get(c, F.lit(None).cast("string")).alias(c) for c in C.REGISTRY_COLUMNS]
    senders.select(*columns).write.csv(f"{root}/registry/rollup_registry.csv", header=True, escape='"')
    u = inputs.universe.select("rollup_id", "origin_key", "display_name", "category", "in_scope", F.lit(None).cast("string").alias("notes"))
    u.write.csv(f"{root}/registry/universe.csv", header=True, escape='"')
    contracts = inputs.contracts.select(*[F.col(c).cast("string") for c in landed.CONTRACT_COLUMNS])
    contracts.write.csv(f"{root}/registry/contract_mappings.csv", header=True, escape='"')

    got = landed.inputs(spark, root, "v1", ("2024-01-31", "2024-02-02"))
    direct = dataclasses.replace(inputs, blocks=blocks, receipts=receipts, addresses=inputs.addresses.filter("confidence = 'high'"))
    cost = lambda i: daily.costs(daily.K.quarantine(daily.transactions(i))[0], "v1")
    assert Q.compare_builds(cost(direct), cost(got)).first().status == "pass"
    assert Q.compare_builds(inputs.metrics, got.metrics.select(*inputs.metrics.columns)).first().status == "pass"
    # Rollups of the vendor universe are not in this registry, so they have no bounds.
    assert got.universe.filter("start_date_utc IS NOT NULL").isEmpty() and got.universe.count() == inputs.universe.count()
