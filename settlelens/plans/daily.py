"""The daily run: from raw chain and vendor tables to costs, panel, checks and alerts."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlelens import contracts as C
from settlelens.functions import columns as X
from settlelens.operators import attribution as A
from settlelens.operators import checks as Q
from settlelens.operators import costs as K
from settlelens.operators import metrics as M
from settlelens.operators import normalize as N
from settlelens.operators import reconcile as R
from settlelens.session import materialize, require_utc
from settlelens.sinks import tables as TB
from settlelens.streaming import refresh as RF

METRICS = ["fees_eth", "fees_usd", "rent_paid_eth", "rent_paid_usd", "profit_eth", "profit_usd", "txcount"]


@dataclass(frozen=True)
class Inputs:
    """Raw tables of a run; the registry version is pinned for all of them."""

    blocks: DataFrame
    receipts: DataFrame
    blob_tx: DataFrame
    blob_index: DataFrame
    addresses: DataFrame
    contracts: DataFrame
    metrics: DataFrame
    universe: DataFrame
    prices: DataFrame
    issuance: DataFrame
    registry_version: str


def transactions(i: Inputs) -> DataFrame:
    """Priced and attributed transactions.

    Blob detail touches type-3 rows only, before the one shuffle every row takes, on block number.
    The registry look-ups match at most one window each and need no shuffle of the transactions
    while the registry is under the broadcast threshold.
    """
    counted = K.fill_blob_count(K.with_blob_detail(i.receipts, i.blob_tx), i.blob_index)
    timed = K.with_block_fees(counted, i.blocks)
    return K.fee_parts(A.attribute(timed, i.addresses, i.contracts))


def costs(tx: DataFrame, registry_version: str) -> DataFrame:
    """Daily costs of usable priced transactions."""
    return N.with_provenance(K.daily_costs(tx), registry_version=registry_version)


def decomposition(tx: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rent decomposition of attributed transactions under its contract."""
    named = tx.filter(~F.col("rollup_id").isin(C.OTHER, C.ROLLUP_LIKE))
    return N.to_contract(K.decomposition(named, K.blob_fee_state(blocks)), C.DECOMPOSITION_CONTRACT)


def coverages(panel_wide: DataFrame, blocks: DataFrame) -> DataFrame:
    """Shares held against their thresholds: days after activation with blob headers, panel rows with on-chain cost.

    Every calendar day from the first to the last block is expected, so a day without any block lowers the share.
    """
    seen = blocks.groupBy(X.epoch_date("timestamp").alias("date_utc")).agg(F.max(F.col("blob_gas_used").isNotNull()).alias("_seen"))
    span = seen.agg(F.greatest(F.min("date_utc"), F.lit(C.DENCUN_DATE)).alias("_a"), F.max("date_utc").alias("_b")).where("_a <= _b")
    expected = span.select(F.explode(F.sequence("_a", "_b")).alias("date_utc"))
    days = expected.join(seen, "date_utc", "left").agg(F.avg(F.coalesce("_seen", F.lit(False)).cast("int")).alias("coverage"))
    rows = panel_wide.agg(F.avg(F.col("onchain_l1_cost_eth").isNotNull().cast("int")).alias("coverage"))
    blob = Q.coverage_threshold(days.filter("coverage IS NOT NULL").withColumn("key", F.lit("all")), "key", "blob_days", C.COVERAGE_BLOB_DAYS)
    chain = Q.coverage_threshold(rows.filter("coverage IS NOT NULL").withColumn("key", F.lit("all")), "key", "onchain_coverage", C.COVERAGE_ONCHAIN)
    return blob.unionByName(chain)


def recent_chain(i: Inputs, first: dt.date, last: dt.date) -> Inputs:
    """Chain tables cut to the days of a bounded run before anything is joined.

    Blocks are cut by their time. Receipts and blob detail are cut by ``date_utc``, which is their
    partition when landed by day; without it receipts are cut by the block numbers of those days.
    """
    seconds = lambda d: (d - dt.date(1970, 1, 1)).days * 86_400
    blocks = i.blocks.filter(F.col("timestamp").between(seconds(first), seconds(last + dt.timedelta(days=1)) - 1))
    if "date_utc" in blocks.columns:
        blocks = blocks.filter(F.col("date_utc").between(F.lit(first), F.lit(last)))

    def cut(df: DataFrame) -> DataFrame:
        if "date_utc" in df.columns:
            return df.filter(F.col("date_utc").between(F.lit(first), F.lit(last))).drop("date_utc")
        if "block_number" in df.columns:
            low, high = blocks.agg(F.min("block_number"), F.max("block_number")).first()
            return df.filter(F.col("block_number").between(low, high)) if low is not None else df.limit(0)
        return df

    return replace(i, blocks=blocks, receipts=cut(i.receipts), blob_tx=cut(i.blob_tx))


def recent_vendor(i: Inputs, first: dt.date, last: dt.date) -> Inputs:
    return replace(i, metrics=i.metrics.filter(F.col("date_utc").between(F.lit(first), F.lit(last))))


def vendor_rows(i: Inputs) -> DataFrame:
    """Vendor panel rows of active in-scope rollups, under contract names; of several run dates the latest counts."""
    metrics = i.metrics
    if "run_date" in metrics.columns:
        cell = ["metric_key", "origin_key", "date_utc"]
        metrics = M.latest_version(metrics.select(*cell, "value", "run_date"), cell, "run_date").drop("run_date")
    mapped = N.map_origins(metrics, i.universe).filter("rollup_id IS NOT NULL")
    wide = N.vendor_panel(mapped, METRICS).withColumnsRenamed({"fees_eth": "l2_fees_eth", "fees_usd": "l2_fees_usd"})
    return N.active_in_scope(N.panel_rows(wide), i.universe)


def contract_panel(i: Inputs, run_date: dt.date) -> DataFrame:
    return N.to_contract(N.clip_window(vendor_rows(i), end=run_date), C.PANEL_CONTRACT)


def wide_panel(i: Inputs, onchain: DataFrame) -> DataFrame:
    """Vendor rows with on-chain costs, blob regime, macro inputs and the rent series that won."""
    wide = M.add_macro(M.assemble_panel(vendor_rows(i), onchain, K.blob_fee_state(i.blocks)), i.prices, i.issuance)
    order = [("onchain", "onchain_l1_cost_eth"), ("vendor", "vendor_rent_paid_eth")]
    return N.pick_source(wide, order, "rent_paid_eth", "rent_source")


TABLES = [
    "onchain_daily_rollup_costs", "daily_l1_rent_decomposition", "daily_rollup_panel", "daily_rollup_panel_wide", "daily_str", "qa",
]


def run(i: Inputs, root: str, run_date: dt.date, full: bool = False) -> dict[str, str]:
    """Refresh the stored tables, then check what was stored. ``full`` rebuilds every day.

    A bounded run reads the chain tables of the last days only and the vendor metrics of its longer span.
    """
    spark = i.receipts.sparkSession
    require_utc(spark)
    paths = {n: f"{root}/{n}" for n in TABLES}
    chain, vendor = i, i
    if not full:
        chain = recent_chain(i, run_date - dt.timedelta(days=C.CHAIN_REFRESH_DAYS - 1), run_date)
        vendor = recent_vendor(i, run_date - dt.timedelta(days=C.PANEL_REFRESH_DAYS - 1), run_date)

    def store(name: str, df: DataFrame, days: int) -> DataFrame:
        if full:
            TB.write_partitions(df, paths[name], ["date_utc"], whole=True)
        else:
            RF.refresh_days(df, paths[name], run_date, days)
        return spark.read.schema(df.schema).parquet(paths[name])

    # Priced once; costs, decomposition and checks read the written rows.
    usable, bad = K.quarantine(materialize(transactions(chain), "priced"))
    bad.write.mode("overwrite").parquet(f"{paths['qa']}/quarantine_{run_date}")
    onchain = store("onchain_daily_rollup_costs", costs(usable, i.registry_version), C.CHAIN_REFRESH_DAYS)
    parts = store("daily_l1_rent_decomposition", decomposition(usable, chain.blocks), C.CHAIN_REFRESH_DAYS)
    panel = store("daily_rollup_panel", contract_panel(vendor, run_date), C.PANEL_REFRESH_DAYS)
    blocks = recent_chain(i, run_date - dt.timedelta(days=C.PANEL_REFRESH_DAYS - 1), run_date).blocks if not full else i.blocks
    wide = store("daily_rollup_panel_wide", N.clip_window(wide_panel(replace(vendor, blocks=blocks), onchain), end=run_date), C.PANEL_REFRESH_DAYS)
    store("daily_str", M.str_daily(panel), C.PANEL_REFRESH_DAYS)

    named = onchain.filter(~F.col("rollup_id").isin(C.OTHER, C.ROLLUP_LIKE))
    months = R.monthly_by_source(named, panel, "l1_total_cost_eth", "rent_paid_eth")
    checks = (
        Q.schema_conformance(panel, C.PANEL_CONTRACT)
        .unionByName(Q.schema_conformance(parts, C.DECOMPOSITION_CONTRACT))
        .unionByName(Q.profit_identity(panel))
        .unionByName(Q.total_identity(parts))
        .unionByName(Q.non_negative(panel, ["l2_fees_eth", "rent_paid_eth", "txcount"]))
        .unionByName(Q.registry_audit(i.addresses, "address"))
        .unionByName(Q.attribution_target(K.attribution_coverage(usable)))
        .unionByName(Q.blob_burn_check(usable))
        .unionByName(coverages(wide, blocks))
        .unionByName(Q.block_continuity(M.missing_numbers(chain.blocks, "block_number")))
        .unionByName(R.reconcile_months(months, M.top_rollups(panel, 5)))
    )
    checks = materialize(checks, "checks")
    TB.write_validation(checks, f"{paths['qa']}/validation_{run_date}")
    TB.write_reports(
        {
            "alerts": checks.filter("status = 'fail'"),
            "gaps": M.missing_day_runs(panel, keys=("rollup_id",)),
            "new_senders": A.new_sender_candidates(usable),
            "unattributed": K.top_unattributed(usable),
        },
        paths["qa"],
        str(run_date),
    )
    return paths
