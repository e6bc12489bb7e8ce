"""From landed folders to the inputs of a daily run.

    <root>/l1/blocks, receipts, blob_tx, blob_index   Parquet, partitioned by run_date
    <root>/vendor/export, prices, issuance            JSON lines below dated folders
    <root>/registry/rollup_registry.csv               rollups with their batcher addresses
    <root>/registry/universe.csv                      rollups with their vendor keys and scope
    <root>/registry/contract_mappings.csv             contract addresses of rollups
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlelens.functions import columns as X
from settlelens.plans.daily import Inputs
from settlelens.sources import chain as SC
from settlelens.sources import vendor as SV

CONTRACT_COLUMNS = ["rollup_id", "contract_address", "contract_role", "valid_from_utc", "valid_to_utc", "source_url", "confidence"]


def universe_with_periods(universe: DataFrame, registry: DataFrame) -> DataFrame:
    """The vendor universe with the active period and status that the registry gives each rollup.

    A rollup listed more than once keeps its latest verified row; one without a registry row has no bounds.
    """
    period = F.struct("start_date_utc", "end_date_utc", "status")
    listed = registry.groupBy("rollup_id").agg(F.max_by(period, F.struct("verified_utc", period)).alias("_p"))
    return universe.join(listed, "rollup_id", "left").select(
        "rollup_id", "origin_key", "display_name", "category", "in_scope",
        F.col("_p.start_date_utc").alias("start_date_utc"), F.col("_p.end_date_utc").alias("end_date_utc"),
        F.col("_p.status").alias("status"),
    )


def address_mappings(registry: DataFrame) -> DataFrame:
    """Batcher addresses as sender mappings. Registry dates are inclusive, timestamps half-open."""
    return registry.filter("address IS NOT NULL").select(
        "rollup_id",
        "address",
        F.lit("batch_poster").alias("address_role"),
        F.coalesce("start_date_utc", F.lit("1970-01-01").cast("date")).cast("timestamp").alias("valid_from_utc"),
        F.date_add("end_date_utc", 1).cast("timestamp").alias("valid_to_utc"),
        F.col("evidence_url").alias("source_url"),
        F.when(F.col("verified_utc").isNotNull(), "high").otherwise("med").alias("confidence"),
    )


def read_contract_mappings(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, schema=", ".join(f"{c} STRING" for c in CONTRACT_COLUMNS), header=True, escape='"', enforceSchema=False)
    moment = lambda c: F.col(c).try_cast("timestamp").alias(c)
    return raw.select(
        "rollup_id", X.normalize_address("contract_address").alias("contract_address"), "contract_role",
        moment("valid_from_utc"), moment("valid_to_utc"), "source_url", "confidence",
    ).filter("contract_address IS NOT NULL")


def inputs(spark: SparkSession, root: str, registry_version: str, run_dates: tuple[str, str] | None = None) -> Inputs:
    """The inputs of a run from the landed folders; ``run_dates`` prunes the chain folders."""
    registry = SC.read_registry(spark, f"{root}/registry/rollup_registry.csv")
    index = spark.read.schema("tx_hash STRING, index_blob_count INT, run_date DATE").parquet(f"{root}/l1/blob_index")
    return Inputs(
        blocks=SC.read_l1(spark, f"{root}/l1", "blocks", run_dates).drop("run_date"),
        receipts=SC.read_l1(spark, f"{root}/l1", "receipts", run_dates).drop("run_date"),
        blob_tx=SC.read_l1(spark, f"{root}/l1", "blob_tx", run_dates).drop("run_date"),
        blob_index=index.drop("run_date"),
        addresses=address_mappings(registry),
        contracts=read_contract_mappings(spark, f"{root}/registry/contract_mappings.csv"),
        metrics=SV.read_vendor_export(spark, f"{root}/vendor/export").drop("snapshot_path"),
        universe=universe_with_periods(SV.read_universe(spark, f"{root}/registry/universe.csv"), registry),
        prices=SV.read_prices(spark, f"{root}/vendor/prices").select("date_utc", "eth_usd_close"),
        issuance=SV.read_issuance(spark, f"{root}/vendor/issuance").select("date_utc", "issuance_eth"),
        registry_version=registry_version,
    )
