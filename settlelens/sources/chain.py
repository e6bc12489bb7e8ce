"""Readers of chain tables and of the attribution registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlelens import contracts as C
from settlelens.functions import columns as X

_TABLES = {"blocks": C.BLOCKS, "receipts": C.RECEIPTS, "blob_tx": C.BLOB_TX}


def read_l1(spark: SparkSession, root: str, table: str, run_dates: tuple[str, str] | None = None) -> DataFrame:
    """One raw chain table, partitioned by run_date; a date range prunes folders, not rows."""
    schema = T.StructType([*_TABLES[table].fields, T.StructField("run_date", T.DateType())])
    df = spark.read.schema(schema).parquet(f"{root}/{table}")
    if run_dates is not None:
        df = df.filter(F.col("run_date").between(F.lit(run_dates[0]).cast("date"), F.lit(run_dates[1]).cast("date")))
    return df


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry CSV with typed dates and one row per batcher address (null where it lists none)."""
    schema = ", ".join(f"{c} STRING" for c in C.REGISTRY_COLUMNS)
    raw = spark.read.csv(path, schema=schema, header=True, escape='"', enforceSchema=False, multiLine=True)
    typed = raw.withColumns(
        {c: X.strict_date(c) for c in ("verified_utc", "start_date_utc", "end_date_utc")}
    )
    return explode_addresses(typed)


def explode_addresses(registry: DataFrame) -> DataFrame:
    return registry.select("*", F.explode_outer(X.json_strings("batcher_addresses_json")).alias("_raw")).withColumn(
        "address", X.normalize_address("_raw")
    ).drop("_raw")
