"""Cross-source comparison by month and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlelens import contracts as C
from settlelens.functions import columns as X
from settlelens.operators.checks import difference_check
from settlelens.operators.metrics import exact_sum


def monthly_by_source(first: DataFrame, second: DataFrame, first_value: str, second_value: str) -> DataFrame:
    """Monthly sums of two sources side by side; each is summed before the join, so the join sees
    months x rollups rows only."""
    month = X.month_of("date_utc").alias("month_utc")
    a = first.groupBy(month, "rollup_id").agg(exact_sum(first_value).cast("double").alias("first_value"))
    b = second.groupBy(month, "rollup_id").agg(exact_sum(second_value).cast("double").alias("second_value"))
    return a.join(b, ["month_utc", "rollup_id"], "full_outer")


def reconcile_months(pairs: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """pass <= 5%, warn <= 10%, else fail; the first source is the base."""
    if top is not None:
        pairs = pairs.join(top.select("rollup_id"), "rollup_id", "left_semi")
    key = F.concat_ws("|", F.col("month_utc").cast("string"), "rollup_id")
    return difference_check(
        pairs, "reconcile", key, "second_value", "first_value", C.RECONCILE_PASS, C.RECONCILE_WARN
    )


def blob_gas_check(onchain_daily: DataFrame, market_daily: DataFrame) -> DataFrame:
    """Blob gas of two sources per day, one percent; the chain is the base."""
    a = onchain_daily.select("date_utc", F.col("blob_gas_used").cast("double").alias("base"))
    b = market_daily.select("date_utc", F.col("blob_gas_used").cast("double").alias("value"))
    return difference_check(
        a.join(b, "date_utc", "full_outer"),
        "blob_gas",
        F.col("date_utc"),
        "value",
        "base",
        C.BLOB_GAS_TOLERANCE,
        C.BLOB_GAS_TOLERANCE,
    )


def monthly_averages(primary: DataFrame, secondary: DataFrame, value: str) -> DataFrame:
    """Monthly average of a global series in two sources."""
    month = X.month_of("date_utc").alias("month_utc")

    def mean(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(month).agg(
            (exact_sum(value).cast("double") / F.count(value)).alias(name)
        )

    return mean(primary, "primary_value").join(mean(secondary, "secondary_value"), "month_utc", "full_outer")


def input_check(pairs: DataFrame, name: str, passed: float, warned: float) -> DataFrame:
    return difference_check(pairs, name, F.col("month_utc"), "secondary_value", "primary_value", passed, warned)


def error_bands(pairs: DataFrame, value: str = "second_value", base: str = "first_value") -> DataFrame:
    """Per-rollup spread of relative differences; one row per rollup and month goes in, so the exact
    percentile holds months, not transactions."""
    d = pairs.withColumn("_diff", F.try_divide(F.col(value) - F.col(base), F.abs(F.col(base)))).filter(
        "_diff IS NOT NULL"
    )
    return d.groupBy("rollup_id").agg(
        F.percentile("_diff", F.lit(0.05)).alias("p05"),
        F.percentile("_diff", F.lit(0.5)).alias("p50"),
        F.percentile("_diff", F.lit(0.95)).alias("p95"),
        F.stddev_samp("_diff").alias("sd"),
        F.count(F.lit(1)).alias("n_months"),
    )


def trusted_series(bands: DataFrame, limit: float = C.RECONCILE_WARN) -> DataFrame:
    """First source while the two agree within the band, on-chain beyond it."""
    spread = F.greatest(F.abs("p05"), F.abs("p95"))
    return bands.withColumn("max_abs_band", spread).withColumn(
        "trusted", F.when(spread <= limit, "vendor").otherwise("onchain")
    )
