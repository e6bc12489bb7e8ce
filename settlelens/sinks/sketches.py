"""Daily sketches as a stored table: distinct senders and fee quantiles over any range of days without the fact.

A row per day and rollup holds a HyperLogLog sketch of the senders, a KLL sketch of the execution fees in gwei,
and exact counts. Sketches merge by aggregation, so a range of days, a set of rollups or both read as many small
rows as there are cells; no transaction is looked at again, and a day is refreshed by replacing its rows.

Errors. HyperLogLog with 2^lg registers has a relative standard error of 1.04 / 2^(lg/2), 1.6 percent at the
default 12; ``SENDER_BOUND`` is three of them. A KLL sketch with k = 200 misses a rank by at most 1.65 percent of the
rows with a confidence of 99 percent, merged or not; ``RANK_BOUND`` is twice that.

Edge cases. Null senders and null fees are in no sketch; a cell without any has a null sketch, which merging
skips. A range without rows gives no row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlelens import contracts as C
from settlelens.sinks.tables import write_partitions

LG = 12
KLL_K = 200
SENDER_BOUND = 3 * 1.04 / 2 ** (LG / 2)
RANK_BOUND = 0.033


def daily_sketches(tx: DataFrame) -> DataFrame:
    """(date_utc, rollup_id, n_tx, n_fees, senders, fees) of attributed transactions; one aggregate with partial sketches."""
    gwei = (F.col("execution_fee_wei") / F.lit(C.WEI_PER_GWEI)).cast("double")
    return tx.groupBy("date_utc", "rollup_id").agg(
        F.count(F.lit(1)).alias("n_tx"),
        F.count("execution_fee_wei").alias("n_fees"),
        F.hll_sketch_agg("from_address", F.lit(LG)).alias("senders"),
        F.kll_sketch_agg_double(gwei, F.lit(KLL_K)).alias("fees"),
    )


def write_sketches(tx: DataFrame, path: str) -> None:
    """Days present in ``tx`` replace those stored."""
    write_partitions(daily_sketches(tx), path, ["date_utc"])


def read_sketches(spark: SparkSession, path: str, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """The stored cells of a range of days; the range prunes folders."""
    cells = spark.read.parquet(path)
    if first is not None:
        cells = cells.where(F.col("date_utc") >= F.lit(first))
    return cells if last is None else cells.where(F.col("date_utc") <= F.lit(last))


def merged(cells: DataFrame, *by, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Estimates per ``by``: n_tx exact, senders, and fee quantiles as ``fee_gwei_p<percent>``."""
    both = cells.groupBy(*by).agg(
        F.sum("n_tx").alias("n_tx"),
        F.sum("n_fees").alias("n_fees"),
        F.hll_union_agg("senders").alias("_senders"),
        F.kll_merge_agg_double("fees").alias("_fees"),
    )
    names = [c for c in both.columns if not c.startswith("_")]
    picks = [
        F.when(F.col("n_fees") > 0, F.kll_sketch_get_quantile_double("_fees", F.lit(q))).alias(f"fee_gwei_p{round(100 * q)}") for q in quantiles
    ]
    return both.select(*names, F.hll_sketch_estimate("_senders").alias("senders"), *picks)
