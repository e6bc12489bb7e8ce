"""The take rate and the ratios built on daily panels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from settlelens import contracts as C
from settlelens.functions import columns as X

# Doubles are summed through decimals: the result does not depend on partitioning or task order.
EXACT = "decimal(38,12)"


def exact_sum(name: Column | str) -> Column:
    return F.sum(X.col(name).cast(EXACT))


def _complete(panel: DataFrame) -> DataFrame:
    return panel.filter(F.col("l2_fees_eth").isNotNull() & F.col("rent_paid_eth").isNotNull())


def str_daily(panel: DataFrame) -> DataFrame:
    """Ecosystem take rate per day. A rollup-day with either side missing leaves both sums."""
    return (
        _complete(panel)
        .groupBy("date_utc")
        .agg(
            exact_sum("rent_paid_eth").cast("double").alias("rent_paid_eth"),
            exact_sum("l2_fees_eth").cast("double").alias("l2_fees_eth"),
            F.count(F.lit(1)).alias("n_rollups"),
        )
        .withColumn("str", X.ratio_or_nan("rent_paid_eth", "l2_fees_eth"))
    )


def str_by_rollup(panel: DataFrame) -> DataFrame:
    return _complete(panel).select(
        "date_utc", "rollup_id", X.ratio_or_nan("rent_paid_eth", "l2_fees_eth").alias("str")
    )


def rollup_and_total(panel: DataFrame) -> DataFrame:
    """Rollup-day rows and day totals from one scan with grouping sets; ``is_total`` marks the latter."""
    p = _complete(panel)
    return (
        p.groupingSets(
            [[F.col("date_utc"), F.col("rollup_id")], [F.col("date_utc")]], F.col("date_utc"), F.col("rollup_id")
        )
        .agg(
            exact_sum("l2_fees_eth").cast("double").alias("l2_fees_eth"),
            exact_sum("rent_paid_eth").cast("double").alias("rent_paid_eth"),
            (F.grouping_id() > 0).alias("is_total"),
        )
        .withColumn("str", X.ratio_or_nan("rent_paid_eth", "l2_fees_eth"))
    )


def monthly_totals(panel: DataFrame, values: list[str]) -> DataFrame:
    return panel.groupBy(X.month_of("date_utc").alias("month_utc"), "rollup_id").agg(
        *[exact_sum(v).cast("double").alias(v) for v in values]
    )


def profit_margin(panel: DataFrame) -> DataFrame:
    profit = F.col("l2_fees_eth") - F.col("rent_paid_eth")
    return panel.withColumns({"l2_profit_eth": profit, "l2_profit_margin": X.ratio_or_nan(profit, "l2_fees_eth")})


def burn_share_of_issuance(costs: DataFrame, issuance: DataFrame) -> DataFrame:
    """(base burn + blob burn) / issuance per day, summed per day before the join; no issuance, no share."""
    burns = costs.groupBy("date_utc").agg(
        (F.sum("burn_base_eth") + F.sum("burn_blob_eth")).cast("double").alias("rollup_burn_eth")
    )
    return burns.join(issuance.select("date_utc", "issuance_eth"), "date_utc", "left").withColumn(
        "burn_share", X.ratio_or_nan("rollup_burn_eth", "issuance_eth")
    )


def burn_tip_shares(costs: DataFrame, keys: tuple[str, ...] = ("date_utc",)) -> DataFrame:
    total = F.col("burn_eth") + F.col("tips_eth")
    return (
        costs.groupBy(*keys)
        .agg(
            (F.sum("burn_base_eth") + F.sum("burn_blob_eth")).cast("double").alias("burn_eth"),
            F.sum("tips_eth").cast("double").alias("tips_eth"),
        )
        .withColumns({"burn_share": X.ratio_or_nan("burn_eth", total), "tip_share": X.ratio_or_nan("tips_eth", total)})
    )


def share_at_minimum(daily_fee: DataFrame, fee: str, epsilon: float = 0.0) -> DataFrame:
    at_min = (F.col(fee) <= C.MIN_BLOB_BASE_FEE_WEI + epsilon).cast("int")
    return daily_fee.agg(F.count(fee).alias("n_days"), F.sum(at_min).alias("n_at_min")).withColumn(
        "share_at_min", X.ratio_or_null("n_at_min", "n_days")
    )


def nonzero_denominator_days(panel: DataFrame) -> DataFrame:
    days = str_daily(panel)
    return days.agg(
        F.count(F.lit(1)).alias("n_days"), F.count_if(F.col("l2_fees_eth") != 0).alias("n_nonzero_days")
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def level_shift(series: DataFrame, value: str, boundary: dt.date) -> DataFrame:
    """Mean, spread and size of a daily series before and after a date."""
    v = X.not_nan(value)
    return series.groupBy(X.post_regime("date_utc", boundary).alias("post_regime")).agg(
        F.avg(v).alias("mean_value"), F.stddev_samp(v).alias("sd_value"), F.count(v).alias("n_days")
    )


def rent_levels(panel: DataFrame) -> DataFrame:
    """Rent per day in ETH and per transaction, next to the ratio."""
    return (
        _complete(panel)
        .groupBy("date_utc")
        .agg(
            exact_sum("rent_paid_eth").cast("double").alias("rent_paid_eth"),
            F.sum("txcount").alias("txcount"),
        )
        .withColumn("rent_per_tx", X.ratio_or_nan("rent_paid_eth", "txcount"))
    )


def smoothed(series: DataFrame, value: str, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Trailing calendar-day means; NaN days are left out. One row per series and day, so a
    partition holds no more rows than there are calendar days."""
    out = {}
    for d in days:
        w = W.partitionBy("series_id").orderBy("t").rangeBetween(-(d - 1), 0)
        out[f"mean_{d}d"] = F.avg(X.not_nan(value)).over(w)
    return series.withColumns(out)


def rolling_ratio(series: DataFrame, num: str, den: str, days: int) -> DataFrame:
    """Rolling sum / rolling sum over calendar days."""
    w = W.partitionBy("series_id").orderBy("t").rangeBetween(-(days - 1), 0)
    return series.withColumn(
        f"{num}_per_{den}_{days}d",
        X.ratio_or_nan(F.sum(F.col(num).cast(EXACT)).over(w), F.sum(F.col(den).cast(EXACT)).over(w)),
    )


def true_runs(df: DataFrame, keys: list[str], date: str, flag: Column, min_days: int) -> DataFrame:
    """Runs of at least ``min_days`` consecutive calendar days with a true flag. A null flag or an
    absent day ends a run. Rows are unique per key and day, so the window of a key, or the single one
    without keys, holds calendar days only."""
    hit = df.filter(flag).select(*keys, F.col(date).alias("_d"))
    w = W.partitionBy(*keys).orderBy("_d") if keys else W.partitionBy(F.lit(1)).orderBy("_d")
    island = F.date_sub("_d", F.row_number().over(w)).alias("_island")
    return (
        hit.select(*keys, "_d", island)
        .groupBy(*keys, "_island")
        .agg(F.min("_d").alias("run_start"), F.max("_d").alias("run_end"), F.count(F.lit(1)).alias("n_days"))
        .filter(F.col("n_days") >= min_days)
        .drop("_island")
    )


def floor_runs(
    decomposition: DataFrame, boundary: dt.date = C.DENCUN_DATE, fee: str = "l1_blob_base_fee_gwei"
) -> DataFrame:
    """Blob fee floor regime: fee <= 1.05 x the minimum over the whole post-activation sample."""
    post = decomposition.filter(X.post_regime("date_utc", boundary)).select("date_utc", fee)
    low = post.agg((F.min(fee) * F.lit(float(C.FLOOR_FACTOR))).alias("_limit"))
    return true_runs(post, [], "date_utc", F.col(fee) <= low.scalar(), C.FLOOR_MIN_DAYS)


def days_in_runs(runs: DataFrame) -> DataFrame:
    return runs.select(F.explode(F.sequence("run_start", "run_end")).alias("date_utc"))


def str_by_regime(daily: DataFrame, runs: DataFrame, state: DataFrame, boundary: dt.date) -> DataFrame:
    """Take-rate level by floor regime and utilization band, after activation."""
    floor_days = days_in_runs(runs).withColumn("at_floor", F.lit(True))
    d = (
        daily.filter(X.post_regime("date_utc", boundary))
        .join(floor_days, "date_utc", "left")
        .join(state.select("date_utc", "blob_utilization"), "date_utc", "left")
    )
    band = (
        F.when(F.col("blob_utilization").isNull(), "unknown")
        .when(F.col("blob_utilization") < 1 / 3, "low")
        .when(F.col("blob_utilization") < 2 / 3, "mid")
        .otherwise("high")
    )
    v = X.not_nan("str")
    return d.groupBy(F.coalesce("at_floor", F.lit(False)).alias("at_floor"), band.alias("utilization_band")).agg(
        F.avg(v).alias("mean_str"), F.count(v).alias("n_days")
    )


# ---- calendars and gaps -----------------------------------------------------------------------


def spine(universe: DataFrame, start: Column | str, end: Column | str) -> DataFrame:
    """One row per rollup and calendar day of its own window; built by exploding, not by a cross join."""
    return universe.withColumn("date_utc", F.explode(F.sequence(X.col(start), X.col(end))))


def calendar(df: DataFrame, date: str = "date_utc", keys: tuple[str, ...] = ()) -> DataFrame:
    bounds = df.groupBy(*keys).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi")).filter("_lo IS NOT NULL")
    return bounds.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(date))


def coverage(spine_rows: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Observed / expected days per rollup."""
    seen = observed.select(*keys).distinct().withColumn("_seen", F.lit(1))
    rest = [k for k in keys if k != "date_utc"]
    return (
        spine_rows.join(seen, keys, "left")
        .groupBy(*rest)
        .agg(F.count(F.lit(1)).alias("expected_days"), F.count("_seen").alias("observed_days"))
        .withColumn("coverage", X.ratio_or_null("observed_days", "expected_days"))
    )


def missing_day_runs(df: DataFrame, max_missing: int = C.MAX_MISSING_DAYS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs of more than ``max_missing`` calendar days without a row, between a key's first and last day."""
    days = df.select(*keys, "date_utc").distinct()
    missing = calendar(days, keys=keys).join(days, [*keys, "date_utc"], "left_anti")
    return true_runs(missing, list(keys), "date_utc", F.lit(True), max_missing + 1)


def missing_numbers(df: DataFrame, number: str, shard: int = 1_000_000) -> DataFrame:
    """Gaps in an integer sequence as (gap_start, gap_end, n_missing).

    Neighbours are found inside shards of ``shard`` numbers; gaps that cross shards come from the
    shard bounds alone, of which there are few. No window runs over the whole table.
    """
    n = df.select(F.col(number).cast("bigint").alias("_n")).distinct().withColumn("_s", F.floor(F.col("_n") / shard))
    inner = n.withColumn("_next", F.lead("_n").over(W.partitionBy("_s").orderBy("_n")))
    bounds = n.groupBy("_s").agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
    edges = bounds.select(
        F.col("_hi").alias("_n"), F.lead("_lo").over(W.partitionBy(F.lit(1)).orderBy("_s")).alias("_next")
    )
    return (
        inner.select("_n", "_next")
        .unionByName(edges)
        .filter(F.col("_next") - F.col("_n") > 1)
        .select(
            (F.col("_n") + 1).alias("gap_start"),
            (F.col("_next") - 1).alias("gap_end"),
            (F.col("_next") - F.col("_n") - 1).alias("n_missing"),
        )
    )


# ---- ranking ----------------------------------------------------------------------------------


def trailing_fees(panel: DataFrame, days: int = 30) -> DataFrame:
    """Fees per rollup over the last ``days`` days of the panel."""
    last = panel.agg(F.max("date_utc").alias("_last"))
    return (
        panel.filter(F.col("date_utc") > F.date_sub(last.scalar(), days))
        .groupBy("rollup_id")
        .agg(exact_sum("l2_fees_eth").cast("double").alias("l2_fees_eth"))
    )


def rank_rollups(panel: DataFrame, days: int = 30) -> DataFrame:
    """Rank by trailing fees; the one window holds a row per rollup."""
    w = W.partitionBy(F.lit(1)).orderBy(F.desc("l2_fees_eth"))
    return trailing_fees(panel, days).withColumn("fee_rank", F.rank().over(w))


def top_rollups(panel: DataFrame, n: int, days: int = 30) -> DataFrame:
    return trailing_fees(panel, days).orderBy(F.desc("l2_fees_eth"), "rollup_id").limit(n)


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """All rows with their 0-based position in a stated order.

    The rows are sorted by ranges and written once; a position is the place within its range plus the
    rows of the ranges before, of which there is one count each. No task sees more than its range.
    """
    from settlelens.session import materialize

    placed = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = materialize(placed, "numbered").withColumn("_range", F.shiftright("_id", 33))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))
    return placed.join(starts, "_range").withColumn(
        "row_index", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    ).drop("_id", "_range", "_before")


# ---- assembly ---------------------------------------------------------------------------------


def assemble_panel(vendor: DataFrame, onchain: DataFrame, blob_state: DataFrame) -> DataFrame:
    """Wide panel: vendor rows, on-chain costs kept null when absent, blob regime by day."""
    o = onchain.select(
        "date_utc",
        "rollup_id",
        F.col("l1_total_cost_eth").cast("double").alias("onchain_l1_cost_eth"),
        F.col("burn_base_eth").cast("double").alias("onchain_burn_base_eth"),
        F.col("burn_blob_eth").cast("double").alias("onchain_burn_blob_eth"),
        F.col("tips_eth").cast("double").alias("onchain_tips_eth"),
        (F.col("missing_blob_tx") > 0).alias("onchain_cost_coverage_flag"),
    )
    v = vendor.withColumnsRenamed({"rent_paid_eth": "vendor_rent_paid_eth", "profit_eth": "vendor_profit_eth"})
    b = blob_state.withColumn("blob_fee_at_min_flag", F.col("blob_base_fee_wei_p50") <= C.MIN_BLOB_BASE_FEE_WEI)
    return v.join(o, ["date_utc", "rollup_id"], "left").join(b, "date_utc", "left")


def add_macro(panel: DataFrame, prices: DataFrame, issuance: DataFrame) -> DataFrame:
    return panel.join(prices.select("date_utc", "eth_usd_close"), "date_utc", "left").join(
        issuance.select("date_utc", "issuance_eth"), "date_utc", "left"
    )


def latest_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest row per key. ``max_by`` combines on the map side, where a row_number would sort every
    version of a key in one task. Rows of one version are told apart by their values, so the winner
    does not depend on the order of rows."""
    rest = [c for c in df.columns if c not in keys]
    ties = [F.col(c) for c in rest if c != version and not isinstance(df.schema[c].dataType, T.MapType)]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(F.col(version), *ties)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def revisions(df: DataFrame, keys: list[str], version: str, value: str) -> DataFrame:
    """Values that changed between consecutive snapshots of a key (as many rows as it has snapshots)."""
    w = W.partitionBy(*keys).orderBy(version)
    return (
        df.withColumns(
            {f"previous_{value}": F.lag(value).over(w), f"previous_{version}": F.lag(version).over(w)}
        )
        .filter(F.col(f"previous_{version}").isNotNull() & ~F.col(value).eqNullSafe(F.col(f"previous_{value}")))
    )
