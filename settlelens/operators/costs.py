"""Fee parts of transactions and their daily sums, exact in wei."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlelens import contracts as C
from settlelens.functions import columns as X
from settlelens.functions.joins import exact_percentiles


# Parts that blocks with a given fee, or without excess gas, are dealt to.
SPREAD = 4_096


def with_blob_fee(blocks: DataFrame) -> DataFrame:
    """Blocks with a blob base fee where their header allows one: the given fee, else the fee rule on excess gas.

    ``blob_fee_derived`` tells which; blocks that have it are through already and stay as they are. The raw block
    table may lack the fee on some rows or altogether. Excess gas moves in steps of a blob, so there are few
    different values: the rule is worked out once for each of them, not once for each block.
    """
    if "blob_fee_derived" in blocks.columns:
        return blocks
    given = F.col("base_fee_per_blob_gas_wei").cast(C.PRICE_WEI) if "base_fee_per_blob_gas_wei" in blocks.columns else F.lit(None).cast(C.PRICE_WEI)
    _, fraction = blob_limits(X.epoch_date("timestamp"))
    lacking = given.isNull() & F.col("excess_blob_gas").isNotNull()
    keyed = blocks.withColumns({"blob_fee_derived": lacking, "_fraction": F.when(lacking, fraction)})
    levels = keyed.where("blob_fee_derived").select(F.col("excess_blob_gas").alias("_excess"), F.col("_fraction").alias("_over")).distinct()
    levels = levels.withColumn("_rule", X.blob_base_fee(F.lit(None), "_excess", "_over").cast(C.PRICE_WEI))
    # Rows with a given fee or without excess gas have no fraction, and so none of them finds a level; they are dealt by
    # themselves, as without excess gas they would all meet in one task.
    dealt = F.pmod(F.xxhash64(*[c for c in ("block_number", "timestamp") if c in blocks.columns]), F.lit(SPREAD))
    keyed = keyed.withColumn("_look", F.when(lacking, F.col("excess_blob_gas")).otherwise(dealt))
    joined = keyed.join(levels, (F.col("_look") == F.col("_excess")) & (F.col("_fraction") == F.col("_over")), "left")
    return joined.withColumn("base_fee_per_blob_gas_wei", F.coalesce(given, "_rule")).drop("_fraction", "_excess", "_over", "_rule", "_look")


def with_block_fees(tx: DataFrame, blocks: DataFrame) -> DataFrame:
    """Base fees and time of each transaction's block; only the needed block columns are shuffled.

    A transaction whose block is absent stays, with ``block_missing`` and no date.
    """
    b = with_blob_fee(blocks).select(
        "block_number",
        F.timestamp_seconds("timestamp").alias("ts"),
        "base_fee_per_gas_wei",
        "base_fee_per_blob_gas_wei",
    )
    joined = tx.join(b, "block_number", "left")
    return joined.withColumns({"date_utc": F.col("ts").cast("date"), "block_missing": F.col("ts").isNull()})


def with_blob_detail(tx: DataFrame, blob_tx: DataFrame) -> DataFrame:
    """Blob counts by hash: the given count, else the number of versioned hashes.

    Only type-3 rows can have detail, so only they are shuffled by hash.
    """
    detail = blob_tx.select(
        "tx_hash",
        F.coalesce("blob_count", X.blob_count_from_hashes("blob_versioned_hashes")).cast("int").alias("blob_count"),
    )
    bare = tx.drop("blob_count")
    typed = bare.filter("tx_type = 3").join(detail, "tx_hash", "left")
    rest = bare.filter("NOT (tx_type <=> 3)").withColumn("blob_count", F.lit(None).cast("int"))
    return typed.unionByName(rest)


def fill_blob_count(tx: DataFrame, index: DataFrame) -> DataFrame:
    """Missing counts from an auxiliary index; ``blob_count_source`` says where a count came from.

    Rows that need no help are not shuffled.
    """
    needs = (F.col("tx_type").eqNullSafe(3)) & F.col("blob_count").isNull()
    filled = (
        tx.filter(needs)
        .drop("blob_count")
        .join(index.select("tx_hash", F.col("index_blob_count").cast("int").alias("blob_count")), "tx_hash", "left")
        .withColumn("blob_count_source", F.when(F.col("blob_count").isNotNull(), "index"))
    )
    rest = tx.filter(~needs).withColumn("blob_count_source", F.when(F.col("blob_count").isNotNull(), "chain"))
    return rest.unionByName(filled)


def fee_parts(tx: DataFrame) -> DataFrame:
    """Per-transaction parts. Type 3 without a blob count or a blob fee has an unknown blob burn, kept apart.

    Failed transactions pay too, so status is not looked at.
    """
    gas, price, base = F.col("gas_used").cast(C.GAS), F.col("effective_gas_price_wei").cast(C.PRICE_WEI), F.col(
        "base_fee_per_gas_wei"
    ).cast(C.PRICE_WEI)
    blob = F.col("blob_count").cast("decimal(6,0)") * F.lit(C.GAS_PER_BLOB).cast("decimal(6,0)")
    burn_blob = (blob * F.col("base_fee_per_blob_gas_wei").cast(C.PRICE_WEI)).cast("decimal(30,0)")
    return tx.withColumns(
        {
            "burn_base_wei": (gas * base).cast("decimal(30,0)"),
            "tips_wei": (gas * (price - base)).cast("decimal(30,0)"),
            "execution_fee_wei": (gas * price).cast("decimal(30,0)"),
            "burn_blob_wei": F.when(F.col("tx_type") == 3, burn_blob).otherwise(F.lit(0).cast("decimal(30,0)")),
            "blob_burn_unknown": (F.col("tx_type") == 3) & burn_blob.isNull(),
            "price_below_base": price < base,
        }
    )


def quarantine(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rows whose price is below the base fee or whose block is absent)."""
    bad = F.coalesce("price_below_base", F.lit(False))
    if "block_missing" in tx.columns:
        bad = bad | F.col("block_missing")
    return tx.filter(~bad), tx.filter(bad)


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast(C.WEI)


def exact_mean(name: str) -> Column:
    """Mean of wei amounts: the decimal average would keep four places only."""
    return X.ratio_or_null(F.sum(name), F.count(name))


def daily_costs(tx: DataFrame, keys: tuple[str, ...] = ("date_utc", "rollup_id")) -> DataFrame:
    """Wei sums per key with map-side partial sums, then one exact conversion to ETH."""
    sums = tx.groupBy(*keys).agg(
        _sum("execution_fee_wei").alias("execution_fee_wei"),
        _sum("burn_base_wei").alias("burn_base_wei"),
        _sum("tips_wei").alias("tips_wei"),
        _sum("burn_blob_wei").alias("burn_blob_wei"),
        F.count_if("blob_burn_unknown").alias("missing_blob_tx"),
        F.coalesce(F.sum(F.when(F.col("blob_burn_unknown"), F.col("execution_fee_wei"))), F.lit(0))
        .cast(C.WEI)
        .alias("missing_blob_execution_wei"),
        F.count(F.lit(1)).alias("n_tx"),
    )
    total = (F.col("execution_fee_wei") + F.col("burn_blob_wei")).cast(C.WEI)
    return sums.select(
        *keys,
        X.wei_to_eth(total).alias("l1_total_cost_eth"),
        X.wei_to_eth("burn_base_wei").alias("burn_base_eth"),
        X.wei_to_eth("burn_blob_wei").alias("burn_blob_eth"),
        X.wei_to_eth("tips_wei").alias("tips_eth"),
        "missing_blob_tx",
        X.wei_to_eth("missing_blob_execution_wei").alias("missing_blob_execution_eth"),
        "n_tx",
    )


def total_spend() -> Column:
    """Execution fee plus blob burn; an unknown burn counts nothing here and is counted apart in the costs."""
    return (F.col("execution_fee_wei") + F.coalesce("burn_blob_wei", F.lit(0))).cast("decimal(31,0)")


def decomposition(tx: DataFrame, blob_state: DataFrame) -> DataFrame:
    """Daily burn and tips of attributed transactions; the total is the sum of its parts.

    The blob fee is the level of the day, the mean over its blocks in ``blob_state``.
    """
    d = (
        tx.groupBy("date_utc")
        .agg(
            _sum("burn_base_wei").alias("_base"),
            _sum("burn_blob_wei").alias("_blob"),
            _sum("tips_wei").alias("_tips"),
            F.sum(X.blob_gas("blob_count")).alias("l1_blob_gas_used"),
        )
        .join(blob_state.select("date_utc", F.col("blob_base_fee_wei_avg").alias("_fee")), "date_utc", "left")
    )
    return d.select(
        "date_utc",
        X.wei_to_eth("_base").alias("l1_base_fee_burn_eth"),
        X.wei_to_eth("_blob").alias("l1_blob_fee_burn_eth"),
        X.wei_to_eth("_tips").alias("l1_priority_fee_eth"),
        X.wei_to_eth((F.col("_base") + F.col("_blob") + F.col("_tips")).cast(C.WEI)).alias("l1_total_rent_eth"),
        "l1_blob_gas_used",
        F.lit(None).cast("bigint").alias("l1_calldata_gas_used"),
        (F.col("_fee") / C.WEI_PER_GWEI).alias("l1_blob_base_fee_gwei"),
    )


def blob_limits(date: Column) -> tuple[Column, Column]:
    """(maximum blob gas per block, fee update fraction) on a date; the first fork before that."""
    gas, fraction = None, None
    for _, start, _, blobs, frac in reversed(C.BLOB_FORKS):
        g, f = F.lit(blobs * C.GAS_PER_BLOB), F.lit(frac)
        gas = F.when(date >= F.lit(start), g) if gas is None else gas.when(date >= F.lit(start), g)
        fraction = F.when(date >= F.lit(start), f) if fraction is None else fraction.when(date >= F.lit(start), f)
    first = C.BLOB_FORKS[0]
    return gas.otherwise(F.lit(first[3] * C.GAS_PER_BLOB)), fraction.otherwise(F.lit(first[4]))




def blob_market_daily(blocks: DataFrame, tx: DataFrame) -> DataFrame:
    """Blob gas of blocks with type-3 transaction and blob counts, per day. ``tx`` needs block_number and tx_type only."""
    gas = (
        blocks.withColumn("date_utc", X.epoch_date("timestamp"))
        .groupBy("date_utc")
        .agg(
            F.sum("blob_gas_used").alias("blob_gas_used"),
            F.max_by("excess_blob_gas", F.struct("timestamp", "block_number")).alias("excess_blob_gas"),
            F.count(F.lit(1)).alias("n_blocks"),
            F.count("blob_gas_used").alias("n_blob_headers"),
        )
        .withColumn("blobs_count", X.blobs_from_gas("blob_gas_used"))
    )
    # Only type-3 rows are looked up; days without any count zero below.
    dates = blocks.select("block_number", X.epoch_date("timestamp").alias("date_utc"))
    typed = tx.filter("tx_type = 3").select("block_number").join(dates, "block_number")
    txs = typed.groupBy("date_utc").agg(F.count(F.lit(1)).alias("blob_tx_count"))
    return gas.join(txs, "date_utc", "left").withColumn("blob_tx_count", F.coalesce("blob_tx_count", F.lit(0)))


def blob_fee_state(blocks: DataFrame) -> DataFrame:
    """Daily average and exact median blob fee, and utilization = used / maximum."""
    b = with_blob_fee(blocks).withColumn("date_utc", X.epoch_date("timestamp"))
    limit, _ = blob_limits(F.col("date_utc"))
    means = b.groupBy("date_utc").agg(
        exact_mean("base_fee_per_blob_gas_wei").alias("blob_base_fee_wei_avg"),
        X.ratio_or_null(F.sum("blob_gas_used"), F.sum(F.when(F.col("blob_gas_used").isNotNull(), limit))).alias(
            "blob_utilization"
        ),
    )
    medians = exact_percentiles(b, ["date_utc"], "base_fee_per_blob_gas_wei", {"blob_base_fee_wei_p50": 0.5})
    return means.join(medians, "date_utc", "left")


def at_minimum(fee: Column | str, epsilon: float = 0.0) -> Column:
    return X.col(fee) <= F.lit(C.MIN_BLOB_BASE_FEE_WEI) + F.lit(epsilon)


def header_presence(blocks: DataFrame, activation: dt.datetime = C.DENCUN_INSTANT) -> DataFrame:
    """Whether blob header fields are null before the activation instant and present after it."""
    seconds = int(activation.timestamp())
    active = F.col("timestamp") >= F.lit(seconds)
    present = F.col("blob_gas_used").isNotNull() & F.col("excess_blob_gas").isNotNull()
    absent = F.col("blob_gas_used").isNull() & F.col("excess_blob_gas").isNull()
    return blocks.withColumns({"active": active, "header_ok": F.when(active, present).otherwise(absent)})


def attribution_coverage(tx: DataFrame, boundary: dt.date = C.DENCUN_DATE) -> DataFrame:
    """Share of settlement spend attributed to a rollup by sender, per regime.

    Before the boundary settlement is paid as calldata, by the execution fee; after it, as blobs.
    """
    named = ~F.col("rollup_id").isin(C.OTHER, C.ROLLUP_LIKE)
    post = X.post_regime("date_utc", boundary)
    spend = "_spend"
    tx = tx.withColumn(spend, F.when(post, F.coalesce("burn_blob_wei", F.lit(0))).otherwise(F.col("execution_fee_wei")).cast(C.WEI))
    return (
        tx.groupBy(X.post_regime("date_utc", boundary).alias("post_regime"))
        .agg(
            F.sum(F.when(named, F.col(spend))).alias("_named"),
            F.sum(spend).alias("_all"),
        )
        .select(
            "post_regime",
            X.wei_to_eth(F.coalesce("_named", F.lit(0).cast(C.WEI))).cast("double").alias("attributed_eth"),
            X.wei_to_eth(F.coalesce("_all", F.lit(0).cast(C.WEI))).cast("double").alias("total_eth"),
            X.ratio_or_null(F.coalesce("_named", F.lit(0).cast(C.WEI)), "_all").alias("coverage"),
        )
    )


def top_unattributed(tx: DataFrame, n: int = 20) -> DataFrame:
    """Largest unattributed senders by spend; sums first, so only one row per sender is ordered."""
    return (
        tx.filter(F.col("rollup_id").isin(C.OTHER, C.ROLLUP_LIKE))
        .groupBy("from_address")
        .agg(F.sum(total_spend()).cast(C.WEI).alias("spend_wei"), F.count(F.lit(1)).alias("n_tx"))
        .orderBy(F.desc("spend_wei"), "from_address")
        .limit(n)
    )


def audit_sample(tx: DataFrame, one_in: int) -> DataFrame:
    """A repeatable sample by hash of the transaction; md5, so any engine draws the same rows."""
    draw = F.conv(F.substring(F.md5("tx_hash"), 1, 8), 16, 10).cast("bigint")
    return tx.filter(draw % one_in == 0)
