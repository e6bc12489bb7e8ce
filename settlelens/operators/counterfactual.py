"""What a blob fee floor would have changed, on observed demand."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlelens import contracts as C
from settlelens.functions import columns as X
from settlelens.operators.costs import fee_parts
from settlelens.operators.metrics import exact_sum


def floor_fee(base_fee: Column | str, ratio: Column | Decimal = C.RESERVE_PRICE_RATIO) -> Column:
    """Reserve price: a share of the execution base fee, rounded down to whole wei."""
    r = ratio if isinstance(ratio, Column) else F.lit(ratio)
    return F.floor(X.col(base_fee).cast("decimal(17,0)") * r.cast("decimal(10,6)")).cast(C.PRICE_WEI)


def with_floor(tx: DataFrame, ratio: Column | Decimal = C.RESERVE_PRICE_RATIO) -> DataFrame:
    """Transactions under the counterfactual blob fee; all fee parts are worked out again."""
    fee = F.greatest(F.col("base_fee_per_blob_gas_wei").cast(C.PRICE_WEI), floor_fee("base_fee_per_gas_wei", ratio))
    return fee_parts(tx.withColumn("base_fee_per_blob_gas_wei", fee))


def counterfactual_daily(tx: DataFrame, fees: DataFrame, ratio: Column | Decimal = C.RESERVE_PRICE_RATIO) -> DataFrame:
    """Observed and counterfactual rent, blob burn and take rate per day.

    Both versions come from one pass over the transactions; only day sums meet the fee series.
    """
    both = with_floor(tx.withColumn("_observed_burn", F.col("burn_blob_wei")), ratio)
    d = both.groupBy("date_utc").agg(
        F.coalesce(F.sum("execution_fee_wei"), F.lit(0)).cast(C.WEI).alias("_exec"),
        F.coalesce(F.sum("_observed_burn"), F.lit(0)).cast(C.WEI).alias("_burn"),
        F.coalesce(F.sum("burn_blob_wei"), F.lit(0)).cast(C.WEI).alias("_burn_cf"),
    )
    d = d.select(
        "date_utc",
        X.eth_double((F.col("_exec") + F.col("_burn")).cast(C.WEI)).alias("rent_eth"),
        X.eth_double((F.col("_exec") + F.col("_burn_cf")).cast(C.WEI)).alias("rent_cf_eth"),
        X.eth_double("_burn").alias("burn_blob_eth"),
        X.eth_double("_burn_cf").alias("burn_blob_cf_eth"),
    )
    daily_fees = fees.groupBy("date_utc").agg(exact_sum("l2_fees_eth").cast("double").alias("l2_fees_eth"))
    return d.join(daily_fees, "date_utc", "left").withColumns(
        {"str": X.ratio_or_nan("rent_eth", "l2_fees_eth"), "str_cf": X.ratio_or_nan("rent_cf_eth", "l2_fees_eth")}
    )


def floor_grid(tx: DataFrame, ratios: list[Decimal]) -> DataFrame:
    """Counterfactual blob burn and rent per floor parameter: one scan, one conditional sum each."""
    blob = F.col("blob_count").cast("decimal(6,0)") * F.lit(C.GAS_PER_BLOB).cast("decimal(6,0)")
    observed = F.col("base_fee_per_blob_gas_wei").cast(C.PRICE_WEI)

    def burn(ratio: Decimal) -> Column:
        fee = F.greatest(observed, floor_fee("base_fee_per_gas_wei", ratio))
        part = F.when(F.col("tx_type") == 3, (blob * fee).cast("decimal(30,0)"))
        return F.coalesce(F.sum(part), F.lit(0)).cast(C.WEI)

    sums = tx.agg(
        F.coalesce(F.sum("execution_fee_wei"), F.lit(0)).cast(C.WEI).alias("_exec"),
        *[burn(r).alias(f"_b{i}") for i, r in enumerate(ratios)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(float(r)).alias("floor_ratio"),
                X.eth_double(f"_b{i}").alias("burn_blob_cf_eth"),
                X.eth_double((F.col("_exec") + F.col(f"_b{i}")).cast(C.WEI)).alias("rent_cf_eth"),
            )
            for i, r in enumerate(ratios)
        ]
    )
    return sums.select(F.inline(rows))
