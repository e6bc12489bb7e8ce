"""Queries of the analytic family: ranking over a whole table, CUBE and ROLLUP."""

from __future__ import annotations

from pyspark.sql import functions as F

from settlelens.operators.ranking import global_ranks
from settlelens.operators.rollups import stepwise_cube, stepwise_rollup
from settlelens.plans import chain_queries as CQ
from settlelens.plans import fixtures as fx
from settlelens.plans.catalogue import query
from settlelens.plans.fixtures import sql


@query("e6_global_ranks",
    """SELECT l_orderkey, l_linenumber, ROW_NUMBER() OVER o AS row_number, RANK() OVER v AS rank, DENSE_RANK() OVER v AS dense_rank,
    ROUND(PERCENT_RANK() OVER v, 12) AS percent_rank, ROUND(CUME_DIST() OVER v, 12) AS cume_dist, NTILE(100) OVER o AS tile FROM lineitem
    WINDOW v AS (ORDER BY l_quantity NULLS FIRST), o AS (ORDER BY l_quantity NULLS FIRST, l_orderkey NULLS FIRST, l_linenumber NULLS FIRST)""")
def e6(spark, d):
    """Every line ranked by its quantity, which has fifty values."""
    ranked = global_ranks(fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", ["l_orderkey", "l_linenumber"])
    shares = {c: F.round(c, 12) for c in ("percent_rank", "cume_dist")}
    return ranked.drop("l_quantity").withColumns(shares)


ROLLED = """COUNT(*) AS n_tx, CAST(SUM(execution_fee_wei) AS VARCHAR) AS execution_fee_wei, CAST(SUM(burn_base_wei) AS VARCHAR) AS burn_base_wei,
  CAST(MAX(gas_used) AS BIGINT) AS largest_gas FROM (SELECT *, strftime(date_utc, '%Y-%m') AS month, COALESCE(from_confidence, 'none') AS rule FROM fx_tx_costs)"""


def measured(spark, d):
    rule = F.coalesce("from_confidence", F.lit("none"))
    tx = CQ.tx_costs(spark, d).select("rollup_id", F.date_format("date_utc", "yyyy-MM").alias("month"), "tx_type", rule.alias("rule"),
                                      "execution_fee_wei", "burn_base_wei", "gas_used")
    return tx, {"n_tx": ("count", F.lit(1)), "execution_fee_wei": ("sum", F.col("execution_fee_wei")),
                "burn_base_wei": ("sum", F.col("burn_base_wei")), "largest_gas": ("max", F.col("gas_used").cast("bigint"))}


def as_text(df):
    """Exact wei as digits."""
    return df.withColumns({c: F.col(c).cast("decimal(38,0)").cast("string") for c in ("execution_fee_wei", "burn_base_wei")})


@query("e7_fee_cube", sql(
    f"""SELECT rollup_id, month, tx_type, rule, GROUPING(rollup_id, month, tx_type, rule) AS grouping_id, {ROLLED}
    GROUP BY CUBE (rollup_id, month, tx_type, rule)""", "fx_tx_costs"))
def e7_cube(spark, d):
    tx, measures = measured(spark, d)
    return as_text(stepwise_cube(tx, ["rollup_id", "month", "tx_type", "rule"], measures))


@query("e7_fee_rollup", sql(
    f"""SELECT rollup_id, month, tx_type, GROUPING(rollup_id, month, tx_type) AS grouping_id, {ROLLED}
    GROUP BY ROLLUP (rollup_id, month, tx_type)""", "fx_tx_costs"))
def e7_rollup(spark, d):
    tx, measures = measured(spark, d)
    return as_text(stepwise_rollup(tx, ["rollup_id", "month", "tx_type"], measures))
