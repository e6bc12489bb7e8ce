"""Queries of the chain family: attribution, fee parts, daily costs, blob market."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlelens.functions import columns as X
from settlelens.operators import attribution as A
from settlelens.operators import checks as Q
from settlelens.operators import costs as K
from settlelens.operators import metrics as M
from settlelens.operators import normalize as N
from settlelens.operators import sets as S
from settlelens.plans import fixtures as fx
from settlelens.plans.catalogue import query
from settlelens.plans.fixtures import REGIME_DATE, sql
from settlelens.plans.panel_queries import COSTS2, costs2

ACTIVATION = dt.datetime(1998, 3, 13, 13, 55, tzinfo=dt.timezone.utc)


def timed_tx(spark: SparkSession, d: str) -> DataFrame:
    return K.with_block_fees(fx.receipts(spark, d), fx.raw_blocks(spark, d))


def attributed(spark: SparkSession, d: str) -> DataFrame:
    return A.attribute(timed_tx(spark, d), fx.address_mappings(spark, d), fx.contract_mappings(spark, d))


def tx_costs(spark: SparkSession, d: str) -> DataFrame:
    return K.fee_parts(attributed(spark, d))


def onchain_daily(spark: SparkSession, d: str) -> DataFrame:
    return K.daily_costs(tx_costs(spark, d))


def named(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("rollup_id").isin("other", "unattributed_rollup_like"))


def eth(wei_sql: str, digits: int = 12) -> str:
    return f"ROUND(CAST({wei_sql} AS DOUBLE) / 1e18, {digits})"


def rounded(df: DataFrame, digits: int = 12) -> DataFrame:
    """Amounts in ETH as doubles on a fixed number of places."""
    return df.select(
        *[
            F.round(F.col(f.name).cast("double"), digits).alias(f.name)
            if f.dataType.typeName() in ("decimal", "double")
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


DAILY = ("daily_", f"""SELECT date_utc, rollup_id,
  {eth('SUM(execution_fee_wei) + SUM(COALESCE(burn_blob_wei, 0))')} AS l1_total_cost_eth,
  {eth('SUM(burn_base_wei)')} AS burn_base_eth, {eth('SUM(COALESCE(burn_blob_wei, 0))')} AS burn_blob_eth,
  {eth('SUM(tips_wei)')} AS tips_eth, CAST(SUM(CASE WHEN blob_burn_unknown THEN 1 ELSE 0 END) AS BIGINT) AS missing_blob_tx,
  {eth('SUM(CASE WHEN blob_burn_unknown THEN execution_fee_wei ELSE 0 END)')} AS missing_blob_execution_eth,
  COUNT(*) AS n_tx FROM fx_tx_costs GROUP BY 1, 2""")


# ---- projections and filters --------------------------------------------------------------------


@query("p2_units", sql(
    """SELECT block_number, ROUND(CAST(base_fee_per_gas_wei * gas_used AS DOUBLE) / 1e18, 13) AS fee_eth,
    ROUND(CAST(base_fee_per_gas_wei AS DOUBLE) / 1e9, 9) AS base_fee_gwei,
    CAST(base_fee_per_gas_wei AS BIGINT) AS base_fee_wei FROM fx_blocks""", "fx_blocks"))
def p2(spark, d):
    wei = (F.col("base_fee_per_gas_wei") * F.col("gas_used").cast("decimal(12,0)")).cast("decimal(38,0)")
    gwei = X.wei_to_gwei("base_fee_per_gas_wei")
    return fx.blocks(spark, d).select(
        "block_number",
        F.round(X.eth_double(wei), 13).alias("fee_eth"),
        gwei.cast("double").alias("base_fee_gwei"),
        X.gwei_to_wei(gwei).cast("bigint").alias("base_fee_wei"),
    )


@query("p6_post_regime", sql(
    f"SELECT block_number, date_utc, date_utc >= DATE '{REGIME_DATE}' AS post_regime FROM fx_blocks", "fx_blocks"),
    dates=("date_utc",))
def p6(spark, d):
    b = fx.blocks(spark, d).select("block_number", X.epoch_date("timestamp").alias("date_utc"))
    return b.withColumn("post_regime", X.post_regime("date_utc", REGIME_DATE))


@query("p10_fee_at_minimum", sql(
    """SELECT block_number, base_fee_per_blob_gas_wei <= 1 AS at_min, base_fee_per_blob_gas_wei <= 1 + 2.5 AS near_min
    FROM fx_blocks""", "fx_blocks"))
def p10(spark, d):
    fee = "base_fee_per_blob_gas_wei"
    return fx.blocks(spark, d).select("block_number", K.at_minimum(fee).alias("at_min"), K.at_minimum(fee, 2.5).alias("near_min"))


@query("p11_addresses", sql(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 2 THEN '0x' || lpad(CAST(s_suppkey AS VARCHAR), 40, 'a') END AS address
    FROM supplier"""))
def p11(spark, d):
    raw = F.concat(F.lit("0x"), F.lpad(F.col("s_suppkey").cast("string"), 40, "a"))
    k = F.col("s_suppkey") % 3
    variant = F.when(k == 0, F.upper(raw)).when(k == 1, F.concat(F.lit("  "), raw, F.lit(" "))).otherwise(
        F.substring(raw, 1, 41))
    return fx.table(spark, d, "supplier").select("s_suppkey", X.normalize_address(variant).alias("address"))


HEADERS = f"""SELECT block_number, "timestamp" >= {int(ACTIVATION.timestamp())} AS active,
CASE WHEN "timestamp" >= {int(ACTIVATION.timestamp())} THEN blob_gas_used IS NOT NULL AND excess_blob_gas IS NOT NULL
ELSE blob_gas_used IS NULL AND excess_blob_gas IS NULL END AS header_ok FROM fx_blocks"""


@query("p12_blob_header_fields", sql(HEADERS, "fx_blocks"))
def p12(spark, d):
    return K.header_presence(fx.blocks(spark, d), ACTIVATION).select("block_number", "active", "header_ok")


@query("p13_failed_transactions", sql(
    f"""SELECT CAST(status AS BIGINT) AS status, COUNT(*) AS n_tx, {eth('SUM(execution_fee_wei)', 6)} AS execution_fee_eth
    FROM fx_tx_costs GROUP BY 1""", "fx_tx_costs"))
def p13(spark, d):
    return K.fee_parts(timed_tx(spark, d)).groupBy("status").agg(
        F.count(F.lit(1)).alias("n_tx"),
        F.round(X.eth_double(F.sum("execution_fee_wei")), 6).alias("execution_fee_eth"))


@query("p14_type3", sql("SELECT tx_hash, block_number FROM fx_receipts WHERE tx_type = 3", "fx_receipts"))
def p14(spark, d):
    return fx.receipts(spark, d).filter("tx_type = 3").select("tx_hash", "block_number")


@query("p15_candidates", sql(
    """SELECT tx_hash, from_address IN (SELECT address FROM fx_addresses) AS known_sender,
    to_address IN (SELECT contract_address FROM fx_contracts) AS known_contract FROM fx_receipts
    WHERE from_address IN (SELECT address FROM fx_addresses) OR to_address IN (SELECT contract_address FROM fx_contracts)
    OR tx_type = 3""", "fx_receipts", "fx_addresses", "fx_contracts"))
def p15(spark, d):
    c = A.candidate_transactions(fx.receipts(spark, d), fx.address_mappings(spark, d), fx.contract_mappings(spark, d))
    return c.select("tx_hash", "known_sender", "known_contract")


def sources(spark, d):
    """Panel rows with rent of three sources."""
    chain = named(onchain_daily(spark, d)).select("date_utc", "rollup_id", F.round(F.col("l1_total_cost_eth").cast("double"), 12).alias("onchain"))
    second = costs2(spark, d).filter("rollup_id IS NOT NULL").select("date_utc", "rollup_id", F.col("total_cost_eth").alias("second"))
    return fx.panel(spark, d).withColumn("vendor", F.when(F.col("txcount") % 4 != 3, F.col("rent_paid_eth"))).join(
        chain, ["date_utc", "rollup_id"], "left").join(second, ["date_utc", "rollup_id"], "left")


SOURCES = ("sources_", """SELECT p.date_utc, p.rollup_id, o.l1_total_cost_eth AS onchain,
  CASE WHEN p.txcount % 4 <> 3 THEN p.rent_paid_eth END AS vendor, c.total_cost_eth AS second FROM fx_panel p
  LEFT JOIN daily_ o ON o.date_utc = p.date_utc AND o.rollup_id = p.rollup_id
  LEFT JOIN costs2 c ON c.date_utc = p.date_utc AND c.rollup_id = p.rollup_id""")


@query("p16_source_priority", sql(
    """SELECT date_utc, rollup_id, COALESCE(onchain, vendor, second) AS rent_paid_eth, CASE WHEN onchain IS NOT NULL
    THEN 'onchain' WHEN vendor IS NOT NULL THEN 'vendor' WHEN second IS NOT NULL THEN 'second_vendor' END AS rent_source
    FROM sources_""", "fx_panel", "fx_tx_costs", "fx_costs", extra=(DAILY, COSTS2, SOURCES)), dates=("date_utc",))
def p16(spark, d):
    order = [("onchain", "onchain"), ("vendor", "vendor"), ("second_vendor", "second")]
    picked = N.pick_source(sources(spark, d).drop("rent_paid_eth"), order, "rent_paid_eth", "rent_source")
    return picked.select("date_utc", "rollup_id", "rent_paid_eth", "rent_source")


@query("p18_price_below_base", sql(
    """SELECT tx_hash, CAST(effective_gas_price_wei AS BIGINT) AS price_wei, CAST(base AS BIGINT) AS base_fee_wei FROM
    (SELECT tx_hash, effective_gas_price_wei, base_fee_per_gas_wei + CASE WHEN part_key % 97 = 0 THEN 2000000000 ELSE 0 END
    AS base FROM fx_attributed) WHERE effective_gas_price_wei < base""", "fx_attributed"))
def p18(spark, d):
    odd = F.when(F.col("part_key") % 97 == 0, 2000000000).otherwise(0).cast("decimal(12,0)")
    tx = timed_tx(spark, d).withColumn("base_fee_per_gas_wei", (F.col("base_fee_per_gas_wei") + odd).cast("decimal(17,0)"))
    _, bad = K.quarantine(K.fee_parts(tx))
    return bad.select("tx_hash", F.col("effective_gas_price_wei").cast("bigint").alias("price_wei"),
                      F.col("base_fee_per_gas_wei").cast("bigint").alias("base_fee_wei"))


@query("p22_blob_burn_unknown", sql(
    f"""SELECT date_utc, rollup_id, missing_blob_tx, missing_blob_execution_eth, burn_blob_eth FROM daily_""",
    "fx_tx_costs", extra=(DAILY,)), dates=("date_utc",))
def p22(spark, d):
    return rounded(onchain_daily(spark, d).select(
        "date_utc", "rollup_id", "missing_blob_tx", "missing_blob_execution_eth", "burn_blob_eth"))


# ---- joins --------------------------------------------------------------------------------------


@query("j3_receipts_to_blocks", sql(
    """SELECT r.tx_hash, r.block_number, b.date_utc, CAST(b.base_fee_per_gas_wei AS BIGINT) AS base_fee_wei
    FROM fx_receipts r JOIN fx_blocks b ON r.block_number = b.block_number""", "fx_receipts"), dates=("date_utc",))
def j3(spark, d):
    return timed_tx(spark, d).select("tx_hash", "block_number", "date_utc",
                                     F.col("base_fee_per_gas_wei").cast("bigint").alias("base_fee_wei"))


@query("j4_blob_detail", sql("SELECT tx_hash, CAST(blob_count AS BIGINT) AS blob_count FROM fx_receipts", "fx_receipts"))
def j4(spark, d):
    return K.with_blob_detail(fx.receipts(spark, d), fx.blob_tx(spark, d)).select("tx_hash", "blob_count")


@query("j5_sender_match", sql("SELECT tx_hash, from_rollup, from_confidence FROM fx_attributed", "fx_attributed"))
def j5(spark, d):
    return A.match_sender(timed_tx(spark, d), fx.address_mappings(spark, d)).select("tx_hash", "from_rollup", "from_confidence")


@query("j6_contract_fallback", sql(
    """SELECT tx_hash, to_rollup AS audit_rollup_id, 'unattributed_rollup_like' AS rollup_id, 'low' AS attribution_confidence
    FROM fx_attributed WHERE from_rollup IS NULL AND to_rollup IS NOT NULL""", "fx_attributed"))
def j6(spark, d):
    return attributed(spark, d).filter("attribution_rule = 'to_match'").select(
        "tx_hash", "audit_rollup_id", "rollup_id", "attribution_confidence")


@query("j7_unattributed", sql(
    """SELECT tx_hash, rollup_id FROM fx_tx_costs WHERE rollup_id IN ('other', 'unattributed_rollup_like')""", "fx_tx_costs"))
def j7(spark, d):
    return attributed(spark, d).filter(F.col("rollup_id").isin("other", "unattributed_rollup_like")).select(
        "tx_hash", "rollup_id")


STATE = ("state_", """SELECT date_utc, AVG(base_fee_per_blob_gas_wei) AS blob_base_fee_wei_avg,
  quantile_cont(base_fee_per_blob_gas_wei, 0.5) AS blob_base_fee_wei_p50,
  CAST(SUM(blob_gas_used) AS DOUBLE) / NULLIF(COUNT(blob_gas_used) * 786432, 0) AS blob_utilization FROM fx_blocks GROUP BY 1""")


@query("j8_panel_assembly", sql(
    """SELECT p.date_utc, p.rollup_id, p.l2_fees_eth, p.rent_paid_eth AS vendor_rent_paid_eth, o.l1_total_cost_eth
    AS onchain_l1_cost_eth, o.missing_blob_tx > 0 AS onchain_cost_coverage_flag, s.blob_base_fee_wei_p50,
    s.blob_base_fee_wei_p50 <= 1 AS blob_fee_at_min_flag
    FROM fx_panel p LEFT JOIN daily_ o ON o.date_utc = p.date_utc AND o.rollup_id = p.rollup_id
    LEFT JOIN state_ s ON s.date_utc = p.date_utc""", "fx_panel", "fx_tx_costs", extra=(DAILY, STATE)), dates=("date_utc",))
def j8(spark, d):
    wide = M.assemble_panel(fx.panel(spark, d), onchain_daily(spark, d), K.blob_fee_state(fx.blocks(spark, d)))
    return wide.select("date_utc", "rollup_id", "l2_fees_eth", "vendor_rent_paid_eth",
                       F.round("onchain_l1_cost_eth", 12).alias("onchain_l1_cost_eth"), "onchain_cost_coverage_flag",
                       "blob_base_fee_wei_p50", "blob_fee_at_min_flag")


@query("j10_fill_blob_count", sql(
    """SELECT tx_hash, CAST(CASE WHEN blob_count IS NULL AND tx_type = 3 AND part_key % 2 = 0 THEN 3 ELSE blob_count END AS BIGINT)
    AS blob_count, CASE WHEN blob_count IS NOT NULL THEN 'chain' WHEN tx_type = 3 AND part_key % 2 = 0 THEN 'index' END
    AS blob_count_source FROM fx_receipts""", "fx_receipts"))
def j10(spark, d):
    return K.fill_blob_count(fx.receipts(spark, d), fx.blob_index(spark, d)).select("tx_hash", "blob_count", "blob_count_source")


@query("j12_missing_receipts", sql("SELECT tx_hash FROM fx_receipts WHERE status = 0", "fx_receipts"))
def j12(spark, d):
    r = fx.receipts(spark, d)
    return r.select("tx_hash").join(r.filter("status = 1").select("tx_hash"), "tx_hash", "left_anti")


@query("j17_overlapping_windows", sql(
    """SELECT b.rollup_id, b.address, b.valid_from FROM fx_addresses b WHERE EXISTS (SELECT 1 FROM fx_addresses a
    WHERE a.address = b.address AND (a.valid_from < b.valid_from OR (a.valid_from = b.valid_from AND a.rollup_id < b.rollup_id))
    AND (a.valid_to IS NULL OR a.valid_to > b.valid_from))""", "fx_addresses"), dates=("valid_from",))
def j17(spark, d):
    return A.overlapping_windows(fx.address_mappings(spark, d), "address").select(
        "rollup_id", "address", F.col("valid_from_utc").cast("date").alias("valid_from"))


@query("j18_seen_on_chain", sql(
    """SELECT DISTINCT a.address, a.rollup_id, EXISTS (SELECT 1 FROM fx_attributed t WHERE t.from_address = a.address
    AND t.to_rollup = a.rollup_id) AS seen FROM fx_addresses a""", "fx_attributed"))
def j18(spark, d):
    return A.seen_on_chain(fx.address_mappings(spark, d), attributed(spark, d))


# ---- aggregates ---------------------------------------------------------------------------------


@query("a4_fee_parts", sql(
    """SELECT tx_hash, CAST(burn_base_wei AS VARCHAR) AS burn_base_wei, CAST(tips_wei AS VARCHAR) AS tips_wei,
    CAST(burn_blob_wei AS VARCHAR) AS burn_blob_wei FROM fx_tx_costs""", "fx_tx_costs"))
def a4(spark, d):
    parts = ["burn_base_wei", "tips_wei", "burn_blob_wei"]
    return K.fee_parts(timed_tx(spark, d)).select("tx_hash", *[F.col(c).cast("string").alias(c) for c in parts])


@query("a5_onchain_daily_costs", sql("SELECT * FROM daily_", "fx_tx_costs", extra=(DAILY,)), dates=("date_utc",))
def a5(spark, d):
    return rounded(onchain_daily(spark, d))


DECOMP = ("decomp_", f"""SELECT date_utc, {eth('SUM(burn_base_wei)')} AS l1_base_fee_burn_eth,
  {eth('SUM(COALESCE(burn_blob_wei, 0))')} AS l1_blob_fee_burn_eth, {eth('SUM(tips_wei)')} AS l1_priority_fee_eth,
  {eth('SUM(burn_base_wei + COALESCE(burn_blob_wei, 0) + tips_wei)')} AS l1_total_rent_eth,
  CAST(SUM(CAST(blob_count AS BIGINT) * 131072) AS BIGINT) AS l1_blob_gas_used,
  ANY_VALUE(day_fee) / 1e9::DOUBLE AS l1_blob_base_fee_gwei
  FROM fx_tx_costs JOIN (SELECT date_utc AS day, CAST(SUM(base_fee_per_blob_gas_wei) AS DOUBLE) / COUNT(base_fee_per_blob_gas_wei) AS day_fee
    FROM fx_blocks GROUP BY 1) ON day = date_utc WHERE rollup_id NOT IN ('other', 'unattributed_rollup_like') GROUP BY 1""")


@query("a6_l1_decomposition", sql(
    """SELECT date_utc, l1_base_fee_burn_eth, l1_blob_fee_burn_eth, l1_priority_fee_eth, l1_total_rent_eth, l1_blob_gas_used,
    l1_blob_base_fee_gwei FROM decomp_""", "fx_tx_costs", extra=(DECOMP,)), dates=("date_utc",))
def a6(spark, d):
    out = K.decomposition(named(tx_costs(spark, d)), K.blob_fee_state(fx.raw_blocks(spark, d))).drop("l1_calldata_gas_used")
    parts = [c for c in out.columns if c.endswith("_eth")]
    return out.withColumns({c: F.round(F.col(c).cast("double"), 12) for c in parts})


@query("a7_blob_market_daily", sql(
    """SELECT b.*, COALESCE(t.blob_tx_count, 0) AS blob_tx_count FROM (SELECT date_utc, CAST(SUM(blob_gas_used) AS BIGINT) AS blob_gas_used,
    arg_max_null(excess_blob_gas, "timestamp" * 10000000 + block_number) AS excess_blob_gas, COUNT(*) AS n_blocks,
    COUNT(blob_gas_used) AS n_blob_headers, CAST(SUM(blob_gas_used) / 131072 AS BIGINT) AS blobs_count FROM fx_blocks GROUP BY 1) b
    LEFT JOIN (SELECT x.date_utc, COUNT(*) AS blob_tx_count FROM fx_receipts r JOIN fx_blocks x ON x.block_number = r.block_number
    WHERE tx_type = 3 GROUP BY 1) t ON t.date_utc = b.date_utc""", "fx_receipts"), dates=("date_utc",))
def a7(spark, d):
    return K.blob_market_daily(fx.blocks(spark, d), fx.receipts(spark, d))


@query("a8_blob_fee_state", sql(
    """SELECT date_utc, ROUND(blob_base_fee_wei_avg, 6) AS blob_base_fee_wei_avg, ROUND(blob_utilization, 9) AS blob_utilization,
    blob_base_fee_wei_p50 FROM state_""", "fx_blocks", extra=(STATE,)), dates=("date_utc",))
def a8(spark, d):
    s = K.blob_fee_state(fx.blocks(spark, d))
    return s.select("date_utc", F.round("blob_base_fee_wei_avg", 6).alias("blob_base_fee_wei_avg"),
                    F.round("blob_utilization", 9).alias("blob_utilization"), "blob_base_fee_wei_p50")


@query("a12_burn_share_of_issuance", sql(
    f"""SELECT x.date_utc, x.rollup_burn_eth, i.issuance_eth, ROUND(x.raw / i.issuance_eth, 9) AS burn_share
    FROM (SELECT date_utc, {eth('SUM(burn_base_wei + COALESCE(burn_blob_wei, 0))')} AS rollup_burn_eth,
    CAST(SUM(burn_base_wei + COALESCE(burn_blob_wei, 0)) AS DOUBLE) / 1e18 AS raw FROM fx_tx_costs
    WHERE rollup_id NOT IN ('other', 'unattributed_rollup_like') GROUP BY 1) x JOIN fx_issuance i ON i.date_utc = x.date_utc""",
    "fx_tx_costs", "fx_issuance"), dates=("date_utc",))
def a12(spark, d):
    out = M.burn_share_of_issuance(named(onchain_daily(spark, d)), fx.issuance(spark, d))
    return out.select("date_utc", F.round("rollup_burn_eth", 12).alias("rollup_burn_eth"),
                      "issuance_eth", F.round("burn_share", 9).alias("burn_share"))


@query("a13_share_at_minimum", sql(
    f"""SELECT COUNT(*) AS n_days, CAST(COUNT(*) FILTER (WHERE blob_base_fee_wei_p50 <= 1) AS BIGINT) AS n_at_min,
    COUNT(*) FILTER (WHERE blob_base_fee_wei_p50 <= 1) / CAST(COUNT(*) AS DOUBLE) AS share_at_min FROM state_
    WHERE date_utc >= DATE '{REGIME_DATE}'""", "fx_blocks", extra=(STATE,)))
def a13(spark, d):
    s = K.blob_fee_state(fx.blocks(spark, d)).filter(X.post_regime("date_utc", REGIME_DATE))
    return M.share_at_minimum(s, "blob_base_fee_wei_p50")


PROBS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


@query("a14_blob_fee_distribution", sql(
    "SELECT date_utc >= DATE '" + str(REGIME_DATE) + "' AS post_regime, "
    + ", ".join(f"quantile_cont(base_fee_per_blob_gas_wei, {p}) AS {n}" for n, p in PROBS.items())
    + " FROM fx_blocks GROUP BY 1", "fx_blocks"))
def a14(spark, d):
    from settlelens.functions.joins import exact_percentiles

    b = fx.blocks(spark, d).withColumn("post_regime", X.post_regime(X.epoch_date("timestamp"), REGIME_DATE))
    return exact_percentiles(b, ["post_regime"], "base_fee_per_blob_gas_wei", PROBS)


@query("a14_blob_share_of_spend", sql(
    """SELECT rollup_id, ROUND(SUM(CAST(COALESCE(burn_blob_wei, 0) AS DOUBLE)) / SUM(CAST(execution_fee_wei + COALESCE(burn_blob_wei, 0)
    AS DOUBLE)), 12) AS blob_share FROM fx_tx_costs GROUP BY 1""", "fx_tx_costs"))
def a14_share(spark, d):
    c = onchain_daily(spark, d).groupBy("rollup_id").agg(F.sum("burn_blob_eth").alias("b"), F.sum("l1_total_cost_eth").alias("t"))
    return c.select("rollup_id", F.round(X.ratio_or_nan("b", "t"), 12).alias("blob_share"))


COVER = ("cover_", f"""SELECT date_utc >= DATE '{REGIME_DATE}' AS post_regime,
  {eth("SUM(CASE WHEN rollup_id NOT IN ('other', 'unattributed_rollup_like') THEN spend ELSE 0 END)", 6)} AS attributed_eth,
  {eth('SUM(spend)', 6)} AS total_eth,
  CAST(SUM(CASE WHEN rollup_id NOT IN ('other', 'unattributed_rollup_like') THEN spend ELSE 0 END) AS DOUBLE)
    / CAST(SUM(spend) AS DOUBLE) AS coverage FROM
  (SELECT *, CASE WHEN date_utc >= DATE '{REGIME_DATE}' THEN COALESCE(burn_blob_wei, 0) ELSE execution_fee_wei END AS spend FROM fx_tx_costs) GROUP BY 1""")


@query("a16_attribution_coverage", sql(
    "SELECT post_regime, attributed_eth, total_eth, ROUND(coverage, 9) AS coverage FROM cover_", "fx_tx_costs", extra=(COVER,)))
def a16(spark, d):
    c = K.attribution_coverage(tx_costs(spark, d), REGIME_DATE)
    return c.select("post_regime", F.round("attributed_eth", 6).alias("attributed_eth"),
                    F.round("total_eth", 6).alias("total_eth"), F.round("coverage", 9).alias("coverage"))


@query("a17_burn_tip_shares", sql(
    """SELECT date_utc, ROUND(burn / (burn + tips), 9) AS burn_share, ROUND(tips / (burn + tips), 9) AS tip_share FROM
    (SELECT date_utc, CAST(SUM(burn_base_wei + COALESCE(burn_blob_wei, 0)) AS DOUBLE) AS burn, CAST(SUM(tips_wei) AS DOUBLE) AS tips
    FROM fx_tx_costs WHERE rollup_id NOT IN ('other', 'unattributed_rollup_like') GROUP BY 1)""", "fx_tx_costs"), dates=("date_utc",))
def a17(spark, d):
    s = M.burn_tip_shares(named(onchain_daily(spark, d)))
    return s.select("date_utc", F.round("burn_share", 9).alias("burn_share"), F.round("tip_share", 9).alias("tip_share"))


@query("a24_missing_blob_bucket", sql(
    f"""SELECT date_utc, CAST(SUM(CASE WHEN blob_burn_unknown THEN 1 ELSE 0 END) AS BIGINT) AS missing_blob_tx,
    {eth('SUM(CASE WHEN blob_burn_unknown THEN execution_fee_wei ELSE 0 END)')} AS missing_blob_execution_eth,
    COUNT(*) AS n_tx FROM fx_tx_costs GROUP BY 1""", "fx_tx_costs"), dates=("date_utc",))
def a24(spark, d):
    c = K.daily_costs(K.fee_parts(timed_tx(spark, d)), ("date_utc",))
    return rounded(c.select("date_utc", "missing_blob_tx", "missing_blob_execution_eth", "n_tx"))


@query("a25_new_senders", sql(
    f"""SELECT from_address, to_rollup AS rollup_id, COUNT(DISTINCT date_utc) AS active_days, COUNT(*) AS n_tx,
    {eth('SUM(execution_fee_wei + COALESCE(burn_blob_wei, 0))')} AS spend_eth FROM fx_tx_costs WHERE from_rollup IS NULL AND to_rollup IS NOT NULL
    GROUP BY 1, 2 HAVING COUNT(DISTINCT date_utc) >= 2""", "fx_tx_costs"))
def a25(spark, d):
    c = A.new_sender_candidates(tx_costs(spark, d))
    return c.select("from_address", "rollup_id", "active_days", "n_tx",
                    F.round(X.eth_double("spend_wei"), 12).alias("spend_eth"))


def daily_blob_fee(spark, d):
    """Daily mean blob fee in gwei."""
    b = fx.blocks(spark, d).groupBy(X.epoch_date("timestamp").alias("date_utc"))
    return b.agg((F.sum("base_fee_per_blob_gas_wei").cast("double") / F.count(F.lit(1)) / 1e9).alias("l1_blob_base_fee_gwei"))


FEE = ("fee_", """SELECT date_utc, CAST(SUM(base_fee_per_blob_gas_wei) AS DOUBLE) / COUNT(*) / 1e9 AS fee FROM fx_blocks GROUP BY 1""")
RUNS = ("runs_", f"""SELECT MIN(date_utc) AS run_start, MAX(date_utc) AS run_end, COUNT(*) AS n_days FROM
  (SELECT date_utc, date_utc - CAST(ROW_NUMBER() OVER (ORDER BY date_utc) AS INTEGER) AS island FROM fee_
   WHERE date_utc >= DATE '{REGIME_DATE}' AND fee <= 1.05::DOUBLE * (SELECT MIN(fee) FROM fee_ WHERE date_utc >= DATE '{REGIME_DATE}'))
  GROUP BY island HAVING COUNT(*) >= 7""")


@query("w2_floor_runs", sql("SELECT * FROM runs_", "fx_blocks", extra=(FEE, RUNS)), dates=("run_start", "run_end"))
def w2(spark, d):
    return M.floor_runs(daily_blob_fee(spark, d), REGIME_DATE)


@query("a26_str_by_regime", sql(
    f"""SELECT r.run_start IS NOT NULL AS at_floor, CASE WHEN blob_utilization IS NULL THEN 'unknown' WHEN blob_utilization < 1.0/3
    THEN 'low' WHEN blob_utilization < 2.0/3 THEN 'mid' ELSE 'high' END AS utilization_band, ROUND(AVG(y), 9) AS mean_str,
    COUNT(*) AS n_days FROM fx_series s LEFT JOIN runs_ r ON DATE '1970-01-01' + CAST(s.t AS INTEGER) BETWEEN r.run_start AND r.run_end
    LEFT JOIN state_ u ON u.date_utc = DATE '1970-01-01' + CAST(s.t AS INTEGER)
    WHERE series_id = 'all' AND DATE '1970-01-01' + CAST(s.t AS INTEGER) >= DATE '{REGIME_DATE}' GROUP BY 1, 2""",
    "fx_series", "fx_blocks", extra=(FEE, RUNS, STATE)))
def a26(spark, d):
    out = M.str_by_regime(M.str_daily(fx.panel(spark, d)), M.floor_runs(daily_blob_fee(spark, d), REGIME_DATE),
                          K.blob_fee_state(fx.blocks(spark, d)), REGIME_DATE)
    return out.withColumn("mean_str", F.round("mean_str", 9))


# ---- windows, top-k, sets -----------------------------------------------------------------------


@query("w4_missing_blocks", """SELECT n + 1 AS gap_start, nxt - 1 AS gap_end, nxt - n - 1 AS n_missing FROM
(SELECT l_orderkey AS n, LEAD(l_orderkey) OVER (ORDER BY l_orderkey) AS nxt FROM
(SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) WHERE nxt - n > 1""")
def w4(spark, d):
    r = fx.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("block_number"))
    return M.missing_numbers(r, "block_number", shard=1000)


@query("w6_window_tie_break", sql(
    """SELECT p.address, p.start_utc, MIN(p.stop_utc) AS stop_utc,
    arg_min(a.rollup_id, a.conf_rank * 1000 + CAST(substr(a.rollup_id, 2) AS INTEGER)) AS rollup_id,
    arg_min(a.confidence, a.conf_rank * 1000 + CAST(substr(a.rollup_id, 2) AS INTEGER)) AS confidence
    FROM (SELECT address, pt AS start_utc, LEAD(pt) OVER (PARTITION BY address ORDER BY pt) AS stop_utc FROM
      (SELECT address, valid_from AS pt FROM fx_addresses UNION SELECT address, COALESCE(valid_to, DATE '9999-12-31') FROM fx_addresses)) p
    JOIN fx_addresses a ON a.address = p.address AND a.valid_from <= p.start_utc
      AND (a.valid_to IS NULL OR p.start_utc < a.valid_to) AND p.stop_utc IS NOT NULL GROUP BY 1, 2""", "fx_addresses"),
    dates=("start_utc", "stop_utc"))
def w6(spark, d):
    w = A.disjoint_windows(fx.address_mappings(spark, d), "address")
    return w.select("address", F.col("_start").cast("date").alias("start_utc"), F.col("_stop").cast("date").alias("stop_utc"),
                    "rollup_id", "confidence")


@query("w8_rolling_burn_issuance", sql(
    f"""SELECT t, ROUND(SUM(burn) OVER w / SUM(iss) OVER w, 8) AS burn_per_issuance_30d FROM
    (SELECT datediff('day', DATE '1970-01-01', x.date_utc)::BIGINT AS t, burn, issuance_eth AS iss FROM (SELECT date_utc,
    CAST(SUM(burn_base_wei + COALESCE(burn_blob_wei, 0)) AS DOUBLE) / 1e18 AS burn FROM fx_tx_costs
    WHERE rollup_id NOT IN ('other', 'unattributed_rollup_like') GROUP BY 1) x JOIN fx_issuance i ON i.date_utc = x.date_utc)
    WINDOW w AS (ORDER BY t RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)""", "fx_tx_costs", "fx_issuance"))
def w8(spark, d):
    s = M.burn_share_of_issuance(named(onchain_daily(spark, d)), fx.issuance(spark, d)).select(
        F.lit("all").alias("series_id"), X.day_number("date_utc").alias("t"),
        F.col("rollup_burn_eth").alias("burn"), F.col("issuance_eth").alias("issuance"))
    return M.rolling_ratio(s, "burn", "issuance", 30).select("t", F.round("burn_per_issuance_30d", 8).alias("burn_per_issuance_30d"))


@query("w10_spans_without_type3", sql(
    """SELECT rollup_id, date_utc + 1 AS run_start, nxt - 1 AS run_end, CAST(nxt - date_utc - 1 AS BIGINT) AS n_days FROM
    (SELECT rollup_id, date_utc, LEAD(date_utc) OVER (PARTITION BY rollup_id ORDER BY date_utc) AS nxt FROM
    (SELECT DISTINCT rollup_id, date_utc FROM fx_tx_costs WHERE tx_type = 3)) WHERE nxt - date_utc > 8""", "fx_tx_costs"),
    dates=("run_start", "run_end"))
def w10(spark, d):
    return M.missing_day_runs(attributed(spark, d).filter("tx_type = 3"), 7, ("rollup_id",))


@query("w12_first_seen", sql(
    """SELECT from_address AS address, MIN("timestamp") AS first_seen FROM fx_attributed GROUP BY 1""", "fx_attributed"))
def w12(spark, d):
    return A.first_seen(timed_tx(spark, d)).select("address", F.unix_timestamp("valid_from_utc").alias("first_seen"))


@query("t3_top_unattributed", sql(
    f"""SELECT from_address, {eth('SUM(execution_fee_wei + COALESCE(burn_blob_wei, 0))')} AS spend_eth, COUNT(*) AS n_tx FROM fx_tx_costs
    WHERE rollup_id IN ('other', 'unattributed_rollup_like') GROUP BY 1 ORDER BY SUM(execution_fee_wei + COALESCE(burn_blob_wei, 0)) DESC, 1 LIMIT 20""", "fx_tx_costs"))
def t3(spark, d):
    return K.top_unattributed(tx_costs(spark, d), 20).select(
        "from_address", F.round(X.eth_double("spend_wei"), 12).alias("spend_eth"), "n_tx")


@query("t6_audit_sample", sql(
    """SELECT tx_hash, rollup_id, CAST(execution_fee_wei AS VARCHAR) AS execution_fee_wei FROM fx_tx_costs
    WHERE CAST('0x' || substr(md5(tx_hash), 1, 8) AS BIGINT) % 50 = 0""", "fx_tx_costs"))
def t6(spark, d):
    return K.audit_sample(tx_costs(spark, d), 50).select(
        "tx_hash", "rollup_id", F.col("execution_fee_wei").cast("string").alias("execution_fee_wei"))


@query("u6_registry_impact", sql(
    """SELECT rollup_id, MIN(valid_from) AS rebuild_from, CASE WHEN COUNT(*) = COUNT(valid_to) THEN MAX(valid_to) END AS rebuild_to,
    COUNT(*) AS n_changes FROM fx_addresses WHERE confidence = 'med' GROUP BY 1""", "fx_addresses"),
    dates=("rebuild_from", "rebuild_to"))
def u6(spark, d):
    new = fx.address_mappings(spark, d)
    return S.registry_impact(new.filter("confidence <> 'med'"), new)


# ---- checks on chain data -----------------------------------------------------------------------


def brief(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select("check", "key", F.round("observed", digits).alias("observed"), "threshold", "status")


@query("q5_total_identity", sql(
    """SELECT 'l1_total_identity' AS "check", CAST(date_utc AS VARCHAR) AS key, 0.0::DOUBLE AS observed, 0.0::DOUBLE AS threshold,
    CASE WHEN SUM(execution_fee_wei) = SUM(burn_base_wei) + SUM(tips_wei) THEN 'pass' ELSE 'fail' END AS status
    FROM fx_tx_costs WHERE rollup_id NOT IN ('other', 'unattributed_rollup_like') GROUP BY date_utc""", "fx_tx_costs"))
def q5(spark, d):
    return brief(Q.total_identity(K.decomposition(named(tx_costs(spark, d)), K.blob_fee_state(fx.raw_blocks(spark, d)))))


@query("q6_execution_identity", sql(
    """SELECT 'execution_identity' AS "check", CAST(date_utc AS VARCHAR) AS key,
    CAST(SUM(CASE WHEN execution_fee_wei <> burn_base_wei + tips_wei THEN 1 ELSE 0 END) AS DOUBLE) AS observed,
    0.0::DOUBLE AS threshold, CASE WHEN SUM(CASE WHEN execution_fee_wei <> burn_base_wei + tips_wei THEN 1 ELSE 0 END) = 0
    THEN 'pass' ELSE 'fail' END AS status FROM fx_tx_costs GROUP BY date_utc""", "fx_tx_costs"))
def q6(spark, d):
    return brief(Q.execution_identity(K.fee_parts(timed_tx(spark, d))))


@query("q12_minimum_blob_fee", sql(
    """SELECT 'blob_fee_minimum' AS "check", CAST(date_utc AS VARCHAR) AS key, CAST(MIN(base_fee_per_blob_gas_wei) AS DOUBLE) AS observed,
    1.0::DOUBLE AS threshold, CASE WHEN MIN(base_fee_per_blob_gas_wei) >= 1 THEN 'pass' ELSE 'fail' END AS status
    FROM fx_blocks GROUP BY date_utc""", "fx_blocks"))
def q12(spark, d):
    return brief(Q.minimum_blob_fee(fx.blocks(spark, d)))


@query("q13_continuity_and_receipts", sql(
    """SELECT 'block_continuity' AS "check", 'all' AS key, CAST(MAX(n) - MIN(n) + 1 - COUNT(*) AS DOUBLE) AS observed,
    0.0::DOUBLE AS threshold, CASE WHEN MAX(n) - MIN(n) + 1 = COUNT(*) THEN 'pass' ELSE 'fail' END AS status
    FROM (SELECT DISTINCT l_orderkey AS n FROM lineitem)
    UNION ALL SELECT 'receipt_coverage', 'all', ROUND(SUM(status) / CAST(COUNT(*) AS DOUBLE), 9), 0.999::DOUBLE,
    CASE WHEN SUM(status) / CAST(COUNT(*) AS DOUBLE) >= 0.999 THEN 'pass' ELSE 'fail' END FROM fx_receipts""", "fx_receipts"))
def q13(spark, d):
    r = fx.receipts(spark, d)
    return brief(Q.block_continuity(M.missing_numbers(r, "block_number")).unionByName(
        Q.receipt_coverage(r, r.filter("status = 1"))))


@query("q14_attribution_target", sql(
    """SELECT 'attribution_coverage' AS "check", CASE WHEN post_regime THEN 'post' ELSE 'pre' END AS key, ROUND(coverage, 9) AS observed,
    CASE WHEN post_regime THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS threshold, CASE WHEN coverage >= CASE WHEN post_regime THEN 0.9
    ELSE 0.8 END THEN 'pass' ELSE 'fail' END AS status FROM cover_""", "fx_tx_costs", extra=(COVER,)))
def q14(spark, d):
    return brief(Q.attribution_target(K.attribution_coverage(tx_costs(spark, d), REGIME_DATE)))


@query("q15_registry_audit", sql(
    """SELECT 'registry_audit' AS "check", rollup_id || '|' || address AS key, 'fail' AS status, 'missing:source_url' AS detail
    FROM fx_addresses WHERE source_url IS NULL""", "fx_addresses"))
def q15(spark, d):
    return Q.registry_audit(fx.address_mappings(spark, d), "address").select("check", "key", "status", "detail")


@query("q20_header_presence", sql(
    f"""SELECT 'blob_header_presence' AS "check", CASE WHEN active THEN 'after' ELSE 'before' END AS key,
    CAST(SUM(CASE WHEN header_ok THEN 0 ELSE 1 END) AS DOUBLE) AS observed, 0.0::DOUBLE AS threshold,
    CASE WHEN SUM(CASE WHEN header_ok THEN 0 ELSE 1 END) = 0 THEN 'pass' ELSE 'fail' END AS status
    FROM ({HEADERS}) GROUP BY active""", "fx_blocks"))
def q20(spark, d):
    return brief(Q.header_presence_check(K.header_presence(fx.blocks(spark, d), ACTIVATION)))


@query("q22_blob_burn", sql(
    """SELECT 'blob_burn' AS "check", 'negative' AS key, 0.0::DOUBLE AS observed, 0.0::DOUBLE AS threshold, 'pass' AS status
    FROM fx_tx_costs HAVING SUM(CASE WHEN burn_blob_wei < 0 THEN 1 ELSE 0 END) = 0
    UNION ALL SELECT 'blob_burn', 'correlation', ROUND(corr(burn, n3), 9), 0.0::DOUBLE, CASE WHEN corr(burn, n3) > 0 THEN 'pass'
    ELSE 'fail' END FROM (SELECT date_utc, CAST(SUM(COALESCE(burn_blob_wei, 0)) AS DOUBLE) AS burn,
    CAST(SUM(CASE WHEN tx_type = 3 THEN 1 ELSE 0 END) AS DOUBLE) AS n3 FROM fx_tx_costs GROUP BY 1)""", "fx_tx_costs"))
def q22(spark, d):
    return brief(Q.blob_burn_check(K.fee_parts(timed_tx(spark, d))))
