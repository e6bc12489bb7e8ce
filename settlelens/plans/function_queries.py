"""Queries of the scalar families, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from settlelens.functions import columns as X
from settlelens.plans import fixtures as fx
from settlelens.plans.catalogue import query, sig, sig_sql
from settlelens.plans.fixtures import sql


@query("f1_profit_tolerance", sql(
    """SELECT date_utc, rollup_id, GREATEST(1e-9::DOUBLE, 0.01::DOUBLE * GREATEST(ABS(l2_fees_eth), ABS(rent_paid_eth), 1e-9::DOUBLE)) AS tolerance
    FROM fx_panel""", "fx_panel"), dates=("date_utc",))
def f1(spark, d):
    return fx.panel(spark, d).select("date_utc", "rollup_id", X.profit_tolerance("l2_fees_eth", "rent_paid_eth").alias("tolerance"))


@query("f2_log_positive", f"""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN {sig_sql('ln(c_acctbal)', 9)} END AS log_balance FROM customer
WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE NOT c_acctbal > 0""")
def f2(spark, d):
    return fx.table(spark, d, "customer").select("c_custkey", sig(X.log_positive("c_acctbal"), 9).alias("log_balance"))


@query("f3_blob_gas", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_linenumber AS BIGINT) * 131072 AS gas, CAST(l_linenumber AS BIGINT) AS blobs,
CAST(FLOOR(l_quantity * 21000 / 131072) AS BIGINT) AS blobs_of_gas FROM lineitem""")
def f3(spark, d):
    li = fx.table(spark, d, "lineitem")
    gas = X.blob_gas("l_linenumber")
    return li.select("l_orderkey", "l_linenumber", gas.alias("gas"), X.blobs_from_gas(gas).alias("blobs"),
                     X.blobs_from_gas(F.col("l_quantity") * 21000).alias("blobs_of_gas"))


@query("f4_blob_base_fee", fx.sql("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 + o_custkey % 50 ELSE fee END AS BIGINT) AS fee_wei,
    o_orderkey % 2 <> 0 AS derived FROM orders JOIN fx_fee ON excess = (o_custkey % 400) * 131072""", "fx_fee"))
def f4(spark, d):
    o = fx.table(spark, d, "orders")
    given = F.when(F.col("o_orderkey") % 2 == 0, 1 + F.col("o_custkey") % 50)
    fee = X.blob_base_fee(given, (F.col("o_custkey") % 400) * 131072, F.lit(3338477))
    return o.select("o_orderkey", fee.cast("bigint").alias("fee_wei"), given.isNull().alias("derived"))


ZEROED = "CASE WHEN txcount % 5 = 0 THEN 0 WHEN txcount % 5 = 1 THEN NULL ELSE l2_fees_eth END"


def _zeroed():
    return F.when(F.col("txcount") % 5 == 0, 0.0).when(F.col("txcount") % 5 != 1, F.col("l2_fees_eth"))


@query("f5_relative_difference", sql(
    f"SELECT date_utc, rollup_id, ABS(rent_paid_eth - x) / NULLIF(ABS(x), 0) AS difference FROM (SELECT *, {ZEROED} AS x FROM fx_panel)", "fx_panel"),
    dates=("date_utc",))
def f5(spark, d):
    return fx.panel(spark, d).select("date_utc", "rollup_id", X.relative_difference("rent_paid_eth", _zeroed()).alias("difference"))


@query("f6_dates", sql(
    """SELECT block_number, date_utc, CAST(date_trunc('month', date_utc) AS DATE) AS month_utc,
    CAST(datediff('day', DATE '1970-01-01', date_utc) AS BIGINT) AS day_no FROM fx_blocks""", "fx_blocks"), dates=("date_utc", "month_utc"))
def f6(spark, d):
    b = fx.blocks(spark, d).withColumn("date_utc", X.strict_date(X.epoch_date("timestamp").cast("string")))
    return b.select("block_number", "date_utc", X.month_of("date_utc").alias("month_utc"), X.day_number("date_utc").alias("day_no"))


@query("f7_text", """SELECT s_suppkey, lower(s_name) AS lowered, regexp_extract(s_name, '#(0*)([0-9]+)$', 2) AS number_text,
concat_ws(' ', 'collect', '--supplier', CAST(s_suppkey AS VARCHAR), '''' || s_name || '''', '''it''"''"''s''') AS command FROM supplier""")
def f7(spark, d):
    s = fx.table(spark, d, "supplier")
    return s.select("s_suppkey", F.lower("s_name").alias("lowered"), F.regexp_extract("s_name", "#(0*)([0-9]+)$", 2).alias("number_text"),
                    X.command_line(F.array(F.lit("collect"), F.lit("--supplier"), F.col("s_suppkey").cast("string"), F.col("s_name"), F.lit("it's"))).alias("command"))


@query("f8_digest_format", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN TRUE ELSE FALSE END AS valid FROM documents")
def f8(spark, d):
    doc = fx.table(spark, d, "documents")
    digest = F.sha2("text", 256)
    k = F.col("doc_id") % 4
    text = F.when(k == 0, digest).when(k == 1, F.concat(digest, F.lit("\n"))).when(k == 2, F.substring(digest, 1, 63)).otherwise(
        F.concat(F.lit("A"), F.substring(digest, 2, 63)))
    return doc.select("doc_id", X.is_sha256(text).alias("valid"))


@query("f9_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def f9(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("f10_json_keys", """SELECT event_id, props LIKE '{%}' AS is_object, props LIKE '%"k":%' AS has_k, FALSE AS has_z FROM events""")
def f10(spark, d):
    e = fx.table(spark, d, "events")
    m = X.json_object("props")
    return e.select("event_id", F.schema_of_variant(F.try_parse_json("props")).startswith("OBJECT").alias("is_object"),
                    F.map_contains_key(m, "k").alias("has_k"), F.map_contains_key(m, "z").alias("has_z"))


@query("f11_json_array", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, UNNEST([CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)]) AS item FROM lineitem""")
def f11(spark, d):
    li = fx.table(spark, d, "lineitem")
    text = F.concat(F.lit('["'), F.col("l_partkey").cast("string"), F.lit('","'), F.col("l_suppkey").cast("string"), F.lit('"]'))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(X.json_strings(text)).alias("item"))


@query("f12_map_rows", """SELECT event_id, 'k' AS key, regexp_extract(props, '([0-9]+)', 1) AS value FROM events""")
def f12(spark, d):
    return fx.table(spark, d, "events").select("event_id", F.explode(X.json_object("props")).alias("key", "value"))


@query("f13_blob_count", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CAST(CASE l_linenumber % 3 WHEN 1 THEN 0 WHEN 2 THEN l_linenumber END AS BIGINT)
AS blob_count FROM lineitem""")
def f13(spark, d):
    k = F.col("l_linenumber")
    hashes = F.when(k % 3 == 1, F.array().cast("array<int>")).when(k % 3 == 2, F.sequence(F.lit(1), k.cast("int")))
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.blob_count_from_hashes(hashes).alias("blob_count"))


@query("f14_number_text", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey AS DOUBLE) WHEN 2 THEN CAST(o_custkey AS DOUBLE)
WHEN 3 THEN -(o_custkey + 0.5::DOUBLE) WHEN 4 THEN CAST('1' || CAST(o_custkey AS VARCHAR) AS DOUBLE) END AS number FROM orders""")
def f14(spark, d):
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, c).when(k == 1, F.concat(c, F.lit("d"))).when(k == 2, F.concat(F.lit("  "), c, F.lit(" ")))
        .when(k == 3, F.concat(F.lit("-"), c, F.lit(".5"))).otherwise(F.concat(F.lit("1_"), c))
    )
    return fx.table(spark, d, "orders").select("o_orderkey", X.parse_number(text).alias("number"))


@query("f15_nan_and_null", sql(
    f"""SELECT date_utc, rollup_id, COALESCE(x = 0, FALSE) AS is_nan, x IS NULL AS is_null, rent_paid_eth / NULLIF(x, 0) AS ratio
    FROM (SELECT *, {ZEROED} AS x FROM fx_panel)""", "fx_panel"), dates=("date_utc",))
def f15(spark, d):
    r = fx.panel(spark, d).withColumn("r", X.ratio_or_nan("rent_paid_eth", _zeroed()))
    return r.select("date_utc", "rollup_id", F.coalesce(F.isnan("r"), F.lit(False)).alias("is_nan"), F.col("r").isNull().alias("is_null"),
                    X.not_nan("r").alias("ratio"))
