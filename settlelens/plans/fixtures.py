"""Adapters that read the supplied tables as fee data; each has the same mapping as ANSI SQL in ``CTES``.

Amounts pass through decimals, so sums do not depend on row order and agree to the last digit
between engines.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlelens.operators.costs import with_blob_fee

# Stand-in for the activation date on the 1995-2001 chain data.
REGIME_DATE = dt.date(1998, 3, 13)
METRIC_OF_EVENT = {
    "view": "fees_eth",
    "click": "rent_paid_eth",
    "purchase": "profit_eth",
    "signup": "txcount",
    "error": "fees_usd",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dec(name: str, scale: int = 2):
    return F.col(name).cast(f"decimal(18,{scale})")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.expr(
        "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in METRIC_OF_EVENT.items()) + " END"
    )
    return (
        table(spark, sf_dir, "events")
        .select(
            key.alias("metric_key"),
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("origin_key"),
            F.to_date("ts").alias("date_utc"),
            _dec("value").alias("value"),
        )
        .groupBy("metric_key", "origin_key", "date_utc")
        .agg(F.sum("value").cast("double").alias("value"))
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    uid = F.col("user_id").cast("int")
    return u.select(
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("rollup_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("origin_key"),
        F.concat(F.lit("Rollup "), F.col("user_id").cast("string")).alias("display_name"),
        F.when(uid % 2 == 0, "optimistic").otherwise("zk").alias("category"),
        (uid % 3 != 0).alias("in_scope"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), uid % 10).alias("start_date_utc"),
        F.when(uid % 4 == 0, F.lit(dt.date(2024, 1, 20))).alias("end_date_utc"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    price, disc, tax = _dec("l_extendedprice"), _dec("l_discount"), _dec("l_tax")
    return (
        li.select(
            "l_suppkey",
            F.to_date("l_shipdate").alias("date_utc"),
            price.cast("decimal(18,2)").alias("fees"),
            (price * disc).cast("decimal(18,4)").alias("rent"),
            (price * tax).cast("decimal(18,4)").alias("tax"),
        )
        .join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("date_utc", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("rollup_id"))
        .agg(
            F.sum("fees").alias("fees"),
            F.sum("rent").alias("rent"),
            F.sum("tax").alias("tax"),
            F.count(F.lit(1)).alias("txcount"),
        )
        .select(
            "date_utc",
            "rollup_id",
            F.col("fees").cast("double").alias("l2_fees_eth"),
            F.col("rent").cast("double").alias("rent_paid_eth"),
            (F.col("fees").cast("double") - F.col("rent").cast("double") - F.col("tax").cast("double") * 0.2).alias(
                "profit_eth"
            ),
            "txcount",
        )
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their blob fee, derived where the raw rows have none."""
    return with_blob_fee(raw_blocks(spark, sf_dir))


def raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block headers; every third one after activation comes without a blob fee."""
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    post = day >= F.lit(REGIME_DATE)
    quiet = F.month(day).isin(1, 2) | ((F.month(day) == 6) & (F.dayofmonth(day) <= 4))
    present = post & (F.col("o_orderkey") % 97 != 0)
    return o.select(
        F.col("o_orderkey").alias("block_number"),
        F.concat(F.lit("0x"), F.md5(F.col("o_orderkey").cast("string"))).alias("block_hash"),
        (F.unix_date(day).cast("bigint") * 86400 + F.col("o_custkey") % 86400).alias("timestamp"),
        (F.floor("o_totalprice").cast("decimal(17,0)") * F.lit(100000).cast("decimal(6,0)"))
        .cast("decimal(17,0)")
        .alias("base_fee_per_gas_wei"),
        (F.lit(15000000) + F.col("o_custkey") % 15000000).cast("bigint").alias("gas_used"),
        F.lit(30000000).cast("bigint").alias("gas_limit"),
        F.when(present, (F.col("o_custkey") % 7) * 131072).cast("bigint").alias("blob_gas_used"),
        F.when(present, (F.col("o_custkey") % 400) * 131072).cast("bigint").alias("excess_blob_gas"),
        F.when(present & (F.col("o_orderkey") % 3 == 0), F.lit(None))
        .when(quiet, F.lit(1))
        .otherwise(1 + F.col("o_custkey") % 50)
        .cast("decimal(17,0)")
        .alias("base_fee_per_blob_gas_wei"),
    )


def _address(key: str):
    return F.concat(F.lit("0x"), F.lpad(F.col(key).cast("string"), 40, "0"))


def _contract_address(number):
    return F.concat(F.lit("0xc"), F.lpad(number.cast("string"), 39, "0"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    base = raw_blocks(spark, sf_dir).select("block_number", "base_fee_per_gas_wei")
    tip = F.round(F.col("l_discount") * 100).cast("decimal(7,0)") * F.lit(1000000000).cast("decimal(10,0)")
    # The hash is worked out after the join: its text is far longer than the keys it is made of.
    return (
        li.join(base, F.col("l_orderkey") == F.col("block_number"))
        .withColumn(
            "tx_hash",
            F.md5(
                F.concat_ws(
                    "|",
                    *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
                    F.to_date("l_shipdate").cast("string"),
                )
            ),
        )
        .select(
            "tx_hash",
            "block_number",
            _address("l_suppkey").alias("from_address"),
            _contract_address(F.col("l_partkey") % 50).alias("to_address"),
            F.when(F.col("l_returnflag") == "R", 3).otherwise(2).alias("tx_type"),
            (F.col("l_quantity") * 21000).cast("decimal(12,0)").alias("gas_used"),
            (F.col("base_fee_per_gas_wei") + tip).cast("decimal(17,0)").alias("effective_gas_price_wei"),
            F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("status"),
            F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") < 7), F.col("l_linenumber"))
            .cast("int")
            .alias("blob_count"),
            F.col("l_partkey").alias("part_key"),
        )
    )


def blob_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type-3 detail; the hash list is given for every third part."""
    r = receipts(spark, sf_dir).filter("tx_type = 3")
    hashes = F.transform(
        F.sequence(F.lit(1), F.col("blob_count")), lambda i: F.md5(F.concat_ws("|", "tx_hash", i.cast("string")))
    )
    return r.select(
        "tx_hash",
        F.when(F.col("part_key") % 3 != 0, F.col("blob_count")).alias("blob_count"),
        F.lit(None).cast("decimal(38,0)").alias("max_fee_per_blob_gas_wei"),
        F.when((F.col("part_key") % 3 == 0) & F.col("blob_count").isNotNull(), hashes).alias("blob_versioned_hashes"),
    )


def blob_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auxiliary index that knows some of the missing blob counts."""
    r = receipts(spark, sf_dir).filter("tx_type = 3 AND blob_count IS NULL AND part_key % 2 = 0")
    return r.select("tx_hash", F.lit(3).alias("index_blob_count"))


def address_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 <> 9")
    key = F.col("s_suppkey").cast("int")
    start = F.date_add(F.lit(dt.date(1995, 1, 1)), (key % 5) * 200)
    stop = F.when(key % 3 != 0, F.date_add(start, 1000))

    def row(rollup_no, valid_from, valid_to, confidence):
        return F.struct(
            F.concat(F.lit("n"), rollup_no.cast("string")).alias("rollup_id"),
            _address("s_suppkey").alias("address"),
            F.lit("batch_poster").alias("address_role"),
            valid_from.cast("timestamp").alias("valid_from_utc"),
            valid_to.cast("timestamp").alias("valid_to_utc"),
            F.when(key % 7 != 0, F.concat(F.lit("https://example.org/"), key.cast("string"))).alias("source_url"),
            F.lit(confidence).alias("confidence"),
        )

    first = row(F.col("s_nationkey"), start, stop, "high")
    second = row((F.col("s_nationkey") + 1) % 25, F.date_add(start, 100), F.lit(None).cast("date"), "med")
    both = F.when(key % 20 == 0, F.array(first, second)).otherwise(F.array(first))
    return s.select(F.inline(both))


def contract_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 5")
    return n.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("rollup_id"),
        _contract_address(F.col("n_nationkey")).alias("contract_address"),
        F.lit("inbox").alias("contract_role"),
        F.lit(dt.date(1990, 1, 1)).cast("timestamp").alias("valid_from_utc"),
        F.lit(None).cast("timestamp").alias("valid_to_utc"),
        F.lit("https://example.org/contracts").alias("source_url"),
        F.lit("low").alias("confidence"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(_dec("o_totalprice")).cast("double")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date_utc"))
        .agg((total / F.count(F.lit(1)) / 100.0).alias("eth_usd_close"))
    )


def prices_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second price source: the same orders without the urgent ones."""
    total = F.sum(_dec("o_totalprice")).cast("double")
    return (
        table(spark, sf_dir, "orders")
        .filter("o_orderpriority <> '1-URGENT'")
        .groupBy(F.to_date("o_orderdate").alias("date_utc"))
        .agg((total / F.count(F.lit(1)) / 100.0).alias("eth_usd_close"))
    )


def issuance(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(_dec("o_totalprice")).cast("double")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date_utc"))
        .agg((total / 1000000.0).alias("issuance_eth"))
    )


def issuance_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second issuance source: each order rounded to whole units."""
    total = F.sum(F.floor("o_totalprice").cast("decimal(18,0)")).cast("double")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date_utc"))
        .agg((total / 1000000.0).alias("issuance_eth"))
    )


def second_vendor_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second vendor: rent of the panel shifted per rollup, by slug, with per-operation rows mixed in."""
    p = panel(spark, sf_dir)
    number = F.substring("rollup_id", 2, 10).cast("int")
    return p.select(
        "date_utc",
        F.concat(F.when(number % 5 == 0, "alias-").otherwise("slug-"), number.cast("string")).alias("slug"),
        F.when(F.col("txcount") % 6 == 5, "per_user_op").otherwise("total").alias("unit"),
        (
            F.col("rent_paid_eth").cast("decimal(18,4)")
            * (F.lit(1) + (number % 9) * F.lit(Decimal("0.0192"))).cast("decimal(6,4)")
        )
        .cast("double")
        .alias("total_cost_eth"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, y) of the take rate per rollup and for all rollups."""
    return str_series(panel(spark, sf_dir))


def str_series(p: DataFrame) -> DataFrame:
    fees, rent = F.col("l2_fees_eth").cast("decimal(38,6)"), F.col("rent_paid_eth").cast("decimal(38,6)")
    both = p.select(
        F.explode(F.array(F.col("rollup_id"), F.lit("all"))).alias("series_id"),
        F.unix_date("date_utc").cast("bigint").alias("t"),
        fees.alias("fees"),
        rent.alias("rent"),
        "txcount",
    )
    return (
        both.groupBy("series_id", "t")
        .agg(F.sum("fees").alias("fees"), F.sum("rent").alias("rent"), F.sum("txcount").alias("tx"))
        .select(
            "series_id",
            "t",
            (F.col("rent").cast("double") / F.col("fees").cast("double")).alias("y"),
            F.col("fees").cast("double").alias("fees"),
            F.col("rent").cast("double").alias("rent"),
            "tx",
        )
    )


# ---- the same adapters as SQL -----------------------------------------------------------------

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_metrics": (
        (),
        "SELECT CASE event_type "
        + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in METRIC_OF_EVENT.items())
        + """ END AS metric_key, 'u' || CAST(user_id AS VARCHAR) AS origin_key, CAST(ts AS DATE) AS date_utc,
        CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2, 3""",
    ),
    "fx_universe": (
        (),
        """SELECT 'r' || CAST(user_id AS VARCHAR) AS rollup_id, 'u' || CAST(user_id AS VARCHAR) AS origin_key,
        'Rollup ' || CAST(user_id AS VARCHAR) AS display_name,
        CASE WHEN user_id % 2 = 0 THEN 'optimistic' ELSE 'zk' END AS category,
        user_id % 3 <> 0 AS in_scope, DATE '2024-01-01' + CAST(user_id % 10 AS INTEGER) AS start_date_utc,
        CASE WHEN user_id % 4 = 0 THEN DATE '2024-01-20' END AS end_date_utc
        FROM (SELECT DISTINCT user_id FROM events)""",
    ),
    "fx_vendor": (
        ("fx_metrics", "fx_universe"),
        """SELECT m.date_utc, u.rollup_id, u.in_scope, u.start_date_utc, u.end_date_utc,
        MAX(CASE WHEN metric_key = 'fees_eth' THEN value END) AS fees_eth,
        MAX(CASE WHEN metric_key = 'fees_usd' THEN value END) AS fees_usd,
        MAX(CASE WHEN metric_key = 'rent_paid_eth' THEN value END) AS rent_paid_eth,
        MAX(CASE WHEN metric_key = 'profit_eth' THEN value END) AS profit_eth,
        CAST(FLOOR(MAX(CASE WHEN metric_key = 'txcount' THEN value END)) AS BIGINT) AS txcount
        FROM fx_metrics m JOIN fx_universe u ON m.origin_key = u.origin_key GROUP BY 1, 2, 3, 4, 5""",
    ),
    "fx_panel": (
        (),
        """SELECT date_utc, rollup_id, CAST(fees AS DOUBLE) AS l2_fees_eth, CAST(rent AS DOUBLE) AS rent_paid_eth,
        CAST(fees AS DOUBLE) - CAST(rent AS DOUBLE) - CAST(tax AS DOUBLE) * 0.2::DOUBLE AS profit_eth, txcount
        FROM (SELECT CAST(l_shipdate AS DATE) AS date_utc, 'n' || CAST(s_nationkey AS VARCHAR) AS rollup_id,
          SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS fees,
          SUM(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4))) AS rent,
          SUM(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4))) AS tax,
          COUNT(*) AS txcount
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)""",
    ),
    # The fee rule's integer series for every excess value of the adapter, step by step.
    "fx_fee_steps": (
        (),
        """SELECT CAST(k AS HUGEINT) * 131072 AS excess, 1::HUGEINT AS i, 0::HUGEINT AS total, 3338477::HUGEINT AS term FROM range(400) r(k)
        UNION ALL SELECT excess, i + 1, total + term, term * excess // (3338477 * i) FROM fx_fee_steps WHERE term > 0""",
    ),
    "fx_fee": (("fx_fee_steps",), "SELECT excess, CAST(total // 3338477 AS BIGINT) AS fee FROM fx_fee_steps WHERE term = 0"),
    "fx_blocks": (
        ("fx_fee",),
        f"""SELECT o_orderkey AS block_number, '0x' || md5(CAST(o_orderkey AS VARCHAR)) AS block_hash,
        CAST(o_orderdate AS DATE) AS date_utc,
        CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400 + o_custkey % 86400
          AS "timestamp",
        CAST(FLOOR(o_totalprice) AS HUGEINT) * 100000 AS base_fee_per_gas_wei,
        CAST(15000000 + o_custkey % 15000000 AS BIGINT) AS gas_used, CAST(30000000 AS BIGINT) AS gas_limit,
        CASE WHEN CAST(o_orderdate AS DATE) >= DATE '{REGIME_DATE}' AND o_orderkey % 97 <> 0
          THEN (o_custkey % 7) * 131072 END AS blob_gas_used,
        CASE WHEN CAST(o_orderdate AS DATE) >= DATE '{REGIME_DATE}' AND o_orderkey % 97 <> 0
          THEN (o_custkey % 400) * 131072 END AS excess_blob_gas,
        CASE WHEN CAST(o_orderdate AS DATE) >= DATE '{REGIME_DATE}' AND o_orderkey % 97 <> 0 AND o_orderkey % 3 = 0 THEN fee
          WHEN month(o_orderdate) IN (1, 2) OR (month(o_orderdate) = 6 AND day(o_orderdate) <= 4)
          THEN 1 ELSE 1 + o_custkey % 50 END AS base_fee_per_blob_gas_wei
        FROM orders JOIN fx_fee ON excess = (o_custkey % 400) * 131072""",
    ),
    "fx_receipts": (
        ("fx_blocks",),
        """SELECT md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR),
          CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(CAST(l_shipdate AS DATE) AS VARCHAR))) AS tx_hash,
        l_orderkey AS block_number, '0x' || lpad(CAST(l_suppkey AS VARCHAR), 40, '0') AS from_address,
        '0xc' || lpad(CAST(l_partkey % 50 AS VARCHAR), 39, '0') AS to_address,
        CASE WHEN l_returnflag = 'R' THEN 3 ELSE 2 END AS tx_type,
        CAST(l_quantity * 21000 AS HUGEINT) AS gas_used,
        base_fee_per_gas_wei + CAST(round(l_discount * 100) AS HUGEINT) * 1000000000 AS effective_gas_price_wei,
        CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS status,
        CASE WHEN l_returnflag = 'R' AND l_linenumber < 7 THEN l_linenumber END AS blob_count,
        l_partkey AS part_key
        FROM lineitem JOIN fx_blocks ON l_orderkey = block_number""",
    ),
    "fx_addresses": (
        (),
        """SELECT 'n' || CAST(s_nationkey AS VARCHAR) AS rollup_id, '0x' || lpad(CAST(s_suppkey AS VARCHAR), 40, '0') AS address,
        DATE '1995-01-01' + CAST((s_suppkey % 5) * 200 AS INTEGER) AS valid_from,
        CASE WHEN s_suppkey % 3 <> 0 THEN DATE '1995-01-01' + CAST((s_suppkey % 5) * 200 + 1000 AS INTEGER) END AS valid_to,
        CASE WHEN s_suppkey % 7 <> 0 THEN 'https://example.org/' || CAST(s_suppkey AS VARCHAR) END AS source_url,
        'high' AS confidence, 0 AS conf_rank
        FROM supplier WHERE s_suppkey % 10 <> 9
        UNION ALL
        SELECT 'n' || CAST((s_nationkey + 1) % 25 AS VARCHAR), '0x' || lpad(CAST(s_suppkey AS VARCHAR), 40, '0'),
        DATE '1995-01-01' + CAST((s_suppkey % 5) * 200 + 100 AS INTEGER), NULL,
        CASE WHEN s_suppkey % 7 <> 0 THEN 'https://example.org/' || CAST(s_suppkey AS VARCHAR) END, 'med', 1
        FROM supplier WHERE s_suppkey % 10 <> 9 AND s_suppkey % 20 = 0""",
    ),
    "fx_contracts": (
        (),
        """SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS rollup_id,
        '0xc' || lpad(CAST(n_nationkey AS VARCHAR), 39, '0') AS contract_address
        FROM nation WHERE n_nationkey < 5""",
    ),
    "fx_attributed": (
        ("fx_receipts", "fx_addresses", "fx_contracts"),
        """SELECT r.*, b.date_utc, b.base_fee_per_gas_wei, b.base_fee_per_blob_gas_wei, b."timestamp",
        a.rollup_id AS from_rollup, c.rollup_id AS to_rollup, a.confidence AS from_confidence
        FROM fx_receipts r JOIN fx_blocks b ON r.block_number = b.block_number
        LEFT JOIN (SELECT r2.tx_hash, arg_min(x.rollup_id, x.conf_rank * 1000 + CAST(substr(x.rollup_id, 2) AS INTEGER)) AS rollup_id,
             arg_min(x.confidence, x.conf_rank * 1000 + CAST(substr(x.rollup_id, 2) AS INTEGER)) AS confidence
             FROM fx_receipts r2 JOIN fx_blocks b2 ON r2.block_number = b2.block_number
             JOIN fx_addresses x ON x.address = r2.from_address AND b2.date_utc >= x.valid_from
               AND (x.valid_to IS NULL OR b2.date_utc < x.valid_to) GROUP BY r2.tx_hash) a ON a.tx_hash = r.tx_hash
        LEFT JOIN fx_contracts c ON c.contract_address = r.to_address""",
    ),
    "fx_tx_costs": (
        ("fx_attributed",),
        """SELECT *, COALESCE(from_rollup, CASE WHEN to_rollup IS NOT NULL THEN 'unattributed_rollup_like' ELSE 'other' END)
          AS rollup_id,
        gas_used * base_fee_per_gas_wei AS burn_base_wei,
        gas_used * (effective_gas_price_wei - base_fee_per_gas_wei) AS tips_wei,
        gas_used * effective_gas_price_wei AS execution_fee_wei,
        CASE WHEN tx_type = 3 THEN CAST(blob_count AS HUGEINT) * 131072 * base_fee_per_blob_gas_wei
          ELSE CAST(0 AS HUGEINT) END AS burn_blob_wei,
        tx_type = 3 AND blob_count IS NULL AS blob_burn_unknown
        FROM fx_attributed""",
    ),
    "fx_prices": (
        (),
        """SELECT CAST(o_orderdate AS DATE) AS date_utc,
        CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) / 100.0::DOUBLE AS eth_usd_close FROM orders GROUP BY 1""",
    ),
    "fx_prices2": (
        (),
        """SELECT CAST(o_orderdate AS DATE) AS date_utc,
        CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) / 100.0::DOUBLE AS eth_usd_close
        FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1""",
    ),
    "fx_issuance": (
        (),
        """SELECT CAST(o_orderdate AS DATE) AS date_utc,
        CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000000.0::DOUBLE AS issuance_eth FROM orders GROUP BY 1""",
    ),
    "fx_issuance2": (
        (),
        """SELECT CAST(o_orderdate AS DATE) AS date_utc,
        CAST(SUM(CAST(FLOOR(o_totalprice) AS DECIMAL(18,0))) AS DOUBLE) / 1000000.0::DOUBLE AS issuance_eth FROM orders GROUP BY 1""",
    ),
    "fx_costs": (
        ("fx_panel",),
        """SELECT date_utc, (CASE WHEN k % 5 = 0 THEN 'alias-' ELSE 'slug-' END) || CAST(k AS VARCHAR) AS slug,
        CASE WHEN txcount % 6 = 5 THEN 'per_user_op' ELSE 'total' END AS unit,
        CAST(CAST(rent_paid_eth AS DECIMAL(18,4)) * CAST(1 + (k % 9) * 0.0192 AS DECIMAL(6,4)) AS DOUBLE) AS total_cost_eth, rollup_id
        FROM (SELECT *, CAST(substr(rollup_id, 2) AS INTEGER) AS k FROM fx_panel)""",
    ),
    "fx_series": (
        ("fx_panel",),
        """SELECT series_id, t, CAST(rent AS DOUBLE) / CAST(fees AS DOUBLE) AS y, CAST(fees AS DOUBLE) AS fees,
        CAST(rent AS DOUBLE) AS rent, tx FROM (
          SELECT series_id, t, SUM(CAST(l2_fees_eth AS DECIMAL(38,6))) AS fees,
          SUM(CAST(rent_paid_eth AS DECIMAL(38,6))) AS rent, CAST(SUM(txcount) AS BIGINT) AS tx FROM (
            SELECT rollup_id AS series_id, CAST(datediff('day', DATE '1970-01-01', date_utc) AS BIGINT) AS t, * FROM fx_panel
            UNION ALL
            SELECT 'all' AS series_id, CAST(datediff('day', DATE '1970-01-01', date_utc) AS BIGINT) AS t, * FROM fx_panel)
          GROUP BY 1, 2)""",
    ),
}


def sql(body: str, *needs: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """``body`` behind the adapter CTEs it needs (dependencies first) and its own ``extra`` CTEs."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    # Materialized, as an engine may else work a shared part out again at each use; a recursive one cannot be.
    given = [(n, CTES[n][1]) for n in order] + list(extra)
    parts = [f"{n} AS {'' if f'FROM {n} ' in b else 'MATERIALIZED '}({b})" for n, b in given]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
