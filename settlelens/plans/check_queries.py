"""Queries of checks and cross-source reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from settlelens import contracts as C
from settlelens.operators import checks as Q
from settlelens.operators import lineage as L
from settlelens.operators import metrics as M
from settlelens.operators import normalize as N
from settlelens.operators import reconcile as R
from settlelens.operators import sets as S
from settlelens.operators import costs as K
from settlelens.plans import chain_queries as CQ
from settlelens.plans import fixtures as fx
from settlelens.plans import panel_queries as PQ
from settlelens.plans.catalogue import query, sig, sig_sql
from settlelens.plans.fixtures import REGIME_DATE, sql

ROWS, SPINE, COVERAGE, COSTS2 = PQ.ROWS, PQ.SPINE, PQ.COVERAGE, PQ.COSTS2
DEC = PQ.DEC


def status(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 'pass' ELSE 'fail' END"


def banded(diff: str, passed: float, warned: float) -> str:
    return f"CASE WHEN {diff} <= {passed} THEN 'pass' WHEN {diff} <= {warned} THEN 'warn' ELSE 'fail' END"


def month(name: str) -> str:
    return f"CAST(date_trunc('month', {name}) AS DATE)"


# ---- contract checks ----------------------------------------------------------------------------


@query("s12_contract_fields", sql(
    """SELECT 'date_utc' AS field, 'date' AS type, FALSE AS nullable, COUNT(*) - COUNT(date_utc) AS n_null FROM fx_vendor
    UNION ALL SELECT 'rollup_id', 'string', FALSE, COUNT(*) - COUNT(rollup_id) FROM fx_vendor
    UNION ALL SELECT 'l2_fees_eth', 'double', FALSE, COUNT(*) - COUNT(fees_eth) FROM fx_vendor
    UNION ALL SELECT 'rent_paid_eth', 'double', FALSE, COUNT(*) - COUNT(rent_paid_eth) FROM fx_vendor
    UNION ALL SELECT 'profit_eth', 'double', TRUE, COUNT(*) - COUNT(profit_eth) FROM fx_vendor
    UNION ALL SELECT 'txcount', 'bigint', TRUE, COUNT(*) - COUNT(txcount) FROM fx_vendor""", "fx_vendor"))
def s12(spark, d):
    schema = C.contract_schema(C.PANEL_CONTRACT)
    v = N.to_contract(PQ.vendor(spark, d).withColumnRenamed("fees_eth", "l2_fees_eth"), C.PANEL_CONTRACT)
    rows = [
        F.struct(F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type"),
                 F.lit(f.nullable).alias("nullable"), F.count_if(F.col(f.name).isNull()).alias("n_null"))
        for f in schema.fields
    ]
    return v.agg(F.array(*rows).alias("r")).select(F.inline("r"))


@query("q1_schema_conformance", sql(
    """SELECT 'schema' AS "check", key, CAST(n AS DOUBLE) AS observed, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
    SELECT 'date_utc' AS key, COUNT(*) - COUNT(date_utc) AS n FROM fx_vendor UNION ALL
    SELECT 'rollup_id', COUNT(*) - COUNT(rollup_id) FROM fx_vendor UNION ALL
    SELECT 'l2_fees_eth', COUNT(*) - COUNT(fees_eth) FROM fx_vendor UNION ALL
    SELECT 'rent_paid_eth', COUNT(*) - COUNT(rent_paid_eth) FROM fx_vendor UNION ALL
    SELECT 'profit_eth', 0 UNION ALL SELECT 'txcount', 0)
    UNION ALL SELECT 'primary_key', 'date_utc,rollup_id', 0.0::DOUBLE, 'pass'
    FROM (SELECT COUNT(*) AS n, COUNT(DISTINCT (date_utc, rollup_id)) AS k FROM fx_vendor) WHERE n = k""", "fx_vendor"))
def q1(spark, d):
    v = N.to_contract(PQ.vendor(spark, d).withColumnRenamed("fees_eth", "l2_fees_eth"), C.PANEL_CONTRACT)
    return Q.schema_conformance(v, C.PANEL_CONTRACT).select("check", "key", "observed", "status")


@query("q4_profit_identity", sql(
    f"""SELECT 'profit_identity' AS "check", CAST(date_utc AS VARCHAR) || '|' || rollup_id AS key,
    ABS(profit_eth - (l2_fees_eth - rent_paid_eth)) AS observed, tol AS threshold,
    {status('ABS(profit_eth - (l2_fees_eth - rent_paid_eth)) <= tol')} AS status FROM
    (SELECT *, GREATEST(1e-9::DOUBLE, 0.01::DOUBLE * GREATEST(ABS(l2_fees_eth), ABS(rent_paid_eth), 1e-9::DOUBLE)) AS tol FROM fx_panel)""",
    "fx_panel"))
def q4(spark, d):
    return Q.profit_identity(fx.panel(spark, d)).select("check", "key", "observed", "threshold", "status")


@query("q7_coverage_thresholds", sql(
    f"""SELECT 'vendor_coverage' AS "check", rollup_id AS key, coverage AS observed, 0.95::DOUBLE AS threshold,
    {status('coverage >= 0.95')} AS status FROM coverage_""", "fx_vendor", "fx_universe", extra=(ROWS, SPINE, COVERAGE)))
def q7(spark, d):
    return Q.coverage_threshold(PQ.vendor_coverage(spark, d), "rollup_id", "vendor_coverage", C.COVERAGE_VENDOR).drop("detail")


@query("q7_second_vendor_coverage", sql(
    f"""SELECT 'second_vendor_coverage' AS "check", s.rollup_id AS key, COUNT(c.rollup_id) / CAST(COUNT(*) AS DOUBLE) AS observed,
    0.8::DOUBLE AS threshold, {status('COUNT(c.rollup_id) / CAST(COUNT(*) AS DOUBLE) >= 0.8')} AS status
    FROM (SELECT rollup_id, CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date_utc FROM
      (SELECT rollup_id, MIN(date_utc) AS lo, MAX(date_utc) AS hi FROM fx_panel GROUP BY 1)) s
    LEFT JOIN costs2 c ON c.rollup_id = s.rollup_id AND c.date_utc = s.date_utc
    WHERE s.rollup_id IN (SELECT rollup_id FROM (SELECT rollup_id, SUM(CAST(l2_fees_eth AS {DEC})) AS f FROM fx_panel
      WHERE date_utc > (SELECT MAX(date_utc) FROM fx_panel) - 30 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) GROUP BY 2""",
    "fx_panel", "fx_costs", extra=(COSTS2,)))
def q7_second(spark, d):
    panel = fx.panel(spark, d)
    spine = M.calendar(panel, keys=("rollup_id",)).join(M.top_rollups(panel, 10).select("rollup_id"), "rollup_id", "left_semi")
    cover = M.coverage(spine, PQ.costs2(spark, d).filter("rollup_id IS NOT NULL"), ["rollup_id", "date_utc"])
    return Q.coverage_threshold(cover, "rollup_id", "second_vendor_coverage", C.COVERAGE_SECOND_VENDOR).drop("detail")


@query("q8_non_negative", sql(
    """SELECT 'non_negative' AS "check", key, CAST(n AS DOUBLE) AS observed, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
    SELECT 'txcount' AS key, SUM(CASE WHEN txcount < 0 THEN 1 ELSE 0 END) AS n FROM fx_panel UNION ALL
    SELECT 'l2_fees_eth', SUM(CASE WHEN l2_fees_eth < 0 THEN 1 ELSE 0 END) FROM fx_panel UNION ALL
    SELECT 'rent_paid_eth', SUM(CASE WHEN rent_paid_eth < 0 THEN 1 ELSE 0 END) FROM fx_panel)""", "fx_panel"))
def q8(spark, d):
    return Q.non_negative(fx.panel(spark, d), ["txcount", "l2_fees_eth", "rent_paid_eth"]).select(
        "check", "key", "observed", "status")


@query("q17_missing_share", sql(
    """SELECT 'missing_share' AS "check", key, ROUND(share, 9) AS observed, 0.05::DOUBLE AS threshold,
    CASE WHEN share < 0.05 THEN 'pass' ELSE 'fail' END AS status FROM (
    SELECT 'fees_eth' AS key, 1 - COUNT(fees_eth) / CAST(COUNT(*) AS DOUBLE) AS share FROM fx_vendor UNION ALL
    SELECT 'rent_paid_eth', 1 - COUNT(rent_paid_eth) / CAST(COUNT(*) AS DOUBLE) FROM fx_vendor UNION ALL
    SELECT 'rollup_id', 1 - COUNT(rollup_id) / CAST(COUNT(*) AS DOUBLE) FROM fx_vendor)""", "fx_vendor"))
def q17(spark, d):
    return CQ.brief(Q.missing_share(PQ.vendor(spark, d), ["fees_eth", "rent_paid_eth", "rollup_id"]))


# ---- reconciliation -----------------------------------------------------------------------------

PAIRS = ("pairs_", f"""SELECT COALESCE(a.month_utc, b.month_utc) AS month_utc, COALESCE(a.rollup_id, b.rollup_id) AS rollup_id,
  a.v AS first_value, b.v AS second_value FROM
  (SELECT {month('date_utc')} AS month_utc, rollup_id, CAST(SUM(CAST(rent_paid_eth AS {DEC})) AS DOUBLE) AS v FROM fx_panel GROUP BY 1, 2) a
  FULL OUTER JOIN (SELECT {month('date_utc')} AS month_utc, rollup_id, CAST(SUM(CAST(total_cost_eth AS DECIMAL(38,8))) AS DOUBLE) AS v FROM costs2 WHERE rollup_id IS NOT NULL
  GROUP BY 1, 2) b ON a.month_utc = b.month_utc AND a.rollup_id = b.rollup_id""")


def pairs(spark, d):
    return R.monthly_by_source(
        fx.panel(spark, d), PQ.costs2(spark, d).filter("rollup_id IS NOT NULL"), "rent_paid_eth", "total_cost_eth")


@query("j11_monthly_cross_source", sql(
    "SELECT month_utc, rollup_id, first_value, second_value FROM pairs_",
    "fx_panel", "fx_costs", extra=(COSTS2, PAIRS)), dates=("month_utc",))
def j11(spark, d):
    return pairs(spark, d)


DIFF = "ABS(second_value - first_value) / NULLIF(ABS(first_value), 0)"


@query("q9_monthly_reconciliation", sql(
    f"""SELECT 'reconcile' AS "check", CAST(month_utc AS VARCHAR) || '|' || rollup_id AS key, ROUND({DIFF}, 8) AS observed,
    {banded(DIFF, 0.05, 0.10)} AS status, CASE WHEN second_value IS NULL THEN 'value_missing' WHEN first_value IS NULL
    THEN 'base_missing' END AS detail FROM pairs_""", "fx_panel", "fx_costs", extra=(COSTS2, PAIRS)))
def q9(spark, d):
    return R.reconcile_months(pairs(spark, d)).select("check", "key", F.round("observed", 8).alias("observed"), "status", "detail")


BANDS = ("bands_", f"""SELECT rollup_id, quantile_cont(diff, 0.05) AS p05, quantile_cont(diff, 0.5) AS p50, quantile_cont(diff, 0.95) AS p95,
  STDDEV_SAMP(diff) AS sd, COUNT(*) AS n_months FROM (SELECT rollup_id, (second_value - first_value) / NULLIF(ABS(first_value), 0) AS diff
  FROM pairs_) WHERE diff IS NOT NULL GROUP BY 1""")


@query("a18_error_bands", sql(
    """SELECT rollup_id, ROUND(p05, 8) AS p05, ROUND(p50, 8) AS p50, ROUND(p95, 8) AS p95, ROUND(sd, 8) AS sd, n_months FROM bands_""",
    "fx_panel", "fx_costs", extra=(COSTS2, PAIRS, BANDS)))
def a18(spark, d):
    b = R.error_bands(pairs(spark, d))
    return b.withColumns({c: F.round(c, 8) for c in ("p05", "p50", "p95", "sd")})


@query("p23_trusted_series", sql(
    """SELECT rollup_id, ROUND(GREATEST(ABS(p05), ABS(p95)), 8) AS max_abs_band,
    CASE WHEN GREATEST(ABS(p05), ABS(p95)) <= 0.1 THEN 'vendor' ELSE 'onchain' END AS trusted FROM bands_""",
    "fx_panel", "fx_costs", extra=(COSTS2, PAIRS, BANDS)))
def p23(spark, d):
    t = R.trusted_series(R.error_bands(pairs(spark, d)))
    return t.select("rollup_id", F.round("max_abs_band", 8).alias("max_abs_band"), "trusted")


def market(spark, d):
    """Second source of blob gas: blob counts of type-3 transactions, by day."""
    tx = CQ.timed_tx(spark, d).filter("tx_type = 3")
    return tx.groupBy("date_utc").agg((F.sum("blob_count") * 131072).alias("blob_gas_used"))


@query("q10_blob_gas", sql(
    """SELECT 'blob_gas' AS "check", CAST(COALESCE(a.date_utc, b.date_utc) AS VARCHAR) AS key,
    ROUND(ABS(b.g - a.g) / NULLIF(ABS(a.g), 0), 9) AS observed,
    CASE WHEN ABS(b.g - a.g) / NULLIF(ABS(a.g), 0) <= 0.01 THEN 'pass' ELSE 'fail' END AS status FROM
    (SELECT date_utc, CAST(SUM(blob_gas_used) AS DOUBLE) AS g FROM fx_blocks GROUP BY 1) a FULL OUTER JOIN
    (SELECT x.date_utc, CAST(SUM(blob_count) * 131072 AS DOUBLE) AS g FROM fx_receipts r JOIN fx_blocks x
     ON x.block_number = r.block_number WHERE tx_type = 3 GROUP BY 1) b ON a.date_utc = b.date_utc""", "fx_receipts"))
def q10(spark, d):
    chain = K.blob_market_daily(fx.blocks(spark, d), CQ.timed_tx(spark, d))
    out = R.blob_gas_check(chain, market(spark, d))
    return out.select("check", "key", F.round("observed", 9).alias("observed"), "status")


MEANS = ("means_", f"""SELECT COALESCE(a.m, b.m) AS month_utc, a.v AS primary_value, b.v AS secondary_value FROM
  (SELECT {month('date_utc')} AS m, CAST(SUM(CAST(eth_usd_close AS {PQ.DEC})) AS DOUBLE) / COUNT(eth_usd_close) AS v FROM fx_prices GROUP BY 1) a FULL OUTER JOIN
  (SELECT {month('date_utc')} AS m, CAST(SUM(CAST(eth_usd_close AS {PQ.DEC})) AS DOUBLE) / COUNT(eth_usd_close) AS v FROM fx_prices2 GROUP BY 1) b ON a.m = b.m""")


@query("j15_input_sources", sql(
    f"""SELECT month_utc, {sig_sql('primary_value', 9)} AS primary_value, {sig_sql('secondary_value', 9)} AS secondary_value
    FROM means_""", "fx_prices", "fx_prices2", extra=(MEANS,)), dates=("month_utc",))
def j15(spark, d):
    m = R.monthly_averages(fx.prices(spark, d), fx.prices_secondary(spark, d), "eth_usd_close")
    return m.withColumns({c: sig(c, 9) for c in ("primary_value", "secondary_value")})


ISS = ("iss_", f"""SELECT COALESCE(a.m, b.m) AS month_utc, a.v AS primary_value, b.v AS secondary_value FROM
  (SELECT {month('date_utc')} AS m, AVG(issuance_eth) AS v FROM fx_issuance GROUP BY 1) a FULL OUTER JOIN
  (SELECT {month('date_utc')} AS m, AVG(issuance_eth) AS v FROM fx_issuance2 GROUP BY 1) b ON a.m = b.m""")
IDIFF = "ABS(secondary_value - primary_value) / NULLIF(ABS(primary_value), 0)"


@query("q11_price_and_issuance", sql(
    f"""SELECT 'price' AS "check", CAST(month_utc AS VARCHAR) AS key, ROUND({IDIFF}, 8) AS observed, {banded(IDIFF, 0.01, 0.02)} AS status
    FROM means_ UNION ALL SELECT 'issuance', CAST(month_utc AS VARCHAR), ROUND({IDIFF}, 8), {banded(IDIFF, 0.005, 0.01)} FROM iss_""",
    "fx_prices", "fx_prices2", "fx_issuance", "fx_issuance2", extra=(MEANS, ISS)))
def q11(spark, d):
    price = R.monthly_averages(fx.prices(spark, d), fx.prices_secondary(spark, d), "eth_usd_close")
    issued = R.monthly_averages(fx.issuance(spark, d), fx.issuance_secondary(spark, d), "issuance_eth")
    both = R.input_check(price, "price", C.PRICE_PASS, C.PRICE_WARN).unionByName(
        R.input_check(issued, "issuance", C.ISSUANCE_PASS, C.ISSUANCE_WARN))
    return both.select("check", "key", F.round("observed", 8).alias("observed"), "status")


@query("q21_top_rollup_fees", sql(
    f"""SELECT 'top_fees' AS "check", rollup_id AS key, ROUND(ABS(b - a) / a, 9) AS observed,
    {banded('ABS(b - a) / a', 0.05, 0.10)} AS status FROM (SELECT p.rollup_id, p.a, q.b FROM
    (SELECT rollup_id, CAST(SUM(CAST(l2_fees_eth AS {DEC})) AS DOUBLE) AS a FROM fx_panel GROUP BY 1) p JOIN
    (SELECT 'n' || CAST(s_nationkey AS VARCHAR) AS rollup_id, CAST(SUM(CAST(l_extendedprice * (1 - l_tax) AS DECIMAL(38,6))) AS DOUBLE) AS b
     FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) q ON p.rollup_id = q.rollup_id)
    WHERE rollup_id IN (SELECT rollup_id FROM (SELECT rollup_id, SUM(CAST(l2_fees_eth AS {DEC})) AS f FROM fx_panel
      WHERE date_utc > (SELECT MAX(date_utc) FROM fx_panel) - 30 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5))""", "fx_panel"))
def q21(spark, d):
    panel = fx.panel(spark, d)
    li, sup = fx.table(spark, d, "lineitem"), fx.table(spark, d, "supplier")
    independent = li.join(sup, li.l_suppkey == sup.s_suppkey).groupBy(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("rollup_id")
    ).agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_tax"))).cast("decimal(38,6)")).cast("double").alias("value"))
    ours = panel.groupBy("rollup_id").agg(M.exact_sum("l2_fees_eth").cast("double").alias("base"))
    both = ours.join(M.top_rollups(panel, 5).select("rollup_id"), "rollup_id", "left_semi").join(independent, "rollup_id")
    out = Q.difference_check(both, "top_fees", F.col("rollup_id"), "value", "base", C.RECONCILE_PASS, C.RECONCILE_WARN)
    return out.select("check", "key", F.round("observed", 9).alias("observed"), "status")


@query("q16_drift_alerts", sql(
    f"""SELECT 'origins_changed' AS "check", origin_key AS key, change AS detail FROM ({PQ.DIFF})
    UNION ALL SELECT 'attribution_coverage', CASE WHEN post_regime THEN 'post' ELSE 'pre' END, NULL FROM cover_
    WHERE coverage < CASE WHEN post_regime THEN 0.9 ELSE 0.8 END
    UNION ALL SELECT 'reconcile', CAST(month_utc AS VARCHAR) || '|' || rollup_id, CASE WHEN second_value IS NULL THEN 'value_missing'
    WHEN first_value IS NULL THEN 'base_missing' END FROM pairs_ WHERE NOT COALESCE({DIFF} <= 0.10, FALSE)""",
    "fx_metrics", "fx_tx_costs", "fx_costs", extra=(*PQ.SNAPS, CQ.COVER, COSTS2, PAIRS)))
def q16(spark, d):
    old, new = PQ.origin_snapshots(spark, d)
    target = Q.attribution_target(K.attribution_coverage(CQ.tx_costs(spark, d), REGIME_DATE))
    out = Q.alerts({"origins": S.catalog_diff(old, new, "origin_key")}, [target, R.reconcile_months(pairs(spark, d))])
    return out.select("check", "key", "detail")


@query("q_overall_verdict", sql(
    f"""SELECT COUNT(*) AS n_checks, CAST(COUNT(*) FILTER (WHERE s = 'fail') AS BIGINT) AS n_fail,
    CAST(COUNT(*) FILTER (WHERE s = 'warn') AS BIGINT) AS n_warn, BOOL_AND(s <> 'fail') AS ok FROM (
    SELECT {status('coverage >= 0.95')} AS s FROM coverage_ UNION ALL SELECT {banded(DIFF, 0.05, 0.10)} FROM pairs_)""",
    "fx_vendor", "fx_universe", "fx_panel", "fx_costs", extra=(ROWS, SPINE, COVERAGE, COSTS2, PAIRS)))
def verdict(spark, d):
    cover = Q.coverage_threshold(PQ.vendor_coverage(spark, d), "rollup_id", "vendor_coverage", C.COVERAGE_VENDOR)
    return Q.overall(cover.unionByName(R.reconcile_months(pairs(spark, d))))


# ---- digests and lineage ------------------------------------------------------------------------


@query("q18_rebuild_digest", sql(
    """SELECT 'rebuild' AS "check", 'table' AS key, CAST(COUNT(*) AS DOUBLE) AS observed, CAST(COUNT(*) AS DOUBLE) AS threshold,
    'pass' AS status FROM fx_panel""", "fx_panel"))
def q18(spark, d):
    p = fx.panel(spark, d)
    again = p.repartition(7, "rollup_id").select(*reversed(p.columns))
    return Q.compare_builds(p, again).drop("detail")


EDGES = ("edges_", """SELECT 'order-' || CAST(l_orderkey AS VARCHAR) AS artifact, 'part-' || CAST(l_partkey AS VARCHAR) AS input FROM lineitem
  UNION SELECT 'part-' || CAST(l_partkey AS VARCHAR), 'supplier-' || CAST(l_suppkey AS VARCHAR) FROM lineitem
  UNION SELECT 'supplier-' || CAST(s_suppkey AS VARCHAR), 'nation-' || CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION SELECT 'nation-' || CAST(n_nationkey AS VARCHAR), 'region-' || CAST(n_regionkey AS VARCHAR) FROM nation""")


def edges(spark, d):
    """Artifact -> input links: orders from parts, parts from suppliers, suppliers from nations, nations from regions."""

    def link(df, a, ka, b, kb):
        # Numbers are told apart before they become texts.
        return df.select(ka, kb).distinct().select(F.concat(F.lit(f"{a}-"), F.col(ka).cast("string")).alias("artifact"),
                                                   F.concat(F.lit(f"{b}-"), F.col(kb).cast("string")).alias("input"))

    li = fx.table(spark, d, "lineitem")
    return (
        link(li, "order", "l_orderkey", "part", "l_partkey")
        .unionByName(link(li, "part", "l_partkey", "supplier", "l_suppkey"))
        .unionByName(link(fx.table(spark, d, "supplier"), "supplier", "s_suppkey", "nation", "s_nationkey"))
        .unionByName(link(fx.table(spark, d, "nation"), "nation", "n_nationkey", "region", "n_regionkey"))
    )


@query("q19_lineage_closure", sql(
    """SELECT split_part(artifact, '-', 1) AS artifact_kind, split_part(input, '-', 1) AS input_kind, COUNT(*) AS n_links FROM (
    SELECT artifact, input FROM edges_ UNION SELECT a.artifact, b.input FROM edges_ a JOIN edges_ b ON a.input = b.artifact
    UNION SELECT a.artifact, c.input FROM edges_ a JOIN edges_ b ON a.input = b.artifact JOIN edges_ c ON b.input = c.artifact
    UNION SELECT a.artifact, e.input FROM edges_ a JOIN edges_ b ON a.input = b.artifact JOIN edges_ c ON b.input = c.artifact
      JOIN edges_ e ON c.input = e.artifact) GROUP BY 1, 2""", extra=(EDGES,)))
def q19(spark, d):
    c = Q.lineage_closure(edges(spark, d))
    kind = lambda name: F.substring_index(name, "-", 1)
    return c.groupBy(kind("artifact").alias("artifact_kind"), kind("input").alias("input_kind")).agg(
        F.count(F.lit(1)).alias("n_links"))


@query("q19_lineage_check", sql(
    """SELECT 'lineage' AS "check", artifact || '<-' || input AS key, 'unknown_input' AS detail FROM edges_ e
    LEFT JOIN known_ k ON k.known = e.input WHERE k.known IS NULL""",
    extra=(EDGES, ("known_", "SELECT DISTINCT artifact AS known FROM edges_"))))
def q19_check(spark, d):
    e = edges(spark, d)
    return Q.lineage_check(e, e).select("check", "key", "detail")


@query("q19_lineage_reach", sql(
    """SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS artifact, 'nation-' || CAST(c_nationkey AS VARCHAR) AS input, r.artifact IS NOT NULL AS reaches
    FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT DISTINCT a.artifact, c.input FROM edges_ a JOIN edges_ b ON a.input = b.artifact
      JOIN edges_ c ON b.input = c.artifact WHERE starts_with(a.artifact, 'order-')) r
    ON r.artifact = 'order-' || CAST(o_orderkey AS VARCHAR) AND r.input = 'nation-' || CAST(c_nationkey AS VARCHAR)""", extra=(EDGES,)))
def q19_reach(spark, d):
    """Whether any supplier of the parts of an order is of its customer's nation."""
    placed = fx.table(spark, d, "orders").join(fx.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    asked = placed.select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("artifact"),
                          F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("input"))
    return L.reaches(asked, edges(spark, d))
