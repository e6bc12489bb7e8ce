"""Queries of the vendor and panel family."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlelens import contracts as C
from settlelens.operators import metrics as M
from settlelens.operators import normalize as N
from settlelens.operators import sets as S
from settlelens.plans import fixtures as fx
from settlelens.plans.catalogue import query
from settlelens.plans.fixtures import REGIME_DATE, sql

KEYS = list(fx.METRIC_OF_EVENT.values())


def vendor(spark: SparkSession, d: str) -> DataFrame:
    u = fx.universe(spark, d)
    mapped = N.map_origins(fx.metrics(spark, d), u)
    wide = N.vendor_panel(mapped, KEYS).withColumn("txcount", F.floor("txcount").cast("bigint"))
    return wide.join(u.select("rollup_id", "in_scope", "start_date_utc", "end_date_utc"), "rollup_id")


def contract_rows(spark: SparkSession, d: str) -> DataFrame:
    return N.panel_rows(vendor(spark, d), "fees_eth", "rent_paid_eth").withColumnRenamed("fees_eth", "l2_fees_eth")


def costs2(spark: SparkSession, d: str) -> DataFrame:
    """Second-vendor costs by rollup."""
    n = fx.table(spark, d, "nation")
    k = F.col("n_nationkey").cast("string")
    slugs = n.select(F.concat(F.lit("slug-"), k).alias("slug"), F.concat(F.lit("n"), k).alias("rollup_id"))
    aliases = n.filter("n_nationkey % 5 = 0 AND n_nationkey <> 10").select(
        F.concat(F.lit("alias-"), k).alias("slug"), F.concat(F.lit("slug-"), k).alias("target")
    )
    aliases = aliases.select(F.col("slug").alias("alias"), F.col("target").alias("slug"))
    return N.map_slugs(N.drop_per_operation(fx.second_vendor_costs(spark, d)), slugs, aliases)


COSTS2 = ("costs2", """SELECT date_utc, CASE WHEN slug LIKE 'alias-%' AND slug <> 'alias-10' THEN replace(slug, 'alias-', 'slug-')
  ELSE slug END AS slug, CASE WHEN slug <> 'alias-10' THEN rollup_id END AS rollup_id, total_cost_eth
  FROM fx_costs WHERE unit <> 'per_user_op'""")

ROWS = ("rows_", "SELECT * FROM fx_vendor WHERE fees_eth IS NOT NULL AND rent_paid_eth IS NOT NULL")


# ---- projections and filters --------------------------------------------------------------------


@query("p1_clip_window", sql(
    "SELECT metric_key, origin_key, date_utc, value FROM fx_metrics "
    "WHERE date_utc BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'", "fx_metrics"), dates=("date_utc",))
def p1(spark, d):
    return N.clip_window(fx.metrics(spark, d), dt.date(2024, 1, 5), dt.date(2024, 1, 25))


@query("p3_usd_conversion", sql(
    """SELECT p.date_utc, rollup_id, eth_usd_close, l2_fees_eth * eth_usd_close AS l2_fees_usd,
    rent_paid_eth * eth_usd_close AS rent_paid_usd FROM fx_panel p LEFT JOIN fx_prices x ON p.date_utc = x.date_utc""",
    "fx_panel", "fx_prices"), dates=("date_utc",))
def p3(spark, d):
    out = N.to_usd(fx.panel(spark, d), fx.prices(spark, d),
                   {"l2_fees_eth": "l2_fees_usd", "rent_paid_eth": "rent_paid_usd"})
    return out.select("date_utc", "rollup_id", "eth_usd_close", "l2_fees_usd", "rent_paid_usd")


@query("p4_active_in_scope", sql(
    """SELECT date_utc, rollup_id, fees_eth, rent_paid_eth FROM fx_vendor WHERE in_scope
    AND date_utc >= start_date_utc AND (end_date_utc IS NULL OR date_utc <= end_date_utc)""", "fx_vendor"),
    dates=("date_utc",))
def p4(spark, d):
    v = vendor(spark, d).drop("in_scope", "start_date_utc", "end_date_utc")
    return N.active_in_scope(v, fx.universe(spark, d)).select("date_utc", "rollup_id", "fees_eth", "rent_paid_eth")


@query("p5_unknown_origins", sql(
    """SELECT m.origin_key, u.rollup_id, COALESCE(u.in_scope, FALSE) AS in_scope, COUNT(*) AS n_rows
    FROM fx_metrics m LEFT JOIN (SELECT * FROM fx_universe WHERE category = 'zk') u ON m.origin_key = u.origin_key
    GROUP BY 1, 2, 3""", "fx_metrics", "fx_universe"))
def p5(spark, d):
    reviewed = fx.universe(spark, d).filter("category = 'zk'")
    return N.map_origins(fx.metrics(spark, d), reviewed).groupBy("origin_key", "rollup_id", "in_scope").agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("p7_panel_rows", sql(
    "SELECT date_utc, rollup_id, fees_eth AS l2_fees_eth, rent_paid_eth, profit_eth, txcount FROM rows_",
    "fx_vendor", extra=(ROWS,)), dates=("date_utc",))
def p7(spark, d):
    return contract_rows(spark, d).select("date_utc", "rollup_id", "l2_fees_eth", "rent_paid_eth", "profit_eth", "txcount")


@query("p8_missing_flags", sql(
    """SELECT date_utc, rollup_id, fees_eth IS NULL AS fees_eth_missing, rent_paid_eth IS NULL AS rent_paid_eth_missing,
    profit_eth IS NULL AS profit_eth_missing FROM fx_vendor""", "fx_vendor"), dates=("date_utc",))
def p8(spark, d):
    flags = ["fees_eth", "rent_paid_eth", "profit_eth"]
    return N.missing_flags(vendor(spark, d), flags).select("date_utc", "rollup_id", *[f"{c}_missing" for c in flags])


@query("p9_rent_above_fees", sql(
    "SELECT date_utc, rollup_id, rent_paid_eth > fees_eth AS rent_above_fees FROM rows_", "fx_vendor", extra=(ROWS,)),
    dates=("date_utc",))
def p9(spark, d):
    return contract_rows(spark, d).select(
        "date_utc", "rollup_id", (F.col("rent_paid_eth") > F.col("l2_fees_eth")).alias("rent_above_fees"))


def text_panel(spark, d):
    """The panel as text cells, some of them broken."""
    return fx.panel(spark, d).select(
        F.col("date_utc").cast("string").alias("date_utc"),
        "rollup_id",
        F.when(F.col("txcount") % 11 == 0, "n/a").otherwise(F.col("l2_fees_eth").cast("string")).alias("l2_fees_eth"),
        F.col("rent_paid_eth").cast("string").alias("rent_paid_eth"),
        F.when(F.col("txcount") % 7 == 0, "12d").otherwise(F.col("txcount").cast("string")).alias("txcount"),
    )


@query("p17_contract_cast", sql(
    """SELECT date_utc, rollup_id, CASE WHEN txcount % 11 <> 0 THEN l2_fees_eth END AS l2_fees_eth, rent_paid_eth,
    CAST(NULL AS DOUBLE) AS profit_eth, CASE WHEN txcount % 7 <> 0 THEN txcount END AS txcount FROM fx_panel""",
    "fx_panel"), dates=("date_utc",))
def p17(spark, d):
    return N.to_contract(text_panel(spark, d), C.PANEL_CONTRACT)


@query("p19_provenance", sql(
    """SELECT metric_key, origin_key, date_utc, value, 'vendor-a' AS source, '2024-02-01' AS run_date,
    'v1' AS registry_version FROM fx_metrics""", "fx_metrics"), dates=("date_utc",))
def p19(spark, d):
    return N.with_provenance(fx.metrics(spark, d), source="vendor-a", run_date="2024-02-01", registry_version="v1")


@query("p20_drop_per_operation", sql(
    "SELECT date_utc, slug, total_cost_eth FROM fx_costs WHERE unit <> 'per_user_op'", "fx_costs"), dates=("date_utc",))
def p20(spark, d):
    return N.drop_per_operation(fx.second_vendor_costs(spark, d)).select("date_utc", "slug", "total_cost_eth")


@query("p21_units", sql(
    """SELECT metric_key, origin_key, date_utc, value, CASE metric_key WHEN 'txcount' THEN 'count' WHEN 'fees_usd'
    THEN 'unknown' ELSE 'ETH' END AS unit FROM fx_metrics""", "fx_metrics"), dates=("date_utc",))
def p21(spark, d):
    m = fx.metrics(spark, d)
    catalog = m.select("metric_key").distinct().filter("metric_key <> 'fees_usd'").withColumn(
        "unit", F.when(F.col("metric_key") == "txcount", "count").otherwise("ETH"))
    return N.add_units(m, catalog).select("metric_key", "origin_key", "date_utc", "value", "unit")


# ---- joins --------------------------------------------------------------------------------------


@query("j1_origin_to_rollup", sql(
    """SELECT m.origin_key, m.metric_key, m.date_utc, m.value, u.rollup_id, COALESCE(u.in_scope, FALSE) AS in_scope
    FROM fx_metrics m LEFT JOIN fx_universe u ON m.origin_key = u.origin_key""", "fx_metrics", "fx_universe"),
    dates=("date_utc",))
def j1(spark, d):
    return N.map_origins(fx.metrics(spark, d), fx.universe(spark, d))


@query("j2_slug_to_rollup", sql("SELECT date_utc, slug, rollup_id, total_cost_eth FROM costs2", "fx_costs",
                                extra=(COSTS2,)), dates=("date_utc",))
def j2(spark, d):
    return costs2(spark, d).select("date_utc", "slug", "rollup_id", "total_cost_eth")


@query("j9_macro_inputs", sql(
    """SELECT p.date_utc, rollup_id, eth_usd_close, issuance_eth FROM fx_panel p
    LEFT JOIN fx_prices x ON p.date_utc = x.date_utc LEFT JOIN fx_issuance i ON p.date_utc = i.date_utc""",
    "fx_panel", "fx_prices", "fx_issuance"), dates=("date_utc",))
def j9(spark, d):
    return M.add_macro(fx.panel(spark, d), fx.prices(spark, d), fx.issuance(spark, d)).select(
        "date_utc", "rollup_id", "eth_usd_close", "issuance_eth")


@query("j13_calendar_spine", sql(
    """SELECT rollup_id, CAST(UNNEST(generate_series(start_date_utc, COALESCE(end_date_utc, DATE '2024-01-31'),
    INTERVAL 1 DAY)) AS DATE) AS date_utc FROM fx_universe""", "fx_universe"), dates=("date_utc",))
def j13(spark, d):
    u = fx.universe(spark, d)
    return M.spine(u, "start_date_utc", F.coalesce("end_date_utc", F.lit(dt.date(2024, 1, 31)))).select(
        "rollup_id", "date_utc")


SNAPS = (
    ("old_", "SELECT DISTINCT origin_key FROM fx_metrics WHERE date_utc = DATE '2024-01-02' AND metric_key = 'fees_eth'"),
    ("new_", "SELECT DISTINCT origin_key FROM fx_metrics WHERE date_utc = DATE '2024-01-29' AND metric_key = 'fees_eth'"),
)


def origin_snapshots(spark, d):
    m = fx.metrics(spark, d).filter("metric_key = 'fees_eth'")
    pick = lambda day: m.filter(F.col("date_utc") == F.lit(day)).select("origin_key")
    return pick(dt.date(2024, 1, 2)), pick(dt.date(2024, 1, 29))


DIFF = """SELECT origin_key, 'added' AS change FROM new_ WHERE origin_key NOT IN (SELECT origin_key FROM old_)
UNION ALL SELECT origin_key, 'removed' AS change FROM old_ WHERE origin_key NOT IN (SELECT origin_key FROM new_)"""


@query("j14_catalog_diff", sql(DIFF, "fx_metrics", extra=SNAPS))
def j14(spark, d):
    old, new = origin_snapshots(spark, d)
    return S.catalog_diff(old, new, "origin_key").select("origin_key", "change")


# ---- aggregates ---------------------------------------------------------------------------------

DEC = "DECIMAL(38,6)"


@query("a1_str_daily", sql(
    f"""SELECT date_utc, CAST(SUM(CAST(rent_paid_eth AS {DEC})) AS DOUBLE) AS rent_paid_eth,
    CAST(SUM(CAST(l2_fees_eth AS {DEC})) AS DOUBLE) AS l2_fees_eth, COUNT(*) AS n_rollups,
    CASE WHEN SUM(l2_fees_eth) = 0 THEN 'NaN'::DOUBLE ELSE CAST(SUM(CAST(rent_paid_eth AS {DEC})) AS DOUBLE)
      / CAST(SUM(CAST(l2_fees_eth AS {DEC})) AS DOUBLE) END AS str FROM fx_panel GROUP BY 1""", "fx_panel"),
    dates=("date_utc",))
def a1(spark, d):
    return M.str_daily(fx.panel(spark, d))


@query("a1_str_daily_vendor", sql(
    """SELECT date_utc, ROUND(SUM(rent_paid_eth), 4) AS rent_paid_eth, ROUND(SUM(fees_eth), 4) AS l2_fees_eth,
    COUNT(*) AS n_rollups, ROUND(SUM(rent_paid_eth) / SUM(fees_eth), 9) AS str FROM rows_
    WHERE in_scope AND date_utc >= start_date_utc AND (end_date_utc IS NULL OR date_utc <= end_date_utc) GROUP BY 1""",
    "fx_vendor", extra=(ROWS,)), dates=("date_utc",))
def a1_vendor(spark, d):
    rows = contract_rows(spark, d).drop("in_scope", "start_date_utc", "end_date_utc")
    daily = M.str_daily(N.active_in_scope(rows, fx.universe(spark, d)))
    return daily.select("date_utc", F.round("rent_paid_eth", 4).alias("rent_paid_eth"),
                        F.round("l2_fees_eth", 4).alias("l2_fees_eth"), "n_rollups", F.round("str", 9).alias("str"))


@query("a2_str_by_rollup", sql(
    """SELECT date_utc, rollup_id, CASE WHEN fees_eth = 0 THEN 'NaN'::DOUBLE ELSE rent_paid_eth / fees_eth END AS str
    FROM rows_""", "fx_vendor", extra=(ROWS,)), dates=("date_utc",))
def a2(spark, d):
    return M.str_by_rollup(contract_rows(spark, d))


@query("a3_grouping_sets", sql(
    f"""SELECT date_utc, rollup_id, CAST(SUM(CAST(l2_fees_eth AS {DEC})) AS DOUBLE) AS l2_fees_eth,
    CAST(SUM(CAST(rent_paid_eth AS {DEC})) AS DOUBLE) AS rent_paid_eth, GROUPING(rollup_id) = 1 AS is_total, ROUND(SUM(rent_paid_eth) / SUM(l2_fees_eth), 9) AS str FROM fx_panel
    GROUP BY GROUPING SETS ((date_utc, rollup_id), (date_utc))""", "fx_panel"), dates=("date_utc",))
def a3(spark, d):
    return M.rollup_and_total(fx.panel(spark, d)).withColumn("str", F.round("str", 9))


@query("a9_metric_pivot", sql(
    "SELECT date_utc, rollup_id, fees_eth, fees_usd, rent_paid_eth, profit_eth, txcount FROM fx_vendor", "fx_vendor"),
    dates=("date_utc",))
def a9(spark, d):
    return vendor(spark, d).select("date_utc", "rollup_id", "fees_eth", "fees_usd", "rent_paid_eth", "profit_eth", "txcount")


@query("a10_monthly_totals", sql(
    f"""SELECT CAST(date_trunc('month', date_utc) AS DATE) AS month_utc, rollup_id,
    CAST(SUM(CAST(l2_fees_eth AS {DEC})) AS DOUBLE) AS l2_fees_eth,
    CAST(SUM(CAST(rent_paid_eth AS {DEC})) AS DOUBLE) AS rent_paid_eth FROM fx_panel GROUP BY 1, 2""", "fx_panel"), dates=("month_utc",))
def a10(spark, d):
    return M.monthly_totals(fx.panel(spark, d), ["l2_fees_eth", "rent_paid_eth"])


@query("a11_profit_margin", sql(
    """SELECT date_utc, rollup_id, l2_fees_eth - rent_paid_eth AS l2_profit_eth,
    CASE WHEN l2_fees_eth = 0 THEN 'NaN'::DOUBLE ELSE (l2_fees_eth - rent_paid_eth) / l2_fees_eth END AS l2_profit_margin
    FROM fx_panel""", "fx_panel"), dates=("date_utc",))
def a11(spark, d):
    return M.profit_margin(fx.panel(spark, d)).select("date_utc", "rollup_id", "l2_profit_eth", "l2_profit_margin")


SPINE = ("spine_", """SELECT rollup_id, CAST(UNNEST(generate_series(start_date_utc, COALESCE(end_date_utc,
  DATE '2024-01-30'), INTERVAL 1 DAY)) AS DATE) AS date_utc FROM fx_universe WHERE in_scope""")
COVERAGE = ("coverage_", """SELECT s.rollup_id, COUNT(*) AS expected_days, COUNT(r.rollup_id) AS observed_days,
  COUNT(r.rollup_id) / CAST(COUNT(*) AS DOUBLE) AS coverage FROM spine_ s LEFT JOIN rows_ r
  ON s.rollup_id = r.rollup_id AND s.date_utc = r.date_utc GROUP BY 1""")


def vendor_coverage(spark, d):
    u = fx.universe(spark, d).filter("in_scope")
    spine = M.spine(u, "start_date_utc", F.coalesce("end_date_utc", F.lit(dt.date(2024, 1, 30)))).select(
        "rollup_id", "date_utc")
    return M.coverage(spine, contract_rows(spark, d), ["rollup_id", "date_utc"])


@query("a15_coverage", sql("SELECT * FROM coverage_", "fx_vendor", "fx_universe", extra=(ROWS, SPINE, COVERAGE)))
def a15(spark, d):
    return vendor_coverage(spark, d)


@query("a19_nonzero_days", sql(
    """SELECT COUNT(*) AS n_days, CAST(COUNT(*) FILTER (WHERE fees <> 0) AS BIGINT) AS n_nonzero_days FROM
    (SELECT date_utc, SUM(fees_eth) AS fees FROM rows_ GROUP BY 1)""", "fx_vendor", extra=(ROWS,)))
def a19(spark, d):
    return M.nonzero_denominator_days(contract_rows(spark, d))


@query("a20_duplicate_keys", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, COUNT(*) AS n_rows FROM lineitem
GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def a20(spark, d):
    return M.duplicate_keys(fx.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a21_distinct_stitch", sql(
    """SELECT DISTINCT rollup_id, date_utc FROM (SELECT rollup_id, date_utc FROM fx_vendor WHERE date_utc <= DATE '2024-01-20'
    UNION ALL SELECT rollup_id, date_utc FROM fx_vendor WHERE date_utc >= DATE '2024-01-11')""", "fx_vendor"),
    dates=("date_utc",))
def a21(spark, d):
    v = vendor(spark, d).select("rollup_id", "date_utc")
    early = v.filter(F.col("date_utc") <= F.lit(dt.date(2024, 1, 20)))
    late = v.filter(F.col("date_utc") >= F.lit(dt.date(2024, 1, 11)))
    return early.unionByName(late).dropDuplicates(["rollup_id", "date_utc"])


@query("a22_level_shift", sql(
    f"""SELECT series_id, t >= datediff('day', DATE '1970-01-01', DATE '{REGIME_DATE}') AS post_regime,
    ROUND(AVG(y), 9) AS mean_value, ROUND(STDDEV_SAMP(y), 9) AS sd_value, COUNT(*) AS n_days
    FROM fx_series WHERE series_id = 'all' GROUP BY 1, 2""", "fx_series"))
def a22(spark, d):
    s = M.str_daily(fx.panel(spark, d))
    return M.level_shift(s, "str", REGIME_DATE).select(
        F.lit("all").alias("series_id"), "post_regime", F.round("mean_value", 9).alias("mean_value"),
        F.round("sd_value", 9).alias("sd_value"), "n_days")


@query("a23_rent_levels", sql(
    f"""SELECT date_utc, CAST(SUM(CAST(rent_paid_eth AS {DEC})) AS DOUBLE) AS rent_paid_eth, CAST(SUM(txcount) AS BIGINT) AS txcount,
    CAST(SUM(CAST(rent_paid_eth AS {DEC})) AS DOUBLE) / CAST(SUM(txcount) AS DOUBLE) AS rent_per_tx FROM fx_panel GROUP BY 1""",
    "fx_panel"), dates=("date_utc",))
def a23(spark, d):
    return M.rent_levels(fx.panel(spark, d))


# ---- windows, ranking ---------------------------------------------------------------------------


@query("w1_smoothing", sql(
    """SELECT series_id, t, ROUND(AVG(y) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 6 PRECEDING AND CURRENT ROW), 9)
    AS mean_7d, ROUND(AVG(y) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 29 PRECEDING AND CURRENT ROW), 9)
    AS mean_30d FROM fx_series""", "fx_series"))
def w1(spark, d):
    return M.smoothed(fx.series(spark, d), "y").select(
        "series_id", "t", F.round("mean_7d", 9).alias("mean_7d"), F.round("mean_30d", 9).alias("mean_30d"))


@query("w3_missing_day_runs", sql(
    """SELECT rollup_id, date_utc + 1 AS run_start, next_day - 1 AS run_end, CAST(next_day - date_utc - 1 AS BIGINT) AS n_days
    FROM (SELECT rollup_id, date_utc, LEAD(date_utc) OVER (PARTITION BY rollup_id ORDER BY date_utc) AS next_day FROM fx_panel)
    WHERE next_day - date_utc > 3""", "fx_panel"), dates=("run_start", "run_end"))
def w3(spark, d):
    return M.missing_day_runs(fx.panel(spark, d), keys=("rollup_id",))


def event_versions(spark, d):
    return fx.table(spark, d, "events").select(
        F.expr("CASE event_type " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in fx.METRIC_OF_EVENT.items()) + " END").alias(
            "metric_key"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("origin_key"),
        F.to_date("ts").alias("date_utc"),
        F.col("event_id").alias("version"),
        "value",
    )


VERSIONS = ("versions_", "SELECT CASE event_type " + " ".join(
    f"WHEN '{e}' THEN '{m}'" for e, m in fx.METRIC_OF_EVENT.items()) +
    " END AS metric_key, 'u' || CAST(user_id AS VARCHAR) AS origin_key, CAST(ts AS DATE) AS date_utc, "
    "event_id AS version, value FROM events")
CELL = ["metric_key", "origin_key", "date_utc"]


@query("w5_latest_version", sql(
    """SELECT metric_key, origin_key, date_utc, MAX(version) AS version, arg_max(value, version) AS value
    FROM versions_ GROUP BY 1, 2, 3""", extra=(VERSIONS,)), dates=("date_utc",))
def w5(spark, d):
    return M.latest_version(event_versions(spark, d), CELL, "version")


@query("w7_rank_rollups", sql(
    f"""SELECT rollup_id, fees AS l2_fees_eth, CAST(RANK() OVER (ORDER BY fees DESC) AS BIGINT) AS fee_rank FROM
    (SELECT rollup_id, CAST(SUM(CAST(l2_fees_eth AS {DEC})) AS DOUBLE) AS fees FROM fx_panel
    WHERE date_utc > (SELECT MAX(date_utc) FROM fx_panel) - 30 GROUP BY 1)""", "fx_panel"))
def w7(spark, d):
    return M.rank_rollups(fx.panel(spark, d))


@query("w11_revisions", sql(
    """SELECT metric_key, origin_key, date_utc, version, value, previous_value, previous_version FROM (SELECT *,
    LAG(value) OVER w AS previous_value, LAG(version) OVER w AS previous_version FROM versions_
    WINDOW w AS (PARTITION BY metric_key, origin_key, date_utc ORDER BY version))
    WHERE previous_version IS NOT NULL AND value IS DISTINCT FROM previous_value""", extra=(VERSIONS,)), dates=("date_utc",))
def w11(spark, d):
    return M.revisions(event_versions(spark, d), CELL, "version", "value")


def _top_sql(n: int) -> str:
    return sql(
        f"""SELECT rollup_id, CAST(SUM(CAST(l2_fees_eth AS {DEC})) AS DOUBLE) AS l2_fees_eth FROM fx_panel
        WHERE date_utc > (SELECT MAX(date_utc) FROM fx_panel) - 30 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n}""", "fx_panel")


@query("t1_top5_rollups", _top_sql(5))
def t1(spark, d):
    return M.top_rollups(fx.panel(spark, d), 5)


@query("t2_top10_rollups", _top_sql(10))
def t2(spark, d):
    return M.top_rollups(fx.panel(spark, d), 10)


# ---- set operations -----------------------------------------------------------------------------


@query("u1_key_changes", sql(DIFF, "fx_metrics", extra=SNAPS))
def u1(spark, d):
    old, new = origin_snapshots(spark, d)
    return S.row_changes(old, new)


@query("u2_stack_sources", sql(
    """SELECT date_utc, rollup_id, rent_paid_eth AS value, CAST(NULL AS VARCHAR) AS slug, 'vendor-a' AS source FROM fx_panel
    UNION ALL SELECT date_utc, rollup_id, total_cost_eth, slug, 'vendor-b' FROM costs2""", "fx_panel", "fx_costs",
    extra=(COSTS2,)), dates=("date_utc",))
def u2(spark, d):
    return S.stack_sources({
        "vendor-a": fx.panel(spark, d).select("date_utc", "rollup_id", F.col("rent_paid_eth").alias("value")),
        "vendor-b": costs2(spark, d).select("date_utc", "rollup_id", F.col("total_cost_eth").alias("value"), "slug"),
    })


@query("u3_stitch_windows", sql(
    """SELECT rollup_id, date_utc, CASE WHEN date_utc >= DATE '2024-01-11' THEN 2 ELSE 1 END::BIGINT AS pull, fees_eth
    FROM fx_vendor""", "fx_vendor"), dates=("date_utc",))
def u3(spark, d):
    v = vendor(spark, d)

    def pull(no, cond):
        return v.filter(cond).select("rollup_id", "date_utc", F.lit(no).cast("bigint").alias("pull"), "fees_eth")

    day = F.col("date_utc")
    return S.stitch_windows(
        [pull(1, day <= F.lit(dt.date(2024, 1, 20))), pull(2, day >= F.lit(dt.date(2024, 1, 11)))],
        ["rollup_id", "date_utc"], "pull")


@query("u4_domain_mismatches", sql(
    """SELECT 'date_utc' AS domain, CAST(date_utc AS VARCHAR) AS key_value, 'left_only' AS side FROM
    (SELECT DISTINCT date_utc FROM fx_panel EXCEPT SELECT date_utc FROM fx_prices)
    UNION ALL SELECT 'date_utc', CAST(date_utc AS VARCHAR), 'right_only' FROM
    (SELECT date_utc FROM fx_prices EXCEPT SELECT DISTINCT date_utc FROM fx_panel)""", "fx_panel", "fx_prices"))
def u4(spark, d):
    return S.domain_mismatches(fx.panel(spark, d), fx.prices(spark, d), "date_utc")


@query("u5_universe_agreement", sql(
    """SELECT rollup_id, CASE WHEN a AND b THEN 'both' WHEN a THEN 'first_only' ELSE 'second_only' END AS status FROM
    (SELECT rollup_id, BOOL_OR(a) AS a, BOOL_OR(b) AS b FROM (SELECT rollup_id, TRUE AS a, FALSE AS b FROM fx_panel
    UNION ALL SELECT rollup_id, FALSE, TRUE FROM costs2 WHERE rollup_id IS NOT NULL) GROUP BY 1)""",
    "fx_panel", "fx_costs", extra=(COSTS2,)))
def u5(spark, d):
    return S.universe_agreement(fx.panel(spark, d), costs2(spark, d).filter("rollup_id IS NOT NULL"), "rollup_id")
