"""Queries of statistics, the counterfactual and chart tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from settlelens.functions import columns as X
from settlelens.operators import costs as K
from settlelens.operators import counterfactual as CF
from settlelens.operators import metrics as M
from settlelens.operators import stats as ST
from settlelens.plans import chain_queries as CQ
from settlelens.plans import fixtures as fx
from settlelens.plans import panel_queries as PQ
from settlelens.plans.catalogue import query, sig, sig_sql
from settlelens.plans.fixtures import REGIME_DATE, sql

BREAK = ST.day(REGIME_DATE)
LAGS = 7
NAMED = "rollup_id NOT IN ('other', 'unattributed_rollup_like')"


def sigs(df, names, digits=6):
    return df.withColumns({c: sig(c, digits) for c in names})


# ---- trend --------------------------------------------------------------------------------------

FIT = ("fit_", """SELECT series_id, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, regr_r2(y, t) AS r2, COUNT(*) AS n,
  AVG(t) AS t0, AVG(y) AS y0 FROM fx_series GROUP BY 1""")


@query("x1_linear_trend", sql(
    f"""SELECT series_id, {sig_sql('slope')} AS slope, {sig_sql('intercept')} AS intercept, {sig_sql('r2')} AS r2, n FROM fit_""",
    "fx_series", extra=(FIT,)))
def x1(spark, d):
    return sigs(ST.linear_trend(fx.series(spark, d)), ["slope", "intercept", "r2"])


RES = ("res_", """SELECT s.series_id, s.t, f.slope, f.n, f.t0, s.t - f.t0 AS x, s.y - f.y0 - f.slope * (s.t - f.t0) AS e
  FROM fx_series s JOIN fit_ f ON s.series_id = f.series_id""")
NUM = ("num_", "SELECT *, x * e AS u, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY t) AS i FROM res_")
LAGGED = ("lagged_", f"""SELECT a.series_id, l.l AS lag, SUM(a.e * b.e) AS ee, SUM(a.u * b.u) AS uu,
  SUM(CASE WHEN l.l = 0 THEN a.u * b.e ELSE a.u * b.e + a.e * b.u END) AS ue
  FROM num_ a CROSS JOIN (SELECT UNNEST(generate_series(0, {LAGS})) AS l) l
  JOIN num_ b ON b.series_id = a.series_id AND b.i = a.i - l.l GROUP BY 1, 2""")


@query("w9_lagged_products", sql(
    f"""SELECT series_id, {sig_sql('MAX(CASE WHEN lag = 0 THEN ee END)', 5)} AS g0_ee,
    ROUND(MAX(CASE WHEN lag = 1 THEN ee END), 7) AS g1_ee, ROUND(MAX(CASE WHEN lag = 7 THEN ee END), 7) AS g7_ee,
    {sig_sql('MAX(CASE WHEN lag = 0 THEN uu END)', 5)} AS g0_uu FROM lagged_ GROUP BY 1""",
    "fx_series", extra=(FIT, RES, NUM, LAGGED)))
def w9(spark, d):
    g = ST.lagged_products(ST.residuals(fx.series(spark, d)), LAGS)
    return g.select("series_id", sig("g0_ee", 5).alias("g0_ee"), F.round("g1_ee", 7).alias("g1_ee"),
                    F.round("g7_ee", 7).alias("g7_ee"), sig("g0_uu", 5).alias("g0_uu"))


@query("x2_newey_west", sql(
    f"""SELECT series_id, n, {sig_sql('slope', 5)} AS slope, {sig_sql('SQRT(uu) / sxx', 5)} AS slope_se,
    {sig_sql('SQRT(ee / (n * n) - 2 * t0 * ue / (sxx * n) + t0 * t0 * uu / (sxx * sxx))', 5)} AS intercept_se,
    {sig_sql('slope / (SQRT(uu) / sxx)', 5)} AS t_stat FROM (SELECT l.series_id, MAX(f.n) AS n, MAX(f.slope) AS slope, MAX(f.t0) AS t0, MAX(x.sxx) AS sxx,
    SUM((CASE WHEN lag = 0 THEN 1 ELSE 2 END) * (1 - lag / {LAGS + 1}.0) * uu) AS uu,
    SUM((CASE WHEN lag = 0 THEN 1 ELSE 2 END) * (1 - lag / {LAGS + 1}.0) * ee) AS ee,
    SUM((1 - lag / {LAGS + 1}.0) * ue) AS ue FROM lagged_ l JOIN fit_ f ON f.series_id = l.series_id
    JOIN (SELECT series_id, SUM(x * x) AS sxx FROM res_ GROUP BY 1) x ON x.series_id = l.series_id GROUP BY 1)""",
    "fx_series", extra=(FIT, RES, NUM, LAGGED)))
def x2(spark, d):
    return sigs(ST.newey_west(fx.series(spark, d), LAGS), ["slope", "slope_se", "intercept_se", "t_stat"], 5)


PAIR_COUNTS = ("pair_counts_", """SELECT a.series_id, CAST(SUM(CASE WHEN b.y > a.y THEN 1 ELSE 0 END) AS BIGINT) AS rising,
  CAST(SUM(CASE WHEN b.y < a.y THEN 1 ELSE 0 END) AS BIGINT) AS falling, CAST(SUM(CASE WHEN b.y = a.y THEN 1 ELSE 0 END) AS BIGINT) AS tied
  FROM fx_series a JOIN fx_series b ON a.series_id = b.series_id AND a.t < b.t GROUP BY 1""")


@query("j16_pair_signs", sql(
    """SELECT f.series_id, f.n, rising, falling, tied FROM pair_counts_ p JOIN fit_ f ON f.series_id = p.series_id""",
    "fx_series", extra=(FIT, PAIR_COUNTS)))
def j16(spark, d):
    return ST.pair_signs(fx.series(spark, d))


@query("x3_mann_kendall", sql(
    """SELECT f.series_id, f.n, rising - falling AS s, ROUND(var, 3) AS var_s, ROUND(CASE WHEN rising = falling THEN 0
    ELSE (rising - falling - SIGN(rising - falling)) / SQRT(var) END, 9) AS z FROM pair_counts_ p JOIN
    (SELECT g.series_id, MAX(g.n) AS n, (MAX(g.n) * (MAX(g.n) - 1) * (2 * MAX(g.n) + 5) - SUM(k.m * (k.m - 1) * (2 * k.m + 5))) / 18.0::DOUBLE AS var
     FROM fit_ g JOIN (SELECT series_id, y, COUNT(*) AS m FROM fx_series GROUP BY 1, 2) k ON k.series_id = g.series_id GROUP BY 1) f
    ON f.series_id = p.series_id""", "fx_series", extra=(FIT, PAIR_COUNTS)))
def x3(spark, d):
    m = ST.mann_kendall(fx.series(spark, d))
    return m.select("series_id", "n", "s", F.round("var_s", 3).alias("var_s"), F.round("z", 9).alias("z"))


# ---- breaks -------------------------------------------------------------------------------------


def _ssr(cond: str) -> str:
    y, t = f"CASE WHEN {cond} THEN y END", f"CASE WHEN {cond} THEN t END"
    return f"regr_syy({y}, {t}) - regr_sxy({y}, {t}) * regr_sxy({y}, {t}) / NULLIF(regr_sxx({y}, {t}), 0)"


@query("x4_chow", sql(
    f"""SELECT series_id, n, n_before, n_after, {sig_sql('((a - b - c) / 2) / ((b + c) / (n - 4))', 5)} AS f_stat FROM
    (SELECT series_id, COUNT(*) AS n, CAST(COUNT(*) FILTER (WHERE t < {BREAK}) AS BIGINT) AS n_before,
    CAST(COUNT(*) FILTER (WHERE t >= {BREAK}) AS BIGINT) AS n_after, {_ssr('TRUE')} AS a, {_ssr(f't < {BREAK}')} AS b,
    {_ssr(f't >= {BREAK}')} AS c FROM fx_series GROUP BY 1)""", "fx_series"))
def x4(spark, d):
    return ST.chow(fx.series(spark, d), BREAK).select("series_id", "n", "n_before", "n_after", sig("f_stat", 5).alias("f_stat"))


PREFIX = ("prefix_", """SELECT series_id, t, i, n, SUM(c) OVER w AS s1, SUM(c * c) OVER w AS s2 FROM
  (SELECT s.series_id, s.t, s.y - f.y0 AS c, f.n, ROW_NUMBER() OVER (PARTITION BY s.series_id ORDER BY s.t) AS i
   FROM fx_series s JOIN fit_ f ON f.series_id = s.series_id)
  WINDOW w AS (PARTITION BY series_id ORDER BY t)""")
ONE_BREAK = ("one_", """SELECT p.series_id, lead_t AS break_t, p.s2 - p.s1 * p.s1 / p.i
  + (e.s2 - p.s2) - (e.s1 - p.s1) * (e.s1 - p.s1) / (p.n - p.i) AS ssr FROM
  (SELECT *, LEAD(t) OVER (PARTITION BY series_id ORDER BY t) AS lead_t FROM prefix_) p
  JOIN prefix_ e ON e.series_id = p.series_id AND e.i = e.n WHERE p.i >= 30 AND p.n - p.i >= 30""")
TWO_BREAKS = ("two_", """SELECT a.series_id, a.lead_t AS first_t, b.lead_t AS second_t, a.s2 - a.s1 * a.s1 / a.i
  + (b.s2 - a.s2) - (b.s1 - a.s1) * (b.s1 - a.s1) / (b.i - a.i) + (e.s2 - b.s2) - (e.s1 - b.s1) * (e.s1 - b.s1) / (e.n - b.i) AS ssr
  FROM (SELECT *, LEAD(t) OVER (PARTITION BY series_id ORDER BY t) AS lead_t FROM prefix_) a
  JOIN (SELECT *, LEAD(t) OVER (PARTITION BY series_id ORDER BY t) AS lead_t FROM prefix_) b ON b.series_id = a.series_id AND b.i >= a.i + 30
  JOIN prefix_ e ON e.series_id = a.series_id AND e.i = e.n WHERE a.i >= 30 AND e.n - b.i >= 30""")


@query("x5_break_dates", sql(
    f"""SELECT series_id, 1::BIGINT AS n_breaks, 1::BIGINT AS break_no, arg_min(break_t, ssr) AS break_t, {sig_sql('MIN(ssr)')} AS ssr FROM one_ GROUP BY 1
    UNION ALL SELECT series_id, 2, UNNEST([1, 2]), UNNEST([arg_min(first_t, ssr), arg_min(second_t, ssr)]), {sig_sql('MIN(ssr)')} FROM two_ GROUP BY 1""",
    "fx_series", extra=(FIT, PREFIX, ONE_BREAK, TWO_BREAKS)))
def x5(spark, d):
    b = ST.break_dates(fx.series(spark, d), 2).filter("n_breaks > 0")
    return b.select("series_id", "n_breaks", "break_no", "break_t", sig("ssr").alias("ssr"))


RANKED = ("ranked_", """SELECT series_id, m, first_t, second_t, n * ln(greatest(ssr, 1e-300) / n) + (2 * m + 1) * ln(n) AS bic FROM (
  SELECT series_id, 0 AS m, NULL AS first_t, NULL AS second_t, s2 - s1 * s1 / n AS ssr, n FROM prefix_ WHERE i = n AND n >= 30
  UNION ALL SELECT o.series_id, 1, arg_min(break_t, ssr), NULL, MIN(ssr), any_value(f.n) FROM one_ o JOIN fit_ f ON f.series_id = o.series_id GROUP BY 1
  UNION ALL SELECT t.series_id, 2, arg_min(first_t, ssr), arg_min(second_t, ssr), MIN(ssr), any_value(f.n) FROM two_ t
    JOIN fit_ f ON f.series_id = t.series_id GROUP BY 1)""")


@query("x5_chosen_breaks", sql(
    f"""SELECT series_id, m::BIGINT AS n_breaks, UNNEST(CASE m WHEN 0 THEN [0] WHEN 1 THEN [1] ELSE [1, 2] END)::BIGINT AS break_no,
    UNNEST(CASE m WHEN 0 THEN [NULL] WHEN 1 THEN [first_t] ELSE [first_t, second_t] END)::BIGINT AS break_t, {sig_sql('bic')} AS bic
    FROM (SELECT * FROM ranked_ QUALIFY ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY bic, m) = 1)""",
    "fx_series", extra=(FIT, PREFIX, ONE_BREAK, TWO_BREAKS, RANKED)))
def x5_chosen(spark, d):
    # The SQL goes to two breaks and agrees where no series has more; the tests hold the search beyond.
    return ST.chosen_breaks(ST.break_dates(fx.series(spark, d), 5)).select(
        "series_id", "n_breaks", "break_no", "break_t", sig("bic").alias("bic"))


# ---- elasticity ---------------------------------------------------------------------------------


def _elastic(x: str) -> str:
    return f"""SELECT series_id, '{x}' AS scale, {sig_sql(f'regr_slope(ln(rent), ln({x}))')} AS beta,
    {sig_sql(f'regr_intercept(ln(rent), ln({x}))', 5)} AS alpha, {sig_sql(f'regr_r2(ln(rent), ln({x}))', 5)} AS r2, COUNT(*) AS n
    FROM fx_series WHERE rent > 0 AND {x} > 0 GROUP BY 1"""


@query("x6_elasticity", sql(_elastic("fees") + " UNION ALL " + _elastic("tx"), "fx_series"))
def x6(spark, d):
    s = fx.series(spark, d)
    both = ST.elasticity(s, "rent", "fees").withColumn("scale", F.lit("fees")).unionByName(
        ST.elasticity(s, "rent", "tx").withColumn("scale", F.lit("tx")))
    return both.select("series_id", "scale", sig("beta").alias("beta"), sig("alpha", 5).alias("alpha"), sig("r2", 5).alias("r2"), "n")


def _two(y: str, a: str, b: str, source: str) -> str:
    det = "(s11 * s22 - s12 * s12)"
    return f"""SELECT series_id, n, {sig_sql(f'(s1y * s22 - s2y * s12) / {det}', 5)} AS b_first,
    {sig_sql(f'(s2y * s11 - s1y * s12) / {det}', 5)} AS b_second FROM (SELECT series_id, COUNT(*) AS n, var_pop({a}) AS s11, var_pop({b}) AS s22,
    covar_pop({a}, {b}) AS s12, covar_pop({a}, {y}) AS s1y, covar_pop({b}, {y}) AS s2y FROM {source} GROUP BY 1) WHERE n > 3 AND {det} > 0"""


LOGS = ("logs_", "SELECT series_id, ln(rent) AS ly, ln(fees) AS lf, ln(tx) AS lt FROM fx_series WHERE rent > 0 AND fees > 0 AND tx > 0")


@query("x7_elasticity_with_controls", sql(_two("ly", "lf", "lt", "logs_"), "fx_series", extra=(LOGS,)))
def x7(spark, d):
    logs = fx.series(spark, d).select("series_id", X.log_positive("rent").alias("ly"), X.log_positive("fees").alias("lf"),
                                      X.log_positive("tx").alias("lt"))
    r = ST.multiple_regression(logs, "ly", ["lf", "lt"], ["series_id"]).filter("b_lf IS NOT NULL")
    return r.select("series_id", "n", sig("b_lf", 5).alias("b_first"), sig("b_lt", 5).alias("b_second"))


BLOBSTR = ("blobstr_", """SELECT 'all' AS series_id, y, blob_base_fee_wei_avg AS f, blob_utilization AS u FROM fx_series s
  JOIN state_ b ON b.date_utc = DATE '1970-01-01' + CAST(s.t AS INTEGER) WHERE series_id = 'all' AND blob_utilization IS NOT NULL""")


@query("x7_str_on_blob_state", sql(_two("y", "f", "u", "blobstr_"), "fx_series", "fx_blocks", extra=(CQ.STATE, BLOBSTR)))
def x7_blob(spark, d):
    days = M.str_daily(fx.panel(spark, d)).join(K.blob_fee_state(fx.blocks(spark, d)), "date_utc").select(
        F.lit("all").alias("series_id"), F.col("str").alias("y"), F.col("blob_base_fee_wei_avg").alias("f"),
        F.col("blob_utilization").alias("u"))
    r = ST.multiple_regression(days, "y", ["f", "u"], ["series_id"])
    return r.select("series_id", "n", sig("b_f", 5).alias("b_first"), sig("b_u", 5).alias("b_second"))


# ---- bootstrap, robustness, grade ---------------------------------------------------------------

BLOCK, REPS, SEED = 14, 100, 7


@query("x8_block_bootstrap", sql(
    f"""SELECT series_id, {sig_sql('quantile_cont(est, 0.025)')} AS low, {sig_sql('quantile_cont(est, 0.5)')} AS mid,
    {sig_sql('quantile_cont(est, 0.975)')} AS high, COUNT(*) AS n_reps FROM (SELECT d.series_id, d.rep, SUM(b.rent) / SUM(b.fees) AS est FROM
    (SELECT series_id, rep, CAST('0x' || substr(md5('{SEED}|' || series_id || '|' || rep || '|' || draw), 1, 8) AS BIGINT) % (n - {BLOCK} + 1) AS start_pos
     FROM (SELECT series_id, n, rep, UNNEST(generate_series(1, CAST(CEIL(n / {BLOCK}.0) AS BIGINT))) AS draw FROM
      (SELECT series_id, n, UNNEST(generate_series(1, {REPS})) AS rep FROM fit_ WHERE n >= {BLOCK}))) d
    JOIN (SELECT series_id, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY t) - 1 AS pos, SUM(rent) OVER w AS rent, SUM(fees) OVER w AS fees
     FROM fx_series WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND {BLOCK - 1} FOLLOWING)) b
    ON b.series_id = d.series_id AND b.pos = d.start_pos GROUP BY 1, 2) GROUP BY 1""", "fx_series", extra=(FIT,)))
def x8(spark, d):
    return sigs(ST.block_bootstrap(fx.series(spark, d), BLOCK, REPS, SEED), ["low", "mid", "high"])


GRID = ("grid_", f"""SELECT source || '/' || keep AS base, t, CAST(SUM(CAST(rent AS DECIMAL(38,8))) AS DOUBLE) AS rent,
  CAST(SUM(CAST(fees AS DECIMAL(38,8))) AS DOUBLE) AS fees FROM
  (SELECT 'vendor' AS source, UNNEST(CASE WHEN rollup_id IN (SELECT rollup_id FROM top_) THEN ['every'] ELSE ['every', 'without_top'] END) AS keep,
    datediff('day', DATE '1970-01-01', date_utc)::BIGINT AS t, rent_paid_eth AS rent, l2_fees_eth AS fees FROM fx_panel
   UNION ALL SELECT 'second', UNNEST(CASE WHEN rollup_id IN (SELECT rollup_id FROM top_) THEN ['every'] ELSE ['every', 'without_top'] END),
    datediff('day', DATE '1970-01-01', date_utc)::BIGINT, rent2, l2_fees_eth FROM
    (SELECT p.*, c.total_cost_eth AS rent2 FROM fx_panel p JOIN costs2 c ON c.date_utc = p.date_utc AND c.rollup_id = p.rollup_id))
  GROUP BY 1, 2""")
TOP = ("top_", f"""SELECT rollup_id FROM (SELECT rollup_id, SUM(CAST(l2_fees_eth AS {PQ.DEC})) AS f FROM fx_panel
  WHERE date_utc > (SELECT MAX(date_utc) FROM fx_panel) - 30 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)""")
CUTS = ("cuts_", """SELECT base, quantile_cont(rent / fees, 0.01) AS lo, quantile_cont(rent / fees, 0.99) AS hi FROM grid_ GROUP BY 1""")


@query("x9_robustness_grid", sql(
    f"""SELECT series_id, CASE WHEN MIN(t) < MAX(t) THEN {sig_sql('regr_slope(y, t)', 5)} END AS slope, COUNT(*) AS n,
     CASE WHEN MIN(fees) < MAX(fees) THEN {sig_sql('regr_slope(ln(rent), ln(fees))', 5)} END AS beta FROM
    (SELECT base || '/plain' AS series_id, t, rent, fees, rent / fees AS y FROM grid_ UNION ALL
     SELECT g.base || '/trimmed', t, rent, fees, rent / fees FROM grid_ g JOIN cuts_ c ON c.base = g.base
     WHERE rent / fees BETWEEN c.lo AND c.hi) GROUP BY 1""", "fx_panel", "fx_costs", extra=(PQ.COSTS2, TOP, GRID, CUTS)))
def x9(spark, d):
    panel = fx.panel(spark, d)
    second = panel.join(PQ.costs2(spark, d).filter("rollup_id IS NOT NULL").select("date_utc", "rollup_id", "total_cost_eth"),
                        ["date_utc", "rollup_id"]).withColumn("rent_paid_eth", F.col("total_cost_eth")).drop("total_cost_eth")
    top = M.top_rollups(panel, 1).select("rollup_id")
    g = ST.robustness_grid({"vendor": panel, "second": second}, {"every": None, "without_top": top},
                           {"plain": None, "trimmed": (0.01, 0.99)})
    return g.select("series_id", sig("slope", 5).alias("slope"), "n", sig("beta", 5).alias("beta"))


@query("x10_grade", sql(
    f"""SELECT n.series_id, {sig_sql('n.t_stat', 5)} AS t_stat, {sig_sql('e.beta', 5)} AS beta, CASE WHEN n.t_stat <= -1.96 OR e.beta <= 0.1 THEN 'C'
    WHEN e.beta >= 0.5 THEN 'A' ELSE 'B' END AS grade FROM (SELECT l.series_id, MAX(f.slope) / (SQRT(SUM((CASE WHEN lag = 0 THEN 1 ELSE 2 END)
    * (1 - lag / {LAGS + 1}.0) * uu)) / MAX(x.sxx)) AS t_stat FROM lagged_ l JOIN fit_ f ON f.series_id = l.series_id
    JOIN (SELECT series_id, SUM(x * x) AS sxx FROM res_ GROUP BY 1) x ON x.series_id = l.series_id GROUP BY 1) n
    JOIN (SELECT series_id, regr_slope(ln(rent), ln(fees)) AS beta FROM fx_series WHERE rent > 0 AND fees > 0 GROUP BY 1) e
    ON e.series_id = n.series_id""", "fx_series", extra=(FIT, RES, NUM, LAGGED)))
def x10(spark, d):
    s = fx.series(spark, d)
    g = ST.grade(ST.newey_west(s, LAGS), ST.elasticity(s, "rent", "fees"))
    return g.select("series_id", sig("t_stat", 5).alias("t_stat"), sig("beta", 5).alias("beta"), "grade")


# ---- counterfactual -----------------------------------------------------------------------------


def cf_burn(num: int, den: int) -> str:
    floor = f"(base_fee_per_gas_wei * {num}) // {den}"
    return f"""CASE WHEN tx_type = 3 THEN CAST(blob_count AS HUGEINT) * 131072 * GREATEST(CAST(base_fee_per_blob_gas_wei AS HUGEINT), {floor}) ELSE 0 END"""


@query("x11_fee_floor", sql(
    f"""SELECT c.date_utc, rent_eth, rent_cf_eth, burn_blob_eth, burn_blob_cf_eth, ROUND(raw / fees * 1e6, 6) AS str_ppm,
    ROUND(raw_cf / fees * 1e6, 6) AS str_cf_ppm FROM (SELECT date_utc, CAST(SUM(execution_fee_wei + COALESCE(burn_blob_wei, 0)) AS DOUBLE) / 1e18 AS raw,
    CAST(SUM(execution_fee_wei + COALESCE({cf_burn(1, 16)}, 0)) AS DOUBLE) / 1e18 AS raw_cf, {CQ.eth('SUM(execution_fee_wei + COALESCE(burn_blob_wei, 0))')} AS rent_eth,
    {CQ.eth(f"SUM(execution_fee_wei + COALESCE({cf_burn(1, 16)}, 0))")} AS rent_cf_eth, {CQ.eth('SUM(COALESCE(burn_blob_wei, 0))')} AS burn_blob_eth,
    {CQ.eth(f"SUM(COALESCE({cf_burn(1, 16)}, 0))")} AS burn_blob_cf_eth FROM fx_tx_costs WHERE {NAMED} GROUP BY 1) c
    LEFT JOIN (SELECT date_utc, CAST(SUM(CAST(l2_fees_eth AS {PQ.DEC})) AS DOUBLE) AS fees FROM fx_panel GROUP BY 1) f ON f.date_utc = c.date_utc""",
    "fx_tx_costs", "fx_panel"), dates=("date_utc",))
def x11(spark, d):
    out = CF.counterfactual_daily(CQ.named(CQ.tx_costs(spark, d)), fx.panel(spark, d))
    amounts = ["rent_eth", "rent_cf_eth", "burn_blob_eth", "burn_blob_cf_eth"]
    return out.select("date_utc", *[F.round(c, 12).alias(c) for c in amounts], F.round(F.col("str") * 1e6, 6).alias("str_ppm"),
                      F.round(F.col("str_cf") * 1e6, 6).alias("str_cf_ppm"))


RATIOS = [Decimal("0"), Decimal("0.03125"), Decimal("0.0625"), Decimal("0.125")]


@query("x12_floor_grid", sql(
    " UNION ALL ".join(
        f"SELECT {float(r)}::DOUBLE AS floor_ratio, {CQ.eth(f'SUM(COALESCE({cf_burn(int(r * 32), 32)}, 0))', 6)} AS burn_blob_cf_eth, "
        f"{CQ.eth(f'SUM(execution_fee_wei + COALESCE({cf_burn(int(r * 32), 32)}, 0))', 6)} AS rent_cf_eth FROM fx_tx_costs WHERE {NAMED}"
        for r in RATIOS), "fx_tx_costs"))
def x12(spark, d):
    g = CF.floor_grid(CQ.named(CQ.tx_costs(spark, d)), RATIOS)
    return g.select("floor_ratio", F.round("burn_blob_cf_eth", 6).alias("burn_blob_cf_eth"), F.round("rent_cf_eth", 6).alias("rent_cf_eth"))


# ---- chart tables -------------------------------------------------------------------------------


@query("x13_chart_str_over_time", sql(
    f"""SELECT series_id, t, ROUND(y, 9) AS y, ROUND(AVG(y) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN 29 PRECEDING AND CURRENT ROW), 9)
    AS mean_30d, t >= {BREAK} AS post_regime FROM fx_series WHERE series_id = 'all' OR series_id IN
    (SELECT rollup_id FROM (SELECT rollup_id, SUM(CAST(l2_fees_eth AS {PQ.DEC})) AS f FROM fx_panel
     WHERE date_utc > (SELECT MAX(date_utc) FROM fx_panel) - 30 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5))""", "fx_series"))
def x13_str(spark, d):
    top = M.top_rollups(fx.panel(spark, d), 5).select(F.col("rollup_id").alias("series_id"))
    s = fx.series(spark, d)
    kept = s.filter("series_id = 'all'").unionByName(s.join(top, "series_id", "left_semi"))
    return M.smoothed(kept, "y", (30,)).select("series_id", "t", F.round("y", 9).alias("y"),
                                               F.round("mean_30d", 9).alias("mean_30d"), (F.col("t") >= BREAK).alias("post_regime"))


@query("x13_chart_rent_vs_fees", sql(
    f"""SELECT t, {sig_sql('ln(fees)', 9)} AS log_fees, {sig_sql('ln(rent)', 9)} AS log_rent,
    {sig_sql('(SELECT regr_intercept(ln(rent), ln(fees)) + 0 FROM all_) + (SELECT regr_slope(ln(rent), ln(fees)) FROM all_) * ln(fees)', 7)} AS fitted
    FROM all_""", "fx_series", extra=(("all_", "SELECT * FROM fx_series WHERE series_id = 'all' AND rent > 0 AND fees > 0"),)))
def x13_scatter(spark, d):
    s = fx.series(spark, d).filter("series_id = 'all'")
    fit = ST.elasticity(s, "rent", "fees").select("series_id", "alpha", "beta")
    pts = s.withColumns({"log_fees": X.log_positive("fees"), "log_rent": X.log_positive("rent")}).filter(
        "log_fees IS NOT NULL AND log_rent IS NOT NULL").join(fit, "series_id")
    return pts.select("t", sig("log_fees", 9).alias("log_fees"), sig("log_rent", 9).alias("log_rent"),
                      sig(F.col("alpha") + F.col("beta") * F.col("log_fees"), 7).alias("fitted"))


@query("x13_chart_decomposition", sql(
    """SELECT date_utc, l1_base_fee_burn_eth + 0 AS base_burn_eth, l1_blob_fee_burn_eth AS blob_burn_eth, l1_priority_fee_eth AS tips_eth
    FROM decomp_""", "fx_tx_costs", extra=(CQ.DECOMP,)), dates=("date_utc",))
def x13_decomposition(spark, d):
    return CQ.rounded(K.decomposition(CQ.named(CQ.tx_costs(spark, d)), K.blob_fee_state(fx.raw_blocks(spark, d))).select(
        "date_utc", F.col("l1_base_fee_burn_eth").alias("base_burn_eth"), F.col("l1_blob_fee_burn_eth").alias("blob_burn_eth"),
        F.col("l1_priority_fee_eth").alias("tips_eth")))


@query("x13_chart_blob_market", sql(
    f"""SELECT s.date_utc, s.blob_base_fee_wei_p50, s.blob_base_fee_wei_p50 <= 1 AS at_min, ROUND(y, 9) AS str FROM state_ s
    JOIN fx_series x ON x.series_id = 'all' AND s.date_utc = DATE '1970-01-01' + CAST(x.t AS INTEGER) WHERE s.date_utc >= DATE '{REGIME_DATE}'""",
    "fx_series", "fx_blocks", extra=(CQ.STATE,)), dates=("date_utc",))
def x13_blob(spark, d):
    s = K.blob_fee_state(fx.blocks(spark, d)).filter(X.post_regime("date_utc", REGIME_DATE))
    return s.join(M.str_daily(fx.panel(spark, d)), "date_utc").select(
        "date_utc", "blob_base_fee_wei_p50", K.at_minimum("blob_base_fee_wei_p50").alias("at_min"), F.round("str", 9).alias("str"))


@query("x13_chart_burn_vs_issuance", sql(
    f"""SELECT t, ROUND(burn / iss, 9) AS burn_share, ROUND(AVG(burn / iss) OVER (ORDER BY t RANGE BETWEEN 6 PRECEDING AND CURRENT ROW), 9) AS mean_7d
    FROM (SELECT datediff('day', DATE '1970-01-01', x.date_utc)::BIGINT AS t, burn, issuance_eth AS iss FROM (SELECT date_utc,
    CAST(SUM(burn_base_wei + COALESCE(burn_blob_wei, 0)) AS DOUBLE) / 1e18 AS burn FROM fx_tx_costs WHERE {NAMED} GROUP BY 1) x
    JOIN fx_issuance i ON i.date_utc = x.date_utc)""", "fx_tx_costs", "fx_issuance"))
def x13_burn(spark, d):
    s = M.burn_share_of_issuance(CQ.named(CQ.onchain_daily(spark, d)), fx.issuance(spark, d)).select(
        F.lit("all").alias("series_id"), X.day_number("date_utc").alias("t"), "burn_share")
    return M.smoothed(s, "burn_share", (7,)).select("t", F.round("burn_share", 9).alias("burn_share"), F.round("mean_7d", 9).alias("mean_7d"))


@query("x14_event_study", sql(
    f"""SELECT s.series_id, e.event_id, CAST(s.t - e.event_t AS BIGINT) AS "offset", ROUND(AVG(y), 9) AS mean_y, COUNT(y) AS n FROM fx_series s
    JOIN (SELECT 'year-' || CAST(year(o_orderdate) AS VARCHAR) AS event_id,
      datediff('day', DATE '1970-01-01', CAST(MIN(o_orderdate) AS DATE))::BIGINT + 30 AS event_t FROM orders GROUP BY 1) e
    ON s.t BETWEEN e.event_t - 10 AND e.event_t + 10 GROUP BY 1, 2, 3""", "fx_series"))
def x14(spark, d):
    o = fx.table(spark, d, "orders")
    events = o.groupBy(F.concat(F.lit("year-"), F.year("o_orderdate").cast("string")).alias("event_id")).agg(
        (F.unix_date(F.min(F.to_date("o_orderdate"))).cast("bigint") + 30).alias("event_t"))
    out = ST.event_study(fx.series(spark, d), events, 10)
    return out.select("series_id", "event_id", F.col("offset").cast("bigint").alias("offset"), F.round("mean_y", 9).alias("mean_y"), "n")


