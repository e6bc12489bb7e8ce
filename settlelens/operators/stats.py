"""Trend, break and elasticity statistics over many series at once.

Every operator takes ``(series_id, t, y[, x...])`` with one row per series and day, so a series has
no more rows than the calendar has days however large the chain tables are.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from settlelens.functions import columns as X
from settlelens.operators.metrics import EXACT


def linear_trend(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg(
        F.regr_slope("y", "t").alias("slope"),
        F.regr_intercept("y", "t").alias("intercept"),
        F.regr_r2("y", "t").alias("r2"),
        F.regr_count("y", "t").alias("n"),
    )


def residuals(series: DataFrame) -> DataFrame:
    """Centred time ``x`` and the residual ``e`` of the linear trend, row by row."""
    fit = series.groupBy("series_id").agg(
        F.regr_slope("y", "t").alias("slope"),
        F.avg("t").alias("_t0"),
        F.avg("y").alias("_y0"),
        F.count(F.lit(1)).alias("n"),
    )
    return series.join(fit, "series_id").select(
        "series_id",
        "t",
        "slope",
        "n",
        "_t0",
        (F.col("t") - F.col("_t0")).alias("x"),
        (F.col("y") - F.col("_y0") - F.col("slope") * (F.col("t") - F.col("_t0"))).alias("e"),
    )


def lagged_products(res: DataFrame, lags: int) -> DataFrame:
    """Per series: sums of e(i)e(i-l), and of the score products, for l = 0..lags, from one sort."""
    w = W.partitionBy("series_id").orderBy("t")
    u = F.col("x") * F.col("e")
    prods = [F.sum(F.col("e") * F.col("e")).alias("g0_ee"), F.sum(u * u).alias("g0_uu"), F.sum(u * F.col("e")).alias("g0_ue")]
    cols = {"u": u}
    for lag in range(1, lags + 1):
        cols[f"_e{lag}"] = F.lag("e", lag).over(w)
        cols[f"_u{lag}"] = F.lag(u, lag).over(w)
    for lag in range(1, lags + 1):
        prods += [
            F.sum(F.col("e") * F.col(f"_e{lag}")).alias(f"g{lag}_ee"),
            F.sum(F.col("u") * F.col(f"_u{lag}")).alias(f"g{lag}_uu"),
            F.sum(F.col("u") * F.col(f"_e{lag}") + F.col("e") * F.col(f"_u{lag}")).alias(f"g{lag}_ue"),
        ]
    return (
        res.withColumns(cols)
        .groupBy("series_id")
        .agg(
            F.first("slope").alias("slope"),
            F.first("n").alias("n"),
            F.first("_t0").alias("t_mean"),
            F.sum(F.col("x") * F.col("x")).alias("sxx"),
            *prods,
        )
    )


def newey_west(series: DataFrame, lags: int = 7) -> DataFrame:
    """Trend slope with Bartlett-weighted autocorrelation-robust standard errors.

    With time centred the bread of the sandwich is diagonal, so both variances are plain columns.
    """
    g = lagged_products(residuals(series), lags)

    def long_run(kind: str) -> Column:
        total = F.col(f"g0_{kind}")
        for lag in range(1, lags + 1):
            weight = 1.0 - lag / (lags + 1.0)
            twice = 1.0 if kind == "ue" else 2.0
            total = total + F.lit(weight * twice) * F.coalesce(F.col(f"g{lag}_{kind}"), F.lit(0.0))
        return total

    v_slope = long_run("uu") / (F.col("sxx") * F.col("sxx"))
    v_mean = long_run("ee") / (F.col("n") * F.col("n"))
    cov = long_run("ue") / (F.col("sxx") * F.col("n"))
    v_intercept = v_mean - 2 * F.col("t_mean") * cov + F.col("t_mean") * F.col("t_mean") * v_slope
    return g.filter("sxx > 0").select(
        "series_id",
        "n",
        "slope",
        F.sqrt(F.greatest(v_slope, F.lit(0.0))).alias("slope_se"),
        F.sqrt(F.greatest(v_intercept, F.lit(0.0))).alias("intercept_se"),
        F.try_divide("slope", F.sqrt(F.greatest(v_slope, F.lit(0.0)))).alias("t_stat"),
    )


def _pair_counts(series: DataFrame) -> DataFrame:
    """Rising and falling pairs, and the tie term of the variance, per series.

    All windows partition by the series first, so one shuffle serves them and the final sum.
    """
    by_series = W.partitionBy("series_id")
    ranked = (
        series.filter(~F.isnan("y") & F.col("y").isNotNull())
        .select(
            "series_id",
            "t",
            (F.dense_rank().over(by_series.orderBy("y")) - 1).cast("bigint").alias("r"),
            F.count(F.lit(1)).over(W.partitionBy("series_id", "y")).alias("m"),
        )
        .withColumns({"n": F.count(F.lit(1)).over(by_series), "top": F.max("r").over(by_series)})
    )
    bits = F.length(F.bin("top"))  # as many as the largest rank has
    split = ranked.select(
        "series_id", "t", "r", "m", "n", F.explode(F.sequence(F.lit(0), bits - 1)).alias("k")
    ).withColumns({"prefix": F.expr("shiftright(r, k + 1)"), "bit": F.expr("shiftright(r, k) & 1")})
    w = W.partitionBy("series_id", "k", "prefix").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    seen = split.select(
        "series_id",
        "n",
        F.when(F.col("bit") == 1, F.sum(1 - F.col("bit")).over(w)).alias("up"),
        F.when(F.col("bit") == 0, F.sum("bit").over(w)).alias("down"),
        F.when(F.col("k") == 0, (F.col("m") - 1) * (2 * F.col("m") + 5)).alias("tie"),
    )
    return seen.groupBy("series_id").agg(
        F.max("n").alias("n"),
        F.coalesce(F.sum("up"), F.lit(0)).alias("rising"),
        F.coalesce(F.sum("down"), F.lit(0)).alias("falling"),
        F.sum("tie").alias("tie_sum"),
    )


def pair_signs(series: DataFrame) -> DataFrame:
    """Rising, falling and tied pairs of days per series, counted without forming pairs.

    Values become dense ranks. Two ranks first differ at one bit, where the larger has a one. So for
    each bit, rows that share the higher bits are walked in time order, and each row counts the
    earlier rows with the opposite bit: n x log2(n) rows instead of n x n.
    """
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("bigint")
    return _pair_counts(series).select(
        "series_id", "n", "rising", "falling", (pairs - F.col("rising") - F.col("falling")).alias("tied")
    )


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal p-value by the Abramowitz-Stegun 26.2.17 polynomial (error below 1e-7)."""
    # The polynomial's published coefficients.
    b = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    x = F.abs(z)
    k = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * x)
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = (poly + F.lit(c)) * k
    return F.lit(2.0) * F.exp(-x * x / 2) / F.lit((2 * 3.141592653589793) ** 0.5) * poly


def mann_kendall(series: DataFrame) -> DataFrame:
    """S, tie-corrected variance, Z with continuity correction and its p-value."""
    n = F.col("n")
    s = F.col("rising") - F.col("falling")
    var = (n * (n - 1) * (2 * n + 5) - F.col("tie_sum")) / 18.0
    z = F.when((s == 0) | (var <= 0), 0.0).otherwise((s - F.signum(s)) / F.sqrt(var))
    return (
        _pair_counts(series)
        .select("series_id", "n", s.alias("s"), var.alias("var_s"), z.alias("z"))
        .withColumn("p_value", normal_two_sided(F.col("z")))
    )


def _ssr(y: Column, t: Column) -> Column:
    sxx = F.regr_sxx(y, t)
    sxy = F.regr_sxy(y, t)
    return F.regr_syy(y, t) - F.when(sxx > 0, sxy * sxy / sxx).otherwise(0.0)


def chow(series: DataFrame, break_t: int) -> DataFrame:
    """F statistic of a known break at ``t >= break_t``; three residual sums from one aggregate."""
    early, late = F.col("t") < break_t, F.col("t") >= break_t
    y, t = F.col("y"), F.col("t").cast("double")
    g = series.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(early).alias("n_before"),
        F.count_if(late).alias("n_after"),
        _ssr(y, t).alias("ssr_all"),
        _ssr(F.when(early, y), F.when(early, t)).alias("ssr_before"),
        _ssr(F.when(late, y), F.when(late, t)).alias("ssr_after"),
    )
    split = F.col("ssr_before") + F.col("ssr_after")
    f = F.when(
        (F.col("n_before") >= 2) & (F.col("n_after") >= 2) & (F.col("n") > 4),
        F.try_divide((F.col("ssr_all") - split) / 2.0, split / (F.col("n") - 4)),
    )
    return g.withColumn("f_stat", f)


BREAKS_SCHEMA = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("n_breaks", T.LongType()),
        T.StructField("break_no", T.LongType()),
        T.StructField("break_t", T.LongType()),
        T.StructField("ssr", T.DoubleType()),
        T.StructField("bic", T.DoubleType()),
    ]
)


def break_dates(series: DataFrame, max_breaks: int = 3, min_segment: int = 30) -> DataFrame:
    """Break dates in the mean for 0..max_breaks breaks, each with its total SSR and BIC.

    Dynamic programming over segment ends, with segment sums from prefix sums, so nothing of size
    n x n is kept. Spark spreads the series over tasks; one task sees one daily series at a time.
    ``break_t`` is the first day of the new segment.
    """

    def per_series(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("t")
        t, y = pdf["t"].to_numpy(), pdf["y"].to_numpy()
        n = len(y)
        y = y - (y.mean() if n else 0.0)
        s1, s2 = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y * y)])

        def ssr(i, j):
            return s2[j] - s2[i] - (s1[j] - s1[i]) ** 2 / (j - i)

        out = []
        if n >= min_segment:
            ends = np.arange(n + 1)
            best = np.full(n + 1, np.inf)
            best[min_segment:] = ssr(0, ends[min_segment:])
            back = []
            for m in range(max_breaks + 1):
                if m:
                    nxt, prev = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
                    for j in range((m + 1) * min_segment, n + 1):
                        starts = np.arange(m * min_segment, j - min_segment + 1)
                        cost = best[starts] + ssr(starts, j)
                        k = int(np.argmin(cost))
                        nxt[j], prev[j] = cost[k], starts[k]
                    best = nxt
                    back.append(prev)
                if not np.isfinite(best[n]):
                    break
                cuts, j = [], n
                for prev in reversed(back):
                    j = int(prev[j])
                    cuts.append(j)
                total = max(float(best[n]), 0.0)
                bic = float(n * np.log(max(total, 1e-300) / n) + (2 * m + 1) * np.log(n))
                if m == 0:
                    out.append((key[0], 0, 0, None, total, bic))
                for no, cut in enumerate(reversed(cuts), start=1):
                    out.append((key[0], m, no, int(t[cut]), total, bic))
        frame = pd.DataFrame(out, columns=BREAKS_SCHEMA.fieldNames())
        frame["break_t"] = frame["break_t"].astype("Int64")
        return frame

    clean = series.filter(F.col("y").isNotNull() & ~F.isnan("y")).select("series_id", "t", "y")
    return clean.groupBy("series_id").applyInPandas(per_series, BREAKS_SCHEMA)


def chosen_breaks(breaks: DataFrame) -> DataFrame:
    """The break count with the lowest BIC per series."""
    best = breaks.groupBy("series_id").agg(F.min_by("n_breaks", F.struct("bic", "n_breaks")).alias("n_breaks"))
    return breaks.join(best, ["series_id", "n_breaks"])


def elasticity(series: DataFrame, y: str, x: str) -> DataFrame:
    """Slope of log(y) on log(x) over days where both are positive."""
    both = series.select(
        "series_id", X.log_positive(y).alias("ly"), X.log_positive(x).alias("lx")
    ).filter("ly IS NOT NULL AND lx IS NOT NULL")
    return both.groupBy("series_id").agg(
        F.regr_slope("ly", "lx").alias("beta"),
        F.regr_intercept("ly", "lx").alias("alpha"),
        F.regr_r2("ly", "lx").alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def multiple_regression(series: DataFrame, y: str, xs: list[str], keys: list[str]) -> DataFrame:
    """OLS of y on several regressors: intercept, b_<x> and r2, null where a regressor is a mix of others.

    One aggregate gives the centred cross moments of each group; the symmetric system is solved by
    elimination on columns, one step per regressor.
    """
    complete = series.select(*keys, *[X.not_nan(F.col(c).cast("double")).alias(c) for c in (y, *xs)]).dropna(subset=[y, *xs])
    p = len(xs)
    moments = complete.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.covar_pop(xs[i], xs[j]).alias(f"_a{i}{j}") for i in range(p) for j in range(i, p)],
        *[F.covar_pop(x, y).alias(f"_b{i}") for i, x in enumerate(xs)],
        F.var_pop(y).alias("_syy"),
        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate((*xs, y))],
    )
    system = moments.withColumns({f"_s{i}": F.col(f"_b{i}") for i in range(p)} | {f"_d{i}": F.col(f"_a{i}{i}") for i in range(p)})
    a = lambda i, j: F.col(f"_a{min(i, j)}{max(i, j)}")
    sound = F.col("n") > p + 1
    for k in range(p):  # elimination below the diagonal; the rest stays symmetric
        sound = sound & (F.col(f"_a{k}{k}") > F.col(f"_d{k}") * 1e-12)
        share = {i: F.try_divide(a(k, i), a(k, k)) for i in range(k + 1, p)}
        system = system.withColumns(
            {f"_a{i}{j}": a(i, j) - share[i] * a(k, j) for i in share for j in range(i, p)}
            | {f"_b{i}": F.col(f"_b{i}") - share[i] * F.col(f"_b{k}") for i in share}
        )
    for k in reversed(range(p)):
        rest = F.col(f"_b{k}")
        for j in range(k + 1, p):
            rest = rest - a(k, j) * F.col(f"_x{j}")
        system = system.withColumn(f"_x{k}", F.try_divide(rest, a(k, k)))
    fitted, level = F.lit(0.0), F.col(f"_m{p}")
    for i in range(p):
        fitted = fitted + F.col(f"_x{i}") * F.col(f"_s{i}")
        level = level - F.col(f"_x{i}") * F.col(f"_m{i}")
    return system.select(
        *keys,
        "n",
        F.when(sound, level).alias("intercept"),
        *[F.when(sound, F.col(f"_x{i}")).alias(f"b_{x}") for i, x in enumerate(xs)],
        F.when(sound, F.try_divide(fitted, "_syy")).alias("r2"),
    )


def block_bootstrap(series: DataFrame, block: int = 14, reps: int = 200, seed: int = 7) -> DataFrame:
    """Percentile band of the take rate (sum rent / sum fees) under a moving-block bootstrap.

    Sums of every block come from one window, so a replicate draws n / block sums rather than n
    rows. Starts come from a hash of (seed, series, replicate, draw): the same seed, the same band.
    """
    order = W.partitionBy("series_id").orderBy("t")
    span = order.rowsBetween(0, block - 1)
    blocks = series.select(
        "series_id",
        (F.row_number().over(order) - 1).cast("bigint").alias("start"),
        F.sum(F.col("rent").cast(EXACT)).over(span).alias("rent"),
        F.sum(F.col("fees").cast(EXACT)).over(span).alias("fees"),
    )
    sizes = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= block)
    draws = sizes.select(
        "series_id",
        "n",
        F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"),
    ).select(
        "series_id",
        "n",
        "rep",
        F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / block).cast("int"))).alias("draw"),
    )
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), "series_id", F.col("rep").cast("string"), F.col("draw").cast("string")))
    starts = draws.select(
        "series_id",
        "rep",
        (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % (F.col("n") - block + 1)).alias("start"),
    )
    estimates = (
        starts.join(blocks, ["series_id", "start"])
        .groupBy("series_id", "rep")
        .agg(X.ratio_or_nan(F.sum("rent").cast("double"), F.sum("fees").cast("double")).alias("estimate"))
    )
    v = X.not_nan("estimate")
    return estimates.groupBy("series_id").agg(
        F.percentile(v, F.lit(0.025)).alias("low"),
        F.percentile(v, F.lit(0.5)).alias("mid"),
        F.percentile(v, F.lit(0.975)).alias("high"),
        F.count(v).alias("n_reps"),
    )


def trimmed(series: DataFrame, low: float, high: float) -> DataFrame:
    """Days whose y lies within the series' own percentiles, both included."""
    v = X.not_nan("y")
    cut = series.groupBy("series_id").agg(
        F.percentile(v, F.lit(low)).alias("_lo"), F.percentile(v, F.lit(high)).alias("_hi")
    )
    return series.join(cut, "series_id").filter(F.col("y").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def robustness_grid(panels: dict[str, DataFrame], excluded: dict[str, DataFrame | None], trims: dict[str, tuple | None]):
    """Trend and elasticity of the ecosystem take rate per (source, rollup set, trimming).

    A panel row carries the rollup sets it belongs to and is summed to days in one pass per source;
    trimming then works on those days.
    """
    from settlelens.operators.metrics import exact_sum

    daily = None
    for source, panel in panels.items():
        sets = []
        for name, drop in excluded.items():
            label = F.lit(f"{source}/{name}")
            if drop is None:
                sets.append(label)
                continue
            flag = f"_out_{name}"
            panel = panel.join(drop.select("rollup_id").distinct().withColumn(flag, F.lit(True)), "rollup_id", "left")
            sets.append(F.when(F.col(flag).isNull(), label))
        d = (
            panel.select(
                F.explode(F.array_compact(F.array(*sets))).alias("series_id"),
                F.unix_date("date_utc").cast("bigint").alias("t"),
                "rent_paid_eth",
                "l2_fees_eth",
            )
            .groupBy("series_id", "t")
            .agg(exact_sum("rent_paid_eth").cast("double").alias("rent"), exact_sum("l2_fees_eth").cast("double").alias("fees"))
            .withColumn("y", X.ratio_or_nan("rent", "fees"))
            .filter(~F.isnan("y"))
        )
        daily = d if daily is None else daily.unionByName(d)
    bounds = {name: cut for name, cut in trims.items() if cut is not None}
    v = X.not_nan("y")
    cuts = daily.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.percentile(v, F.lit(p)).alias(f"_{name}_{i}") for name, cut in bounds.items() for i, p in enumerate(cut)],
    )
    labels = [
        F.lit(name) if cut is None else F.when(F.col("y").between(F.col(f"_{name}_0"), F.col(f"_{name}_1")), F.lit(name))
        for name, cut in trims.items()
    ]
    out = (
        daily.join(cuts, "series_id")
        .select("series_id", "t", "rent", "fees", "y", F.explode(F.array_compact(F.array(*labels))).alias("_trim"))
        .withColumn("series_id", F.concat_ws("/", "series_id", "_trim"))
    )
    lr, lf = X.log_positive("rent"), X.log_positive("fees")
    # A single day, or days of equal fees, have no slope.
    return out.groupBy("series_id").agg(
        F.when(F.min("t") < F.max("t"), F.regr_slope("y", "t")).alias("slope"),
        F.count(F.lit(1)).alias("n"),
        F.when(F.min("fees") < F.max("fees"), F.regr_slope(lr, lf)).alias("beta"),
    )


def grade(
    trends: DataFrame, elasticities: DataFrame, z_cut: float = 1.96, high_beta: float = 0.5, low_beta: float = 0.1
) -> DataFrame:
    """A / B / C from the sign and significance of the trend and from the elasticity."""
    falling = F.col("t_stat") <= -z_cut
    g = trends.select("series_id", "slope", "t_stat").join(elasticities.select("series_id", "beta"), "series_id")
    return g.withColumn(
        "grade",
        F.when(falling | (F.col("beta") <= low_beta), "C")
        .when(~falling & (F.col("beta") >= high_beta), "A")
        .otherwise("B"),
    )


def event_study(series: DataFrame, events: DataFrame, span: int) -> DataFrame:
    """Mean y by day offset around events (event_id, event_t): each event is spread over its own
    offsets and joined on the day."""
    around = events.select(
        "event_id", F.col("event_t"), F.explode(F.sequence(F.lit(-span), F.lit(span))).alias("offset")
    ).withColumn("t", F.col("event_t") + F.col("offset"))
    v = X.not_nan("y")
    return (
        series.join(around, "t")
        .groupBy("series_id", "event_id", "offset")
        .agg(F.avg(v).alias("mean_y"), F.count(v).alias("n"))
    )


def day(date: dt.date) -> int:
    return (date - dt.date(1970, 1, 1)).days
