"""Quality classifier: document evidence combined with host and path posteriors by empirical Bayes.

Evidence: the statistics of a text are cut into bins; for each bin the log ratio of its smoothed
frequencies among labelled good and bad documents is added up (naive Bayes). All labelled rows are
counted, by grouped aggregation; the table has at most features x bins rows.

Hierarchy: the evidence alone gives each document a probability. Sums of it over hosts and over paths
below hosts, the document itself left out, are shrunk: a path towards its host, a host towards the global
prior. The strength of each prior is estimated from the spread between groups (moments), so sparse groups
lean on the level above. The path posterior is the prior of the document, to which its evidence is added.

Edge cases. A null text has no words; null hosts and paths are groups of their own. Null labels and labels
without a document do not count; of several labels of a document the best holds. Without labels of both
kinds the evidence is smoothing only and every document gets about the prior. Repeated rows and rows
without an id are scored like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlelens.llm.common import materialize
from settlelens.llm.quality import text_statistics

# Feature: (value in thousandths, as SQL that both engines read alike; ascending cut points).
FEATURES = {
    "symbols": ("1000 * n_symbols / greatest(n_words, 1)", (1, 5, 20, 50, 100, 200, 400, 700)),
    "exclaims": ("1000 * n_exclaims / greatest(n_words, 1)", (1, 5, 20, 50, 100, 200, 400, 700)),
    "capitals": ("1000 * n_upper / greatest(word_chars, 1)", (1, 10, 20, 40, 70, 120, 250, 500)),
    "word_length": ("1000 * word_chars / greatest(n_words, 1)", (2000, 3000, 4000, 4500, 5000, 6000, 7000, 9000, 12000)),
    "dup_lines": ("1000 * n_dup_lines / greatest(n_lines, 1)", (1, 50, 100, 200, 300, 500)),
    "repeats": ("1000 * n_repeat_words / greatest(n_words, 1)", (1, 20, 50, 100, 200, 400, 700)),
    "words": ("1000 * n_words", (5000, 10000, 20000, 50000, 100000, 300000, 1000000)),
}
UNIT = 1_000_000  # probabilities are summed in millionths, as integers, so that sums do not depend on their order
CUTOFF = 0.3  # under a half: a clean document wrongly dropped weighs more than junk kept


def _bin(value: str, cuts: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"CASE WHEN {value} >= {c} THEN 1 ELSE 0 END" for c in cuts) + ")"


def _logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def evidence_table(binned: DataFrame, labels: DataFrame) -> tuple[dict[str, dict[int, float]], float]:
    """Log ratio of each (feature, bin) seen among the labelled, and the prior log odds.

    At most features x bins rows are fetched (under a hundred), whatever the input.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"))
    held = binned.join(marks, "doc_id")
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"bin_{f}").alias("bin")) for f in FEATURES])
    counts = held.select("good", F.inline(pairs)).groupBy("feature", "bin").agg(
        F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("g"), F.sum(F.when(F.col("good") == 1, 0).otherwise(1)).alias("b")
    )
    rows = counts.collect()
    good = sum(r["g"] for r in rows if r["feature"] == "words")
    bad = sum(r["b"] for r in rows if r["feature"] == "words")
    from math import log

    table: dict[str, dict[int, float]] = {f: {} for f in FEATURES}
    for r in rows:
        n = len(FEATURES[r["feature"]][1]) + 1
        table[r["feature"]][r["bin"]] = log((r["g"] + 1) / (good + n)) - log((r["b"] + 1) / (bad + n))
    return table, log((good + 1) / (bad + 1))


def _evidence(table: dict[str, dict[int, float]]) -> Column:
    total = F.lit(0.0)
    for feature, ratios in table.items():
        cases = [F.when(F.col(f"bin_{feature}") == b, F.lit(x)) for b, x in sorted(ratios.items())]
        total = total + F.coalesce(*cases, F.lit(0.0))
    return total


def _strength(groups: DataFrame, level: str, above: Column) -> DataFrame:
    """One row: the prior strength of a level, by moments from the spread of its groups around ``above``.

    With m the mean and t the variance between groups left after the noise of small groups, it is
    m (1 - m) / t - 1, held between 1 and a million.
    """
    n, s = F.col(f"n_{level}").cast("double"), F.col(f"s_{level}") / F.lit(float(UNIT))
    gap = s / n - above
    noise = above * (F.lit(1.0) - above)
    sums = groups.agg(
        F.sum(F.round(n * gap * gap * UNIT).cast("bigint")).alias("spread"),
        F.sum(F.round(noise * UNIT).cast("bigint")).alias("noise"),
        F.sum(F.round(n * noise * UNIT).cast("bigint")).alias("mass"),
        F.sum(F.col(f"n_{level}")).alias("n"),
    )
    between = (F.col("spread") - F.col("noise")) / F.lit(float(UNIT)) / F.col("n")
    within = F.col("mass") / F.lit(float(UNIT)) / F.col("n")
    strength = F.when(between > 0, within / between - 1).otherwise(1e6)
    return sums.select(F.greatest(F.lit(1.0), F.least(F.lit(1e6), strength)).alias(f"k_{level}"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", cutoff: float = CUTOFF
) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, probability and kept of every row."""
    stats = text_statistics(docs, ("doc_id", host, path))
    binned = stats.select(
        "doc_id",
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
        *[F.expr(_bin(value, cuts)).alias(f"bin_{f}") for f, (value, cuts) in FEATURES.items()],
    )
    binned = materialize(binned, "hier-bins")
    table, prior = evidence_table(binned, labels)
    alone = binned.select("doc_id", "host", "path", _evidence(table).alias("evidence")).withColumn(
        "own", F.round(_logistic(F.col("evidence") + F.lit(prior)) * UNIT).cast("bigint")
    )
    paths = alone.groupBy("host", "path").agg(F.count("*").alias("n_path"), F.sum("own").alias("s_path"))
    paths = materialize(paths, "hier-paths")
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    whole = hosts.agg(F.sum("n_host").alias("n"), F.sum("s_host").alias("s"))
    mean = whole.select(((F.col("s") + UNIT) / F.lit(float(UNIT)) / (F.col("n") + 2)).alias("m"))
    # One row of three numbers: the priors of the whole table.
    m = mean.first()["m"]
    if m is None:
        m = 0.5
    grouped = materialize(paths.join(hosts, "host"), "hier-groups")
    k_host = _strength(hosts, "host", F.lit(m)).first()["k_host"]
    k_path = _strength(grouped, "path", F.col("s_host") / F.lit(float(UNIT)) / F.col("n_host")).first()["k_path"]
    k_host, k_path = (1e6 if k is None else k for k in (k_host, k_path))
    own, unit = F.col("own"), F.lit(float(UNIT))
    joined = alone.join(grouped, ["host", "path"])
    host_post = (F.lit(k_host * m) + (F.col("s_host") - own) / unit) / (F.lit(k_host) + F.col("n_host") - 1)
    path_post = (F.lit(k_path) * F.col("host_posterior") + (F.col("s_path") - own) / unit) / (F.lit(k_path) + F.col("n_path") - 1)
    held = F.least(F.greatest(F.col("path_posterior"), F.lit(1e-6)), F.lit(1 - 1e-6))
    out = joined.withColumn("host_posterior", host_post).withColumn("path_posterior", path_post)
    out = out.withColumn("probability", F.round(_logistic(F.col("evidence") + _logit(held)), 6))
    return out.select(
        "doc_id",
        F.round("evidence", 6).alias("evidence"),
        F.round("host_posterior", 6).alias("host_posterior"),
        F.round("path_posterior", 6).alias("path_posterior"),
        "probability",
        (F.col("probability") >= cutoff).alias("kept"),
    )


def hierarchy_sql(cutoff: float = CUTOFF) -> str:
    """The SQL of the query over documents and labels."""
    from settlelens.llm.quality_sql import statistics_ctes

    bins = ", ".join(f"{_bin(value, cuts)} AS bin_{f}" for f, (value, cuts) in FEATURES.items())
    counts = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {len(cuts) + 1} AS n, bin_{f} AS bin, count(*) FILTER (WHERE good = 1) AS g, "
        f"count(*) FILTER (WHERE good <> 1) AS b FROM held GROUP BY bin_{f}"
        for f, (_, cuts) in FEATURES.items()
    )
    total = " + ".join(f"coalesce(l_{f}.x, 0)" for f in FEATURES)
    joins = " ".join(f"LEFT JOIN ratios l_{f} ON l_{f}.feature = '{f}' AND l_{f}.bin = b.bin_{f}" for f in FEATURES)
    u = f"{UNIT}.0::DOUBLE"

    def strength(level: str, table: str, above: str) -> str:
        n, m = f"n_{level}", f"({above})"
        gap = f"(s_{level} / {u} / {n} - {m})"
        return f"""SELECT greatest(1.0::DOUBLE, least(1e6::DOUBLE, CASE WHEN (spread - noise) / {u} / n > 0
      THEN (mass / {u} / n) / ((spread - noise) / {u} / n) - 1 ELSE 1e6::DOUBLE END)) AS k FROM (
      SELECT CAST(sum(CAST(round({n} * {gap} * {gap} * {UNIT}) AS BIGINT)) AS DOUBLE) AS spread,
        CAST(sum(CAST(round({m} * (1 - {m}) * {UNIT}) AS BIGINT)) AS DOUBLE) AS noise,
        CAST(sum(CAST(round({n} * {m} * (1 - {m}) * {UNIT}) AS BIGINT)) AS DOUBLE) AS mass, CAST(sum({n}) AS DOUBLE) AS n FROM {table})"""

    return (
        statistics_ctes()
        + f""", binned AS (
  SELECT doc_id, source AS host, lang AS path, {bins} FROM stats
), marks AS (
  SELECT doc_id, max(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), held AS (
  SELECT b.*, m.good FROM binned b JOIN marks m ON m.doc_id = b.doc_id
), counts AS ({counts}), sums AS (
  SELECT coalesce(sum(g), 0) AS good, coalesce(sum(b), 0) AS bad FROM counts WHERE feature = 'words'
), ratios AS (
  SELECT feature, bin, ln((g + 1) / (good + n)) - ln((b + 1) / (bad + n)) AS x FROM counts, sums
), alone AS (
  SELECT doc_id, host, path, {total} AS evidence FROM binned b {joins}
), owned AS (
  SELECT *, CAST(round({UNIT} / (1 + exp(-(evidence + (SELECT ln((good + 1) / (bad + 1)) FROM sums))))) AS BIGINT) AS own FROM alone
), paths AS (
  SELECT host, path, count(*) AS n_path, sum(own) AS s_path FROM owned GROUP BY ALL
), hosts AS (
  SELECT host, sum(n_path) AS n_host, sum(s_path) AS s_host FROM paths GROUP BY host
), whole AS (
  SELECT (sum(s_host) + {UNIT}) / {u} / (sum(n_host) + 2) AS m FROM hosts
), grouped AS (
  SELECT p.*, n_host, s_host FROM paths p JOIN hosts h ON h.host = p.host
), k_host AS ({strength('host', 'hosts', '(SELECT m FROM whole)')}), k_path AS ({strength('path', 'grouped', f's_host / {u} / n_host')}),
levels AS (
  SELECT o.doc_id, evidence, own, n_path, s_path,
    ((SELECT k FROM k_host) * (SELECT m FROM whole) + (s_host - own) / {u}) / ((SELECT k FROM k_host) + n_host - 1) AS hp
  FROM owned o JOIN grouped g ON g.host = o.host AND g.path = o.path
), posts AS (
  SELECT *, ((SELECT k FROM k_path) * hp + (s_path - own) / {u}) / ((SELECT k FROM k_path) + n_path - 1) AS pp FROM levels
), scored AS (
  SELECT *, round(1 / (1 + exp(-(evidence + ln(least(greatest(pp, 1e-6), 1 - 1e-6) / (1 - least(greatest(pp, 1e-6), 1 - 1e-6)))))), 6) AS p FROM posts
)
SELECT doc_id, CAST(round(evidence, 6) AS DOUBLE) AS evidence, CAST(round(hp, 6) AS DOUBLE) AS host_posterior,
  CAST(round(pp, 6) AS DOUBLE) AS path_posterior, CAST(p AS DOUBLE) AS probability, p >= {cutoff} AS kept FROM scored"""
    )
