"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) by their tokens. The token weights of the cells
are raked to target shares of each margin in turn; a weight never exceeds the tokens its cell has, so the
result is a sampling probability per cell, and what a full cell cannot give goes to others of its margin
in the next sweep. A document is kept when a uniform number drawn from its id is under the probability of
its cell, so a rerun keeps the same documents.

Margins not given are tempered: the share of a value is its share of the tokens to the power ``temper``,
scaled to one; a large source gives up weight to small ones.

Edge cases. Null sources, languages and topics are values of their own (written as the empty text). A
null or empty text has no tokens: its cell may have weight zero, and then probability zero. Values of a
given target that no document has are ignored and the others scaled up; values without a target get
nothing. Rows without an id share one draw. Repeated rows share a fate. An empty table gives an empty
result. Input columns are carried along; the working columns have a prefix that inputs must not use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from settlelens.llm.common import materialize, null_safe_text

# Topics by the first pattern that a text contains, in this order.
TOPICS = (("legal", r"(?i)licen[sc]e|copyright"), ("tabular", r" \| "), ("contact", r"@|[0-9]{7}"))
OTHER = "general"
BUDGET = 0.6  # share of all tokens to keep
TEMPER = 0.7
SWEEPS = 10
SEED = 17
DIGITS = 6  # of a probability; decisions use the rounded value
MARGINS = ("source", "lang", "topic")


def topic_of(text: Column, topics=TOPICS, other: str = OTHER) -> Column:
    cases = [F.when(text.rlike(pattern), F.lit(name)) for name, pattern in topics]
    return F.coalesce(*cases, F.lit(other))


def draw(id_column: Column, seed: int = SEED) -> Column:
    """A uniform number in [0, 1) that depends on the id and the seed only."""
    text = F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def tempered(cells: DataFrame, margin: str, temper: float) -> DataFrame:
    """(value, share) of one margin."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
    raised = sums.select("value", F.pow(F.col("t"), F.lit(temper)).alias("p"))
    whole = raised.agg(F.sum("p")).first()[0] or 1.0
    return raised.select("value", (F.col("p") / F.lit(whole)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], budget: float = BUDGET, sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (margins and tokens) with ``weight``: tokens to keep, raked to the shares of all margins."""
    margins = list(targets)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = {}
    for m, shares in targets.items():
        present = shares.join(cells.where("tokens > 0").select(F.col(m).alias("value")).distinct(), "value")
        scale = present.agg(F.sum("share")).first()[0] or 1.0
        goals[m] = materialize(present.select("value", (F.col("share") * (total * budget / scale)).alias("goal")), f"goal-{m}")
    fitted = cells.withColumn("weight", F.col("tokens") * F.lit(budget))
    for m in margins:
        fitted = fitted.join(goals[m].select(F.col("value").alias(m), F.col("goal").alias(f"goal_{m}")), m, "left")
    for sweep in range(sweeps):
        for m in margins:
            # Cells are counts already; a window over a margin is one shuffle of them and no join.
            have = F.sum("weight").over(W.partitionBy(m))
            factor = F.when(have > 0, F.coalesce(f"goal_{m}", F.lit(0.0)) / have).otherwise(0.0)
            fitted = fitted.withColumn("weight", F.least(F.col("weight") * factor, F.col("tokens").cast("double")))
        if sweep % 5 == 4:  # keeps the plan short
            fitted = materialize(fitted, "mix-weights")
    return fitted.drop(*[f"goal_{m}" for m in margins])


def mixed(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    budget: float = BUDGET,
    temper: float = TEMPER,
    sweeps: int = SWEEPS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """``docs`` with ``mix_source``, ``mix_lang``, ``mix_topic``, ``mix_tokens``, ``mix_probability``, ``mix_kept``.

    ``targets`` maps any of source, lang and topic to a table (value, share); the others are tempered.
    """
    text = null_safe_text(text_col)
    keyed = docs.withColumns(
        {
            "mix_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
            "mix_lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")),
            "mix_topic": topic_of(text),
            "mix_tokens": F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("bigint"),
        }
    )
    cells = keyed.groupBy(*[F.col(f"mix_{m}").alias(m) for m in MARGINS]).agg(F.sum("mix_tokens").alias("tokens"))
    cells = materialize(cells, "mix-cells")
    goals = {m: (targets or {}).get(m) for m in MARGINS}
    goals = {m: tempered(cells, m, temper) if t is None else t for m, t in goals.items()}
    fitted = rake(cells, goals, budget, sweeps)
    chance = F.when(F.col("tokens") > 0, F.round(F.col("weight") / F.col("tokens"), DIGITS)).otherwise(F.lit(0.0))
    rates = materialize(
        fitted.select(*[F.col(m).alias(f"mix_{m}") for m in MARGINS], chance.alias("mix_probability")), "mix-rates"
    )
    joined = keyed.join(rates, [f"mix_{m}" for m in MARGINS])
    return joined.withColumn("mix_kept", draw(F.col(id_col), seed) < F.col("mix_probability"))


def mixing_sql(budget: float = BUDGET, temper: float = TEMPER, sweeps: int = SWEEPS, seed: int = SEED) -> str:
    """The SQL of the query over documents."""
    topic = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS)
    parts = [
        f"""WITH body AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents
), keyed AS (
  SELECT doc_id, source, lang, CASE {topic} ELSE '{OTHER}' END AS topic,
    CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM body
), cells AS (
  SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM keyed GROUP BY ALL
), w0 AS MATERIALIZED (
  SELECT *, tokens * CAST({budget} AS DOUBLE) AS weight FROM cells
)"""
    ]
    for m in MARGINS:
        parts.append(f"""goal_{m} AS MATERIALIZED (
  SELECT value, p / (sum(p) OVER ()) * (SELECT sum(tokens) FROM cells) * CAST({budget} AS DOUBLE) AS goal
  FROM (SELECT {m} AS value, pow(sum(tokens), CAST({temper} AS DOUBLE)) AS p FROM cells GROUP BY {m} HAVING sum(tokens) > 0)
)""")
    k = 0
    for _ in range(sweeps):
        for m in MARGINS:
            parts.append(f"""w{k + 1} AS MATERIALIZED (
  SELECT source, lang, topic, tokens, least(weight * CASE WHEN have > 0 THEN coalesce(goal, 0) / have ELSE 0 END, tokens) AS weight
  FROM (SELECT *, sum(weight) OVER (PARTITION BY {m}) AS have FROM w{k}) f LEFT JOIN goal_{m} g ON g.value = f.{m}
)""")
            k += 1
    return (
        ", ".join(parts)
        + f"""
SELECT doc_id, source, lang, topic, n_tokens, probability,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{seed}'), 1, 8) AS BIGINT) / 4294967296.0 < probability AS kept
FROM (SELECT doc_id, k.source, k.lang, k.topic, k.tokens AS n_tokens,
    CASE WHEN w.tokens > 0 THEN round(weight / w.tokens, {DIGITS}) ELSE 0.0 END AS probability
  FROM keyed k JOIN w{k} w ON w.source = k.source AND w.lang = k.lang AND w.topic = k.topic)"""
    )
