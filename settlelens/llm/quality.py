"""Quality rules with risk-controlled cutoffs, on built-in functions only.

Each rule compares an integer statistic of a text with a cutoff from a fixed grid. The (rule, cutoff) pairs
make a path of ever stricter settings, fixed beforehand (``path``): each step adds one pair to those before,
the most lenient cutoff of every rule first. For a stratum a setting is certified when the labelled good
documents there show, by an exact binomial bound, that it rejects at most the allowed share of good
documents, all its rules together. Settings are tested in the order of the path and tests stop at the first
that fails; as the settings are nested and their order is fixed, each may be tested at the whole level of its
stratum (fixed-sequence testing), and the level is the error divided by the number of strata (Bonferroni).
So choosing among certified settings afterwards keeps the guarantee. The one with the best balance
(labelled bad minus labelled good documents rejected) is used, the most lenient on ties, and none at all
when no balance is positive. The path is fixed beforehand, so all labelled rows serve as the holdout; they
are only counted, in one grouped aggregation by the first step that rejects a document.

With a risk of 5 percent and an error of 5 percent over four strata, 86 good labels that no step rejects are
enough to certify it.

Edge cases. A null text has no words. A null stratum is a stratum of its own. A text of under ten words
fails the base rule. Rows without a label, labels without a document and null labels do not count; a
document labelled more than once counts as good if any label says so. A stratum with too few good labels
certifies nothing and keeps every text that passes the base rules; so does an empty label table. Repeated
rows each get their verdict. Further columns are carried by none of the results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from settlelens.llm.common import WORD, materialize, null_safe_text

# Fixed values of the base rules.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class Rule:
    """Rejects when ``scale * value > cutoff * base`` (``below``: when ``value < cutoff``)."""

    name: str
    value: str
    base: str | None
    scale: int
    cutoffs: tuple[int, ...]  # from strict to lenient

    def condition(self, cutoff) -> str:
        if self.base is None:
            return f"({self.value} < {cutoff})"
        return f"({self.scale} * {self.value} > {cutoff} * {self.base})"


RULES = (
    Rule("symbols", "n_symbols", "n_words", 100, (5, 10, 20, 30, 50, 80)),
    Rule("dup_lines", "n_dup_lines", "n_lines", 100, (10, 20, 30, 40, 50, 70)),
    Rule("repeats", "n_repeat_words", "n_words", 100, (2, 5, 10, 15)),
    Rule("capitals", "n_upper", "word_chars", 100, (20, 30, 50, 70)),
    Rule("exclaims", "n_exclaims", "n_words", 100, (10, 20, 50, 80)),
    Rule("long_words", "word_chars", "n_words", 10, (90, 100, 120, 150)),
    Rule("short", "n_words", None, 1, (50, 30, 20, 15)),
)
RISK = 0.05  # share of good documents of a stratum that its certified setting may reject
ERROR = 0.05  # chance that the bound fails in any stratum


def _count(pattern: str) -> Column:
    return F.regexp_count("body", F.lit(pattern)).cast("bigint")


def text_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the statistics of each whole text, worked out row by row."""
    body = docs.select(*keep, null_safe_text(text_col).alias("body"))
    split = body.select(
        *keep,
        "body",
        F.array_remove(F.split("body", r"[\x20\x09-\x0D]+"), "").alias("w"),
        F.filter(F.split("body", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    last = F.size("w") - (WINDOW - 1)
    at = lambda i, k: F.get("w", i + k)
    hashed = split.select(
        *keep,
        "w",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("bigint").alias("word_chars"),
        _count(SYMBOLS).alias("n_symbols"),
        _count("[A-Z]").alias("n_upper"),
        _count("!").alias("n_exclaims"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(
            last >= 2,
            F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])),
        ).alias("codes"),
    )
    # Unequal hashes prove unequal windows; only a text with equal hashes is looked at word by word.
    suspect = F.size("codes") > F.size(F.array_distinct("codes"))
    windows = F.transform(
        F.sequence(F.lit(1), last),
        lambda i: F.struct(F.array_join(F.slice("w", i, WINDOW), " ").alias("t"), i.alias("p")),
    )
    ordered = hashed.withColumn("s", F.when(suspect, F.array_sort(windows))).drop("codes", "w")
    twice = F.filter("s", lambda x, i: (F.get("s", i - 1)["t"] == x["t"]) | (F.get("s", i + 1)["t"] == x["t"]))
    places = F.array_sort(F.transform(twice, lambda x: x["p"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    return ordered.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("s")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def acceptance_number(n: Column, share: float, level: Column) -> Column:
    """Largest k with P(Binomial(n, share) <= k) <= level; null if there is none.

    So many good documents out of n may be rejected while the true share is shown to be under ``share``.
    The sum runs up to n * share, past which it exceeds any level under a half.
    """
    log_first = n * F.log(F.lit(1.0 - share))
    ratio = float(share / (1.0 - share))

    def step(a, k):
        term = F.when(k == 0, log_first).otherwise(a["term"] + F.log((n - k + 1) / k * F.lit(ratio)))
        total = a["total"] + F.exp(term)
        best = F.when(total <= level, k).otherwise(a["best"])
        return F.struct(term.alias("term"), total.alias("total"), best.alias("best"))

    start = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("total"), F.lit(None).cast("bigint").alias("best"))
    upto = F.floor(n * F.lit(share)).cast("bigint")
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), upto), start, step, lambda a: a["best"])


def path(rules=RULES) -> list[tuple[Rule, int]]:
    """The steps: the most lenient cutoff of every rule in turn, then the next of each, and so on."""
    depth = max(len(r.cutoffs) for r in rules)
    return [(r, r.cutoffs[-1 - level]) for level in range(depth) for r in rules if level < len(r.cutoffs)]


def first_step(rules=RULES) -> Column:
    """The number of the first step that rejects a document, null if none does."""
    return F.coalesce(*[F.when(F.expr(r.condition(c)), F.lit(t)) for t, (r, c) in enumerate(path(rules))])


def certified_steps(held: DataFrame, rules=RULES, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, last_step) of the strata with a certified setting of positive balance.

    ``held`` has a row per labelled document: stratum, good (0 or 1) and step, the first that rejects it.
    """
    by_step = held.groupBy("stratum", "step").agg(
        F.count(F.when(F.col("good") == 1, True)).alias("good"), F.count(F.when(F.col("good") == 0, True)).alias("bad")
    )
    by_step = materialize(by_step, "quality-counts")
    sizes = by_step.groupBy("stratum").agg(F.sum("good").alias("n_good")).where("n_good > 0")
    strata = max(sizes.count(), 1)
    allowed = sizes.select("stratum", acceptance_number(F.col("n_good"), risk, F.lit(error / strata)).alias("allowed"))
    # One row for each step of a stratum at most, so the window is as long as the path.
    upto = W.partitionBy("stratum").orderBy("step")
    sums = by_step.where("step IS NOT NULL").select(
        "stratum", "step", F.sum("good").over(upto).alias("good_hits"), F.sum("bad").over(upto).alias("bad_hits")
    )
    passed = sums.join(allowed, "stratum").where("good_hits <= allowed AND bad_hits > good_hits")
    best = F.struct(F.col("bad_hits") - F.col("good_hits"), -F.col("step"))
    return passed.groupBy("stratum").agg(F.max_by("step", best).alias("last_step"))


def quality_verdicts(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    rules=RULES,
    risk: float = RISK,
    error: float = ERROR,
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Statistics of each document, ``base_failed``, the rule that rejects it (null: none) and ``kept``; ``keep`` names columns to carry.

    ``docs`` has doc_id and the stratum column; ``labels`` has doc_id and quality 0/1.
    """
    stats = text_statistics(docs, ("doc_id", stratum, *keep), text_col)
    stats = stats.withColumns({"stratum": F.coalesce(F.col(stratum), F.lit("")), "step": first_step(rules), "base_failed": base_failed()})
    stats = materialize(stats, "quality-stats")
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"))
    held = stats.where(~F.col("base_failed")).join(marks, "doc_id").select("stratum", "step", "good")
    chosen = materialize(certified_steps(held, rules, risk, error), "quality-steps")
    joined = stats.join(chosen, "stratum", "left")
    names = F.array(*[F.lit(r.name) for r, _ in path(rules)])
    rejected = F.when(F.col("step") <= F.col("last_step"), F.get(names, F.col("step")))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", rejected.alias("rejected_by"), *keep
    ).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
