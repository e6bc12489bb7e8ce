"""Toxicity scores by a classifier that swaps of identity terms must not move.

Features of a text are its words (runs of letters, lower-cased) and the beginnings of 4 to 7 letters of
longer words, each counted as present or absent, whatever the length of the text. The vocabulary holds the
features whose presence is tied most to the label by the likelihood ratio; the model is logistic regression
on them, with a lasso penalty against chance words.

The counterfactual part. A sentence of a labelled text that has an identity term (``IDENTITY``, by groups)
is written again with each other term of the same group in its place. The squared change of the score that
such swaps make, averaged over the swaps and weighted by ``swap_penalty``, is part of what is minimised. A
group that is mentioned mostly in toxic texts of the sample then lends no score to neutral mentions of it:
what its term gains over the other terms of its group is penalised away, and the words around it, which a
swap leaves as they are, carry the score. As the terms of a group share one weight then, a group's own
weight would be left free; so a sentence with its term left out is one more swap.

The fit is on a bounded sample: the ``sample`` labelled texts with the smallest digests of their ids, each
different text once, as many swaps at most, and ``vocabulary`` features. It runs on the driver over the sample's features in
the vocabulary. Scores cover every whole text, in tasks.

Edge cases. A null text counts as empty; a text without features gets the score of the intercept. Rows
without an id have no label and are not held out. Null labels do not count; a document labelled twice is
toxic if any label says so. Equal texts with unequal labels count once, as toxic. Without labels of both
kinds every score is the smoothed share of toxic labels (a half without any). Repeated rows each get a row.
An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from settlelens.llm.common import drop, null_safe_text, written

SAMPLE = 20_000  # labelled texts that fit the model
VOCABULARY = 4_096
MIN_TEXTS = 3  # of a feature, in the sample
LASSO = 0.5
REFIT = 0.1
SWAP_PENALTY = 20.0
STEPS = 500
PIECE = 256  # texts whose features are counted at a time
CUTOFF = 0.7
FOLDS, HELD_OUT = 3, 1

# Terms that name people by what they are; those of one row stand for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("immigrants", "foreigners", "refugees", "natives", "citizens"),
    ("old", "young", "elderly"),
    ("deaf", "blind", "disabled", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("ausländer", "einwanderer", "flüchtlinge", "deutsche"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "athées"),
    ("immigrés", "étrangers", "réfugiés", "français"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"),
    ("inmigrantes", "extranjeros", "refugiados", "españoles"),
)

WORDS = re.compile(r"[^\W\d_]+")
SENTENCES = re.compile(r"[.!?\n]+")
BEGINNINGS = (4, 5, 6, 7)


def features(text: str) -> set[str]:
    """Words and, marked with a star, beginnings of longer words."""
    words = set(WORDS.findall(text.lower()))
    out = set(words)
    for n in BEGINNINGS:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


def swaps(text: str, identity=IDENTITY) -> list[tuple[set[str], set[str]]]:
    """Feature sets of each sentence with an identity term, before and after each swap of one of its terms."""
    groups = {t: g for g in identity for t in g}
    out = []
    for sentence in SENTENCES.split(text.lower()):
        words = WORDS.findall(sentence)
        for term in sorted(groups.keys() & set(words)):
            before = features(sentence)
            others = [t for t in groups[term] if t != term]
            out += [(before, features(" ".join(o if w == term else w for w in words))) for o in [*others, ""]]
    return out


@dataclass
class Model:
    intercept: float
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.lengths = sorted({len(f) - 1 for f in self.weights if f.endswith("*")})

    def logit(self, text: str) -> float:
        total, weights = self.intercept, self.weights
        if not weights:
            return total
        words = set(WORDS.findall(text.lower()))
        total += sum(weights[w] for w in sorted(words & weights.keys()))
        for n in self.lengths:
            starts = {w[:n] + "*" for w in words if len(w) > n}
            total += sum(weights[s] for s in sorted(starts & weights.keys()))
        return total

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-self.logit(text))))


def fit(rows: list[np.ndarray], toxic: np.ndarray, changes: list[dict[int, float]], size: int, lasso=LASSO, swap_penalty=SWAP_PENALTY, steps=STEPS):
    """Intercept and weights that minimise log loss + lasso + swap penalty, by accelerated proximal gradient.

    ``rows`` has the feature numbers of each text, ``changes`` what each swap adds to and takes off a sentence.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    c_at = np.array([i for i, c in enumerate(changes) for _ in c], dtype=np.int64)
    c_col = np.array([k for c in changes for k in c], dtype=np.int64)
    c_val = np.array([v for c in changes for v in c.values()], dtype=np.float64)
    n, m = len(rows), max(len(changes), 1)
    pull = swap_penalty * n / m  # the mean over swaps, on the scale of the summed log loss

    def products(w):
        return np.bincount(at, w[1:][col], n) + w[0], np.bincount(c_at, c_val * w[1:][c_col], len(changes))

    def gradient(w):
        z, moved = products(w)
        miss = 1 / (1 + np.exp(-z)) - toxic
        g = np.empty(size + 1)
        g[0] = miss.sum()
        g[1:] = np.bincount(col, miss[at], size) + 2 * pull * np.bincount(c_col, c_val * moved[c_at], size)
        return g

    # The largest curvature, by power iteration.
    v = np.ones(size + 1)
    for _ in range(30):
        z, moved = products(v)
        u = np.concatenate(([z.sum()], np.bincount(col, z[at], size))) / 4
        u[1:] += 2 * pull * np.bincount(c_col, c_val * moved[c_at], size)
        curve = float(np.linalg.norm(u)) or 1.0
        v = u / curve
    step = 1 / (1.1 * curve)
    share = (toxic.sum() + 1) / (n + 2)
    w = np.zeros(size + 1)
    w[0] = np.log(share / (1 - share))
    y, t = w.copy(), 1.0
    for _ in range(steps):
        new = y - step * gradient(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * lasso, 0)
        if (y - new) @ (new - w) > 0:  # restart the momentum where it points the wrong way
            t = 1.0
        turn = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, w, t = new + (t - 1) / turn * (new - w), new, turn
    return w[0], w[1:]


def fold(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def _feature_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(feature, texts, toxic texts) of a few hundred texts at a time."""
    for frame in frames:
        for at in range(0, len(frame), PIECE):
            part = frame.iloc[at : at + PIECE]
            texts, toxic = Counter(), Counter()
            for text, mark in zip(part["body"], part["toxic"], strict=True):
                found = features(text)
                texts.update(found)
                if mark:
                    toxic.update(found)
            yield pd.DataFrame({"feature": list(texts), "c": list(texts.values()), "a": [toxic[f] for f in texts]})


def _vocabulary(sample: DataFrame, vocabulary: int, least: int) -> list[str]:
    """The features tied most to the label by the likelihood ratio of the 2x2 table of presence and label."""
    whole = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    n, k = whole["n"], whole["k"] or 0
    if not 0 < k < n:
        return []
    counts = sample.select("toxic", "body").mapInPandas(_feature_counts, "feature string, c bigint, a bigint")
    counts = counts.groupBy("feature").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))

    def cell(found, rows, columns):
        return F.when(found > 0, found * F.log(found * F.lit(float(n)) / (rows * columns))).otherwise(0.0)

    a, c = F.col("a").cast("double"), F.col("c").cast("double")
    toxic, clean = F.lit(float(k)), F.lit(float(n - k))
    ratio = cell(a, c, toxic) + cell(c - a, c, clean) + cell(toxic - a, n - c, toxic) + cell(clean - c + a, n - c, clean)
    best = counts.where(F.col("c") >= least).orderBy(F.round(ratio, 6).desc(), "feature").limit(vocabulary)
    return [r["feature"] for r in best.select("feature").collect()]


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    vocabulary: int = VOCABULARY,
    swap_penalty: float = SWAP_PENALTY,
    lasso: float = LASSO,
    least: int = MIN_TEXTS,
    identity=IDENTITY,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> Model:
    """The model learnt from those labels that are not held out."""
    spark = docs.sparkSession
    known = labels.where(f"{id_col} IS NOT NULL AND toxic IS NOT NULL").groupBy(id_col).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(fold(id_col) != HELD_OUT)
    body = null_safe_text(text_col)
    texts = docs.select(F.col(id_col), F.sha2(body.cast("binary"), 256).alias("digest"), body.alias("body"))
    key = F.md5(F.col(id_col).cast("string").cast("binary"))
    # Digests alone are shuffled and ordered; copies are one row.
    distinct = texts.select(id_col, "digest").join(known, id_col).groupBy("digest").agg(
        F.max("toxic").alias("toxic"), F.min(F.struct(key.alias("key"), F.col(id_col).alias("id"))).alias("first")
    )
    chosen = distinct.orderBy("first", "digest").limit(sample).select(F.col("first")["id"].alias(id_col), "digest", "toxic")
    chosen, chosen_path = written(chosen, "toxicity-chosen")
    # At most ``sample`` rows of an id, a digest and a label are broadcast, so that no text is shuffled but those chosen.
    found = texts.join(F.broadcast(chosen), [id_col, "digest"])
    table, path = written(found.dropDuplicates(["digest"]).select("digest", "toxic", "body"), "toxicity-sample")
    names = _vocabulary(table, vocabulary, least)
    number = {f: i for i, f in enumerate(names)}

    @pandas_udf("array<int>")
    def numbers(column: pd.Series) -> pd.Series:
        return column.map(lambda text: [number[f] for f in sorted(features(text) & number.keys())])

    @pandas_udf("array<array<int>>")
    def changes(column: pd.Series) -> pd.Series:
        """Of each swap the numbers of the features it takes off, negative and less one, and of those it adds."""

        def one(text):
            both = [(before - after, after - before) for before, after in swaps(text, identity)]
            moved = [[-number[f] - 1 for f in sorted(lost & number.keys())] + [number[f] for f in sorted(won & number.keys())] for lost, won in both]
            return [m for m in moved if m]

        return column.map(one)

    # At most ``sample`` rows of at most ``vocabulary`` numbers.
    rows = table.select("digest", "toxic", numbers("body").alias("numbers")).orderBy("digest").collect()
    swapped = table.select("digest", F.explode(changes("body")).alias("change"))
    swapped = swapped.orderBy(F.xxhash64("digest", "change"), "digest", "change").limit(sample).collect()
    pairs = [{-k - 1 if k < 0 else k: -1.0 if k < 0 else 1.0 for k in r["change"]} for r in swapped]
    drop(spark, chosen_path, path)
    toxic = np.array([r["toxic"] for r in rows], dtype=np.float64)
    if not names:
        share = (toxic.sum() + 1) / (len(toxic) + 2)
        return Model(float(np.log(share / (1 - share))))
    matrix = [np.array(r["numbers"], dtype=np.int64) for r in rows]
    _, weights = fit(matrix, toxic, pairs, len(names), lasso, swap_penalty)
    # The lasso chooses features but also shrinks their weights; those chosen are fitted again under a tenth of it.
    chosen = weights != 0
    place = np.cumsum(chosen) - 1
    matrix = [place[r[chosen[r]]] for r in matrix]
    pairs = [{int(place[k]): v for k, v in c.items() if chosen[k]} for c in pairs]
    names = [f for f, use in zip(names, chosen, strict=True) if use]
    intercept, weights = fit(matrix, toxic, pairs, len(names), lasso * REFIT, swap_penalty)
    return Model(float(intercept), {f: float(w) for f, w in zip(names, weights, strict=True) if w})


def scored(docs: DataFrame, model: Model, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(model.score).astype(float)

    out = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(fold(id_col) == HELD_OUT, F.lit(False)).alias("held_out"),
        score(null_safe_text(text_col)).alias("score"),
    )
    return out.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return scored(docs, train(docs, labels, **options))
