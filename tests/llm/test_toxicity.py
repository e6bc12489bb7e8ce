import zlib

import numpy as np
import pandas as pd
import pytest

from settlelens.llm import toxicity as T
from settlelens.llm.queries import queries

MIDDLE = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"
GROUPS = (("zorbs", "quills", "mamps"),)


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def quality(out, labels):
    both = labels.merge(out, on="doc_id")
    hit, bad = both["predicted"] == 1, both["toxic"] == 1
    rank = both["score"].rank()
    n1, n0 = bad.sum(), (~bad).sum()
    auc = (rank[bad].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    return (hit & bad).sum() / bad.sum(), (hit & ~bad).sum() / (~bad).sum(), auc


def test_held_out_accuracy(spark):
    """Labels of the corpus have noise: about a tenth of the toxic ones have no toxic word."""
    out = queries()["op12_toxicity"](spark, LARGE).toPandas()
    docs = pd.read_parquet(f"{LARGE}/documents.parquet")
    assert sorted(out["doc_id"]) == sorted(docs["doc_id"]) and out["score"].between(0, 1).all()
    assert (out["held_out"] == out["doc_id"].map(held_out)).all()
    assert (out["predicted"] == (out["score"] >= 0.7)).all()
    recall, false_alarms, auc = quality(out[out["held_out"]], pd.read_parquet(f"{LARGE}/labels.parquet"))
    assert recall > 0.75 and false_alarms < 0.005 and auc > 0.97


def test_held_out_labels_are_never_read(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", T.F.when(T.fold() == T.HELD_OUT, 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    assert T.train(docs, labels) == T.train(docs, turned)


def corpus(rng):
    """Mentions of one group are mostly toxic in the sample, so that a plain classifier blames its name."""
    rows, labels = [], []
    calm, rude = ["warm", "kind", "plain", "green", "early", "quiet"], ["vile", "rotten"]
    for i in range(1500):
        words = [str(w) for w in rng.choice(calm, 6)]
        toxic = i % 3 == 0
        group = "zorbs" if rng.random() < (0.8 if toxic else 0.02) else str(rng.choice(["quills", "mamps"]))
        # Not every toxic text has a word that says so: the group's name is the tempting sign.
        words += [str(rng.choice(rude))] if toxic and rng.random() < 0.6 else []
        rows.append((i, f"The {group} are {' '.join(words)} in row {'x' * (i % 7)}."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_swaps_keep_neutral_mentions_clean(spark):
    rows, labels = corpus(np.random.default_rng(3))
    docs, marks = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(labels, "doc_id int, toxic int")
    plain = T.train(docs, marks, identity=GROUPS, swap_penalty=0.0)
    fair = T.train(docs, marks, identity=GROUPS)
    neutral = [f"The {{}} are {a} and {b}." for a in ("warm", "kind") for b in ("green", "quiet")]
    for sentence in neutral:
        spread = [plain.score(sentence.format(g)) for g in GROUPS[0]]
        assert max(spread) > 0.7  # the plain classifier calls them toxic
        scores = [fair.score(sentence.format(g)) for g in GROUPS[0]]
        assert max(scores) < 0.5 and max(scores) - min(scores) < 0.05
    assert fair.score("The quills are vile and rotten.") > 0.7


def test_swaps_touch_one_term_of_a_sentence():
    found = T.swaps("Zorbs sing. A quiet line.\nThe quills and the zorbs", GROUPS)
    assert len(found) == 9  # one sentence with one term, one with two; two other terms and leaving it out
    for before, after in found:
        assert before != after and "quiet" not in before
    assert ({"zorbs", "zorb*", "sing"}, {"mamps", "mamp*", "sing"}) in found
    assert ({"zorbs", "zorb*", "sing"}, {"sing"}) in found


def test_fit_reaches_the_minimum():
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(80)]
    toxic = (rng.random(80) < np.array([0.8 if 0 in r else 0.2 for r in rows])).astype(float)
    changes = [{0: -1.0, 1: 1.0}, {2: 1.0}]

    def loss(w):
        z = np.array([w[0] + w[1:][r].sum() for r in rows])
        moved = np.array([sum(v * w[1 + k] for k, v in c.items()) for c in changes])
        return (np.logaddexp(0, z) - toxic * z).sum() + 0.3 * np.abs(w[1:]).sum() + 20 * 80 / 2 * (moved**2).sum()

    b, w = T.fit(rows, toxic, changes, 6, lasso=0.3, steps=4000)
    best = np.append(b, w)
    assert abs(w[0] - w[1]) < 1e-2 and abs(w[2]) < 1e-2
    for _ in range(200):
        assert loss(best + rng.normal(0, 10.0 ** rng.integers(-6, 0), 7)) >= loss(best) - 1e-7


def test_edge_rows(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (3, 0), (None, 1), (6, 1), (77, 1)], "doc_id bigint, toxic int")
    out = T.toxicity(edges, labels).toPandas()
    assert len(out) == edges.count() and out["score"].between(0, 1).all() and out["predicted"].isin([0, 1]).all()
    texts = {r["doc_id"]: r["text"] for r in edges.collect()}
    scores = dict(zip(out["doc_id"], out["score"], strict=True))
    assert scores[3] == scores[4] == scores[5] and texts[3] is None  # nothing to read: the intercept
    assert T.toxicity(nothing, labels).count() == 0
    unlabelled = T.toxicity(edges, labels.limit(0)).toPandas()
    assert (unlabelled["score"] == 0.5).all()
    one_kind = T.toxicity(edges, spark.createDataFrame([(6, 1), (8, 1)], "doc_id bigint, toxic int")).toPandas()
    assert one_kind["score"].nunique() == 1


@pytest.mark.parametrize("text", ["", "a", "Ab ab AB", "überall12stehen", "x" * 100_000])
def test_model_scores_by_features(text):
    model = T.Model(0.5, {"ab": 1.0, "über*": -2.0, "xxxx*": 0.25, "stehen": 0.125})
    assert model.logit(text) == pytest.approx(0.5 + sum(model.weights.get(f, 0) for f in T.features(text)))
