import random

import corpus_pipeline
import pandas as pd

from settlelens.llm import minhash
from tests.llm.conftest import SMALL
from tests.llm.test_simhash import plain_components, plain_fingerprint


def plain_groups(texts):
    sets = []
    for t in texts:
        words = t.encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)})
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def near_groups(texts):
    """Components of both rules: Jaccard 0.8 of 5-word shingles, and fingerprints of them within four bits."""
    sets, prints = plain_groups(texts), plain_components([plain_fingerprint(t, 5) for t in texts])
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for other in (sets, prints):
            for i, j in enumerate(other):
                low = min(label[i], label[j])
                changed |= label[i] != low or label[j] != low
                label[i] = label[j] = low
    return label


def planted():
    """Texts with copies in which words are replaced at any rate, and a large group around one text."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for k in range(50):
        base = [word() for _ in range(rng.randrange(6, 300))]
        texts.append(" ".join(base))
        for _ in range(60 if k == 0 else 3):
            copy = list(base)
            for at in rng.sample(range(len(base)), max(1, int(len(base) * rng.random() * 0.04))):
                copy[at] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_near_copies_against_brute_force(spark):
    small = pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id").text.fillna("").tolist()
    for texts in (planted(), small):
        rows = minhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
        got = {r["doc_id"]: r["component_id"] for r in rows}
        want = plain_groups(texts)
        assert [got[i] for i in range(len(texts))] == want and len(set(want)) < len(texts)


def test_a_hot_bucket_is_dealt_in_chunks(spark, monkeypatch):
    """Texts that share half or so of their words with all others, some with four fifths of them."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(160):
        own = list(base)
        start = rng.randrange(0, 300)
        own[start : start + 60] = [f"x{k}y{i}" for i in range(60)]
        texts.append(" ".join(own))
        if k % 4 == 0:
            own[rng.randrange(400)] = "other"
            texts.append(" ".join(own))
    want = plain_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    calls = []
    real = minhash._links_within_buckets
    monkeypatch.setattr(minhash, "_links_within_buckets", lambda *a: calls.append(1) or real(*a))
    for size in (minhash.CHUNK_BYTES, 40_000):
        monkeypatch.setattr(minhash, "CHUNK_BYTES", size)
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_copies(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert 1 < len(set(want)) < len(texts) and len(calls) == 2


def test_given_links_hold(spark):
    texts = ["a b c d e f", "u v w x y z", "k l m n o p"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    given = spark.createDataFrame([(2, 0), (None, 1)], "u bigint, v bigint")
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_copies(docs, given=given).collect()} == {(0, 0), (1, 1), (2, 0)}


def test_stage_removes_copies_beyond_four_bits(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert kept == set(near_groups(texts)) and len(set(plain_groups(texts))) < len(texts)


def test_edges(edges, nothing):
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_copies(edges).collect()}
    # 1 and 2 are equal; 3, 4 and 5 have no words
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (None, None), (8, 8)} <= got
    assert minhash.near_copies(nothing).count() == 0
