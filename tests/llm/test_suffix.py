import hashlib
import random

import numpy as np
import pandas as pd

from settlelens.llm import suffix


def test_sort_and_extensions_against_plain_sort():
    rng = random.Random(4)
    for _ in range(60):
        size = [rng.randint(1, 9) for _ in range(rng.randint(1, 6))]
        blobs = [bytes(rng.choices(b"ab", k=rng.randint(6, 30))) for _ in range(sum(size))]
        off = np.array([rng.randint(0, 4) for _ in blobs])
        first = np.cumsum(size) - size
        ctx = suffix.Contexts(blobs, off)
        for left in (False, True):
            order, shared = suffix.suffix_sort(ctx, first, np.array(size), left)
            for f, n in zip(first, size, strict=True):
                texts = [ctx.side_bytes(i, left) for i in order[f : f + n]]
                assert texts == sorted(texts)
                assert list(shared[f : f + n]) == [suffix._common(a, b) for a, b in zip(texts, texts[1:], strict=False)] + [-1]


def test_collisions_are_noticed(monkeypatch):
    monkeypatch.setattr(suffix.PrefixHash, "of", lambda self, start, length: np.zeros(len(start), np.uint64))
    blobs = [b"abcdef", b"abcxyz", b"abcaaa"]
    order, shared = suffix.suffix_sort(suffix.Contexts(blobs, np.array([1, 1, 1])), np.array([0]), np.array([3]), False)
    assert [blobs[i] for i in order] == sorted(blobs) and list(shared) == [2, 2, -1]


def texts():
    rng = random.Random(3)
    make = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    core, base = make(70), [make(60) for _ in range(4)]
    out = [make(rng.randint(0, 40)) + core[rng.randint(0, 20) : rng.randint(50, 70)] + make(rng.randint(0, 40)) + rng.choice(base) for _ in range(60)]
    return out + ["", None, core, core, "a" * 100, "é" * 40]


def test_against_brute_force_with_and_without_many_contexts(spark):
    given = texts()
    frame = pd.DataFrame({"doc_id": [*range(len(given) - 2), None, 7], "text": given}).astype({"doc_id": "Int64"})
    docs = spark.createDataFrame(frame)
    want = sorted(suffix.brute_force(given, 30))
    for many in (2048, 3):
        rows = suffix.without_repeats(docs, length=30, gram=8, many=many).collect()
        assert sorted((r[1], r[2], r[3], hashlib.sha256(r[4]).hexdigest()) for r in rows) == want


def test_edges(edges):
    rows = suffix.without_repeats(edges).collect()
    assert len(rows) == edges.count()
    given = [r["text"] for r in edges.collect()]
    assert sorted((r[1], r[2], r[3], hashlib.sha256(r[4]).hexdigest()) for r in rows) == sorted(suffix.brute_force(given))


def test_empty(nothing):
    assert suffix.without_repeats(nothing).count() == 0
