import random
import re
import time

import numpy as np
import pytest

from settlelens.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_patterns_against_plain_search():
    random.seed(0)
    for _ in range(20_000):
        text = "".join(random.choices("0123456789012345..@@-+ ()aé%\n", k=random.randint(1, 60)))
        assert pii.pattern_spans(text)[0] == plain(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a.b@" * 50_000, "+1(" * 50_000, "1.1." * 60_000):
        began = time.time()
        pii.pattern_spans(text)
        assert time.time() - began < 5


def test_gradients():
    rng = np.random.default_rng(0)
    model = pii.Tagger.fresh(rng, 3)
    x, y, mask = rng.integers(0, pii.N_CHARS, (3, 7)), np.zeros((3, 7), int), np.ones((3, 7), bool)
    y[0, 2:5], y[1, 0:2], mask[1, 5:] = [1, 2, 2], [3, 4], False
    _, grads = model.gradients(x, y, mask)
    for key, w in model.w.items():
        at = (x[0, 2], 1) if key[0] == "x" else (1, 2) if key == "trans" else tuple(rng.integers(0, s) for s in w.shape)
        kept, values = w[at], []
        for step in (1e-5, -1e-5):
            w[at] = kept + step
            values.append(model.gradients(x, y, mask)[0])
        w[at] = kept
        assert abs((values[0] - values[1]) / 2e-5 - grads[key][at]) < 1e-5


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return pii.train(pii.sample_windows(docs.where("doc_id % 2 = 0")))


def test_held_out_recall_and_clean_texts(spark, model):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 1").limit(2000).collect()]
    want = {(i, *s) for i, t in enumerate(texts) for s in pii.pattern_spans(t)[0]}
    got = {(i, *s) for i, spans in enumerate(pii.model_spans(model, texts)) for s in spans}
    assert len(want & got) / len(want) > 0.8
    clean = ["no data here version 3.0 and 2.1 of 2024-01-02", "plain prose", 'token = "08813ad77930c5f691325605b62c9dfd1b407297"']
    assert all(both == [] for _, both in pii.all_spans(model, clean))


def test_windows_are_reconciled(model):
    text = "and so on " * 30 + "mail anna.berg@mail.example.com now " + "and so on " * 30
    classes = [pii.char_classes(text)]
    blended = pii.region_emissions(model, classes)[0]
    assert blended.shape == (len(text), pii.N_TAGS) and np.isfinite(blended).all()


def test_base_spans_stay_and_edges(edges, model):
    found = {r["doc_id"]: r for r in pii.find_personal_data(edges, model).collect()}
    spans = [(s["kind"], s["start"], s["stop"]) for s in found[6]["base"]]
    assert [k for k, _, _ in spans] == ["email", "phone", "ip"]
    assert {(s["kind"], s["start"], s["stop"]) for s in found[6]["spans"]} >= set(spans)
    assert found[3]["spans"] == [] and found[4]["spans"] == []
    assert pii.personal_data_digests(edges).count() == edges.count()


def test_empty(nothing):
    assert pii.personal_data_digests(nothing).count() == 0
    assert pii.train(["nothing here"]) is None


def test_sample_is_distinct_and_holds_rare_spans(spark):
    texts = [f"General Public License, version {k}." for k in range(3) for _ in range(700)]
    texts += [f"room {k} of the old house" for k in range(1500)]
    texts += [f"write to user{k}@mail.example.com today" for k in range(3)]
    texts += ["page 1 of 2, line 3, " * 12 + "call +1 (555) 010-2030 now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    windows = pii.sample_windows(docs)
    assert len(windows) == len(set(windows)) == pii.SAMPLE
    spans = [s for w in windows for s in pii.pattern_spans(w)[0]]
    assert sorted(k for k, _, _ in spans) == ["email"] * 3 + ["phone"]
    assert pii.windows_of("1 " * 30 + "+1 (555) 010-2030 " * 20)[0].endswith(" ")


def test_long_regions_are_decoded_in_overlapping_pieces():
    for end in (1, 2048, 2304, 2305, 10_000):
        parts = pii.pieces_of(7, 7 + end)
        own = [(a, b) for _, _, a, b in parts]
        assert own[0][0] == 7 and own[-1][1] == 7 + end and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
        assert all(s <= a and b <= e and e - s <= pii.PIECE + 2 * pii.OVERLAP for s, e, a, b in parts)


def test_a_long_text_of_numbers_takes_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    text = " ".join(map(str, rng.integers(0, 60, 140_000)))
    assert len(pii.regions(text)) == 1 and len(text) > 390_000
    model = pii.Tagger.fresh(np.random.default_rng(0))
    tracemalloc.start()
    pii.model_spans(model, [text, ""])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
