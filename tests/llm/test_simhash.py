import re

import numpy as np
import pandas as pd
import xxhash

from settlelens.llm import common, simhash
from settlelens.llm.common import components


def plain_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, budget=4):
    values, label = np.array(values, dtype=np.uint64), list(range(len(values)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values ^ v) <= budget):
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    out = set()
    for centre in rng.integers(0, 2**64, n, dtype=np.uint64):
        for _ in range(rng.integers(1, 25)):
            value = int(centre)
            for _ in range(rng.integers(0, 9)):
                value ^= 1 << int(rng.integers(0, 64))
            out.add(value)
    return np.array(sorted(out), dtype=np.uint64)


def test_one_trie_with_the_whole_budget():
    for seed in range(5):
        values = clustered(seed, 30)
        assert list(simhash.trie_links(values, None, 0, 4)) == plain_components(values)


def test_dealt_node_pairs_and_chunks(spark, monkeypatch):
    values = clustered(9, 40)
    classes = spark.createDataFrame(pd.DataFrame({"fp": values.astype(np.int64), "rep": np.arange(len(values))}))
    want = plain_components(values)
    for target, chunk in ((4096, 32_768), (64, 32_768), (10**9, 90)):
        monkeypatch.setattr(simhash, "NODE_TARGET", target)
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        links = simhash.near_links(classes).toPandas()
        assert list(simhash._labels(len(values), links.u.to_numpy(), links.v.to_numpy())) == want


def test_edges_that_are_stars_take_no_round(spark, monkeypatch):
    real, rounds = common._large_star, []
    monkeypatch.setattr(common, "_large_star", lambda links: rounds.append(1) or real(links))
    for edges, want in (([(5, 1), (1, 7), (9, 8)], 0), ([(5, 1), (7, 5)], 1)):
        rounds.clear()
        found = components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
        root = {1: 1, 5: 1, 7: 1} | ({8: 8, 9: 8} if want == 0 else {})
        assert {r["node"]: r["root"] for r in found} == root and len(found) == len(root) and len(rounds) == want


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    found = components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()
    roots = {r["node"]: r["root"] for r in found}
    assert len(found) == len(roots) == 41 + 60
    assert all(roots[i] == 0 for i in range(41)) and all(roots[i] == 100 for i in range(100, 160))


def test_edges_against_brute_force(edges):
    rows = sorted(simhash.near_duplicates(edges).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    given = sorted(edges.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    prints = [plain_fingerprint(r["text"]) for r in given]
    assert [r["fingerprint"] for r in rows] == [f"{p:016x}" for p in prints]
    groups = plain_components(prints)
    ids = [r["doc_id"] for r in given]
    least = {g: min((i for i, h in zip(ids, groups, strict=True) if h == g and i is not None), default=None) for g in groups}
    assert [r["component_id"] for r in rows] == [least[g] for g in groups]


def test_rows_without_an_id_link_others(spark, monkeypatch):
    """B lies within four bits of A and of C, A and C further apart."""
    prints = spark.createDataFrame([(1, 0b1111), (None, 0), (2, 0b11110000), (9, -1), (None, 1 << 40)], "doc_id bigint, fp bigint")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: prints)
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(prints).collect()}
    assert got == {
        (1, "000000000000000f"): 1, (None, "0000000000000000"): 1, (2, "00000000000000f0"): 1,
        (9, "f" * 16): 9, (None, "0000010000000000"): 1,
    }


def test_other_budgets(spark):
    values = clustered(4, 20)
    classes = spark.createDataFrame(pd.DataFrame({"fp": values.astype(np.int64), "rep": np.arange(len(values))}))
    for budget in (0, 1, 7):
        links = simhash.near_links(classes, budget).toPandas()
        assert list(simhash._labels(len(values), links.u.to_numpy(), links.v.to_numpy())) == plain_components(values, budget)


def test_empty(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
