"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: words of the text (A-Z lower-cased) form shingles; a bit is set when over half of the
shingle hashes have it. Equal fingerprints are collapsed first, so that exact copies cost one row.

Join: the bits are cut into one block more than the ``budget``; two fingerprints within it have at least
one block equal. So there is a trie for each block, over the fingerprints rotated until the block leads, and
each is joined with itself along pairs of nodes that are equal down to the end of the block. Fingerprints are
dealt by trie and by the node they lie under at a depth within the block, one row for each trie. A task
goes down pairs of nodes together, adds up differing bits and drops a pair as soon as it exceeds the
budget, or when everything below both nodes is in one component already. Tasks return a spanning forest
instead of all pairs; the forests are joined to components by distributed star contraction.

Nodes with very many fingerprints are split into chunks and dealt as pairs of chunks, so no task holds
more than two chunks.

Edge cases. A null text counts as empty; texts without words share the fingerprint zero, linked like any
other; a text of fewer words than a shingle is hashed as one shingle. Repeated rows each get a row. Rows
without an id take part like any other, also as the only link between others, and get the smallest id of
their component, null if it has none. An
empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from settlelens.llm.common import components, drop, materialize, null_safe_text, written

SEED = 42
SHINGLE = 4
BUDGET = 4
NODE_TARGET = 4096  # fingerprints of a trie node that is dealt out whole
CHUNK = 32_768  # most fingerprints of one side of a task
DIRECT = 32  # pairs under two nodes that are compared at once instead of going further down


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text, unsigned."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(body, SEED)], dtype=np.uint64)
    else:
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
        digest = xxhash.xxh64_intdigest
        spans = zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(body[a:b], SEED) for a, b in spans), np.uint64, len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long."""

    @pandas_udf("bigint")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).astype(np.int64))

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), simhash(null_safe_text(text_col)).alias("fp"))


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block, as even as can be; any pair within the budget has one of them equal."""
    n = min(budget + 1, 64)
    return [(64 * k // n, 64 * (k + 1) // n - 64 * k // n) for k in range(n)]


def _rotated(fp: np.ndarray, by: int) -> np.ndarray:
    return (fp << np.uint64(by)) | (fp >> np.uint64(64 - by)) if by else fp


def _deal(depths: list[int], chunks: dict[tuple[int, int], int], blocks: list[tuple[int, int]]):
    """Rows (trie, node, p1, p2, side, fp, rep): of each trie one, or one for each pair of chunks of a large node."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp, rep = frame["fp"].to_numpy().astype(np.uint64), frame["rep"].to_numpy()
            for trie, (first, _) in enumerate(blocks):
                own, depth = _rotated(fp, first), depths[trie]
                node = (own >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(own), np.int64)
                parts = np.array([chunks.get((trie, n), 1) for n in node.tolist()], dtype=np.int64)
                # Any even spread of a node over its chunks will do, as long as all tasks agree on it.
                part = (((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % parts.astype(np.uint64)).astype(np.int64)
                for q in range(int(parts.max(initial=1))):
                    use = q < parts
                    p = part[use]
                    yield pd.DataFrame(
                        {
                            "trie": trie, "node": node[use], "p1": np.minimum(p, q), "p2": np.maximum(p, q),
                            "side": np.where(p <= q, 0, 1), "fp": fp[use].astype(np.int64), "rep": rep[use],
                        }
                    )

    return run


def _labels(n: int, u: np.ndarray, v: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of each component of a graph on 0..n-1."""
    label = np.arange(n) if start is None else start.copy()
    while True:
        lu, lv = label[u], label[v]
        low = np.minimum(lu, lv)
        if (lu == lv).all():
            return label
        np.minimum.at(label, lu, low)
        np.minimum.at(label, lv, low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump


def _ends_of_runs(label: np.ndarray) -> np.ndarray:
    """For each index the end of the run of equal labels it lies in."""
    n = len(label)
    last = np.flatnonzero(np.append(label[1:] != label[:-1], True)) + 1
    return last[np.searchsorted(last, np.arange(n), side="right")]


def trie_links(a: np.ndarray, b: np.ndarray | None, depth: int, budget: int, equal: int = 0) -> np.ndarray:
    """Component labels over the fingerprints under a trie node, those of ``a`` or those of ``a`` against ``b``.

    Pairs within ``budget`` that agree in the ``equal`` leading bits are linked; others within it may be.
    ``a`` and ``b`` are sorted and distinct; the node lies at ``depth``. Labels are indexes into a, then b.
    """
    same = b is None
    values = a if same else np.concatenate((a, b))
    na, n = len(a), len(values)
    cum = {}
    for level in range(depth, 64):
        bit = ((values >> np.uint64(63 - level)) & np.uint64(1)).astype(np.int32)
        cum[level] = np.concatenate(([0], np.cumsum(bit, dtype=np.int32)))
    label = np.arange(n)
    # Rising radius: what is joined at a small radius lets whole subtrees be skipped at the next.
    for radius in range(budget + 1):
        run_end = _ends_of_runs(label)
        if same:
            state = [np.array([x]) for x in (0, n, 0, n, 0)]
        else:
            state = [np.array([x]) for x in (0, na, na, n, 0)]
        for level in range(depth, 65):
            alo, ahi, blo, bhi, diff = state
            small = (ahi - alo) * (bhi - blo) <= DIRECT if level < 64 else np.ones(len(alo), bool)
            if small.any():
                u, v = _compare(values, [x[small] for x in state], radius)
                if len(u):
                    label = _labels(n, u, v, label)
                    run_end = _ends_of_runs(label)
            rest = ~small
            if not rest.any():
                break
            alo, ahi, blo, bhi, diff = (x[rest] for x in state)
            c = cum[level]
            amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
            own = (alo == blo) & (ahi == bhi)
            cross = (diff + 1 <= radius) & (level >= equal)
            parts = (
                (alo, amid, blo, bmid, diff, np.ones(len(alo), bool)),
                (amid, ahi, bmid, bhi, diff, np.ones(len(alo), bool)),
                (alo, amid, bmid, bhi, diff + 1, cross),
                (amid, ahi, blo, bmid, diff + 1, cross & ~own),
            )
            kept = []
            for plo, phi, qlo, qhi, d, go in parts:
                go = go & (phi > plo) & (qhi > qlo)
                p, q = plo[go], qlo[go]
                done = (run_end[p] >= phi[go]) & (run_end[q] >= qhi[go]) & (label[p] == label[q])
                kept.append([x[go][~done] for x in (plo, phi, qlo, qhi, d)])
            state = [np.concatenate(x) for x in zip(*kept, strict=True)]
            if not len(state[0]):
                break
    return label


def _compare(values: np.ndarray, state: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked index pairs under small node pairs, compared whole."""
    alo, ahi, blo, bhi, _ = state
    wide = bhi - blo
    sizes = (ahi - alo) * wide
    found_u, found_v = [], []
    edges = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), 1 << 20))
    for lo, hi in zip(edges, np.append(edges[1:], len(sizes)), strict=True):
        s = sizes[lo:hi]
        pair = np.repeat(np.arange(lo, hi), s)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(s) - s, s)
        u, v = alo[pair] + k // wide[pair], blo[pair] + k % wide[pair]
        near = (u != v) & (np.bitwise_count(values[u] ^ values[v]) <= radius)
        found_u.append(u[near])
        found_v.append(v[near])
    return np.concatenate(found_u), np.concatenate(found_v)


def _join_pair(depths: list[int], blocks: list[tuple[int, int]], budget: int):
    def run(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.drop_duplicates(["side", "fp"])
        trie = int(pair["trie"].iloc[0])
        first, bits = blocks[trie]
        own = _rotated(pair["fp"].to_numpy().astype(np.uint64), first)
        rep, side = pair["rep"].to_numpy(), pair["side"].to_numpy()
        if pair["p1"].iloc[0] == pair["p2"].iloc[0]:
            order = np.argsort(own)
            label = trie_links(own[order], None, depths[trie], budget, bits)
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            left, right = left[np.argsort(own[left])], right[np.argsort(own[right])]
            order = np.concatenate((left, right))
            if not len(left) or not len(right):
                label = np.arange(len(order))
            else:
                label = trie_links(own[left], own[right], depths[trie], budget, bits)
        rep = rep[order]
        tied = label != np.arange(len(label))
        return pd.DataFrame({"u": rep[tied], "v": rep[label[tied]]})

    return run


def near_links(classes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Links (u, v) between representatives whose components are those of all pairs within the budget.

    ``classes`` has one row per distinct fingerprint: fp and rep, its representative.
    """
    blocks = _blocks(budget)
    wanted = max(0, int(classes.count() / NODE_TARGET).bit_length())
    depths = [min(bits, wanted) for _, bits in blocks]

    def node(first: int, depth: int):
        turned = F.shiftleft("fp", first).bitwiseOR(F.shiftrightunsigned("fp", 64 - first)) if first else F.col("fp")
        return F.shiftrightunsigned(turned, 64 - depth) if depth else F.lit(0).cast("bigint")

    places = [F.struct(F.lit(k).alias("trie"), node(first, depths[k]).alias("node")) for k, (first, _) in enumerate(blocks)]
    sizes = classes.select(F.explode(F.array(*places)).alias("at")).groupBy("at").count().where(F.col("count") > CHUNK)
    # As many rows as there are blocks times nodes of a block at most, whatever the number of fingerprints.
    chunks = {(r["at"]["trie"], r["at"]["node"]): -(-r["count"] // CHUNK) for r in sizes.collect()}
    dealt = classes.mapInPandas(_deal(depths, chunks, blocks), "trie int, node bigint, p1 bigint, p2 bigint, side int, fp bigint, rep bigint")
    return dealt.groupBy("trie", "node", "p1", "p2").applyInPandas(_join_pair(depths, blocks, budget), "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; a component's id is its smallest document id."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    groups, groups_path = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes")
    # Fingerprints are linked by themselves, so that those of rows without an id hold others together as well.
    roots = components(near_links(groups.select("fp", F.col("fp").alias("rep")), budget), "simhash-links")
    merged = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    merged, merged_path = written(merged, "simhash-merged")
    ids = merged.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialize(merged.join(ids, "root").select("fp", "component_id"), "simhash-components")
    drop(docs.sparkSession, groups_path, merged_path)
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
