"""Removal of repeated byte strings by hash-compared suffix sorting.

Every string of ``length`` bytes (400) that starts in two or more places, in one document or in several,
is removed wherever it stands. Strings are compared as bytes of the UTF-8 text, within documents.

1. Anchors. Each start of a window of ``length`` bytes is tied to the gram in its window with the least
   hash (the leftmost of equal ones). Equal windows are tied to equal grams at equal distances, so only
   starts with the same gram can match; neighbouring starts that share one form a run, whose bytes are its
   context. About two runs in ``length`` bytes leave a document, whatever repeats.
2. Grams and contexts are counted. A context that occurs twice is repeated as a whole. Where one gram has
   several contexts, one copy of each is fetched.
3. Suffix sort. The contexts of a gram are sorted by what follows the gram, and again by what precedes it,
   in a mergesort whose comparisons find the common extension of two suffixes by binary search over prefix
   polynomial hashes; common extensions of neighbours are then verified byte by byte, and a group with a
   collision is sorted by its bytes. A window at distance d is repeated where two contexts agree on d bytes
   before and length - d bytes after the start of the gram, which the extensions of neighbours tell.
4. Grams with very many contexts are not sorted in one task: their windows are counted in the cluster,
   first what all windows of a block of distances have in common, then single windows where that is shared.
5. Covered bytes go back to the documents and are cut out.

Contexts and, for the grams of step 4, windows are identified by their length and two 64-bit hashes of different
families: a polynomial one, which structured texts could defeat, and XXH64.

Edge cases. A null text counts as empty; a text shorter than ``length`` loses nothing. Rows of one id are
told apart by their text; repeated rows are documents of their own, and so repeat each other. Rows
without an id take part like any other. An empty table gives an empty result. Cut bytes may leave invalid
UTF-8; results are bytes. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from settlelens.llm.common import materialize, null_safe_text

LENGTH = 400
GRAM = 48
SEED = 42
SEGMENT = 1 << 18  # starts worked on at a time
MANY = 2_048  # contexts of a gram that one task sorts
TOGETHER = 1_024  # contexts that a task sorts in one go
VERIFY = 1 << 18  # bytes compared at a time
BLOCK = 16  # distances of a block in step 4
ROWS = 1 << 17  # class rows worked on at a time in a task

_U = np.uint64


# ---- polynomial prefix hashes modulo 2**64, with random codes for bytes


@lru_cache(maxsize=2)
def _codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse; one table per seed, made anew when a longer one is asked for."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < size:
        base = int(np.random.default_rng(seed + 1000).integers(1, 1 << 62)) * 2 + 1
        have = _POWERS[seed] = (_power_table(base, size), _power_table(pow(base, -1, 1 << 64), size))
    return have


def _power_table(x: int, size: int) -> np.ndarray:
    out = np.ones(size, dtype=np.uint64)
    done, step = 1, x
    while done < size:
        n = min(done, size - done)
        out[done : done + n] = out[:n] * _U(step)
        done, step = done + n, step * step % (1 << 64)
    return out


class PrefixHash:
    """Hash of any stretch of a byte array in constant time."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        size = 1 << max(18, int(len(data)).bit_length())
        powers, self.inverse = _powers(seed, size)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_codes(seed)[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def xxh64_of(data: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """XXH64 of stretches of a byte array, as signed longs."""
    import xxhash

    digest, view = xxhash.xxh64_intdigest, memoryview(np.ascontiguousarray(data))
    ends = (start + length).tolist()
    return np.fromiter((digest(view[a:b], SEED) for a, b in zip(start.tolist(), ends, strict=True)), np.uint64, len(start)).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    n = len(key)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = key
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - width + 1
    return np.minimum(behind[:last], ahead[width - 1 : width - 1 + last])


def runs_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of window starts of one document: gram and context hashes, start, number of starts, place of the gram."""
    out: dict[str, list] = {k: [] for k in ("gram", "c1", "c2", "start", "run", "off")}
    mask = _U((1 << 20) - 1)
    for lo in range(0, max(0, len(data) - length + 1), SEGMENT):
        piece = data[lo : lo + SEGMENT + length - 1]
        one = PrefixHash(piece)
        grams = _mix(one.of(np.arange(len(piece) - gram + 1), gram))
        key = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        least = (_sliding_least(key, length - gram + 1) & mask).astype(np.int64)
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        run = np.diff(np.append(first, len(least)))
        size = run + length - 1
        out["gram"].append(grams[least[first]].astype(np.int64))
        out["c1"].append(_mix(one.of(first, size) + size.astype(np.uint64)).astype(np.int64))
        out["c2"].append(xxh64_of(piece, first, size))
        out["start"].append(first + lo)
        out["run"].append(run)
        out["off"].append(least[first] - first)
    return {k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in out.items()}


# ---- suffix sort of the contexts of many grams at once


class Contexts:
    """Contexts laid end to end, with the place of the gram in each."""

    def __init__(self, blobs: list[bytes], off: np.ndarray):
        self.data = np.frombuffer(b"".join(blobs), np.uint8)
        size = np.array([len(b) for b in blobs], dtype=np.int64)
        self.begin = np.cumsum(size) - size
        self.at = self.begin + off
        self.after, self.before = size - off, off
        self.hash = PrefixHash(self.data)

    def extension(self, i: np.ndarray, j: np.ndarray, left: bool) -> np.ndarray:
        """Bytes that contexts i and j have in common after (before) the start of the gram."""
        limit = np.minimum(self.before[i], self.before[j]) if left else np.minimum(self.after[i], self.after[j])
        a, b = self.at[i], self.at[j]
        low, high = np.zeros(len(i), np.int64), limit.copy()
        for _ in range(int(limit.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.hash.of(a - mid if left else a, mid) == self.hash.of(b - mid if left else b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def less(self, i: np.ndarray, j: np.ndarray, left: bool, ties: np.ndarray) -> np.ndarray:
        """Whether context i comes before j; equal ones do where ``ties`` says so."""
        common = self.extension(i, j, left)
        side = self.before if left else self.after
        ended_i, ended_j = common == side[i], common == side[j]
        step = -1 - common if left else common
        top = len(self.data) - 1
        x = self.data[np.clip(self.at[i] + step, 0, top)]
        y = self.data[np.clip(self.at[j] + step, 0, top)]
        return np.where(ended_i & ended_j, ties, np.where(ended_i, True, np.where(ended_j, False, x < y)))

    def agree(self, i: np.ndarray, j: np.ndarray, common: np.ndarray, left: bool) -> np.ndarray:
        """Verification: whether the common extensions hold byte by byte."""
        out = np.ones(len(i), bool)
        whole = np.append(0, np.cumsum(common))
        edges = np.unique(np.searchsorted(whole, np.arange(0, whole[-1] + 1, VERIFY)))
        for lo, hi in zip(edges, np.append(edges[1:], len(i)), strict=True):
            lo, hi = min(lo, len(i)), min(hi, len(i))
            if lo == hi:
                continue
            n = common[lo:hi]
            pair = np.repeat(np.arange(lo, hi), n)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            step = -1 - k if left else k
            out[pair[self.data[self.at[i[pair]] + step] != self.data[self.at[j[pair]] + step]]] = False
        return out

    def side_bytes(self, i: int, left: bool) -> bytes:
        a = self.at[i]
        return self.data[a - self.before[i] : a][::-1].tobytes() if left else self.data[a : a + self.after[i]].tobytes()


def suffix_sort(ctx: Contexts, first: np.ndarray, size: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """Order of the contexts of each group (rows first..first+size) and the extension shared with the next in order.

    A bottom-up mergesort of all groups together: each element finds its rank in the run it is merged with.
    """
    total = int(size.sum())
    group = np.repeat(np.arange(len(size)), size)
    order = np.arange(total)
    place = np.arange(total) - first[group]  # in the group's order
    width = 1
    while width < size.max(initial=1):
        busy = np.flatnonzero(size[group] > width)
        g = group[busy]
        mine = place[busy] // width
        other_lo = (mine ^ 1) * width
        other_hi = np.minimum(other_lo + width, size[g])
        there = other_lo < size[g]
        low, high = np.where(there, other_lo, 0), np.where(there, other_hi, 0)
        low0 = low.copy()
        element = order[busy]
        second = (mine & 1).astype(bool)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            rival = order[first[g[open_]] + mid]
            # An element of the second run goes after equal ones of the first.
            before = ctx.less(rival, element[open_], left, second[open_])
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        start = (mine >> 1) * 2 * width
        target = start + (place[busy] - mine * width) + (low - low0)
        merged = order.copy()
        merged[first[g] + target] = element
        order = merged
        width *= 2
    follows = np.flatnonzero(np.append(group[1:] == group[:-1], False))
    shared = np.full(total, -1, np.int64)
    i, j = order[follows], order[follows + 1]
    common = ctx.extension(i, j, left)
    shared[follows] = common
    wrong = ~ctx.agree(i, j, common, left)
    for g in np.unique(group[follows[wrong]]):  # a hash collision: sort the group by its bytes
        rows = slice(first[g], first[g] + size[g])
        own = sorted(range(first[g], first[g] + size[g]), key=lambda r: ctx.side_bytes(r, left))
        order[rows] = own
        texts = [ctx.side_bytes(r, left) for r in own]
        shared[rows] = [*(_common(a, b) for a, b in zip(texts, texts[1:], strict=False)), -1]
    return order, shared


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def repeated_windows(
    ctx: Contexts, first: np.ndarray, size: np.ndarray, run: np.ndarray, off: np.ndarray, length: int = LENGTH
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, from, to): byte stretches of contexts that windows shared with another context of the group cover."""
    after_order, after = suffix_sort(ctx, first, size, False)
    before_order, before = suffix_sort(ctx, first, size, True)
    group = np.repeat(np.arange(len(size)), size)
    # Classes of equal windows change with the distance d only where an extension of neighbours sets in or ends.
    pairs = after >= 0
    starts = np.concatenate((length - after[pairs], before[before >= 0] + 1))
    owner = np.concatenate((group[pairs], group[before >= 0]))
    top_d = np.maximum.reduceat(off, first) + 1
    low_d = np.minimum.reduceat(off - run + 1, first)
    best_after, best_before = np.maximum.reduceat(after, first), np.maximum.reduceat(before, first)
    low_d = np.maximum(low_d, length - best_after)
    top_d = np.minimum(top_d, best_before + 1)
    inside = (starts > low_d[owner]) & (starts < top_d[owner])
    alive = np.flatnonzero(low_d < top_d)
    cut_g = np.concatenate((owner[inside], alive))
    cut_d = np.concatenate((starts[inside], low_d[alive]))
    cut = np.unique(cut_g * (2 * length + 2) + cut_d)
    cut_g, cut_d = cut // (2 * length + 2), cut % (2 * length + 2)
    end_d = np.where(np.append(cut_g[1:] == cut_g[:-1], False), np.append(cut_d[1:], 0), top_d[cut_g])
    found = []
    weight = np.cumsum(size[cut_g])
    edges = np.unique(np.searchsorted(weight, np.arange(0, (weight[-1] if len(weight) else 0) + 1, ROWS)))
    for lo, hi in zip(edges, np.append(edges[1:], len(cut_g)), strict=True):
        g, d, e = cut_g[lo:hi], cut_d[lo:hi], end_d[lo:hi]
        if not len(g):
            continue
        n = size[g]
        block = np.repeat(np.arange(len(g)), n)
        row = first[g][block] + np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
        dd = d[block]

        def classes(order, shared, need, row=row, block=block):
            """Class of each context, by row: a new one wherever neighbours share less than needed."""
            same = np.append(False, (shared[row] >= need)[:-1]) & np.append(False, block[1:] == block[:-1])
            number = np.cumsum(~same)
            out = np.empty(len(row), np.int64)
            base = row - order[row]  # where the context of this rank lies, relative to its rank
            out[np.arange(len(row)) - base] = number
            return out

        ac, bc = classes(after_order, after, length - dd), classes(before_order, before, dd)
        bc -= bc.min()
        both = ac * (int(bc.max()) + 1) + bc
        _, back, count = np.unique(both, return_inverse=True, return_counts=True)
        i = row
        fits = (count[back] > 1) & (dd <= off[i]) & (dd > off[i] - run[i])
        ee = np.minimum(e[block], off[i] + 1)
        found.append((i[fits], (off[i] - ee + 1)[fits], (off[i] - dd + length)[fits]))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# ---- jobs

_KEY = ["gram", "c1", "c2"]
_DOC = ["doc_id", "text_code"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = null_safe_text(text_col)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_code"), text.alias("text"))


def _packed(keyed: DataFrame) -> DataFrame:
    """Texts as compressed UTF-8 bytes: what joins shuffle is then less than the input."""

    @pandas_udf("binary")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for texts in batches:
            yield pd.Series([press.compress(t.encode("utf-8", "surrogatepass")) for t in texts])

    return keyed.select("doc_id", "text_code", pack("text").alias("packed"))


def _nullable_ids(column: pd.Series) -> pd.Series:
    return column.astype("Int64")


def anchor_table(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts, who, size = [], [], 0
            for k, text in enumerate(frame["text"]):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                if len(data) < length:
                    continue
                runs = runs_of(data, length, gram)
                parts.append(runs)
                who.append(np.full(len(runs["run"]), k))
                size += len(runs["run"])
                if size > 100_000:
                    yield _anchor_frame(frame, parts, who)
                    parts, who, size = [], [], 0
            if parts:
                yield _anchor_frame(frame, parts, who)

    fields = "doc_id bigint, text_code bigint, gram bigint, c1 bigint, c2 bigint, start bigint, run int, off int"
    return keyed.where(F.octet_length("text") >= length).mapInPandas(cut, fields)


def _anchor_frame(frame: pd.DataFrame, parts: list, who: list) -> pd.DataFrame:
    who = np.concatenate(who)
    out = {"doc_id": _nullable_ids(frame["doc_id"]).iloc[who].reset_index(drop=True), "text_code": frame["text_code"].to_numpy()[who]}
    return pd.DataFrame(out | {k: np.concatenate([p[k] for p in parts]) for k in ("gram", "c1", "c2", "start", "run", "off")})


def fetch_contexts(keyed: DataFrame, wanted: DataFrame, length: int = LENGTH) -> DataFrame:
    """The bytes of wanted contexts (gram, c1, c2, run, off and the place of one copy)."""
    lists = wanted.groupBy(*_DOC).agg(F.collect_list(F.struct("gram", "c1", "c2", "n", "run", "off", "start")).alias("list"))
    lists = lists.withColumnsRenamed({"doc_id": "d2", "text_code": "t2"})
    joined = _packed(keyed).join(lists, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_code") == F.col("t2")))

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for frame in frames:
            rows = []
            for packed, listed in zip(frame["packed"], frame["list"], strict=True):
                data = unpack(packed)
                for x in listed:
                    at = x["start"]
                    rows.append((x["gram"], x["c1"], x["c2"], x["n"], x["run"], x["off"], data[at : at + x["run"] + length - 1]))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=[*_KEY, "n", "run", "off", "bytes"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=[*_KEY, "n", "run", "off", "bytes"])

    fields = "gram bigint, c1 bigint, c2 bigint, n bigint, run int, off int, bytes binary"
    return joined.select("packed", "list").mapInPandas(fetch, fields)


def sorted_groups(contexts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(gram, c1, c2, a, b): covered stretches of contexts, from a suffix sort within each gram."""

    def resolve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(_KEY).reset_index(drop=True)
        gram = frame["gram"].to_numpy()
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        size = np.diff(np.append(first, len(gram)))
        off, run = frame["off"].to_numpy().astype(np.int64), frame["run"].to_numpy().astype(np.int64)
        ctx = Contexts(frame["bytes"].tolist(), off)
        i, a, b = repeated_windows(ctx, first, size, run, off, length)
        keep = frame["n"].to_numpy()[i] < 2  # the others are covered as a whole
        i, a, b = i[keep], a[keep], b[keep]
        return pd.DataFrame({**{k: frame[k].to_numpy()[i] for k in _KEY}, "a": a, "b": b})

    def run_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat((held, frame), ignore_index=True)
            whole = frame["gram"] != frame["gram"].iloc[-1]  # the last gram may go on in the next batch
            held = frame[~whole]
            yield from in_parts(frame[whole])
        if held is not None and len(held):
            yield from in_parts(held)

    def in_parts(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Whole grams together, about TOGETHER contexts at a time."""
        gram = frame["gram"].to_numpy()
        ends = np.flatnonzero(np.append(gram[1:] != gram[:-1], True)) + 1 if len(gram) else np.empty(0, np.int64)
        start = 0
        while start < len(gram):
            end = int(ends[min(np.searchsorted(ends, start + TOGETHER), len(ends) - 1)])
            yield resolve(frame.iloc[start:end])
            start = end

    dealt = contexts.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInPandas(run_partition, "gram bigint, c1 bigint, c2 bigint, a int, b int")


def counted_groups(contexts: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """As sorted_groups, for grams with very many contexts: windows are counted by their hashes in the cluster."""

    def emit(level: str):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), 512):
                    part = frame.iloc[at : at + 512]
                    rows = []
                    for r in part.itertuples(index=False):
                        data = np.frombuffer(r.bytes, np.uint8)
                        one = PrefixHash(data)
                        low, high = r.off - r.run + 1, r.off  # distances of the context
                        if level == "blocks":
                            q = np.arange(low // block, high // block + 1)
                            d, e = q * block, q * block + block - 1
                            core = (r.off - d, length - e + d)
                            full = (d >= low) & (e <= high)
                            hull = (np.where(full, r.off - e, 0), np.where(full, length + block - 1, 0))
                            cols = [h for s in (core, hull) for h in (one.of(*s).astype(np.int64), xxh64_of(data, *s))]
                            rows.append(pd.DataFrame({"q": q, "k1": cols[0], "k2": cols[1], "full": full, "h1": cols[2], "h2": cols[3]}))
                        else:
                            d = np.concatenate([np.arange(max(low, q * block), min(high, q * block + block - 1) + 1) for q in r.qs])
                            cols = [one.of(r.off - d, length).astype(np.int64), xxh64_of(data, r.off - d, length)]
                            rows.append(pd.DataFrame({"d": d, "k1": cols[0], "k2": cols[1]}))
                        for k in (*_KEY, "off"):
                            rows[-1][k] = getattr(r, k)
                    yield pd.concat(rows, ignore_index=True)

        return run

    keys = "gram bigint, c1 bigint, c2 bigint"
    blocks = contexts.mapInPandas(emit("blocks"), f"q int, k1 bigint, k2 bigint, full boolean, h1 bigint, h2 bigint, {keys}, off int")
    blocks = materialize(blocks.dropDuplicates([*_KEY, "q"]), "suffix-blocks")
    shared = blocks.groupBy("gram", "q", "k1", "k2").count().where("count > 1").drop("count")
    live = blocks.join(shared, ["gram", "q", "k1", "k2"])
    twice = blocks.where("full").groupBy("gram", "q", "h1", "h2").agg(F.count("*").alias("c"), F.min(F.struct("c1", "c2")).alias("one"))
    twice = twice.where("c > 1").drop("c").withColumn("full", F.lit(True))
    live = live.join(twice, ["gram", "q", "h1", "h2", "full"], "left")
    live = materialize(live.select(*_KEY, "off", "q", "one"), "suffix-live")
    whole = live.where("one IS NOT NULL").select(
        *_KEY, (F.col("off") - F.col("q") * block - (block - 1)).alias("a"), (F.col("off") - F.col("q") * block + length).alias("b")
    )
    # One context stands for each repeated block, so that others can match its windows.
    open_ = live.where("one IS NULL OR one = struct(c1, c2)").groupBy(*_KEY).agg(F.collect_set("q").alias("qs"))
    windows = contexts.join(open_, _KEY).mapInPandas(emit("windows"), f"d int, k1 bigint, k2 bigint, {keys}, off int")
    windows = materialize(windows.dropDuplicates([*_KEY, "d"]), "suffix-windows")
    again = windows.groupBy("gram", "d", "k1", "k2").count().where("count > 1").drop("count")
    single = windows.join(again, ["gram", "d", "k1", "k2"]).select(
        *_KEY, (F.col("off") - F.col("d")).alias("a"), (F.col("off") - F.col("d") + length).alias("b")
    )
    # Neighbouring windows of a context make one stretch.
    return whole.union(single).groupBy(*_KEY).agg(F.collect_list(F.struct("a", "b")).alias("s")).select(*_KEY, F.inline("s"))


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    many: int = MANY,
) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans and the remaining bytes ``kept``."""
    keyed = _keyed(docs, id_col, text_col)
    anchors = materialize(anchor_table(keyed, length, gram), "suffix-anchors")
    grams = anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    # Written before the join, so that both its sides are plain exchanges and a common gram can be split.
    grams = materialize(grams, "suffix-grams")
    anchors = materialize(anchors.join(grams, "gram", "left_semi"), "suffix-shared")
    copy = F.struct("doc_id", "text_code", "start")
    contexts = anchors.groupBy(*_KEY, "run", "off").agg(F.count("*").alias("n"), F.min(copy).alias("copy"))
    contexts = materialize(contexts, "suffix-contexts")
    kinds = materialize(contexts.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"), "suffix-kinds")
    wanted = contexts.join(kinds, "gram").select(*_KEY, "run", "off", "n", "kinds", "copy.*")
    wanted = materialize(wanted, "suffix-wanted")
    few = fetch_contexts(keyed, wanted.where(F.col("kinds") <= many), length)
    parts = materialize(sorted_groups(few, length), "suffix-stretches")
    if not wanted.where(F.col("kinds") > many).isEmpty():
        lots = materialize(fetch_contexts(keyed, wanted.where(F.col("kinds") > many), length), "suffix-many")
        parts = parts.union(materialize(counted_groups(lots, length), "suffix-counted"))
    whole = contexts.where("n > 1").select(*_KEY, F.lit(0).alias("a"), (F.col("run") + length - 1).alias("b"))
    covered = parts.groupBy(*_KEY).agg(F.collect_list(F.struct("a", "b")).alias("s"))
    covered = covered.union(whole.select(*_KEY, F.array(F.struct("a", "b")).alias("s")))
    covered = materialize(covered, "suffix-covered")
    hits = anchors.select(*_KEY, *_DOC, "start").join(covered, _KEY)
    moved = F.transform("s", lambda x: F.struct((F.col("start") + x["a"]).alias("a"), (F.col("start") + x["b"]).alias("b")))
    holes = hits.groupBy(*_DOC).agg(F.flatten(F.collect_list(moved)).alias("holes"))
    holes = materialize(holes.withColumnsRenamed({"doc_id": "d2", "text_code": "t2"}), "suffix-holes")
    same = F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_code") == F.col("t2"))
    joined = _packed(keyed).join(holes, same, "left")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for frame in frames:
            rows = []
            for packed, holes in zip(frame["packed"], frame["holes"], strict=True):
                data = np.frombuffer(unpack(packed), np.uint8)
                if holes is None or not len(holes):
                    rows.append((len(data), 0, 0, data.tobytes()))
                    continue
                depth = np.zeros(len(data) + 1, np.int64)
                np.add.at(depth, [h["a"] for h in holes], 1)
                np.add.at(depth, [h["b"] for h in holes], -1)
                gone = np.cumsum(depth[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((len(data), int(gone.sum()), spans, data[~gone].tobytes()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            out.insert(0, "doc_id", _nullable_ids(frame["doc_id"]).to_numpy())
            yield out

    fields = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    return joined.select("doc_id", "packed", "holes").mapInPandas(cut, fields)


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by looking at every window; for tests."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for p in range(len(d) - length + 1):
            seen[d[p : p + length]] = seen.get(d[p : p + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
