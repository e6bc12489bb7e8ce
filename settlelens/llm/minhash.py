"""Near copies by Jaccard similarity of word shingles: MinHash bands propose pairs, the texts decide.

Shingles are runs of five words of the text (A-Z lower-cased). A text has 240 MinHash values in 40 bands of
six; texts with a band in common are candidates. A pair at similarity 0.8 has no band in common with a chance
of 5 in a million, and less above. Candidates are verified on the whole shingle sets, so no link lies below
the similarity, whatever the bands say.

Links are sought until every two members of a bucket are in one component or have been compared: first each
member against the smallest id of its bucket, then against the largest. Buckets whose members still lie in
different components are then gone through inside tasks: a bucket is cut into chunks of bounded size, each
pair of chunks is a task, and the task goes through the pairs of its members, in the first band that two
members share only, and returns a spanning forest of the links it finds. So no join makes pairs, and a large
group of which many members share bands but are no copies is spread over tasks by its chunks. Within a task
the MinHash values (eight bits of each) come before the sets: two members that agree in under 168 of the 240
are not copies; a pair at similarity 0.8 falls under that with a chance of 5 in 100,000.

Links found elsewhere (``given``) count like links of the first step.

Edge cases. A null text counts as empty; texts without words are copies of each other; a text of fewer words
than a shingle is one shingle. Rows without an id take no part and get a null component. Rows that share an
id are one node. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructType

from settlelens.llm.common import components, drop, null_safe_text, written

SEED = 42
SHINGLE = 5
SIMILAR = 0.8
BANDS = 40
ROWS = 6
STEP = 256  # shingles that are hashed by all functions at once

AGREE = 168  # of the MinHash values, for two texts to be compared
CHUNK_BYTES = 4 << 20  # of a chunk of a bucket, two of which make a task

_BANDED = StructType().add("keys", ArrayType(LongType())).add("values", BinaryType())
_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_ODD = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: str, size: int = SHINGLE) -> frozenset[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


@lru_cache(maxsize=16)
def _kept_shingles(text: str) -> frozenset[bytes]:
    return shingles(text)


def similar(a: str, b: str, least: float = SIMILAR) -> bool:
    """Whether the Jaccard similarity of the shingle sets is ``least`` or more."""
    left, right = _kept_shingles(a), _kept_shingles(b)
    if min(len(left), len(right)) < least * max(len(left), len(right)):
        return False
    both = len(left & right)
    return both >= least * (len(left) + len(right) - both)


def shingle_codes(text: str) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text)], dtype=np.uint64)


def band_keys(text: str) -> tuple[np.ndarray, bytes]:
    """One key per band, different from band to band, and eight bits of each MinHash value."""
    import xxhash

    hashes = shingle_codes(text)
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), STEP):
        np.minimum(least, ((hashes[at : at + STEP, None] ^ _XOR) * _ODD).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], dtype=np.uint64).astype(np.int64)
    return keys, (least >> np.uint64(40)).astype(np.uint8).tobytes()


@pandas_udf(_BANDED)
def _keys(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([band_keys(t) for t in texts], columns=["keys", "values"])


@pandas_udf(BinaryType())
def _pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for texts in batches:
        yield pd.Series([press.compress(t.encode("utf-8", "surrogatepass")) for t in texts])


@pandas_udf(BooleanType())
def _similar(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([similar(a, b) for a, b in zip(left, right, strict=True)])


def _verified(pairs: DataFrame, texts: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Those of the pairs (u, v) whose texts are similar, and their folder."""
    left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("u_text"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("v_text"))
    found = pairs.join(left, "u").join(right, "v").where(_similar("u_text", "v_text"))
    return written(found.select("u", "v"), label)


def _pairs(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def chunk_links(pair: pd.DataFrame) -> pd.DataFrame:
    """Links (u, v) between members of two chunks of a bucket, or of one, that join different components.

    A spanning forest: what the links already found hold together is not compared.
    """
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    band = int(pair["band"].iloc[0])
    own = pair["low"].iloc[0] == pair["high"].iloc[0]
    ids, side = pair["doc_id"].to_numpy(), pair["part"].to_numpy() == pair["high"].to_numpy()
    values = np.frombuffer(b"".join(pair["values"]), np.uint8).reshape(len(ids), -1)
    keys = np.stack(pair["prints"].to_numpy())
    label = np.unique(pair["root"].to_numpy(), return_inverse=True)[1]
    codes: dict[int, np.ndarray] = {}

    def code(i: int) -> np.ndarray:
        if i not in codes:
            codes[i] = shingle_codes(unpack(pair["packed"].iloc[i]).decode("utf-8", "surrogatepass"))
        return codes[i]

    links = []
    for i in range(len(ids)):
        others = np.flatnonzero(label != label[i])
        others = others[others > i] if own else others[side[others] & ~side[i]]
        others = others[(values[others] == values[i]).sum(axis=1) >= AGREE]
        others = others[(keys[others] == keys[i]).argmax(axis=1) == band]
        for j in others.tolist():
            if label[i] == label[j]:
                continue
            a, b = code(i), code(j)
            if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
                continue
            either = len(np.unique(np.concatenate((a, b))))
            if len(a) + len(b) - either >= SIMILAR * either:
                links.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return pd.DataFrame(links, columns=["u", "v"], dtype="int64")


def _links_within_buckets(open_: DataFrame, texts: DataFrame) -> tuple[DataFrame, list[str]]:
    """Links between members (band, key, doc_id, root) of open buckets, dealt to tasks by pairs of chunks.

    With the folders that the links are worked out from when they are read.

    Members are dealt by their ids and sizes alone; what tasks compare is joined to them last, so it is
    shuffled once.
    """
    used = texts.join(open_.select("doc_id").distinct(), "doc_id", "left_semi")
    used = used.select("doc_id", _keys("text").alias("m"), _pack("text").alias("packed"))
    # 32 bits of a key are enough to tell the first band that two texts share.
    prints = F.transform("m.keys", lambda k: k.bitwiseAND(0x7FFFFFFF).cast("int")).alias("prints")
    used, used_path = written(used.select("doc_id", prints, "m.values", "packed"), "minhash-packed")
    lengths = used.select("doc_id", (F.length("packed") + 1000).alias("size"))
    sizes = open_.join(lengths, "doc_id").groupBy("key").agg(F.ceil(F.sum("size") / CHUNK_BYTES).cast("int").alias("parts"))
    dealt = open_.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("band", "key", "doc_id", "root", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    dealt, dealt_path = written(dealt, "minhash-dealt")
    rows = dealt.join(used, "doc_id").where(F.get("prints", F.col("band")) == F.col("key").bitwiseAND(0x7FFFFFFF).cast("int"))
    return rows.groupBy("key", "low", "high").applyInPandas(chunk_links, "u bigint, v bigint"), [used_path, dealt_path]


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", given: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id) of every row; a component's id is its smallest document id.

    ``given`` are links (u, v) between ids that hold whatever their similarity is.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), null_safe_text(text_col).alias("text"))
    texts = rows.where("doc_id IS NOT NULL")
    keys = texts.select("doc_id", _keys("text")["keys"].alias("keys"))
    # There always are keys; the outer form keeps the optimizer from a filter on them, which would work them out twice.
    bands, bands_path = written(keys.select("doc_id", F.posexplode_outer("keys").alias("band", "key")), "minhash-bands")
    shared = bands.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    members, members_path = written(bands.join(shared, "key"), "minhash-members")
    drop(docs.sparkSession, bands_path)
    tried, links, roots, spent = None, given, None, [members_path]
    if given is not None:
        roots, roots_path = written(components(given, "minhash-edges").select("node", "root"), "minhash-roots-given")
    for step in ("low", "high", "all"):
        open_, stale = members, []  # folders that nothing reads once the roots of the step are written
        if roots is not None:
            open_ = members.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            open_ = open_.withColumn("root", F.coalesce("root", "doc_id"))
            # Buckets that are one component already are done.
            apart = open_.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
            open_, open_path = written(open_.join(apart, "key"), f"minhash-open-{step}")
            stale += [open_path, roots_path]
        if step == "all":
            found, paths = _links_within_buckets(open_.select("band", "key", "doc_id", "root"), texts)
            stale += paths
        else:
            if step == "low":
                pairs = open_.where("doc_id <> low").select(*_pairs("doc_id", "low"))
            else:
                ends = open_.where("doc_id = high").select("key", F.col("root").alias("high_root")).distinct()
                pairs = open_.join(ends, "key").where("root <> high_root").select(*_pairs("doc_id", "high"))
            pairs = pairs.distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["u", "v"], "left_anti")
            tried, tried_path = written(pairs, f"minhash-pairs-{step}")
            found, found_path = _verified(tried, texts, f"minhash-links-{step}")
            spent.append(tried_path)
            stale.append(found_path)
        links = found if links is None else links.union(found)
        roots, roots_path = written(components(links, "minhash-edges").select("node", "root"), f"minhash-roots-{step}")
        drop(docs.sparkSession, *stale)
        # The stars around the roots hold the same components as all links so far.
        links = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    drop(docs.sparkSession, *spent)
    return rows.join(roots, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.coalesce("root", "doc_id").alias("component_id")
    )
