"""Token ids in bit-plane files.

Documents are dealt to tasks by ranges of their id and sorted; each task encodes its documents, appends
an end id to each, and writes one shard file. A shard is a row of chunks of a fixed number of ids. The ids
of a chunk are transposed into planes (all bits, or all bytes, of one weight together), and each plane is
compressed with zstandard by itself, or stored as it is if that is smaller. After the chunks come the
document table (ids and lengths) and the chunk index, so a reader can fetch any chunk without the others.

    chunk   planes, from the lowest weight up
    tail    document table, chunk index (JSON, zstandard)
    footer  tail offset, tail length (8 bytes each, little-endian), magic

Files go to a temporary name first and are renamed, so a retried or doubled task leaves one whole file.
Shards are numbered in id order; a manifest table has one row per shard.

Encoding cuts the texts of many documents into parts, numbers the different ones and looks each up once before it calls the tokenizer. The byte-level pattern always breaks
before a single space between two visible characters, around a single line break between two, and between
a letter and a run of plain punctuation, so encoding the parts gives the ids of the whole.

A literal special token of the file in a text, such as ``<|endoftext|>``, becomes its one id in the jobs, as
the library has it by default. No cut falls inside one; files whose special tokens could be cut, or depend on
their neighbours, are encoded whole.

Edge cases. A null text counts as empty: it has the end id alone. Rows without an id come first and keep
a null id. Rows of one id are ordered by their text. An empty table gives no shard and an empty result.
Further columns are not read. A path that cannot be opened fails the job.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from settlelens.llm.common import fresh_dir, null_safe_text

MAGIC = b"BPLANE01"
BLOCK = 65_536  # ids in a chunk
LEVEL = 3
UNIT = 8  # bits of a plane: bytes of ids compress better than single bits, which zstandard cannot model
END_ID = 0
CACHE = 300_000  # parts of text in each of the two tables of known ones of a Python worker
GROUP = 8 << 20  # characters of documents that are encoded together

_PUNCTUATION = ".,;:!?%$&#*|"
_BREAK = np.isin(np.arange(256), [10, 32])
_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])  # bytes that are a space by themselves
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the byte-level form shows as themselves
_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SEEN)}
_WIDE = {n: np.array([int.from_bytes(c.encode()) for c in map(chr, range(128, 0x10000)) if c.isspace() and len(c.encode()) == n]) for n in (2, 3)}


# ---- planes


def to_planes(ids: np.ndarray, unit: int = 1) -> list[bytes]:
    """Planes of ``unit`` bits (1 or 8) from the lowest weight up, as many as the largest id needs."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if unit == 8:
        table = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [table[:, k].tobytes() for k in range(-(-top // 8))]
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & np.uint8(1)).tobytes() for k in range(top)]


def from_planes(planes: list[bytes], n: int, unit: int = 1) -> np.ndarray:
    ids = np.zeros(n, dtype=np.uint32)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        part = raw if unit == 8 else np.unpackbits(raw, count=n)
        ids |= part.astype(np.uint32) << np.uint32(k * unit)
    return ids


# ---- files


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes ids and document lengths of one shard as they come."""

    def __init__(self, stream, unit: int = UNIT, block: int = BLOCK, level: int = LEVEL):
        import zstandard

        self.stream, self.unit, self.block = stream, unit, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.at = 0
        self.chunks: list[list] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            self._flush(False)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        end = len(ids) if last else len(ids) - len(ids) % self.block
        for lo in range(0, end, self.block):
            part = ids[lo : min(lo + self.block, end)].astype(np.uint32)
            offset, sizes = self.at, []
            for plane in to_planes(part, self.unit):
                packed = self.pack(plane)
                stored = packed if len(packed) < len(plane) else plane
                sizes.append(len(stored) if stored is packed else -len(stored))
                self._put(stored)
            self.chunks.append([len(part), offset, sizes])
            self.n_ids += len(part)
        self.waiting, self.n_waiting = [ids[end:]], len(ids) - end

    def finish(self) -> int:
        """Writes the tail; returns the size of the file."""
        self._flush(True)
        tail = {"unit": self.unit, "chunks": self.chunks, "doc_ids": self.doc_ids, "lengths": self.lengths}
        packed = self.pack(json.dumps(tail, separators=(",", ":")).encode())
        start = self.at
        self._put(packed)
        self._put(struct.pack("<QQ", start, len(packed)) + MAGIC)
        return self.at


class ShardReader:
    """Reads a shard: its document table, and any of its chunks."""

    def __init__(self, stream):
        import zstandard

        self.stream = stream
        self.unpack = zstandard.ZstdDecompressor()
        stream.seek(0, 2)
        size = stream.tell()
        stream.seek(size - 24)
        footer = stream.read(24)
        if footer[16:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        start, length = struct.unpack("<QQ", footer[:16])
        stream.seek(start)
        tail = json.loads(self.unpack.decompress(stream.read(length)))
        self.unit, self.chunks = tail["unit"], tail["chunks"]
        self.doc_ids, self.lengths = tail["doc_ids"], tail["lengths"]

    def chunk(self, k: int) -> np.ndarray:
        n, offset, sizes = self.chunks[k]
        self.stream.seek(offset)
        whole = n if self.unit == 8 else -(-n // 8)
        planes = []
        for size in sizes:
            data = self.stream.read(abs(size))
            planes.append(data if size < 0 else self.unpack.decompress(data, max_output_size=whole))
        return from_planes(planes, n, self.unit)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, ids) of each document; one document and one chunk are held at a time."""
        held, k = np.empty(0, np.uint32), 0
        for doc_id, length in zip(self.doc_ids, self.lengths, strict=True):
            parts, have = [held], len(held)
            while have < length:
                parts.append(self.chunk(k))
                have += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, held[:length]
            held = held[length:]


# ---- encoding


def _wide_space(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Whether a space of ``size`` bytes stands at each place; places outside the data have none."""
    code = np.zeros(len(at), np.int64)
    for k in range(size):
        code = code << 8 | data[np.clip(at + k, 0, len(data) - 1)]
    return np.isin(code, _WIDE[size]) & (at >= 0) & (at + size <= len(data))


class Encoder:
    """Ids of whole texts by a tokenizer file of the byte-level kind; ``plain`` takes special tokens as plain text."""

    def __init__(self, path: str, plain: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        model = json.loads(self.tokenizer.to_str())
        kind, usual = model["pre_tokenizer"], {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.parted = self.tokenizer.normalizer is None and all(kind.get(k, v) == v for k, v in usual.items())
        self.parted = self.parted and all(map(self.stays_whole, model["added_tokens"]))
        self.model = self.tokenizer.model
        self.plain_words = not any(token["content"].isalpha() for token in model["added_tokens"])

    @staticmethod
    def stays_whole(token: dict) -> bool:
        """Whether no cut falls inside an added token, and none changes how it is found."""
        text = token["content"]
        apart = token["single_word"] or token["lstrip"] or token["rstrip"] or "\0" in text
        return not apart and not re.search(r"\s", text) and text[-1:] not in _PUNCTUATION

    @staticmethod
    def one_word(part: str) -> bool:
        """Whether a part is Latin letters after a space or none: one match of the pattern, whatever version of Unicode it has."""
        return (part[1:] if part[:1] == " " else part).isalpha() and (part.isascii() or max(part) < "\u0250")

    def _word(self, part: str) -> bytes:
        """Ids of one match of the pattern, which goes to the model as it is."""
        shown = part.replace(" ", "\u0120") if part.isascii() else part.encode().decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    @staticmethod
    def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the parts of the texts start that lie end to end in ``data`` (UTF-8) from ``starts`` on.

        Parts are words with the space before them, and line breaks; the pattern always breaks at their edges.
        """
        edge = np.zeros(len(data) + 1, bool)  # where a text starts or ends: no neighbour across it counts as visible
        edge[starts] = edge[-1] = True
        at = np.flatnonzero(_BREAK[data])
        at = at[~edge[at] & ~edge[at + 1]]
        at = at[~_SPACE[data[at - 1]] & ~_SPACE[data[at + 1]]]
        high = np.flatnonzero((data[at - 1] >= 128) | (data[at + 1] >= 128))  # spaces of several bytes may stand there
        near = at[high]
        wide = _wide_space(data, near - 3, 3) | _wide_space(data, near - 2, 2) | _wide_space(data, near + 1, 3) | _wide_space(data, near + 1, 2)
        at = np.delete(at, high[wide])
        edge[at] = True
        edge[at[data[at] == 10] + 1] = True
        return np.flatnonzero(edge[:-1])

    @staticmethod
    def finer(part: str) -> tuple[str, str] | None:
        """A word and the plain punctuation after it, if that is what the part is."""
        stem = part.rstrip(_PUNCTUATION)
        if len(stem) < len(part) and stem[-1:].isalpha():
            return stem, part[len(stem) :]
        return None

    def look_up(self, parts: list[str]) -> list[bytes]:
        """Ids of different parts."""
        if len(self.known) > CACHE:  # the parts of late go on; older ones are looked up once more before they go
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        got = list(map(known.get, parts))
        where = [k for k, ids in enumerate(got) if ids is None]
        found = {parts[k] for k in where}
        again = found & older.keys()
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        lacking, halves = [], []
        for p in found - again:
            if p[-1:] in _PUNCTUATION and (pair := self.finer(p)):
                halves.append((p, pair))
            else:
                lacking.append(p)
        for q in {q for _, pair in halves for q in pair}.difference(known):
            if q in older:
                known[q] = older[q]
            else:
                lacking.append(q)
        words = set(filter(self.one_word, lacking)) if self.plain_words else set()
        known.update((w, self._word(w)) for w in words)
        lacking = list(set(lacking) - words)
        known.update(zip(lacking, self._raw(lacking), strict=True))
        for p, (stem, tail) in halves:
            known[p] = known[stem] + known[tail]
        for k in where:
            got[k] = known[parts[k]]
        return got

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each different part of the texts is looked up once; the texts are put together from the parts' ids."""
        if not self.parted:
            return [np.frombuffer(b, np.uint32) for b in self._raw(texts)]
        import pyarrow as pa

        column = pa.array(texts, pa.large_string())
        bounds = np.frombuffer(column.buffers()[1], np.int64, len(texts) + 1)
        if bounds[-1] == 0:
            return [np.empty(0, np.uint32) for _ in texts]
        data = column.buffers()[2]
        begin = self.cuts(np.frombuffer(data, np.uint8, bounds[-1]), np.unique(bounds[:-1][bounds[:-1] < bounds[-1]]))
        parts = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, bounds[-1])), data).dictionary_encode()
        ids = self.look_up(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        code = parts.indices.to_numpy()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        n = size[code]
        ends = np.cumsum(n)
        flat = np.frombuffer(b"".join(ids), np.uint32)
        whole = flat[np.repeat(first[code] - ends + n, n) + np.arange(ends[-1])]
        return np.split(whole, np.append(0, ends)[np.searchsorted(begin, bounds[1:-1])])


@lru_cache(maxsize=2)
def load_encoder(path: str) -> Encoder:
    """One tokenizer per Python worker; the path must lie on every executor, as tokenizer files do."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, plain=False)


# ---- jobs


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT
) -> DataFrame:
    """Writes the shards and the manifest under ``folder`` (a URI); returns the manifest table.

    Manifest: shard, path, n_docs, n_ids, n_bytes and ``start``, the ids of all shards before.
    """
    end = np.array([END_ID], dtype=np.uint32)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        encoder = load_encoder(tokenizer)
        task = TaskContext.get()
        name = f"{folder}/shard-{task.partitionId():06d}.tok"
        system, path = _file_system(name)
        trial = f"{path}.{task.taskAttemptId()}"
        writer = None
        for frame in frames:
            for _, part in frame.groupby(frame["text"].str.len().cumsum() // GROUP):
                ids = encoder.encode(part["text"].tolist())
                for doc_id, found in zip(part["doc_id"].tolist(), ids, strict=True):
                    if writer is None:
                        system.create_dir(path.rpartition("/")[0], recursive=True)
                        stream = system.open_output_stream(trial)
                        writer = ShardWriter(stream, unit)
                    writer.add(None if pd.isna(doc_id) else int(doc_id), np.concatenate((found, end)))
        if writer is None:
            return
        size = writer.finish()
        stream.close()
        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_file(path)
        system.move(trial, path)
        yield pd.DataFrame(
            {"shard": [task.partitionId()], "path": [name], "n_docs": [len(writer.lengths)], "n_ids": [writer.n_ids], "n_bytes": [size]}
        )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), null_safe_text(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInPandas(write, "shard bigint, path string, n_docs bigint, n_ids bigint, n_bytes bigint")
    spark = docs.sparkSession
    shards.write.parquet(f"{folder}/shards")
    # One row per task of the job above, which the driver has to hold anyway.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.parquet(f"{folder}/shards").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files under ``folder``: doc_id, start, n_tokens, ids_crc32 and, if asked, ids."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start in zip(frame["path"], frame["start"], strict=True):
                system, place = _file_system(path)
                with system.open_input_file(place) as stream:
                    rows, n = [], 0
                    for doc_id, ids in ShardReader(stream).documents():
                        row = (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        rows.append((*row, ids.astype(np.int64)) if with_ids else row)
                        start += len(ids)
                        n += len(ids) * with_ids + 1
                        if n >= 1 << 20:
                            yield _frame(rows, with_ids)
                            rows, n = [], 0
                    yield _frame(rows, with_ids)

    manifest = spark.read.parquet(f"{folder}/manifest")
    spread = manifest.select("path", "start").repartition(max(1, manifest.count()))
    fields = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return spread.mapInPandas(read, fields)


def _frame(rows: list[tuple], with_ids: bool) -> pd.DataFrame:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the files of a whole table to the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "tokens")
    if folder.startswith("/"):
        folder = f"file://{folder}"
    write_token_files(docs, tokenizer, folder)
    return read_token_files(spark, folder)
