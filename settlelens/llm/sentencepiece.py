"""SentencePiece encoding and decoding with the pieces of a model file.

Encoding: the text gets the model's dummy prefix and its spaces become the space mark. An Aho-Corasick
automaton over the pieces reports, at each position, every piece that ends there (its output links); each
relaxes the best score of its end from the best score of its start, so one pass over the text gives the
Viterbi path of the greatest score sum. A character that no piece covers costs a fixed penalty and is
written as byte pieces (or the unknown id if the model has none). Ties: the longest last piece wins.

No piece of the public models crosses from a visible character to a space mark. Where the vocabulary has
that property (it is checked), the best path breaks at every such place, so a text is encoded chunk by
chunk and a chunk seen before is looked up; the table of known chunks is a cache of bounded size that
never changes a result. Otherwise whole texts go through the automaton.

The scores are those of the file. For a unigram model this is the library's own encoding; for a BPE model
file it is the unigram reading of its vocabulary, and ids differ from the library's merge order.

Edge cases. A null or an empty text has no ids and decodes to the empty text. The space mark itself,
U+2581, decodes to a space, so a text that has it does not come back exactly; ``exact`` says so. Repeated
rows, rows without an id and clashing further columns are passed through unchanged by the expressions.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value: below the least score of a piece by so much
CACHE = 120_000  # chunks in each of the two tables of known ones of a Python worker
SLICE = 500  # rows of a batch of results
_PUNCTUATION = ".,;:!?%$&#*|"


class Pieces:
    """The vocabulary of a model file and its automaton."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models without character normalisation are supported")
        self.prefix = MARK if model.normalizer_spec.add_dummy_prefix else ""
        self.texts = [p.piece for p in model.pieces]
        self.bytes_of: dict[int, int] = {}
        self.byte_ids: list[int] = [-1] * 256
        self.unknown = 0
        self.silent = set()
        self.automaton = ahocorasick.Automaton()
        usable, scores = [], []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.bytes_of[i] = int(p.piece[1:-1], 16)
            elif p.type == kinds.UNKNOWN:
                self.unknown = i
            elif p.type == kinds.CONTROL:
                self.silent.add(i)
            elif p.piece:
                self.automaton.add_word(p.piece, (len(p.piece), p.score, i))
                usable.append(p.piece)
                scores.append(p.score)
        self.automaton.make_automaton()
        self.penalty = min(scores, default=0.0) - UNKNOWN_PENALTY
        self.chunked = not any(re.search(f"[^{MARK}]{MARK}", t) for t in usable)
        self.lines = not any("\n" in t for t in usable)
        # Marks that no piece has after a letter: a path always breaks between the two.
        self.tails = "".join(c for c in _PUNCTUATION if not any(a.isalpha() and b == c for t in usable for a, b in zip(t, t[1:], strict=False)))
        surface = [t.replace(MARK, " ").encode() for t in self.texts]
        for i in self.silent:
            surface[i] = b""
        for i, b in self.bytes_of.items():
            surface[i] = bytes([b])
        surface[self.unknown] = " ⁇ ".encode()
        self.surface = surface
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def viterbi(self, marked: str) -> list[int]:
        """Ids of the best path over one marked text or chunk."""
        n = len(marked)
        best = [0.0] * (n + 1)
        came = [-1] * (n + 1)  # id of the last piece; -1: the single character falls back
        size = [1] * (n + 1)
        penalty = self.penalty
        done = 0  # positions up to here have their score
        for end, found in self.automaton.iter(marked):
            end += 1
            while done < end:
                best[done + 1] = best[done] + penalty
                done += 1
            length, score, piece = found
            total = best[end - length] + score
            if total > best[end]:  # longer pieces come first and win ties
                best[end], came[end], size[end] = total, piece, length
        while done < n:
            best[done + 1] = best[done] + penalty
            done += 1
        ids: list[int] = []
        at = n
        while at:
            if came[at] >= 0:
                ids.append(came[at])
            else:
                ids.extend(reversed(self._fallback(marked[at - 1])))
            at -= size[at]
        ids.reverse()
        return ids

    def _fallback(self, char: str) -> list[int]:
        ids = [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown] if min(ids) < 0 else ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        marked = self.prefix + text.replace(" ", MARK)
        if not self.chunked:
            return np.array(self.viterbi(marked), np.int32)
        chunks = self._chunks(marked)
        if len(self.known) > CACHE:  # the chunks of late go on; older ones are looked up once more before they go
            self.older, self.known = self.known, {}
        known = self.known
        for chunk in set(chunks).difference(known):
            stem = chunk.rstrip(self.tails)
            if len(stem) < len(chunk) and stem[-1:].isalpha():
                known[chunk] = self._ids(stem) + self._ids(chunk[len(stem) :])
            else:
                self._ids(chunk)
        return np.frombuffer(b"".join(map(known.__getitem__, chunks)), np.int32)

    def _ids(self, chunk: str) -> bytes:
        found = self.known.get(chunk) or self.older.get(chunk) or array("i", self.viterbi(chunk)).tobytes()
        self.known[chunk] = found
        return found

    def _chunks(self, marked: str) -> list[str]:
        """Parts of the text, cut wherever a space mark follows another character, and at line ends if no piece has one."""
        if MARK + MARK in marked or marked[-1:] == MARK or "\0" in marked:
            return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", marked)
        parts = marked.replace(MARK, "\0" + MARK)
        if self.lines:
            parts = parts.replace("\n", "\0\n\0").replace("\0\0", "\0")
        return parts.strip("\0").split("\0")

    def decode(self, ids) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become replacement characters."""
        surface = self.surface
        out = b"".join([surface[i] for i in ids])
        if self.prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load_pieces(path: str) -> Pieces:
    """One vocabulary per Python worker; the path must lie on every executor, as tokenizer files do."""
    return Pieces(path)


def _in_slices(series: pd.Series) -> Iterator[pd.Series]:
    """Results leave a worker in small batches, whatever the size of those that come in."""
    for at in range(0, len(series), SLICE):
        yield series.iloc[at : at + SLICE]


def encode(text: Column, model_path: str) -> Column:
    """array<int> of piece ids."""

    @pandas_udf("array<int>")
    def spm_encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = load_pieces(model_path)
        for batch in batches:
            for texts in _in_slices(batch):
                yield pd.Series([pieces.encode(t) for t in texts])

    return spm_encode(text)


def decode(ids: Column, model_path: str) -> Column:
    """The text of an array of piece ids; null ids give the empty text."""

    @pandas_udf("string")
    def spm_decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = load_pieces(model_path)
        for batch in batches:
            for lists in _in_slices(batch):
                yield pd.Series([pieces.decode(() if x is None else x.tolist()) for x in lists])

    return spm_decode(ids)


def encode_and_decode(text: Column, model_path: str) -> Column:
    """struct(ids, decoded): the ids of a text and the text decoded from them, in one worker."""

    @pandas_udf("ids array<int>, decoded string")
    def spm_both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = load_pieces(model_path)
        for batch in batches:
            for texts in _in_slices(batch):
                ids = [pieces.encode(t) for t in texts]
                yield pd.DataFrame({"ids": ids, "decoded": [pieces.decode(x.tolist()) for x in ids]})

    return spm_both(text)
