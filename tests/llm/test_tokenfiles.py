import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from settlelens.llm import tokenfiles

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


def test_parts_give_the_ids_of_the_whole(library):
    random.seed(1)
    alphabet = [" ", "\n", "\t", "a", "é", "1", ".", ",", "'", "s", "!", "|", " ", "中", "  ", "\r", "\xa0"]
    texts = ["", "it's don't' 's !!\n\nfoo. Bar baz  \n x", "<|endoftext|> a", "foo,'s bar.'ll", "Ⅷ. ②, x² y½.", "x\x1cy z"]
    texts += ["".join(random.choices(alphabet, k=random.randint(1, 14))) for _ in range(5000)]
    own = [x.tolist() for x in tokenfiles.Encoder(FILE).encode(texts)]
    assert own == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_jobs_give_the_librarys_default_ids_of_special_tokens(spark):
    random.seed(2)
    pieces = ["<|endoftext|>", "<|endoftext|", " ", "\n", "a", ".", "'s", "|>", "!", "1", "  "]
    texts = ["<|endoftext|>", "so it ends.<|endoftext|>\nIt goes on", "a <|endoftext|>, b"]
    texts += ["".join(random.choices(pieces, k=random.randint(1, 10))) for _ in range(2000)]
    default = Tokenizer.from_file(FILE)
    want = [e.ids for e in default.encode_batch(texts, add_special_tokens=False)]
    assert tokenfiles.load_encoder(FILE).parted and 50256 in want[0]
    assert [x.tolist() for x in tokenfiles.load_encoder(FILE).encode(texts)] == want
    docs = spark.createDataFrame(list(enumerate(texts[:50])), "doc_id bigint, text string")
    rows = sorted(tokenfiles.token_digests(docs, FILE).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_tokens"], r["ids_crc32"]) for r in rows] == [
        (len(w) + 1, zlib.crc32(np.array([*w, 0], dtype="<u4").tobytes())) for w in want[:50]
    ]


@pytest.mark.parametrize("unit", [1, 8])
def test_planes_and_files_come_back(unit):
    rng = np.random.default_rng(2)
    for top in (1, 255, 256, 50_256, 2**32 - 1):
        ids = rng.integers(0, top, 1001, dtype=np.uint32, endpoint=True)
        assert (tokenfiles.from_planes(tokenfiles.to_planes(ids, unit), len(ids), unit) == ids).all()
    stream, docs = io.BytesIO(), [rng.integers(0, 50_000, n, dtype=np.uint32) for n in (0, 5, 999, 1, 2500, 0)]
    writer = tokenfiles.ShardWriter(stream, unit, block=1000)
    for k, ids in enumerate(docs):
        writer.add(k or None, ids)
    writer.finish()
    reader = tokenfiles.ShardReader(stream)
    back = list(reader.documents())
    assert [k for k, _ in back] == [None, 1, 2, 3, 4, 5] and all((a == b).all() for (_, a), b in zip(back, docs, strict=True))
    assert (reader.chunk(2) == np.concatenate(docs)[2000:3000]).all()
    with pytest.raises(ValueError):
        tokenfiles.ShardReader(io.BytesIO(stream.getvalue()[:-5]))


def test_edges_in_id_order(edges, library):
    rows = sorted(tokenfiles.token_digests(edges, FILE).collect(), key=lambda r: r["start"])
    given = sorted(edges.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    at = 0
    for row, doc in zip(rows, given, strict=True):
        ids = np.array([*library.encode(doc["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_empty(nothing):
    assert tokenfiles.token_digests(nothing, FILE).count() == 0


def test_different_parts_are_looked_up_once(library):
    """Also where spaces of several bytes, or none at all, stand at the edges of texts and parts."""
    random.seed(3)
    alphabet = [" ", "\n", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "\0", "a", "É", "ß", "ɐ", "ж", "1", "’", "*"]
    texts = ["", *("".join(random.choices(alphabet, k=random.randint(1, 9))) for _ in range(20_000)), "", "the night the Éclair", "the night"]
    encoder, asked = tokenfiles.Encoder(FILE), []
    look_up = encoder.look_up
    encoder.look_up = lambda parts: asked.extend(parts) or look_up(parts)
    assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(asked) == len(set(asked)) and {"the", " night", " Éclair"} <= set(asked)
    assert [x.tolist() for x in encoder.encode(["", ""])] == [[], []]
