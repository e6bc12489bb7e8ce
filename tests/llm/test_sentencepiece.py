import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from settlelens.llm import sentencepiece as spm
from settlelens.llm.queries import piece_ids

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return spm.Pieces(MODEL)


@pytest.fixture(scope="module")
def unigram():
    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    return model, sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_best_score_as_the_library(pieces, unigram):
    model, library = unigram
    score = lambda ids: sum(model.pieces[i].score for i in ids)
    texts = ["Hello world, this is a test.", "internationalisation of thorough examples", "a", "two  spaces   here", " lead and trail "]
    for text in texts:
        own = pieces.encode(text).tolist()
        assert score(own) == pytest.approx(score(library.encode(text))), text
        assert "".join(pieces.texts[i] for i in own) == "▁" + text.replace(" ", "▁")


def test_chunks_and_whole_text_agree(pieces):
    for text in ("  a  b\n\nc d ", "naïve café 日本語 😀 words", "x" * 300, "tabs\tand\rmore", "\na\n\nb.\n", "a\n b, c.. d!e ,f |g", "x\0y z"):
        marked = pieces.prefix + text.replace(" ", spm.MARK)
        assert pieces.encode(text).tolist() == pieces.viterbi(marked)


def test_a_full_cache_changes_nothing(pieces, monkeypatch):
    text = "many different words make the cache run over and over again"
    want = pieces.encode(text).tolist()
    monkeypatch.setattr(spm, "CACHE", 3)
    pieces.known.clear()
    assert pieces.encode(text).tolist() == want == pieces.encode(text).tolist()


def test_round_trip_and_edges(edges):
    rows = piece_ids(edges).select("doc_id", "text", "ids", "decoded").collect()
    assert len(rows) == edges.count()
    assert all(r["decoded"] == (r["text"] or "") for r in rows)
    assert all(r["ids"] == [] for r in rows if not r["text"])


def test_the_mark_itself_does_not_come_back(spark, nothing):
    df = spark.createDataFrame([(1, "a▁b")], "doc_id int, text string")
    assert piece_ids(df).select(F.col("decoded")).first()[0] == "a b"
    assert piece_ids(nothing).count() == 0


def test_encode_and_decode_alone(edges):
    rows = edges.select("text", spm.decode(spm.encode(F.col("text"), MODEL), MODEL).alias("back")).collect()
    assert all(r["back"] == (r["text"] or "") for r in rows)
