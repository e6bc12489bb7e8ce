import pathlib
import time

import corpus_pipeline
import pandas as pd
import public_tokenizers

from settlelens.llm.mixing import mixing_sql
from settlelens.llm.common import materialize
from settlelens.llm.quality_sql import quality_sql
from settlelens.llm.sentencepiece import Pieces
from settlelens.session import scratch_root
from tests.llm.conftest import SMALL, duck
from tests.llm.test_minhash import near_groups


def test_against_brute_force(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    verdict = duck(quality_sql(), {t: f"{SMALL}/{t}.parquet" for t in ("documents", "labels")})
    docs = docs[docs.doc_id.isin(verdict[verdict.kept].doc_id)]
    docs = docs.sort_values("doc_id").drop_duplicates("text", keep="last").reset_index(drop=True)
    groups = near_groups(docs.text.tolist())
    assert len(set(groups)) < len(groups)
    docs = docs[[g == i for i, g in enumerate(groups)]]
    mixed = duck(mixing_sql(), {"documents": docs})
    docs = docs[docs.doc_id.isin(mixed[mixed.kept].doc_id)]
    pieces = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: pieces.encode(t).tolist() for i, t in zip(docs.doc_id, docs.text, strict=True)}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == want and all(r["exact"] for r in got)


def test_stages_keep_the_columns_and_stand_edges(spark, edges, nothing, tmp_path):
    edges.sparkSession.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edges, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                if name != "mixing":  # rows that agree in id and text are one document
                    assert out.groupBy("doc_id", "text").count().where("count > 1").isEmpty()
                kept = out.count()
                assert kept <= docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mixing", "pieces"]


def test_rows_without_an_id_and_rows_of_one_id_are_told_apart(spark):
    texts = ["a b c d e f g h i j k l", "m n o p q r s t u v w x", "y z a c e g i k m o q s", "m n o p q r s t u v w x"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[0]), (5, texts[2]), (6, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for stage, want in (
        (corpus_pipeline.exact, [(5, texts[0]), (5, texts[2]), (6, texts[1])]),
        (corpus_pipeline.near, [(5, texts[0]), (5, texts[2]), (6, texts[1])]),
    ):
        assert sorted(map(tuple, stage(spark, docs, "").collect())) == want
    alone = docs.where("doc_id IS NULL")
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        assert sorted(r["text"] for r in stage(spark, alone, "").collect()) == texts[:2]


def test_near_leaves_only_what_its_result_reads(spark):
    """Tables of the steps are deleted as soon as nothing reads them."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(0, 60, 10)] + ["a b c d e f g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    folder = pathlib.Path(scratch_root(spark).removeprefix("file:")) / "settlelens"
    before = {p.name for p in folder.glob("*")}
    kept = {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert 6 in kept and len(kept) < len(texts)
    left = [p.name.rpartition("-")[0] for p in folder.glob("*") if p.name not in before]
    assert "near-rows" in left and not {n for n in left if n.startswith(("minhash-", "simhash-"))} - {
        "minhash-roots-all", "minhash-edges", "simhash-prints", "simhash-components", "simhash-links"
    }
    assert left.count("minhash-edges") <= 4 and left.count("simhash-links") == 1


def test_a_written_table_leaves_no_shuffle_files(spark):
    where = spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f.name for d in where for f in pathlib.Path(d).rglob("shuffle_*")}
    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(key)
    table = materialize(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "sevens")
    assert spark.conf.get(key) == kept
    until = time.time() + 10
    while files() - before and time.time() < until:  # executors are told to delete them, and do so a little later
        time.sleep(0.2)
    assert not files() - before and table.count() == 7
