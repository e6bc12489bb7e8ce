"""Registered queries of this subpackage, each over its whole table, and their SQL where it exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlelens.llm import sentencepiece as spm
from settlelens.llm.common import documents, null_safe_text
from settlelens.llm.exact import exact_duplicates
from settlelens.llm.hierarchy import hierarchy_sql, quality_scores
from settlelens.llm.linededup import LINES_SQL, without_boilerplate
from settlelens.llm.mixing import mixed, mixing_sql
from settlelens.llm.pii import personal_data_digests
from settlelens.llm.quality import quality_verdicts
from settlelens.llm.quality_sql import quality_sql
from settlelens.llm.shallot import cluster_table
from settlelens.llm.simhash import near_duplicates
from settlelens.llm.suffix import without_repeats
from settlelens.llm.tokenfiles import token_digests
from settlelens.llm.toxicity import toxicity
from settlelens.llm.whitening import whitened


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back."""
    return piece_ids(documents(spark, sf_dir)).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == null_safe_text()).alias("exact"),
    )


def piece_ids(docs: DataFrame, model: str = public_tokenizers.path("piece_bpe_32k.model")) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``."""
    both = docs.withColumn("pieces", spm.encode_and_decode(null_safe_text(), model))
    return both.withColumns({"ids": F.col("pieces.ids"), "decoded": F.col("pieces.decoded")}).drop("pieces")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"source": "source", "lang": "lang", "topic": "topic", "tokens": "n_tokens", "probability": "probability", "kept": "kept"}
    out = mixed(documents(spark, sf_dir))
    return out.select("doc_id", *[F.col(f"mix_{a}").alias(b) for a, b in names.items()])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_boilerplate(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digests(documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(embeddings(spark, sf_dir))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_table(embeddings(spark, sf_dir))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  coalesce(doc_id = max(doc_id) OVER same, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def queries():
    return {f.__name__: f for f in (op1_sentencepiece, op2_quality_rules, op3_mixing, op4_line_dedup, op5_quality_classifier, op6_personal_data, op7_exact_dedup, op8_suffix_dedup, op9_simhash, op10_token_files, op11_embedding_whitening, op12_toxicity, op13_centroid_clusters)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_sql(), "op3_mixing": mixing_sql(), "op4_line_dedup": LINES_SQL, "op5_quality_classifier": hierarchy_sql(), "op7_exact_dedup": OP7_SQL}
