"""The corpus pipeline: stages applied one after another to the documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlelens.llm.common import documents, materialize, null_safe_text
from settlelens.llm.exact import exact_duplicates
from settlelens.llm.minhash import SHINGLE, near_copies
from settlelens.llm.mixing import mixed
from settlelens.llm.quality import quality_verdicts
from settlelens.llm.queries import piece_ids
from settlelens.llm.simhash import near_duplicates


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_key``, which tells apart rows that differ in their id, their text or both.

    It is not null, so rows without an id are told apart by their text. ``row_key`` and ``kept_key`` are the
    only names that columns of ``docs`` must not use.
    """
    text = F.sha2(null_safe_text().cast("binary"), 256)
    return docs.withColumn("row_key", F.concat(text, F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` (``keyed``) whose ``row_key`` is in ``kept``, without the key.

    Rows that agree in id and text are the same document, of which one stays.
    """
    keys = kept.select(F.col("row_key").alias("kept_key")).distinct()
    joined = docs.join(keys, F.col("row_key") == F.col("kept_key")).drop("kept_key")
    return joined.dropDuplicates(["row_key"]).drop("row_key")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    verdicts = quality_verdicts(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=("row_key",))
    return keep_rows(rows, verdicts.where("kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, also where only some of them have one."""
    rows = keyed(docs)
    found = exact_duplicates(docs)
    # Where no copy has an id, the operator keeps none of them by id; one stays all the same.
    kept = found.where("kept OR keep_id IS NULL").select(
        F.concat("text_sha256", F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("row_key")
    )
    return keep_rows(rows, kept)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Groups hold documents whose SimHash fingerprints of 5-word shingles are within four bits of 64 (the trie
    self-join), or whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more. Rows without an id
    stay, unless they are in a group with rows that have one.
    """
    rows = materialize(keyed(docs), "near-rows")
    # Ids of this stage: rows of one id but different texts are documents of their own.
    numbered = rows.select("row_key", "doc_id", "text", F.xxhash64("row_key").alias("node"))
    prints = near_duplicates(numbered, id_col="node", shingle=SHINGLE)
    given = prints.select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    found = near_copies(numbered, id_col="node", given=given)
    groups = numbered.select("node", "doc_id", "row_key").join(found.distinct().withColumnRenamed("doc_id", "member"), F.col("node") == F.col("member"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    return keep_rows(rows, groups.groupBy("component_id").agg(F.min_by("row_key", order).alias("row_key")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs).where("mix_kept").select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left; ``exact`` says that they decode to the text."""
    out = piece_ids(docs.select("doc_id", "source", "lang", "text"))
    return out.select(
        "doc_id", "source", "lang", F.size("ids").cast("bigint").alias("n_ids"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("pieces", pieces)]

# Near copies and piece ids have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
