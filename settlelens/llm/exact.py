"""Exact duplicates by a persistent digest index.

The index is a table bucketed and sorted by SHA-256 digest, one row per text: (digest, keep_id, n_rows).
A batch is reduced to one row per digest on the map side, compared with the index by a sort-merge
anti-join whose index side is read in its buckets without a shuffle, and what is new is appended.

Edge cases. A null text counts as empty. Empty texts are equal to one another. Repeated rows of one id
are one document and get one verdict. Rows without an id take part as copies but cannot stand for their
text: a group without any id has a null ``keep_id`` and none of its rows stays. An empty table gives an
empty result and leaves the index as it is. Further columns of the input are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlelens.llm.common import materialize, null_safe_text

INDEX_COLUMNS = "digest string, keep_id bigint, n_rows bigint"


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of every row; nothing is normalised."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.sha2(null_safe_text(text_col).cast("binary"), 256).alias("digest")
    )


class DigestIndex:
    """Digests of the texts that have been let through so far."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64):
        self.spark, self.table, self.buckets = spark, table, buckets
        if not spark.catalog.tableExists(table):
            self._append(spark.createDataFrame([], INDEX_COLUMNS))

    def _append(self, rows: DataFrame) -> None:
        # One shuffle by the bucket key, so that each bucket gets one sorted file per batch.
        rows = rows.repartition(self.buckets, "digest")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, digests: DataFrame) -> None:
        """Append the digests that the index lacks, each with the largest id of the batch and its row count."""
        batch = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n_rows"))
        known = self.read().select("digest").hint("merge")
        self._append(materialize(batch.join(known, "digest", "left_anti"), "digest-batch"))

    def verdicts(self, digests: DataFrame) -> DataFrame:
        """One row per row of ``digests``: who stays for its text, copies counted among ``digests``.

        The join keeps one row per input row; a text with very many copies is split by AQE.
        """
        sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
        groups = sizes.join(self.read().select("digest", "keep_id"), "digest", "left")
        joined = digests.join(materialize(groups, "digest-groups"), "digest")
        kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
        return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """Digest groups of a whole table through a fresh index; of equal texts the largest id stays.

    The rows are added in ``batches`` id ranges from the largest ids down, so whatever the index already
    holds when a batch arrives is what has to stay.
    """
    spark = docs.sparkSession
    digests = materialize(text_digests(docs, id_col, text_col), "digests")
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        index.add(digests)
        return index.verdicts(digests)
    step = (high - low) // batches + 1
    number = F.coalesce(F.floor((F.lit(high) - F.col("doc_id")) / F.lit(step)), F.lit(batches - 1))
    for k in range(batches):
        index.add(digests.where(number == k))
    return index.verdicts(digests)
