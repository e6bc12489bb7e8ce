"""Embedding vectors as whole numbers, and sums of them over a distributed table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
# Squared distances of 64 components stay under 2**63 and products under 2**57 up to this size.
LARGEST = 2**27


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the usable rows: x has floor(scale * component), the component taken as a double.

    Rows go whose vector is null, has a null or non-finite component, or one beyond ``LARGEST`` after scaling,
    for which exact sums would leave the range of a long. Further columns are not read.
    """
    real = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), real.alias("real")).where("real IS NOT NULL")
    # NaN is larger than any number in Spark, so the one comparison drops it as well.
    usable = F.forall("real", lambda e: e.isNotNull() & (F.abs(e) <= F.lit(float(LARGEST) / scale)))
    return rows.where(usable).select("vec_id", F.transform("real", lambda e: F.floor(F.lit(float(scale)) * e).cast("int")).alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as an integer matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def partition_sums(frame: DataFrame, width: int, add: Callable[[dict, pa.RecordBatch], None]) -> DataFrame:
    """(a, b, total) with exact whole-number totals over all rows.

    ``add`` puts a batch into a dict from (a, b) to a Python int; a partition sends one row per key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            if batch.num_rows:
                add(totals, batch)
        keys = np.array(list(totals), dtype=np.int32).reshape(-1, 2)
        # As text, since a decimal of 38 digits has no quick way from Python ints.
        values = pa.array([str(v) for v in totals.values()], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), values], ["a", "b", "part"])

    parts = frame.mapInArrow(run, "a int, b int, part string")
    return parts.groupBy("a", "b").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
