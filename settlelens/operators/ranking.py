"""Ranking over a whole table, with no task that holds more than a range of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlelens.operators.metrics import numbered
from settlelens.session import materialize

RANKS = ["row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "tile"]


def tile_of(index: Column, n_rows: int, tiles: int) -> Column:
    """1-based tile of a 0-based position; the first ``n_rows % tiles`` tiles have one row more."""
    size, longer = divmod(n_rows, tiles)
    edge = longer * (size + 1)
    if size == 0:
        return index + 1
    return F.when(index < edge, F.floor(index / (size + 1))).otherwise(longer + F.floor((index - edge) / size)).cast("bigint") + 1


def global_ranks(df: DataFrame, value: str, ties: list[str], tiles: int = 100) -> DataFrame:
    """``df`` with the columns ``RANKS`` in ascending order of ``value``, nulls first.

    Rows are sorted by ranges of (value, ties) and numbered with carried counts. A value's first and last
    number, which give its rank and cumulative share, are an aggregate, so a value that a third of all rows
    have is spread over ranges and its equal rows meet only as partial sums. ``ties`` order rows of one value
    for ``row_number`` and ``tile``; rows equal in all of them are numbered in any order.

    NaN is the largest value. An empty table gives an empty result. Columns of ``df`` named as in ``RANKS`` are replaced.
    """
    if tiles < 1:
        raise ValueError("tiles must be at least 1")
    placed = materialize(numbered(df.drop(*RANKS), value, *ties), "ranked")
    n_rows = placed.count()
    spans = placed.groupBy(F.col(value).alias("_value")).agg(F.min("row_index").alias("_first"), F.max("row_index").alias("_last"))
    spans = numbered(spans, "_value").withColumnRenamed("row_index", "_nth")
    index, first = F.col("row_index"), F.col("_first")
    share = (first / F.lit(n_rows - 1)) if n_rows > 1 else F.lit(0.0)
    out = placed.join(spans, F.col(value).eqNullSafe(F.col("_value")))
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in RANKS],
        (index + 1).alias("row_number"),
        (first + 1).alias("rank"),
        (F.col("_nth") + 1).alias("dense_rank"),
        share.alias("percent_rank"),
        ((F.col("_last") + 1) / F.lit(n_rows)).alias("cume_dist"),
        tile_of(index, n_rows, tiles).alias("tile"),
    )
