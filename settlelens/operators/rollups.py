"""CUBE and ROLLUP by partial sums: the facts are read once, at the finest grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlelens.session import materialize

MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _rolled(df: DataFrame, dims: list[str], measures: dict[str, tuple[str, Column]], chain: bool) -> DataFrame:
    taken = {"grouping_id", "_dropped"} & {*dims, *measures}
    if taken or set(dims) & set(measures):
        raise ValueError(f"names in use: {sorted(taken | set(dims) & set(measures))}")
    start = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    finest = df.groupBy(*dims).agg(*[start[kind](c).alias(n) for n, (kind, c) in measures.items()])
    layer = out = materialize(finest.withColumn("grouping_id", F.lit(0)), "rolled")
    bits = [1 << (len(dims) - 1 - i) for i in range(len(dims))]
    level = F.col("grouping_id")
    for _ in dims:
        # Every level has one parent: the one in which its first rolled-up dimension is still there.
        due = F.filter(F.array(*map(F.lit, bits)), lambda b: (b == level + 1) if chain else (b > level))
        wider = layer.withColumn("_dropped", F.explode(due))
        wider = wider.withColumn("grouping_id", level.bitwiseOR(F.col("_dropped")))
        gone = {d: level.bitwiseAND(F.lit(b)) != 0 for d, b in zip(dims, bits, strict=True)}
        wider = wider.select("grouping_id", *[F.when(~gone[d], F.col(d)).alias(d) for d in dims], *measures)
        merged = wider.groupBy("grouping_id", *dims).agg(*[MERGE[kind](n).alias(n) for n, (kind, _) in measures.items()])
        layer = materialize(merged.select(*[F.col(f.name).cast(f.dataType) for f in out.schema.fields]), "rolled")
        out = out.unionByName(layer)
    return out


def stepwise_cube(df: DataFrame, dims: list[str], measures: dict[str, tuple[str, Column]]) -> DataFrame:
    """Aggregates of every subset of ``dims``; ``measures`` are {name: (sum | count | min | max, column)}.

    One aggregate of the facts gives the finest grain. The subsets with one dimension less follow from it, and so
    on: each is merged from one parent that is already small, so no fact row is copied 2^k times before it is
    summed, as the built-in form does. A rolled-up dimension is null; bit k-1-i of ``grouping_id`` says that
    dimension i is rolled up, which tells a total from a null in the data. Put the dimensions with many values
    first: they are the first to go. Sums keep the type of the fine sums (decimals stay exact).

    An empty table gives an empty result, without a grand total. Further columns are not read.
    """
    return _rolled(df, dims, measures, chain=False)


def stepwise_rollup(df: DataFrame, dims: list[str], measures: dict[str, tuple[str, Column]]) -> DataFrame:
    """Like ``stepwise_cube`` for the prefixes of ``dims`` only, from all of them to none."""
    return _rolled(df, dims, measures, chain=True)
