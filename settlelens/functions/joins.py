"""Joins against dimensions, and exact percentiles, without size assumptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from settlelens.session import materialize


def lookup(fact: DataFrame, dim: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a fact to a dimension with no hint.

    Catalyst broadcasts the dimension only when its estimated size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and AQE checks again with real sizes. Beyond that the
    join sorts and merges, and AQE splits the partitions of a hot key.
    """
    return fact.join(dim, on, how)


# Rows of one part of a key, and of one task, where rows are looked up by key.
PART_ROWS, TASK_ROWS = 250_000, 1_000_000


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], accuracy: int = 10_000
) -> DataFrame:
    """Exact interpolated percentiles per key, with no task holding a whole group.

    A quantile sketch per key brackets each wanted rank. One aggregate counts what lies below each bracket
    and keeps its two neighbours; the distinct values inside the brackets, some ten-thousandths of a key's
    rows whatever their distribution, are counted and ranked. A large key meets its brackets in parts. Brackets are compared as doubles, which
    keeps the order of any number; values are ranked and returned from their own type, so whole numbers
    beyond 2^53 are told apart.
    """
    if not keys:
        one = exact_percentiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probs, accuracy)
        return one.drop("_all")
    v = F.col(value)
    # Written once: the sketch, the counts and the brackets each go over the rows, which may be costly to work out.
    rows = materialize(df.select(*keys, v.alias("_v")).filter(v.isNotNull() & ~F.isnan(v.cast("double"))), "percentile-rows")
    rows = rows.withColumn("_d", F.col("_v").cast("double"))
    pad = 2.0 / accuracy
    wanted = [q for p in probs.values() for q in (max(0.0, p - pad), min(1.0, p + pad))]
    edges = rows.groupBy(*keys).agg(F.percentile_approx("_d", wanted, accuracy).alias("_e"), F.count(F.lit(1)).alias("_total"))
    edges = materialize(edges, "percentile-edges")
    largest, total = edges.agg(F.max("_total"), F.sum("_total")).first()
    parts = (largest or 0) // PART_ROWS + 1
    dealt = [*keys, "_part"] if parts > 1 else keys
    if parts > 1:  # a key's rows meet its brackets in parts, not in one task
        rows = rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts))).repartition(total // TASK_ROWS + 1, *dealt)
        edges = edges.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    placed = lookup(rows, edges, dealt, "inner")
    low = {n: F.col("_e")[2 * i] for i, n in enumerate(probs)}
    high = {n: F.col("_e")[2 * i + 1] for i, n in enumerate(probs)}
    inside = {n: (F.col("_d") >= low[n]) & (F.col("_d") <= high[n]) for n in probs}

    around = placed.groupBy(*keys).agg(
        F.first("_total").alias("_total"),
        *[F.count_if(F.col("_d") < low[n]).alias(f"_below_{n}") for n in probs],
        *[F.max(F.when(F.col("_d") < low[n], F.col("_v"))).alias(f"_under_{n}") for n in probs],
        *[F.min(F.when(F.col("_d") > high[n], F.col("_v"))).alias(f"_over_{n}") for n in probs],
    )
    any_band = F.lit(False)
    for n in probs:
        any_band = any_band | inside[n]
    counts = placed.filter(any_band).groupBy(*keys, "_v").agg(
        F.count(F.lit(1)).alias("_n"), *[F.max(inside[n]).alias(f"_in_{n}") for n in probs]
    )
    order = W.partitionBy(*keys).orderBy("_v")
    ranked = counts.withColumns(
        {f"_end_{n}": F.sum(F.when(F.col(f"_in_{n}"), F.col("_n")).otherwise(0)).over(order) for n in probs}
    )
    both = lookup(ranked, around, keys, "inner")

    def at(name: str, rank: Column) -> Column:
        """The value of a 0-based rank: in the bracket, or its neighbour below or above."""
        end = F.col(f"_below_{name}") + F.col(f"_end_{name}")
        hit = F.max(F.when(F.col(f"_in_{name}") & (rank >= end - F.col("_n")) & (rank < end), F.col("_v")))
        under = F.max(F.when(rank < F.col(f"_below_{name}"), F.col(f"_under_{name}")))
        return F.coalesce(hit, under, F.max(f"_over_{name}")).cast("double")

    picks = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        picks += [at(name, F.floor(pos)).alias(f"_lo_{name}"), at(name, F.ceil(pos)).alias(f"_hi_{name}")]
    picked = both.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    out = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.select(*keys, *out)
