"""Differences and unions of snapshots, catalogs and registries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def catalog_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys added or removed, by one pass over both snapshots."""
    a, b = old.select(key).distinct(), new.select(key).distinct()
    added = b.join(a, key, "left_anti").withColumn("change", F.lit("added"))
    removed = a.join(b, key, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def row_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Whole rows added or removed, with multiplicity."""
    cols = new.columns
    return (
        new.exceptAll(old.select(*cols)).withColumn("change", F.lit("added"))
        .unionByName(old.select(*cols).exceptAll(new).withColumn("change", F.lit("removed")))
    )


def stack_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """One long fact from several vendors; columns a vendor lacks become null."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def stitch_windows(frames: list[DataFrame], keys: list[str], version: str) -> DataFrame:
    """Overlapping date windows as one series; the later pull wins on a shared day."""
    from settlelens.operators.metrics import latest_version

    return latest_version(reduce(lambda a, b: a.unionByName(b), frames), keys, version)


def domain_mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Values of a key column that only one input has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return (
        a.join(b, key, "left_anti").withColumn("side", F.lit("left_only"))
        .unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only")))
        .select(F.lit(key).alias("domain"), F.col(key).cast("string").alias("key_value"), "side")
    )


def universe_agreement(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    both = first.select(key).intersect(second.select(key)).withColumn("status", F.lit("both"))
    only_first = first.select(key).subtract(second.select(key)).withColumn("status", F.lit("first_only"))
    only_second = second.select(key).subtract(first.select(key)).withColumn("status", F.lit("second_only"))
    return both.unionByName(only_first).unionByName(only_second)


def registry_impact(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rollups and the date range to rebuild after a registry change; an open end stays null."""
    changed = row_changes(old, new)
    return changed.groupBy("rollup_id").agg(
        F.min("valid_from_utc").cast("date").alias("rebuild_from"),
        F.when(F.count_if(F.col("valid_to_utc").isNull()) == 0, F.max("valid_to_utc").cast("date")).alias("rebuild_to"),
        F.count(F.lit(1)).alias("n_changes"),
    )
