"""As-of join: for each row of a fact, the latest version at or before its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400
# Parts that the facts without a key or a time are dealt to.
SPREAD = 4_096


def asof_join(
    facts: DataFrame,
    versions: DataFrame,
    key: list[str],
    at: str,
    since: str,
    values: list[str],
    width: int = DAY,
    max_age: int | None = None,
    unmatched: bool = True,
) -> DataFrame:
    """``facts`` with ``values`` of the latest row of ``versions`` of the same key whose ``since`` is at or before ``at``.

    Both sides go into one tagged table, cut into time buckets of ``width`` seconds. Inside a bucket of a key a
    running last value fills the facts; what a bucket starts with is the last version of the buckets before,
    carried over a table of one row per key and bucket. So a task holds one bucket of one key, never a key; a
    key with very many rows in a short time wants a smaller width. The table is shuffled twice by key and
    bucket, once for the fill and once for the summary (keys and times only), and no pair of a fact and a version that is not its
    latest is formed.

    Times are timestamps or dates. Of several versions of a key at one time the largest ``values`` count, in
    the order of their names given. A fact without a key or a time, and one before all versions of its key,
    has nulls, or goes if not ``unmatched``; versions without key or time are ignored. ``max_age`` is the
    largest age in seconds at which a version still holds. A version's values may be null: they hold as
    they are. Columns of facts must not be named like ``values`` or begin with ``_asof``.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    version = F.struct(micros(since).alias("time"), *values)
    left = facts.select(*[F.col(k).alias(f"_asof_{k}") for k in key], micros(at).alias("_asof_time"), F.lit(1).alias("_asof_tag"),
                        F.lit(None).cast(versions.select(version.alias("v")).schema["v"].dataType).alias("_asof_version"), F.struct(*facts.columns).alias("_asof_row"))
    right = versions.select(*[F.col(k).alias(f"_asof_{k}") for k in key], micros(since).alias("_asof_time"), F.lit(0).alias("_asof_tag"),
                            version.alias("_asof_version"), F.lit(None).cast(left.schema["_asof_row"].dataType).alias("_asof_row"))
    keys = [f"_asof_{k}" for k in key]
    known = F.col("_asof_time").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    bucket = F.floor(F.col("_asof_time") / F.lit(width * 1_000_000))
    right, sound = right.where(known).withColumn("_asof_bucket", bucket), left.where(known).withColumn("_asof_bucket", bucket)
    both = sound.unionByName(right)
    if unmatched:  # facts without a key or a time go along, dealt by their rows, so that the facts are worked out once for all of them
        plain = [F.col("_asof_row")[c] for c, kind in facts.dtypes if "map<" not in kind and "variant" not in kind]
        dealt = F.when(known, bucket).otherwise(F.pmod(F.xxhash64(F.lit(0), *plain), F.lit(SPREAD)))
        tagged = left.withColumn("_asof_bucket", dealt).unionByName(right)
    else:
        tagged = both
    order = ["_asof_time", "_asof_tag", "_asof_version"]
    inside = W.partitionBy(*keys, "_asof_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    filled = tagged.repartition(*keys, "_asof_bucket").withColumn("_asof_found", F.last("_asof_version", ignorenulls=True).over(inside)).where("_asof_tag = 1")
    summary = both.groupBy(*keys, "_asof_bucket").agg(F.max("_asof_version").alias("_asof_last"))
    before = W.partitionBy(*keys).orderBy("_asof_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(*keys, "_asof_bucket", F.last("_asof_last", ignorenulls=True).over(before).alias("_asof_carried"))
    joined = filled.join(carried, [*keys, "_asof_bucket"], "left" if unmatched else "inner")
    found = F.when(known, F.coalesce("_asof_found", "_asof_carried"))
    if max_age is not None:
        found = F.when(F.col("_asof_time") - found["time"] <= F.lit(max_age * 1_000_000), found)
    out = joined.select("_asof_row.*", found.alias("_asof_hit"))
    if not unmatched:
        out = out.where("_asof_hit IS NOT NULL")
    return out.select(*facts.columns, *[F.col("_asof_hit")[v].alias(v) for v in values])


def bucket_sizes(facts: DataFrame, key: list[str], at: str, width: int = DAY) -> DataFrame:
    """Rows of each bucket, the largest share of which bounds a task: for choosing ``width``."""
    bucket: Column = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(width * 1_000_000))
    return facts.groupBy(*key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
