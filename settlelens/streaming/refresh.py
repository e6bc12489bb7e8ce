"""Bounded refresh: the last days again, full rebuilds, idempotent appends, and file pick-up."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlelens import contracts as C
from settlelens.operators.metrics import latest_version
from settlelens.session import materialize
from settlelens.sinks.tables import drop_days, write_partitions


def recent(df: DataFrame, run_date: dt.date, days: int, date: str = "date_utc") -> DataFrame:
    """The last ``days`` days up to and including the run date."""
    first = run_date - dt.timedelta(days=days - 1)
    return df.filter(F.col(date).between(F.lit(first), F.lit(run_date)))


def refresh_days(df: DataFrame, path: str, run_date: dt.date, days: int, date: str = "date_utc") -> None:
    """Put the last days of ``df`` in place of the stored ones; a day without rows any more goes.

    Older corrections wait for the full run. The days are worked out once, into the shared folder, so
    that what is written and what is dropped agree.
    """
    fresh = materialize(recent(df, run_date, days, date), "refresh")
    write_partitions(fresh, path, [date])
    have = {r[0] for r in fresh.select(date).distinct().collect()}  # at most ``days`` rows
    span = [run_date - dt.timedelta(days=k) for k in range(days)]
    drop_days(df.sparkSession, path, date, [d for d in span if d not in have])


def refresh_chain(raw: DataFrame, path: str, run_date: dt.date, days: int = C.CHAIN_REFRESH_DAYS) -> None:
    refresh_days(raw, path, run_date, days)


def refresh_costs(
    tx: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, run_date: dt.date, days: int = C.CHAIN_REFRESH_DAYS
) -> None:
    """Daily costs of the last days only: the date filter reaches the scan before the aggregate."""
    refresh_days(build(recent(tx, run_date, days)), path, run_date, days)


def refresh_panel(
    build: Callable[[dt.date | None], DataFrame], path: str, run_date: dt.date, days: int = C.PANEL_REFRESH_DAYS
) -> None:
    """Panel days again. ``build(first_day)`` makes the panel from that day on."""
    refresh_days(build(run_date - dt.timedelta(days=days - 1)), path, run_date, days)


def full_rebuild(build: Callable[[dt.date | None], DataFrame], path: str) -> None:
    """The whole table anew: what the build lacks is stored no more.

    The build is written beside the table and takes its name at the end, so one that fails leaves the table as it
    was. Between the two renames the name is free for a moment; readers who must not see that, or want older
    builds as well, use ``sinks.versioned``.
    """
    df = build(None)
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    mark = uuid.uuid4().hex
    fresh, old = f"{path.rstrip('/')}.build-{mark}", f"{path.rstrip('/')}.old-{mark}"
    write_partitions(df, fresh, ["date_utc"], whole=True)
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(place(path)) and not fs.rename(place(path), place(old)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(place(fresh), place(path)):
        raise OSError(f"cannot move {fresh}")
    fs.delete(place(old), True)


def append_new(new: DataFrame, path: str, keys: list[str], version: str) -> None:
    """Append only keys not stored yet, one row per key; running it twice adds nothing.

    Of the stored table only the key columns are read, and only days the new rows touch.
    """
    spark = new.sparkSession
    stored = spark.read.schema(T.StructType([new.schema[k] for k in keys])).parquet(path)
    once = latest_version(new, keys, version)
    if "date_utc" in keys:
        low, high = new.agg(F.min("date_utc")).scalar(), new.agg(F.max("date_utc")).scalar()
        stored = stored.filter(F.col("date_utc").between(low, high))
    once.join(stored.select(*keys), keys, "left_anti").select(*new.columns).write.mode("append").parquet(path)


def follow_files(
    spark: SparkSession, source: str, schema: T.StructType, target: str, keys: list[str], version: str, checkpoint: str
) -> None:
    """Pick up new raw JSON files and append their unseen keys, then stop when none are left."""

    def deliver(batch: DataFrame, _: int) -> None:
        append_new(batch, target, keys, version)

    query = (
        spark.readStream.schema(schema)
        .json(source)
        .writeStream.foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
