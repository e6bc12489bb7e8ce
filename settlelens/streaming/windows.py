"""Event-time windows and sender sessions over streams of files, and the batch results they must equal.

Windows. ``window_updates`` aggregates a stream by tumbling or sliding windows with a watermark; each trigger
writes the windows it changed under its batch number, so a trigger that is run again replaces its own rows, and
``latest_windows`` takes the last state of every window. What comes after a window has closed (later than the
watermark's delay) is dropped by the engine; ``late_rows`` counts it, as the rows that arrived less those in windows.

Sessions. A session of a key is a run of events with less than ``gap`` between one and the next. ``SessionProcessor``
keeps the open sessions of a key as state (start, end, count, sum), merges events that arrive out of order into
them, and has a timer at which a session is emitted: when the watermark passes its end by the gap, nothing that
may still arrive can change it. State lives in the checkpoint, so a query that stops goes on from there.
A key's state holds its open sessions only, as many as fit into the watermark's delay and a gap.

Edge cases. Rows without a time are in no window and no session, and are not late; rows without a key have a session of the
null key, written as the empty text. Repeated rows count each. A stream without rows gives empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Timers and several values per key need this store; it keeps state on disk, not in the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


# ---- windows


def by_window(rows: DataFrame, at: str, keys: list[str], value: str, width: str, slide: str | None = None) -> DataFrame:
    """(window_start, window_end, keys, n, total) of a batch, or of a stream with a watermark."""
    grouped = rows.where(F.col(at).isNotNull()).groupBy(F.window(at, width, slide).alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(
        F.col("w")["start"].alias("window_start"), F.col("w")["end"].alias("window_end"), *keys, "n", "total"
    )


def window_updates(
    stream: DataFrame, at: str, keys: list[str], value: str, target: str, checkpoint: str, width: str, slide: str | None = None, delay: str = "1 hour"
) -> None:
    """Runs until all files are in: the windows changed by each trigger, under ``target``/batch=<number>."""

    def deliver(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    changed = by_window(stream.withWatermark(at, delay), at, keys, value, width, slide)
    query = changed.writeStream.outputMode("update").foreachBatch(deliver).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def latest_windows(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The last state of each window."""
    updates = spark.read.option("basePath", target).parquet(target)
    cell = ["window_start", "window_end", *keys]
    last = updates.groupBy(*cell).agg(F.max_by(F.struct("n", "total"), "batch").alias("s"))
    return last.select(*cell, "s.*")


def late_rows(arrived: DataFrame, at: str, windows: DataFrame, per_row: int = 1) -> int:
    """Rows with a time that no window holds; a row is in ``per_row`` windows. Exact for tumbling windows.

    A late row may miss only some of its sliding windows; then this counts whole rows missed, rounded up.
    """
    have = arrived.where(F.col(at).isNotNull()).count()
    held = windows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return -(-(have * per_row - held) // per_row)


# ---- sessions

SESSIONS = "key string, session_start timestamp, session_end timestamp, n bigint, total double"


def merge_sessions(open_: list[tuple], events: list[tuple], gap: int) -> list[tuple]:
    """Sessions (start, end, n, total) in microseconds after ``events`` of the same form joined them."""
    out: list[tuple] = []
    for start, end, n, total in sorted([*open_, *events]):
        if out and start - out[-1][1] < gap:
            a, b, m, s = out[-1]
            out[-1] = (a, max(b, end), m + n, s + total)
        else:
            out.append((start, end, n, total))
    return out


def _micros(at: pd.Series) -> list[int]:
    return at.astype("datetime64[us]").astype("int64").tolist()


class SessionProcessor(StatefulProcessor):
    """Emits a session of a key once the watermark is past its end by the gap."""

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start bigint, last bigint, n bigint, total double")

    def _frame(self, key, sessions: list[tuple]) -> pd.DataFrame:
        start, end, n, total = zip(*sessions, strict=True)
        at = {"session_start": np.array(start, "datetime64[us]"), "session_end": np.array(end, "datetime64[us]")}
        return pd.DataFrame({"key": [key[0]] * len(n), **at, "n": n, "total": total})

    def _had(self) -> list[tuple]:
        return [tuple(s) for s in self.open.get()]

    def _keep(self, had: list[tuple], sessions: list[tuple], fired: bool = False) -> None:
        """Puts ``sessions`` in the place of ``had``, whose timer is gone if it has ``fired``."""
        old, new = self._timer(had), self._timer(sessions)
        if old is not None and not fired and old != new:
            self.handle.deleteTimer(old)
        if new is not None and (fired or old != new):
            self.handle.registerTimer(new)
        if sessions:
            self.open.put(sessions)
        else:
            self.open.clear()

    def _timer(self, sessions: list[tuple]) -> int | None:
        """When the first session ends; timers are in milliseconds, rounded up."""
        return -(-(min(s[1] for s in sessions) + self.gap) // 1000) if sessions else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = []
        for frame in rows:
            times = _micros(frame["at"])
            # What is later than the watermark may belong to a session that has been emitted.
            mark = timerValues.getCurrentWatermarkInMs() * 1000
            each = zip(times, frame["value"].fillna(0.0).tolist(), strict=True)
            events = merge_sessions(events, [(t, t, 1, float(v)) for t, v in each if t >= mark], self.gap)
        if events:
            had = self._had()
            self._keep(had, merge_sessions(had, events, self.gap))
        return iter(())  # a frame for each key, though empty, takes longer than all else

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        had = self._had()
        done = [s for s in had if s[1] + self.gap <= mark]
        self._keep(had, [s for s in had if s[1] + self.gap > mark], fired=True)
        if done:
            yield self._frame(key, done)

    def close(self) -> None:
        pass


def session_stream(stream: DataFrame, key: str, at: str, value: str, gap_seconds: int, delay: str) -> DataFrame:
    """Closed sessions of each key of a stream, appended as the watermark passes them."""
    rows = stream.where(F.col(at).isNotNull()).select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(at).alias("at"), F.col(value).cast("double").alias("value")
    )
    return rows.withWatermark("at", delay).groupBy("key").transformWithStateInPandas(
        SessionProcessor(gap_seconds), SESSIONS, outputMode="append", timeMode="eventTime"
    )


def run_sessions(stream: DataFrame, key: str, at: str, value: str, gap_seconds: int, delay: str, target: str, checkpoint: str) -> None:
    """Appends closed sessions to ``target`` until all files are in; run again, it goes on from the checkpoint."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        closed = session_stream(stream, key, at, value, gap_seconds, delay)
        query = closed.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def batch_sessions(rows: DataFrame, key: str, at: str, value: str, gap_seconds: int, closed_by: str | None = None) -> DataFrame:
    """All sessions by gaps and islands; with ``closed_by`` those that a watermark of that time has passed.

    A window per key over its events; for a key with very many rows the stream is the form that scales.
    """
    known = rows.where(F.col(at).isNotNull()).select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.unix_micros(at).alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")
    )
    order = W.partitionBy("key").orderBy("t")
    first = F.coalesce((F.col("t") - F.lag("t").over(order) >= gap_seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = known.withColumn("new", first).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = numbered.groupBy("key", "island").agg(
        F.timestamp_micros(F.min("t")).alias("session_start"), F.timestamp_micros(F.max("t")).alias("session_end"),
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"),
    ).drop("island")
    if closed_by is not None:
        out = out.where(F.unix_micros("session_end") + gap_seconds * 1_000_000 <= F.unix_micros(F.lit(closed_by).cast("timestamp")))
    return out
