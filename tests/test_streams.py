"""Event-time windows and sessions against their batch results."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import types as T

from settlelens.streaming import windows as S

SCHEMA = T.StructType().add("id", T.LongType()).add("key", T.StringType()).add("ts", T.TimestampType()).add("value", T.DoubleType())
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def rows_of(n, spread, seed=1, keys=("a", "b", "c", None)):
    """Events over ten hours that arrive up to ``spread`` seconds out of order."""
    rng = random.Random(seed)
    out = [(i, rng.choice(keys), rng.randrange(36_000), float(rng.randrange(100))) for i in range(n)]
    out.sort(key=lambda r: r[2] + rng.uniform(0, spread))
    return [(i, k, START + dt.timedelta(seconds=t), v) for i, k, t, v in out]


def land(spark, path, rows, parts, first=0):
    """One file per part, in order of arrival."""
    size = -(-len(rows) // parts)
    for p in range(parts):
        spark.createDataFrame(rows[p * size : (p + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/part={first + p:03d}")


def stream(spark, path):
    return S.file_stream(spark, f"{path}/*", SCHEMA, 1)


def cells(df):
    return sorted((str(r["window_start"]), r["key"] or "", r["n"], r["total"]) for r in df.collect())


@pytest.mark.parametrize("slide", [None, "10 minutes"])
def test_windows_of_shuffled_arrival_equal_the_batch(spark, tmp_path, slide):
    rows = rows_of(600, 1800)
    rows.append((999, "a", None, 1.0))
    land(spark, f"{tmp_path}/in", rows, 5)
    S.window_updates(stream(spark, f"{tmp_path}/in"), "ts", ["key"], "value", f"{tmp_path}/out", f"{tmp_path}/ck", "30 minutes", slide, delay="12 hours")
    batch = spark.createDataFrame(rows, SCHEMA)
    got = S.latest_windows(spark, f"{tmp_path}/out", ["key"])
    assert cells(got) == cells(S.by_window(batch, "ts", ["key"], "value", "30 minutes", slide))
    assert S.late_rows(batch, "ts", got, 3 if slide else 1) == 0


def test_rows_beyond_the_delay_are_counted(spark, tmp_path):
    rows = [r for r in rows_of(300, 60) if r[2] >= START + dt.timedelta(hours=1)]
    late = [(5000 + i, "a", START + dt.timedelta(seconds=i), 1.0) for i in range(7)]
    land(spark, f"{tmp_path}/in", rows, 3)
    land(spark, f"{tmp_path}/in", late, 1, first=3)
    S.window_updates(stream(spark, f"{tmp_path}/in"), "ts", ["key"], "value", f"{tmp_path}/out", f"{tmp_path}/ck", "30 minutes", delay="10 minutes")
    got = S.latest_windows(spark, f"{tmp_path}/out", ["key"])
    assert S.late_rows(spark.createDataFrame(rows + late, SCHEMA), "ts", got) == 7
    assert cells(got) == cells(S.by_window(spark.createDataFrame(rows, SCHEMA), "ts", ["key"], "value", "30 minutes"))


def test_merging_is_the_same_in_any_order():
    rng = random.Random(2)
    events = [(t, t, 1, 1.0) for t in (rng.randrange(1000) for _ in range(60))]
    whole = S.merge_sessions([], events, 20)
    for _ in range(20):
        rng.shuffle(events)
        state = []
        for at in range(0, len(events), 7):
            state = S.merge_sessions(state, events[at : at + 7], 20)
        assert state == whole
    assert all(b[0] - a[1] >= 20 for a, b in zip(whole, whole[1:], strict=False)) and sum(s[2] for s in whole) == 60


def sessions(df):
    return sorted((r["key"], str(r["session_start"]), str(r["session_end"]), r["n"], r["total"]) for r in df.collect())


def test_sessions_equal_the_batch_after_a_restart(spark, tmp_path):
    rows = rows_of(500, 900, seed=7)
    half = len(rows) // 2
    where, out, ck = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    land(spark, where, rows[:half], 3)
    S.run_sessions(stream(spark, where), "key", "ts", "value", 300, "20 minutes", out, ck)
    first = spark.read.schema(S.SESSIONS).parquet(out).count()
    land(spark, where, rows[half:], 3, first=3)
    S.run_sessions(stream(spark, where), "key", "ts", "value", 300, "20 minutes", out, ck)  # state comes from the checkpoint
    got = spark.read.schema(S.SESSIONS).parquet(out)
    last = max(r[2] for r in rows) - dt.timedelta(minutes=20)
    batch = S.batch_sessions(spark.createDataFrame(rows, SCHEMA), "key", "ts", "value", 300, closed_by=last.strftime("%Y-%m-%d %H:%M:%S"))
    assert 0 < first < got.count() and sessions(got) == sessions(batch)
    # Run again without new files, nothing is added.
    S.run_sessions(stream(spark, where), "key", "ts", "value", 300, "20 minutes", out, ck)
    assert sessions(spark.read.schema(S.SESSIONS).parquet(out)) == sessions(batch)


def test_batch_sessions_against_plain_python(spark):
    rows = rows_of(200, 0, seed=3)
    want = []
    for key in {r[1] for r in rows}:
        micro = lambda t: int((t - START).total_seconds() * 1e6)
        for s in S.merge_sessions([], [(micro(r[2]), micro(r[2]), 1, r[3]) for r in rows if r[1] == key], 600 * 10**6):
            want.append((key or "", s[2], s[3]))
    got = S.batch_sessions(spark.createDataFrame(rows, SCHEMA), "key", "ts", "value", 600)
    assert sorted((r["key"], r["n"], r["total"]) for r in got.collect()) == sorted(want)
    assert S.batch_sessions(spark.createDataFrame([], SCHEMA), "key", "ts", "value", 600).count() == 0


class Handle:
    """One key's list state and timers in memory, with a count of the calls."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], [], []

    def getListState(self, *_):
        return self

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.calls.append(at)
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Mark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_key_yields_frames_for_closed_sessions_only():
    processor, handle = S.SessionProcessor(10), Handle()
    processor.init(handle)

    def given(*seconds):
        return iter([pd.DataFrame({"at": pd.to_datetime(list(seconds), unit="s"), "value": [1.0] * len(seconds)})])

    assert list(processor.handleInputRows(("k",), given(100, 105, 200), Mark(0))) == []
    assert handle.rows == [(100_000_000, 105_000_000, 2, 2.0), (200_000_000, 200_000_000, 1, 1.0)] and handle.timers == [115_000]
    assert list(processor.handleInputRows(("k",), given(205), Mark(0))) == [] and handle.calls == [115_000]  # the same timer goes on
    assert list(processor.handleInputRows(("k",), given(90), Mark(95_000))) == []  # late
    assert list(processor.handleInputRows(("k",), given(99), Mark(0))) == [] and handle.timers == [115_000]
    handle.timers.remove(115_000)  # the engine takes a timer away that fires
    (frame,) = processor.handleExpiredTimer(("k",), Mark(150_000), None)
    assert frame["n"].tolist() == [3] and frame["session_start"].tolist() == [pd.Timestamp(99, unit="s")] and frame["key"].tolist() == ["k"]
    assert handle.timers == [215_000] and len(handle.rows) == 1
