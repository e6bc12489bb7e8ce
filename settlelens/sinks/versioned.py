"""Versioned tables: each publish is a new version, readers see whole versions only.

    root/data/build=<id>/<date>=<day>/   files of one publish, never changed afterwards
    root/versions/v<number>.json         one row per day of the version: day, build, rows

A publish writes its days into a build folder of its own, then the manifest of the new version under a temporary
name, and renames that to the next number: the rename is the one step that changes what readers see, and it
fails if another publish took the number first. A job that dies before it leaves the old version as it was,
and files that no version names. Days that a publish does not touch are taken over by name, not copied. The
manifest has a row per day, so it grows with the calendar and not with the rows of the table.

Edge cases. Rows without a date are refused before anything is written. A publish of no rows is a version
without the days of its span. An unknown version is an error; a table without any version has none to read.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlelens.sinks.tables import write_partitions


class Conflict(RuntimeError):
    """Another publish made the version first; the work may be run again on top of it."""


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, date: str = "date_utc"):
        self.spark, self.root, self.schema, self.date = spark, root.rstrip("/"), schema, date
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def manifest(self, version: int) -> dict[str, dict]:
        """day -> {"build", "rows"} of a version."""
        stream = self._fs.open(self._path(self._name(version)))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _name(self, version: int) -> str:
        return f"{self.root}/versions/v{version:08d}.json"

    def _commit(self, base: int | None, days: dict[str, dict]) -> int:
        version = (base or 0) + 1
        trial = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(trial, False)
        try:
            out.write(bytearray(json.dumps(days, sort_keys=True), "utf-8"))
        finally:
            out.close()
        target = self._path(self._name(version))
        # Refuses an existing target on HDFS and object stores with atomic rename; asked first for the local one.
        if self._fs.exists(target) or not self._fs.rename(trial, target):
            self._fs.delete(trial, False)
            raise Conflict(f"version {version} exists")
        return version

    # ---- publishing

    def _write(self, df: DataFrame) -> dict[str, dict]:
        build = uuid.uuid4().hex
        path = f"{self.root}/data/build={build}"
        dated = df.select(*self.schema.fieldNames())
        checked = dated.withColumn(self.date, F.coalesce(self.date, F.raise_error(F.lit(f"a row without {self.date}")).cast("date")))
        write_partitions(checked, path, [self.date], whole=True)
        found = self._data([path]).groupBy(self.date).count().collect()  # a row per day
        return {str(r[self.date]): {"build": build, "rows": r["count"]} for r in found}

    def publish_whole(self, df: DataFrame) -> int:
        """A version with the rows of ``df`` alone: days that it lacks are gone."""
        base = self.latest()
        return self._commit(base, self._write(df))

    def publish_days(self, df: DataFrame, first: dt.date, last: dt.date) -> int:
        """A version in which ``df`` stands in place of all days from ``first`` to ``last``."""
        base = self.latest()
        old = {} if base is None else self.manifest(base)
        kept = {d: v for d, v in old.items() if not str(first) <= d <= str(last)}
        fresh = self._write(df.where(F.col(self.date).isNull() | F.col(self.date).between(F.lit(first), F.lit(last))))
        return self._commit(base, kept | fresh)

    # ---- reading

    def _data(self, paths: list[str]) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField("build", T.StringType())])
        return self.spark.read.schema(full).option("basePath", f"{self.root}/data").parquet(*paths).drop("build").select(*self.schema.fieldNames())

    def read(self, version: int | None = None, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        """A version (the latest by default), of which only the folders of the asked days are read."""
        version = self.latest() if version is None else version
        if version is None or version not in self.versions():
            raise ValueError(f"no version {version}")
        days = self.manifest(version).items()
        paths = [
            f"{self.root}/data/build={v['build']}/{self.date}={d}"
            for d, v in sorted(days)
            if (first is None or d >= str(first)) and (last is None or d <= str(last))
        ]
        return self._data(paths) if paths else self.spark.createDataFrame([], self.schema)

    def changed_days(self, old: int, new: int) -> list[str]:
        """Days whose files differ between two versions; their rows are not read."""
        a, b = self.manifest(old), self.manifest(new)
        return sorted(d for d in a.keys() | b.keys() if a.get(d, {}).get("build") != b.get(d, {}).get("build"))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Drop all but the last ``keep`` versions, and builds that no version left names. Not while a publish runs."""
        versions = self.versions()
        for v in versions[: max(0, len(versions) - keep)]:
            self._fs.delete(self._path(self._name(v)), False)
        named = {d["build"] for v in versions[-keep:] for d in self.manifest(v).values()}
        data = self._path(f"{self.root}/data")
        gone = []
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            build = status.getPath().getName().removeprefix("build=")
            if build not in named:
                self._fs.delete(status.getPath(), True)
                gone.append(build)
        return gone
