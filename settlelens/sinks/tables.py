"""Parquet, CSV and report writers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitions(df: DataFrame, path: str, by: list[str], mode: str = "overwrite", whole: bool = False) -> None:
    """Partitioned Parquet; only the partitions present in ``df`` are replaced, with ``whole`` all there are.

    Rows are rebalanced by the partition key; AQE splits a partition with very many rows between tasks.
    """
    (
        df.hint("rebalance", *by)
        .write.mode(mode)
        .option("partitionOverwriteMode", "static" if whole else "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def drop_days(spark: SparkSession, path: str, date: str, days: list[dt.date]) -> None:
    """Remove the partitions of the given days."""
    jvm = spark._jvm
    for day in days:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{date}={day}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_metrics(df: DataFrame, path: str) -> None:
    write_partitions(df, path, ["metric_key", "run_date"])


def write_panel(df: DataFrame, root: str, version: str) -> tuple[str, str]:
    """One dataset version as Parquet and CSV; an existing version is never replaced."""
    parquet, csv = f"{root}/daily_rollup_panel_v{version}.parquet", f"{root}/daily_rollup_panel_v{version}.csv"
    df.write.mode("errorifexists").parquet(parquet)
    df.sparkSession.read.schema(df.schema).parquet(parquet).write.mode("errorifexists").csv(csv, header=True)
    return parquet, csv


def write_reports(reports: dict[str, DataFrame], root: str, run_date: str) -> dict[str, str]:
    """QA tables as CSV folders named <report>_<run_date>."""
    paths = {}
    for name, df in reports.items():
        paths[name] = f"{root}/{name}_{run_date}.csv"
        df.write.mode("overwrite").csv(paths[name], header=True)
    return paths


def append_ledger(files: DataFrame, path: str, run_date: str) -> None:
    """Checksum ledger of raw files: appended, never rewritten."""
    files.withColumn("run_date", F.lit(run_date).cast("date")).write.mode("append").parquet(path)


def summary_by_check(checks: DataFrame) -> DataFrame:
    return checks.groupBy("check").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("status") == "pass").alias("n_pass"),
        F.count_if(F.col("status") == "warn").alias("n_warn"),
        F.count_if(F.col("status") == "fail").alias("n_fail"),
    )


def summary_markdown(summary: DataFrame) -> DataFrame:
    """The summary as Markdown table lines, in order: (line_no, line)."""
    head = ["| check | rows | pass | warn | fail |", "| --- | --- | --- | --- | --- |"]
    body = summary.select(
        F.lit(2).alias("line_no"),
        F.concat(
            F.lit("| "),
            F.concat_ws(" | ", "check", *[F.col(c).cast("string") for c in ("n_rows", "n_pass", "n_warn", "n_fail")]),
            F.lit(" |"),
        ).alias("line"),
    )
    heads = summary.sparkSession.createDataFrame(list(enumerate(head)), "line_no int, line string")
    return heads.unionByName(body).orderBy("line_no", "line")


def write_validation(checks: DataFrame, root: str) -> None:
    """Machine-readable (JSON) and readable (Markdown) validation summaries, one row per check."""
    summary = summary_by_check(checks)
    summary.write.mode("overwrite").json(f"{root}/summary.json")
    stored = summary.sparkSession.read.schema(summary.schema).json(f"{root}/summary.json")
    summary_markdown(stored).select("line").write.mode("overwrite").text(f"{root}/summary.md")
