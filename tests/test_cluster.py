"""Queries on executors of their own, with spark.checkpoint.dir given without a scheme."""

import os
import pathlib
import shutil
import subprocess
import sys

import pytest

REPO = pathlib.Path(__file__).resolve().parents[1]
SF = pathlib.Path("/root/testdata/sf0.001")
RUN = """
import sys
from pyspark.sql import SparkSession
d, scratch, key = sys.argv[1:]
conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1", "spark.executor.memory": "900m",
        "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"{scratch}/shared",
        "spark.sql.warehouse.dir": f"{scratch}/warehouse", "spark.local.dir": f"{scratch}/local"}
b = SparkSession.builder.master("local-cluster[2,1,900]")
for k, v in conf.items():
    b = b.config(k, v)
spark = b.getOrCreate()
spark.createDataFrame([(i, ("en", "de")[i % 2], "web", f"text {i}") for i in range(7)], "doc_id bigint, lang string, source string, text string").write.parquet(f"{d}/documents.parquet")
import __spark_entry__ as E
print("rows", E.queries()[key](spark, d).count())
spark.stop()
"""


def rows_on_a_cluster(key: str, tmp_path) -> int:
    """Rows of a query over seven documents of our own."""
    d = tmp_path / "tables"
    d.mkdir()
    for file in SF.iterdir():
        if file.name != "documents.parquet":
            shutil.copy(file, d)
    env = {**os.environ, "PYTHONPATH": str(REPO), "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", RUN, str(d), str(tmp_path), key], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    return int(done.stdout.split("rows ")[-1])


def test_k5_processed_manifest(tmp_path):
    assert rows_on_a_cluster("k5_processed_manifest", tmp_path) == 7


def test_k6_run_manifest(tmp_path):
    assert rows_on_a_cluster("k6_run_manifest", tmp_path) == 4


def test_k7_checksum_ledger(tmp_path):
    assert rows_on_a_cluster("k7_checksum_ledger", tmp_path) == 14
