"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import SparkSession

# Partition sizes are left to AQE: it coalesces small shuffle partitions and splits skewed ones,
# so the same settings hold for a laptop sample and for a large cluster.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

def build_session(app: str = "settlelens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_utc(spark: SparkSession) -> None:
    """Days are UTC days; a session in another zone would shift them."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, a folder of the warehouse, shared as well.

    A setting without a scheme means Spark's default file system, and is given back as a URI that says so.
    """
    shared = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    if "://" not in shared and not shared.startswith("file:"):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared)
        shared = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return shared.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/settlelens/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, Spark deletes the shuffle files of an execution as soon as that has ended.

    Otherwise they stay until the driver happens to collect its garbage, and many small steps pile them up.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df, label: str):
    """Like ``materialize``, with the folder, which can be deleted once nothing reads it any more."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df, label: str):
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives executor loss."""
    return written(df, label)[0]
