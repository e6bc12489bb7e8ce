"""Readers of vendor snapshots laid out as <root>/<key>/<run_date>/<file>.json."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from settlelens import contracts as C
from settlelens.functions import columns as X

RUN_DATE = r"/([0-9]{4}-[0-9]{2}-[0-9]{2})/"


def snapshot_date(path: Column | str) -> Column:
    """Date of the dated folder a snapshot lies in; null when it has none or an impossible one.

    The shape is tested before the cast, which alone would also accept a year or a month.
    """
    return X.strict_date(F.regexp_extract(X.col(path), r"(?:\A|/)([^/]+)/?\z", 1))


def require_snapshot_date(path: Column | str) -> Column:
    """As ``snapshot_date``, but a path without a valid dated folder is an error."""
    d = snapshot_date(path)
    return F.when(d.isNotNull(), d).otherwise(
        F.raise_error(F.concat(F.lit("no YYYY-MM-DD folder: "), X.col(path))).cast("date")
    )


def _json(spark: SparkSession, path: str, schema: T.StructType, lines: bool) -> DataFrame:
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path, multiLine=not lines)
    file = F.col("_metadata.file_path")
    return df.select(
        "*", file.alias("snapshot_path"), X.strict_date(F.regexp_extract(file, RUN_DATE, 1)).alias("run_date")
    )


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("date_utc", X.strict_date("date")).drop("date")


def read_vendor_export(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Metric exports as a long fact. Records are one per line; ``lines=False`` takes whole arrays,
    which Spark cannot split inside a file."""
    return _dated(_json(spark, path, C.VENDOR_EXPORT, lines)).select(
        "metric_key", "origin_key", "date_utc", "value", "run_date", "snapshot_path"
    )


def read_catalog(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Catalog object {key: metadata} under ``field`` as one row per key; metadata stays JSON text."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    entries = F.from_json("value", T.StructType([T.StructField(field, T.MapType(T.StringType(), T.StringType()))]))
    return text.select(F.col("_metadata.file_path").alias("snapshot_path"), F.explode(entries[field]).alias("key", "metadata"))


def read_costs(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Per-slug cost series; the slug is the file's folder below the run date or its name."""
    df = _json(spark, path, C.COSTS_EXPORT, lines)
    slug = F.regexp_extract("snapshot_path", r"/slug=([^/]+)/", 1)
    stem = F.regexp_extract("snapshot_path", r"/([^/]+)\.json\z", 1)
    return _dated(df.withColumn("slug", F.when(slug != "", slug).otherwise(stem)))


def read_blob_market(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    return _dated(_json(spark, path, C.BLOB_DAILY, lines))


def read_blob_blocks(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """The blob market at block level, for validation of the daily rows and of the chain's own headers."""
    return _dated(_json(spark, path, C.BLOB_BLOCKS, lines))


def read_rollup_blobs(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Blob gas and transaction hashes per day and labelled rollup; ``blobs_count`` follows from the gas."""
    return _dated(_json(spark, path, C.ROLLUP_BLOBS, lines)).withColumn("blobs_count", X.blobs_from_gas("rollup_blob_gas_used"))


def read_prices(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    return _dated(_json(spark, path, C.PRICES, lines))


def read_issuance(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    return _dated(_json(spark, path, C.ISSUANCE, lines))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    schema = "rollup_id STRING, origin_key STRING, display_name STRING, category STRING, in_scope BOOLEAN, notes STRING"
    return spark.read.csv(path, schema=schema, header=True, escape='"', enforceSchema=False)


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """(header, paths): the distinct first lines of the CSV files under ``path``, and the files that have each."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    first = lines.filter("_block = 0").groupBy("path").agg(F.min_by("value", "_id").alias("header"))
    return first.groupBy(F.regexp_replace("header", "\\r$", "").alias("header")).agg(F.collect_list("path").alias("paths"))


def header_failures(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """(path, failure, message) of the CSV files under ``path`` whose header lacks required columns or that have no header.

    A file of blank lines has no header; one of no bytes at all is not seen by any scan, so not here either.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")
    )
    first = lines.filter("_block = 0 AND value <> ''").groupBy("path").agg(F.min_by("value", "_id").alias("header"))
    have = F.transform(F.split(F.regexp_replace("header", "\\r$", ""), ","), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    wanted = F.array(*[F.lit(c) for c in sorted(required)])
    missing = F.array_except(wanted, have)
    judged = files.join(first, "path", "left").select(
        "path",
        F.when(F.col("header").isNull(), F.lit("missing_header")).when(F.size(missing) > 0, F.lit("missing_columns")).alias("failure"),
        F.when(F.col("header").isNull(), F.lit("missing_header")).otherwise(F.concat(F.lit("missing_columns:"), F.array_join(missing, ","))).alias("message"),
    )
    return judged.where("failure IS NOT NULL")


def read_panel_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """As ``_panel_files``, with the columns of every file taken by the names in its own header.

    Files of one header are read together; the driver gets one row per distinct header, with the file names
    it would list for the scan anyway.
    """
    groups = csv_headers(spark, path).collect()
    if len(groups) < 2:
        return _panel_files(spark, path, multi_line)
    parts = [_panel_files(spark, sorted(g["paths"]), multi_line) for g in sorted(groups, key=lambda g: g["header"] or "")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _panel_files(spark: SparkSession, path: str | list[str], multi_line: bool) -> DataFrame:
    """A panel CSV with every cell as text, its file and the row's 0-based position in that file.

    Quoted cells may hold line breaks, and such a file is read by one task. ``multi_line=False`` lets
    Spark split large files without them. Rows of one split have consecutive ids, so the position is
    the distance to the least id of the split plus the rows of the file's earlier splits.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')
    rows = raw.select(
        "*",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = rows.groupBy("path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy("path").orderBy("_block")) - F.col("_n")
    offsets = splits.select("path", "_block", (earlier - F.col("_first")).alias("_shift"))
    return (
        rows.join(offsets, ["path", "_block"])
        .withColumn("row_index", F.col("_id") + F.col("_shift"))
        .drop("_id", "_block", "_shift")
    )


def missing_columns(df: DataFrame, required: list[str]) -> str | None:
    """The header message of a panel sample: no header at all, columns missing, or nothing wrong."""
    have = [c for c in df.columns if c not in ("path", "row_index")]
    if not have:
        return "missing_header"
    missing = sorted(set(required) - set(have))
    return "missing_columns:" + ",".join(missing) if missing else None
