"""Queries of sources, sinks and refresh: the adapters' rows are written in the raw layout under the
shared scratch folder and read back, so the adapter's SQL is the expected content."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlelens import contracts as C
from settlelens.operators import checks as Q
from settlelens.operators import costs as K
from settlelens.operators import metrics as M
from settlelens.operators import reconcile as R
from settlelens.plans import chain_queries as CQ
from settlelens.plans import check_queries as KQ
from settlelens.plans import fixtures as fx
from settlelens.plans import panel_queries as PQ
from settlelens.plans.catalogue import query
from settlelens.plans.fixtures import sql
from settlelens.session import fresh_dir
from settlelens.sinks import manifests as MF
from settlelens.sinks import tables as TB
from settlelens.sources import chain as SC
from settlelens.sources import snapshots as SN
from settlelens.sources import vendor as SV
from settlelens.streaming import refresh as RF

RUN = "2024-02-01"
RUN_DAY = dt.date(2024, 1, 30)


def iso(name: str):
    return F.col(name).cast("string").alias("date")


# ---- scans --------------------------------------------------------------------------------------


@query("s1_vendor_export", sql(
    f"SELECT metric_key, origin_key, date_utc, value, DATE '{RUN}' AS run_date FROM fx_metrics", "fx_metrics"),
    dates=("date_utc", "run_date"))
def s1(spark, d):
    root = fresh_dir(spark, "export")
    fx.metrics(spark, d).select("metric_key", "origin_key", iso("date_utc"), "value").write.json(f"{root}/{RUN}")
    return SV.read_vendor_export(spark, root).drop("snapshot_path")


@query("s2_catalog", sql(
    "SELECT origin_key AS key, display_name AS name, category FROM fx_universe", "fx_universe"))
def s2(spark, d):
    """Catalog documents of at most a thousand origins each."""
    root = fresh_dir(spark, "master")
    u = fx.universe(spark, d)
    entry = F.struct(F.col("origin_key"), F.struct(F.col("display_name").alias("name"), "category"))
    shard = F.floor(F.substring("origin_key", 2, 20).cast("bigint") / 1000)
    docs = u.groupBy(shard.alias("shard")).agg(F.map_from_entries(F.collect_list(entry)).alias("origins"))
    docs.select(F.to_json(F.struct("origins")).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{root}/{RUN}")
    c = SV.read_catalog(spark, root, "origins")
    meta = F.from_json("metadata", "name STRING, category STRING")
    return c.select("key", meta.getField("name").alias("name"), meta.getField("category").alias("category"))


@query("s3_costs", sql("SELECT date_utc, slug, unit, total_cost_eth FROM fx_costs", "fx_costs"), dates=("date_utc",))
def s3(spark, d):
    root = fresh_dir(spark, "costs")
    fx.second_vendor_costs(spark, d).select("slug", iso("date_utc"), "unit", "total_cost_eth").write.partitionBy("slug").json(
        f"{root}/{RUN}")
    return SV.read_costs(spark, root).select("date_utc", "slug", "unit", "total_cost_eth")


@query("s4_blob_market", sql(
    """SELECT date_utc, CAST(SUM(blob_gas_used) AS BIGINT) AS blob_gas_used, CAST(SUM(blob_gas_used) / 131072 AS BIGINT) AS blobs_count
    FROM fx_blocks GROUP BY 1""", "fx_blocks"), dates=("date_utc",))
def s4(spark, d):
    root = fresh_dir(spark, "blob-market")
    m = K.blob_market_daily(fx.blocks(spark, d), CQ.timed_tx(spark, d))
    m.select(iso("date_utc"), "blob_gas_used", "excess_blob_gas", "blob_tx_count", "blobs_count").write.json(f"{root}/{RUN}")
    return SV.read_blob_market(spark, root).select("date_utc", "blob_gas_used", "blobs_count")


@query("s4_blob_blocks", sql(
    """SELECT block_number, date_utc, CAST(base_fee_per_blob_gas_wei AS BIGINT) AS fee_wei, blob_gas_used, excess_blob_gas FROM fx_blocks
    WHERE blob_gas_used IS NOT NULL""", "fx_blocks"), dates=("date_utc",))
def s4_blocks(spark, d):
    """The blob market at block level, landed as JSON and read back."""
    root = fresh_dir(spark, "blob-blocks")
    b = fx.blocks(spark, d).where("blob_gas_used IS NOT NULL").withColumn("date_utc", F.timestamp_seconds("timestamp").cast("date"))
    b.select(iso("date_utc"), "block_number", "timestamp", "base_fee_per_blob_gas_wei", "blob_gas_used", "excess_blob_gas").write.json(f"{root}/{RUN}")
    read = SV.read_blob_blocks(spark, root)
    return read.select("block_number", "date_utc", F.col("base_fee_per_blob_gas_wei").cast("bigint").alias("fee_wei"), "blob_gas_used", "excess_blob_gas")


@query("s4_rollup_blobs", sql(
    """SELECT date_utc, rollup_id AS rollup_label, COUNT(*) AS n_hashes, CAST(SUM(blob_count) AS BIGINT) AS blobs_count FROM fx_tx_costs
    WHERE tx_type = 3 AND blob_count IS NOT NULL GROUP BY 1, 2""", "fx_tx_costs"), dates=("date_utc",))
def s4_rollups(spark, d):
    """Blob gas and hashes per labelled rollup and day, landed as JSON and read back."""
    root = fresh_dir(spark, "rollup-blobs")
    per = CQ.attributed(spark, d).where("tx_type = 3 AND blob_count IS NOT NULL").groupBy("date_utc", F.col("rollup_id").alias("rollup_label")).agg(
        F.collect_list("tx_hash").alias("rollup_blob_tx_hashes"), (F.sum("blob_count") * C.GAS_PER_BLOB).cast("bigint").alias("rollup_blob_gas_used"))
    per.select(iso("date_utc"), "rollup_label", "rollup_blob_tx_hashes", "rollup_blob_gas_used").write.json(f"{root}/{RUN}")
    read = SV.read_rollup_blobs(spark, root)
    return read.select("date_utc", "rollup_label", F.size("rollup_blob_tx_hashes").cast("bigint").alias("n_hashes"), "blobs_count")


@query("s5_prices_and_issuance", sql(
    """SELECT p.date_utc, eth_usd_close, issuance_eth FROM fx_prices p JOIN fx_issuance i ON p.date_utc = i.date_utc""",
    "fx_prices", "fx_issuance"), dates=("date_utc",))
def s5(spark, d):
    root = fresh_dir(spark, "inputs")
    fx.prices(spark, d).select(iso("date_utc"), "eth_usd_close", F.lit("primary").alias("source")).write.json(f"{root}/prices/{RUN}")
    fx.issuance(spark, d).select(iso("date_utc"), "issuance_eth", F.lit("primary").alias("source"), F.lit("epochs").alias("method")).write.json(
        f"{root}/issuance/{RUN}")
    p, i = SV.read_prices(spark, f"{root}/prices"), SV.read_issuance(spark, f"{root}/issuance")
    return p.select("date_utc", "eth_usd_close").join(i.select("date_utc", "issuance_eth"), "date_utc")


@query("s6_l1_tables", sql(
    """SELECT block_number, "timestamp", CAST(base_fee_per_gas_wei AS BIGINT) AS base_fee_wei, blob_gas_used FROM fx_blocks
    WHERE date_trunc('year', date_utc) BETWEEN DATE '1996-01-01' AND DATE '1998-01-01'""", "fx_blocks"))
def s6(spark, d):
    root = fresh_dir(spark, "l1")
    b = fx.blocks(spark, d)
    TB.write_partitions(
        b.withColumn("run_date", F.trunc(F.timestamp_seconds("timestamp").cast("date"), "year")), f"{root}/blocks", ["run_date"])
    read = SC.read_l1(spark, root, "blocks", ("1996-01-01", "1998-01-01"))
    return read.select("block_number", "timestamp", F.col("base_fee_per_gas_wei").cast("bigint").alias("base_fee_wei"), "blob_gas_used")


def landed_tx(spark, d, table: str, rows: DataFrame) -> DataFrame:
    """A transaction table landed by the year of its block and read back for three years."""
    root = fresh_dir(spark, "l1")
    year = fx.raw_blocks(spark, d).select("block_number", F.trunc(F.timestamp_seconds("timestamp").cast("date"), "year").alias("run_date"))
    TB.write_partitions(rows.join(year, "block_number"), f"{root}/{table}", ["run_date"])
    return SC.read_l1(spark, root, table, ("1996-01-01", "1998-01-01"))


@query("s6_l1_receipts", sql(
    """SELECT r.tx_hash, r.block_number, CAST(r.gas_used AS BIGINT) AS gas_used FROM fx_receipts r JOIN fx_blocks b ON b.block_number = r.block_number
    WHERE date_trunc('year', b.date_utc) BETWEEN DATE '1996-01-01' AND DATE '1998-01-01'""", "fx_receipts", "fx_blocks"))
def s6_receipts(spark, d):
    read = landed_tx(spark, d, "receipts", fx.receipts(spark, d))
    return read.select("tx_hash", "block_number", F.col("gas_used").cast("bigint").alias("gas_used"))


@query("s6_l1_blob_tx", sql(
    """SELECT r.tx_hash FROM fx_receipts r JOIN fx_blocks b ON b.block_number = r.block_number
    WHERE r.tx_type = 3 AND date_trunc('year', b.date_utc) BETWEEN DATE '1996-01-01' AND DATE '1998-01-01'""", "fx_receipts", "fx_blocks"))
def s6_blob_tx(spark, d):
    of = fx.receipts(spark, d).select("tx_hash", "block_number").distinct()
    return landed_tx(spark, d, "blob_tx", fx.blob_tx(spark, d).join(of, "tx_hash")).select("tx_hash")


def registry(spark, d):
    s = fx.table(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    address = F.concat(F.lit("0x"), F.lpad(k, 40, "a"))
    listed = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.upper(address), F.concat(F.lit("0x"), F.lpad(k, 40, "b")))).otherwise(
        F.array().cast("array<string>"))
    text = {
        "rollup_id": F.concat(F.lit("s"), k), "display_name": F.concat(F.lit('Rollup "'), k, F.lit('", main')), "type": F.lit("zk"),
        "da_posting_method": F.lit("blob"), "batcher_addresses_json": F.to_json(listed), "evidence_url": F.lit("https://example.org"),
        "verified_utc": F.lit("2024-01-15"), "status": F.lit("active"), "start_date_utc": F.lit("2023-05-01"),
        "end_date_utc": F.when(F.col("s_suppkey") % 2 == 0, "2024-02-30").otherwise("2024-02-29"), "notes": F.lit(None).cast("string"),
    }
    return s.select(*[text[c].alias(c) for c in C.REGISTRY_COLUMNS])


@query("s7_registry",
       """SELECT 's' || CAST(s_suppkey AS VARCHAR) AS rollup_id, 'Rollup "' || CAST(s_suppkey AS VARCHAR) || '", main' AS display_name,
       DATE '2023-05-01' AS start_date_utc, CASE WHEN s_suppkey % 2 <> 0 THEN DATE '2024-02-29' END AS end_date_utc,
       CASE WHEN a IS NOT NULL THEN '0x' || lpad(CAST(s_suppkey AS VARCHAR), 40, a) END AS address FROM supplier
       LEFT JOIN (SELECT 'a' AS a UNION ALL SELECT 'b') ON s_suppkey % 3 = 0""", dates=("start_date_utc", "end_date_utc"))
def s7(spark, d):
    root = fresh_dir(spark, "registry")
    registry(spark, d).write.csv(root, header=True, escape='"')
    return SC.read_registry(spark, root).select("rollup_id", "display_name", "start_date_utc", "end_date_utc", "address")


@query("s8_universe", sql("SELECT rollup_id, origin_key, display_name, category, in_scope FROM fx_universe", "fx_universe"))
def s8(spark, d):
    root = fresh_dir(spark, "universe")
    u = fx.universe(spark, d).select("rollup_id", "origin_key", "display_name", "category", "in_scope", F.lit(None).cast("string").alias("notes"))
    u.write.csv(root, header=True, escape='"')
    return SV.read_universe(spark, root).drop("notes")


def panel_csv(spark: SparkSession, d: str) -> DataFrame:
    root = fresh_dir(spark, "panel-csv")
    profit = fx.panel(spark, d).select(
        F.col("date_utc").cast("string").alias("date_utc"), "rollup_id",
        F.when(F.col("txcount") % 4 == 2, "").otherwise(F.col("profit_eth").cast("string")).alias("profit_eth"))
    PQ.text_panel(spark, d).join(profit, ["date_utc", "rollup_id"]).write.csv(root, header=True, escape='"', quoteAll=True, emptyValue="")
    return SV.read_panel_csv(spark, root)


@query("s9_panel_csv", sql(
    """SELECT date_utc, rollup_id, CASE WHEN txcount % 11 = 0 THEN 'n/a' END AS broken_fees,
    CASE WHEN txcount % 7 = 0 THEN '12d' ELSE CAST(txcount AS VARCHAR) END AS txcount FROM fx_panel""", "fx_panel"), dates=("date_utc",))
def s9(spark, d):
    p = panel_csv(spark, d)
    return p.select("date_utc", "rollup_id", F.when(F.col("l2_fees_eth") == "n/a", F.col("l2_fees_eth")).alias("broken_fees"), "txcount")


@query("q2_panel_text", sql(
    """SELECT 'l2_fees_eth' AS "column", 'invalid_number' AS failure, COUNT(*) AS n_rows FROM fx_panel WHERE txcount % 11 = 0 HAVING COUNT(*) > 0
    UNION ALL SELECT 'profit_eth', 'negative', COUNT(*) FROM fx_panel WHERE profit_eth < 0 AND txcount % 4 <> 2 HAVING COUNT(*) > 0""", "fx_panel"))
def q2(spark, d):
    return Q.panel_text_failures(panel_csv(spark, d)).groupBy("column", "failure").agg(F.count(F.lit(1)).alias("n_rows"))


@query("q2_panel_header", sql(
    """SELECT 'missing_columns' AS failure, 'missing_columns:l2_fees_eth,rent_paid_eth' AS message, COUNT(*) AS n_files FROM
      (SELECT DISTINCT date_trunc('month', date_utc) FROM fx_panel WHERE month(date_utc) = 2) HAVING COUNT(*) > 0
    UNION ALL SELECT 'missing_header', 'missing_header', COUNT(*) FROM (SELECT DISTINCT date_trunc('month', date_utc) FROM fx_panel WHERE month(date_utc) = 3) HAVING COUNT(*) > 0""",
    "fx_panel"))
def q2_header(spark, d):
    """Panel samples, one file per month: those of February lack columns, those of March have no header at all."""
    root, panel = fresh_dir(spark, "headers"), fx.panel(spark, d).withColumn("month", F.trunc("date_utc", "month").cast("string"))
    files = panel.groupBy("month").agg(F.month(F.first("date_utc")).alias("k"), F.sort_array(F.collect_set("date_utc")).alias("days"))
    head = F.when(F.col("k") == 2, F.lit("date_utc,rollup_id\n")).when(F.col("k") == 3, F.lit("")).otherwise(F.lit("date_utc,rollup_id,l2_fees_eth,rent_paid_eth\n"))
    body = F.when(F.col("k") == 3, F.lit("")).otherwise(F.array_join(F.transform("days", lambda t: F.concat(t.cast("string"), F.lit(",all"))), "\n"))
    files.select("month", F.concat(head, body).alias("text")).coalesce(4).write.option("lineSep", "\n").partitionBy("month").text(root)
    found = SV.header_failures(spark, f"{root}/*", Q.PANEL_REQUIRED)
    return found.groupBy("failure", "message").agg(F.countDistinct(F.regexp_extract("path", "month=([0-9-]+)", 1)).alias("n_files"))


# All rows come back; whether a sample check of the first rows would have looked at one is a column.
SAMPLE_ROWS = 2000


@query("t5_row_cap", sql(
    f"""SELECT i AS row_index, date_utc, rollup_id, i < {SAMPLE_ROWS} AS in_sample FROM
    (SELECT *, ROW_NUMBER() OVER (ORDER BY date_utc, rollup_id) - 1 AS i FROM fx_panel)""", "fx_panel"), dates=("date_utc",))
def t5(spark, d):
    return M.numbered(fx.panel(spark, d).select("date_utc", "rollup_id"), "date_utc", "rollup_id").withColumn(
        "in_sample", F.col("row_index") < SAMPLE_ROWS)


def snapshot(spark: SparkSession, d: str) -> str:
    """A dated snapshot folder with one file per document text, in one sub-folder per language."""
    folder = f"{fresh_dir(spark, 'snapshot')}/{RUN}"
    name = F.concat(F.col("lang"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    MF.write_documents(fx.table(spark, d, "documents").select(name.alias("name"), F.col("text").alias("document")), folder)
    return folder


def snapshot_files(spark: SparkSession, d: str) -> DataFrame:
    return SN.scan_snapshot_files(spark, snapshot(spark, d))


FILES = ("files_", """SELECT lang || '/doc-' || CAST(doc_id AS VARCHAR) || '.txt' AS path, sha256(text || chr(10)) AS sha256,
  CAST(octet_length(encode(text)) + 1 AS BIGINT) AS bytes FROM documents""")


@query("s11_snapshot_files", sql("SELECT path, sha256, bytes FROM files_", extra=(FILES,)))
def s11(spark, d):
    return snapshot_files(spark, d)


DOC_SQL = """SELECT CASE WHEN o_orderkey % 6 = 1 THEN 'invalid_json' WHEN o_orderkey % 6 = 2 THEN 'top_level_not_object'
WHEN o_orderkey % 6 = 3 THEN 'missing_keys:command,source' WHEN o_orderkey % 6 = 4 THEN 'files[0]:invalid_sha256'
WHEN o_orderkey % 6 = 5 THEN 'files_not_list' END AS failure, COUNT(*) AS n FROM orders WHERE o_orderkey % 6 > 0 GROUP BY 1"""


def documents(spark: SparkSession, d: str) -> DataFrame:
    """One manifest text per order, five kinds of them broken."""
    o = fx.table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    entry = F.struct(F.concat(F.lit("a/"), key).alias("path"), F.sha2(key, 256).alias("sha256"), F.col("o_custkey").alias("bytes"))
    bad = F.struct(F.concat(F.lit("a/"), key).alias("path"), F.upper(F.sha2(F.concat(key, F.lit("f")), 256)).alias("sha256"),
                   F.col("o_custkey").alias("bytes"))
    head = lambda files: F.to_json(F.struct(
        F.lit("vendor").alias("source"), F.lit("t").alias("fetched_at_utc"), F.lit("c").alias("command"), files.alias("files")))
    k = F.col("o_orderkey") % 6
    text = (
        F.when(k == 1, F.concat(F.lit('{"source": '), key))
        .when(k == 2, F.to_json(F.array(key)))
        .when(k == 3, F.to_json(F.struct(F.lit("t").alias("fetched_at_utc"), F.array(entry).alias("files"))))
        .when(k == 4, head(F.array(bad)))
        .when(k == 5, head(entry))
        .otherwise(head(F.array(entry)))
    )
    return o.select(F.concat(F.lit("m-"), key, F.lit(".json")).alias("path"), text.alias("content"))


@query("q3_manifest_validity", DOC_SQL)
def q3(spark, d):
    return Q.manifest_failures(documents(spark, d)).groupBy("failure").agg(F.count(F.lit(1)).alias("n"))


def tagged_files(spark, d):
    return snapshot_files(spark, d).withColumns({"source": F.lit("vendor"), "as_of_utc_date": F.lit(RUN).cast("date")})


def stored_entries(spark: SparkSession, root: str, field: str = "files") -> DataFrame:
    """Entries of the manifests below ``root``, read from their files."""
    return SN.manifest_entries(SN.read_manifests(spark, root), field).select("path", "sha256", "bytes")


@query("s10_manifests", sql("SELECT path, sha256, bytes FROM files_", extra=(FILES,)))
def s10(spark, d):
    root = fresh_dir(spark, "manifests")
    MF.write_documents(MF.raw_manifests(tagged_files(spark, d), "collect --all", 500), root)
    return stored_entries(spark, root)


@query("s13_snapshot_date",
       """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) END AS as_of FROM orders""", dates=("as_of",))
def s13(spark, d):
    day = F.to_date("o_orderdate").cast("string")
    k = F.col("o_orderkey") % 4
    folder = F.when(k == 0, day).when(k == 1, F.substring(day, 1, 7)).when(k == 2, "2024-02-30").otherwise("latest")
    path = F.concat(F.lit("data/raw/vendor/"), folder)
    return fx.table(spark, d, "orders").select("o_orderkey", SV.snapshot_date(path).alias("as_of"))


@query("t4_path_order",
       """SELECT path, ROW_NUMBER() OVER (ORDER BY string_split(path, '/')) - 1 AS row_index FROM (SELECT 'raw/' || CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'a-b' END || '/' || CAST(o_orderkey AS VARCHAR) AS path
       FROM orders)""")
def t4(spark, d):
    o = fx.table(spark, d, "orders")
    path = F.concat(F.lit("raw/"), F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("a-b"), F.lit("/"), F.col("o_orderkey").cast("string"))
    return M.numbered(o.select(path.alias("path")), *SN.path_order())


# ---- sinks --------------------------------------------------------------------------------------


@query("k1_write_metrics", sql(
    f"SELECT metric_key, origin_key, date_utc, value, DATE '{RUN}' AS run_date FROM fx_metrics", "fx_metrics"),
    dates=("date_utc", "run_date"))
def k1(spark, d):
    root = fresh_dir(spark, "metrics")
    m = fx.metrics(spark, d).withColumn("run_date", F.lit(RUN).cast("date"))
    TB.write_metrics(m, root)
    TB.write_metrics(m.filter("metric_key = 'fees_eth'"), root)  # a second run replaces its partition only
    return spark.read.schema(m.schema).parquet(root).select(*m.columns)


@query("k2_write_panel", sql(
    """SELECT format, date_utc, rollup_id, txcount FROM fx_panel, (SELECT 'parquet' AS format UNION ALL SELECT 'csv')""", "fx_panel"),
    dates=("date_utc",))
def k2(spark, d):
    p = fx.panel(spark, d)
    parquet, csv = TB.write_panel(p, fresh_dir(spark, "panel"), "1")
    a = spark.read.schema(p.schema).parquet(parquet).withColumn("format", F.lit("parquet"))
    b = spark.read.schema(p.schema).csv(csv, header=True, enforceSchema=False).withColumn("format", F.lit("csv"))
    return a.unionByName(b).select("format", "date_utc", "rollup_id", "txcount")


@query("k3_qa_reports", sql(
    """SELECT 'coverage' AS report, COUNT(*) AS n_rows FROM fx_universe WHERE in_scope UNION ALL
    SELECT 'gaps', COUNT(*) FROM (SELECT LEAD(date_utc) OVER (PARTITION BY rollup_id ORDER BY date_utc) - date_utc AS gap FROM fx_panel) WHERE gap > 3""",
    "fx_universe", "fx_panel"))
def k3(spark, d):
    reports = {"coverage": PQ.vendor_coverage(spark, d), "gaps": M.missing_day_runs(fx.panel(spark, d), keys=("rollup_id",))}
    paths = TB.write_reports(reports, fresh_dir(spark, "qa"), RUN)
    parts = [
        spark.read.schema(reports[n].schema).csv(p, header=True, enforceSchema=False).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(n).alias("report"), "n_rows")
        for n, p in paths.items()
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query("k4_raw_manifest", sql(
    """SELECT 'vendor' AS source, '2024-02-01' AS as_of_utc_date, 'collect --all' AS command, COUNT(*) AS n_files,
    CAST(SUM(bytes) AS BIGINT) AS bytes, TRUE AS sorted FROM files_""", extra=(FILES,)))
def k4(spark, d):
    docs = MF.raw_manifests(tagged_files(spark, d), "collect --all")
    doc = F.from_json(
        "document", "source STRING, as_of_utc_date STRING, command STRING, files ARRAY<STRUCT<path: STRING, sha256: STRING, bytes: BIGINT>>")
    m = docs.select(doc.alias("m")).select("m.*")
    order = F.transform("files", lambda f: F.split(f.path, "/"))
    per_doc = m.select("source", "as_of_utc_date", "command", F.size("files").alias("n"),
                       F.aggregate("files", F.lit(0).cast("bigint"), lambda t, f: t + f.bytes).alias("b"),
                       (F.sort_array(order) == order).alias("s"))
    return per_doc.groupBy("source", "as_of_utc_date", "command").agg(
        F.sum("n").alias("n_files"), F.sum("b").alias("bytes"), F.bool_and("s").alias("sorted"))


@query("k5_processed_manifest", sql("SELECT path, sha256, bytes FROM files_", extra=(FILES,)))
def k5(spark, d):
    files = snapshot_files(spark, d).withColumn("name", F.lit("texts"))
    docs = MF.processed_manifest(files, [f"vendor_{RUN}.json"], RUN, "settlelens/operators/normalize.py", "0" * 40, "build texts")
    root = fresh_dir(spark, "processed-manifests")
    MF.write_documents(docs, root)
    return stored_entries(spark, root, "outputs")


@query("k6_run_manifest", sql(
    """SELECT 'run' AS section, 1::BIGINT AS n UNION ALL SELECT 'source_snapshots', COUNT(*) FROM files_
    UNION ALL SELECT 'coverage_metrics', COUNT(*) FROM fx_universe WHERE in_scope
    UNION ALL SELECT 'reconciliation_metrics', COUNT(*) FROM pairs_""",
    "fx_universe", "fx_panel", "fx_costs", extra=(FILES, PQ.COSTS2, KQ.PAIRS)))
def k6(spark, d):
    root = fresh_dir(spark, "run-manifest")
    rec = R.reconcile_months(KQ.pairs(spark, d)).select("key", "observed", "status")
    doc = MF.run_manifest("run-1", RUN, "0" * 40, snapshot_files(spark, d), PQ.vendor_coverage(spark, d), rec)
    doc.write.json(root)
    stored = spark.read.schema(doc.schema).json(root)
    return stored.groupBy("section").agg(F.count("document").alias("n"))


@query("k7_checksum_ledger", sql(
    """SELECT path, sha256, bytes, CAST(run_date AS VARCHAR) AS run_date FROM files_,
    (SELECT UNNEST([DATE '2024-02-01', DATE '2024-02-02']) AS run_date)""", extra=(FILES,)))
def k7(spark, d):
    ledger = fresh_dir(spark, "ledger")
    files = snapshot_files(spark, d)
    TB.append_ledger(files, ledger, "2024-02-01")
    TB.append_ledger(files, ledger, "2024-02-02")
    return spark.read.parquet(ledger)


@query("k8_validation_summary", sql(
    f"""SELECT 'reconcile' AS "check", COUNT(*) AS n_rows, CAST(COUNT(*) FILTER (WHERE s = 'pass') AS BIGINT) AS n_pass,
    CAST(COUNT(*) FILTER (WHERE s = 'warn') AS BIGINT) AS n_warn, CAST(COUNT(*) FILTER (WHERE s = 'fail') AS BIGINT) AS n_fail
    FROM (SELECT {KQ.banded(KQ.DIFF, 0.05, 0.10)} AS s FROM pairs_)
    UNION ALL SELECT 'vendor_coverage', COUNT(*), CAST(COUNT(*) FILTER (WHERE coverage >= 0.95) AS BIGINT), 0,
    CAST(COUNT(*) FILTER (WHERE coverage < 0.95) AS BIGINT) FROM coverage_""",
    "fx_vendor", "fx_universe", "fx_panel", "fx_costs", extra=(PQ.ROWS, PQ.SPINE, PQ.COVERAGE, PQ.COSTS2, KQ.PAIRS)))
def k8(spark, d):
    root = fresh_dir(spark, "validation")
    cover = Q.coverage_threshold(PQ.vendor_coverage(spark, d), "rollup_id", "vendor_coverage", C.COVERAGE_VENDOR)
    checks = R.reconcile_months(KQ.pairs(spark, d)).unionByName(cover)
    TB.write_validation(checks, root)
    return spark.read.schema(TB.summary_by_check(checks).schema).json(f"{root}/summary.json")


# ---- refresh ------------------------------------------------------------------------------------

REFRESHED = """SELECT metric_key, origin_key, date_utc, CASE WHEN date_utc > DATE '2024-01-30' - {days} THEN value ELSE value * 2 END AS value
FROM fx_metrics"""


def stale(df: DataFrame) -> DataFrame:
    """An earlier build in which every value is off."""
    return df.withColumn("value", F.col("value") * 2)


# One day inside the refreshed spans and one before them that the source has no more.
GONE = (dt.date(2024, 1, 27), dt.date(2024, 1, 5))
KEPT_SQL = f"date_utc NOT IN (DATE '{GONE[0]}', DATE '{GONE[1]}')"
INSIDE_SQL = f"date_utc <> DATE '{GONE[0]}'"


def without_gone(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("date_utc").isin(*GONE))


@query("n1_refresh_chain", sql(REFRESHED.format(days=7) + f" WHERE {INSIDE_SQL}", "fx_metrics"), dates=("date_utc",))
def n1(spark, d):
    root, m = fresh_dir(spark, "refresh"), fx.metrics(spark, d)
    TB.write_partitions(stale(m), root, ["date_utc"])
    RF.refresh_chain(without_gone(m), root, RUN_DAY)
    return spark.read.schema(m.schema).parquet(root).select(*m.columns)


def daily_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("date_utc").agg(M.exact_sum("value").cast("double").alias("value"), F.count(F.lit(1)).alias("n"))


SUMS = """SELECT date_utc, CAST(SUM(CAST(value AS DECIMAL(38,6))) AS DOUBLE) * {factor} AS value, COUNT(*) AS n FROM fx_metrics
WHERE {kept} GROUP BY 1"""


@query("n2_refresh_costs", sql(SUMS.format(factor="CASE WHEN date_utc > DATE '2024-01-30' - 7 THEN 1 ELSE 2 END", kept=INSIDE_SQL), "fx_metrics"),
       dates=("date_utc",))
def n2(spark, d):
    root, m = fresh_dir(spark, "refresh"), fx.metrics(spark, d)
    TB.write_partitions(stale(daily_sums(m)), root, ["date_utc"])
    RF.refresh_costs(without_gone(m), daily_sums, root, RUN_DAY)
    return spark.read.schema(daily_sums(m).schema).parquet(root).select("date_utc", "value", "n")


def panel_builder(spark, d, all_days=False):
    m = fx.metrics(spark, d)
    m = m if all_days else without_gone(m)
    return lambda first: daily_sums(m if first is None else m.filter(F.col("date_utc") >= F.lit(first)))


@query("n3_refresh_panel", sql(SUMS.format(factor="CASE WHEN date_utc > DATE '2024-01-30' - 14 THEN 1 ELSE 2 END", kept=INSIDE_SQL), "fx_metrics"),
       dates=("date_utc",))
def n3(spark, d):
    root, build = fresh_dir(spark, "refresh"), panel_builder(spark, d)
    TB.write_partitions(stale(panel_builder(spark, d, True)(None)), root, ["date_utc"])
    RF.refresh_panel(build, root, RUN_DAY)
    return spark.read.schema(build(None).schema).parquet(root).select("date_utc", "value", "n")


@query("n4_full_rebuild", sql(SUMS.format(factor="1", kept=KEPT_SQL), "fx_metrics"), dates=("date_utc",))
def n4(spark, d):
    root, build = fresh_dir(spark, "refresh"), panel_builder(spark, d)
    TB.write_partitions(stale(panel_builder(spark, d, True)(None)), root, ["date_utc"])
    RF.full_rebuild(build, root)
    return spark.read.schema(build(None).schema).parquet(root).select("date_utc", "value", "n")


@query("n5_idempotent_append", sql(
    """SELECT metric_key, origin_key, date_utc, CASE WHEN MIN(CASE WHEN event_day <= 20 THEN version END) IS NOT NULL
    THEN arg_max(value, version) FILTER (WHERE event_day <= 20) ELSE arg_max(value, version) END AS value FROM
    (SELECT *, day(date_utc) AS event_day FROM versions_) GROUP BY 1, 2, 3""", extra=(PQ.VERSIONS,)), dates=("date_utc",))
def n5(spark, d):
    root = fresh_dir(spark, "append")
    v = PQ.event_versions(spark, d)
    M.latest_version(v.filter(F.dayofmonth("date_utc") <= 20), PQ.CELL, "version").write.parquet(root)
    for _ in range(2):
        RF.append_new(v, root, PQ.CELL, "version")
    return spark.read.schema(v.schema).parquet(root).select(*PQ.CELL, "value")


@query("n6_file_pickup", sql("SELECT metric_key, origin_key, date_utc, value FROM fx_metrics", "fx_metrics"), dates=("date_utc",))
def n6(spark, d):
    """Raw files delivered by a stream that stops when none are left. It goes on from its offsets when more
    files have come; from fresh offsets it reads all files again and adds nothing."""
    raw, target, offsets = fresh_dir(spark, "incoming"), fresh_dir(spark, "store"), fresh_dir(spark, "offsets")
    m = fx.metrics(spark, d).withColumn("version", F.lit(1).cast("bigint"))
    early = F.col("date_utc") < F.lit(dt.date(2024, 1, 15))
    spark.createDataFrame([], m.schema).write.parquet(target)
    for part, state in ((early, offsets), (~early, offsets), (F.lit(False), fresh_dir(spark, "offsets"))):
        m.filter(part).write.mode("append").json(raw)
        RF.follow_files(spark, raw, m.schema, target, PQ.CELL, "version", state)
    return spark.read.schema(m.schema).parquet(target).select(*PQ.CELL, "value")


@query("q18_snapshot_rehash", sql(
    """SELECT 'snapshot_hash' AS "check", path AS key, 'pass' AS status FROM files_""", extra=(FILES,)))
def q18_rehash(spark, d):
    folder, root = snapshot(spark, d), fresh_dir(spark, "manifests")
    files = SN.scan_snapshot_files(spark, folder)
    tagged = files.withColumns({"source": F.lit("vendor"), "as_of_utc_date": F.lit(RUN).cast("date")})
    MF.write_documents(MF.raw_manifests(tagged, "collect --all"), root)
    return Q.rehash(stored_entries(spark, root), files).select("check", "key", "status")
