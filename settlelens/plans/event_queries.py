"""Queries of the event family: as-of joins, event-time windows, sessions, stored sketches, versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlelens.operators.asof import asof_join
from settlelens.plans import chain_queries as CQ
from settlelens.plans import file_queries as FQ
from settlelens.plans import fixtures as fx
from settlelens.plans.catalogue import query
from settlelens.plans.fixtures import sql
from settlelens.session import fresh_dir
from settlelens.sinks import sketches as SK
from settlelens.sinks.versioned import VersionedTable
from settlelens.streaming import windows as SW

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
STAMP_SQL = "%Y-%m-%d %H:%M:%S.%f"
GAP = 1_800
ARRIVALS = 4


# ---- as-of joins


@query("e1_asof_registry", sql(
    """SELECT r.tx_hash, arg_max(a.rollup_id, a.valid_from) AS rollup_id FROM fx_receipts r JOIN fx_blocks b ON r.block_number = b.block_number
    LEFT JOIN fx_addresses a ON a.address = r.from_address AND a.valid_from <= b.date_utc GROUP BY 1""",
    "fx_receipts", "fx_blocks", "fx_addresses"))
def e1_registry(spark, d):
    """The registry entry of the sender that started last at or before the transaction."""
    tx = CQ.timed_tx(spark, d).select("tx_hash", "from_address", "ts")
    entries = fx.address_mappings(spark, d).select(F.col("address").alias("from_address"), "valid_from_utc", "rollup_id")
    # Entries change some times a year, so a bucket is half a year.
    return asof_join(tx, entries, ["from_address"], "ts", "valid_from_utc", ["rollup_id"], width=180 * 86_400).select("tx_hash", "rollup_id").distinct()


@query("e1_asof_price", sql(
    """SELECT n.block_number, ROUND(p.eth_usd_close, 6) AS eth_usd_close FROM (
      SELECT block_number, MAX(CASE WHEN tag = 0 THEN d END) OVER (ORDER BY d, tag ROWS UNBOUNDED PRECEDING) AS priced, tag FROM
      (SELECT NULL AS block_number, date_utc AS d, 0 AS tag FROM fx_prices WHERE day(date_utc) % 5 = 0
       UNION ALL SELECT block_number, date_utc, 1 FROM fx_blocks)) n
    LEFT JOIN fx_prices p ON p.date_utc = n.priced WHERE n.tag = 1""", "fx_prices", "fx_blocks"))
def e1_price(spark, d):
    """The last quoted price at each block, quotes on every fifth day of a month only; one key has all rows."""
    blocks = fx.raw_blocks(spark, d).select("block_number", F.timestamp_seconds("timestamp").alias("ts"), F.lit("eth").alias("asset"))
    quotes = fx.prices(spark, d).where(F.dayofmonth("date_utc") % 5 == 0).withColumn("asset", F.lit("eth"))
    out = asof_join(blocks, quotes, ["asset"], "ts", "date_utc", ["eth_usd_close"], width=7 * 86_400)
    return out.select("block_number", F.round("eth_usd_close", 6).alias("eth_usd_close"))


# ---- streams


def arrivals(spark: SparkSession, events: DataFrame, number) -> str:
    """Files of the events, one landing after the other in the order of ``number`` (0 to ``ARRIVALS`` - 1)."""
    root = fresh_dir(spark, "arrivals")
    for part in range(ARRIVALS):
        events.where(number == part).write.parquet(f"{root}/part={part}")
    return root


def stream_of(spark: SparkSession, root: str, events: DataFrame) -> DataFrame:
    return SW.file_stream(spark, f"{root}/*", events.schema)


def windows_of(spark: SparkSession, d: str, slide: str | None) -> DataFrame:
    """Hourly windows per type from events that arrive shuffled, none later than the delay."""
    events = fx.table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    root = arrivals(spark, events, F.pmod(F.xxhash64("event_id"), F.lit(ARRIVALS)))
    target, checkpoint = fresh_dir(spark, "windows"), fresh_dir(spark, "windows-state")
    SW.window_updates(stream_of(spark, root, events), "ts", ["event_type"], "value", target, checkpoint, "1 hour", slide, delay="4000 days")
    out = SW.latest_windows(spark, target, ["event_type"])
    return out.select(F.date_format("window_start", STAMP).alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("e2_tumbling_windows", f"""SELECT strftime(date_trunc('hour', ts), '{STAMP_SQL}') AS window_start, event_type, COUNT(*) AS n,
    ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2""")
def e2_tumbling(spark, d):
    return windows_of(spark, d, None)


@query("e2_sliding_windows", f"""SELECT strftime(w, '{STAMP_SQL}') AS window_start, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM
    (SELECT event_type, value, date_trunc('hour', ts) + (half - CASE WHEN minute(ts) < 30 THEN 1 ELSE 0 END) * INTERVAL 30 MINUTE AS w
     FROM events, (SELECT 0 AS half UNION ALL SELECT 1)) GROUP BY 1, 2""")
def e2_sliding(spark, d):
    return windows_of(spark, d, "30 minutes")


@query("e3_sender_sessions", f"""SELECT CAST(user_id AS VARCHAR) AS key, strftime(MIN(ts), '{STAMP_SQL}') AS session_start,
    strftime(MAX(ts), '{STAMP_SQL}') AS session_end, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM
    (SELECT *, SUM(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM
     (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < {GAP} * 1000000 THEN 0 ELSE 1 END AS is_new FROM events))
    GROUP BY user_id, island HAVING epoch_us(MAX(ts)) + {GAP} * 1000000 <= (SELECT epoch_ms(MAX(ts)) - 3600000 FROM events) * 1000""")
def e3_sessions(spark, d):
    """Sessions of users that the watermark has closed; the events land in four files by their time, and in two runs of the query."""
    events = fx.table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    step = ((high or 0) - (low or 0)) // ARRIVALS + 1
    number = F.floor((F.unix_micros("ts") - F.lit(low or 0)) / F.lit(step))
    root, target, checkpoint = fresh_dir(spark, "arrivals"), fresh_dir(spark, "sessions"), fresh_dir(spark, "sessions-state")
    for part in range(ARRIVALS):
        events.where(number == part).write.parquet(f"{root}/part={part}")
        if part in (1, ARRIVALS - 1):
            SW.run_sessions(stream_of(spark, root, events), "user_id", "ts", "value", GAP, "1 hour", target, checkpoint)
    out = spark.read.schema(SW.SESSIONS).parquet(target)
    return out.select("key", *[F.date_format(c, STAMP).alias(c) for c in ("session_start", "session_end")], "n", F.round("total", 4).alias("total"))


# ---- stored sketches


@query("e4_sketched_months", sql(
    """SELECT CAST(date_trunc('month', date_utc) AS DATE) AS month_utc, rollup_id, COUNT(*) AS n_tx, COUNT(DISTINCT from_address) AS exact_senders,
    TRUE AS senders_in_bound, TRUE AS median_in_bound FROM fx_tx_costs GROUP BY 1, 2""", "fx_tx_costs"), dates=("month_utc",))
def e4(spark, d):
    """Monthly senders and median fee from daily sketches, with whether they hold their bounds against the exact ones."""
    tx = CQ.tx_costs(spark, d).select("date_utc", "rollup_id", "from_address", "execution_fee_wei")
    root = fresh_dir(spark, "sketches")
    SK.write_sketches(tx, root)
    month = F.trunc("date_utc", "month").alias("month_utc")
    found = SK.merged(SK.read_sketches(spark, root), month, "rollup_id", quantiles=(0.5,))
    gwei = (F.col("execution_fee_wei") / F.lit(10**9)).cast("double")
    placed = tx.select(month, "rollup_id", "from_address", gwei.alias("gwei")).join(
        found.select("month_utc", F.col("rollup_id").alias("r"), "fee_gwei_p50"), ["month_utc"]).where("rollup_id = r")
    exact = placed.groupBy("month_utc", "rollup_id").agg(
        F.countDistinct("from_address").alias("exact_senders"),
        F.avg((F.col("gwei") < F.col("fee_gwei_p50")).cast("double")).alias("below"),
        F.avg((F.col("gwei") <= F.col("fee_gwei_p50")).cast("double")).alias("upto"),
    )
    both = found.join(exact, ["month_utc", "rollup_id"])
    return both.select(
        "month_utc", "rollup_id", "n_tx", "exact_senders",
        (F.abs(F.col("senders") - F.col("exact_senders")) <= F.greatest(SK.SENDER_BOUND * F.col("exact_senders"), F.lit(0.5))).alias("senders_in_bound"),
        ((F.col("below") <= 0.5 + SK.RANK_BOUND) & (F.col("upto") >= 0.5 - SK.RANK_BOUND)).alias("median_in_bound"),
    )


# ---- versioned tables


@query("e5_versioned_rebuild", sql(
    f"""SELECT 1 AS version, * FROM ({FQ.SUMS.format(factor='2', kept='TRUE')}) UNION ALL
    SELECT 2, * FROM ({FQ.SUMS.format(factor="CASE WHEN date_utc > DATE '2024-01-30' - 14 AND date_utc <= DATE '2024-01-30' THEN 1 ELSE 2 END", kept=FQ.INSIDE_SQL)}) UNION ALL
    SELECT 3, * FROM ({FQ.SUMS.format(factor='1', kept=FQ.KEPT_SQL)})""", "fx_metrics"), dates=("date_utc",))
def e5(spark, d):
    """Three versions of the daily sums: all of them doubled, the last 14 days refreshed, everything rebuilt."""
    build, everything = FQ.panel_builder(spark, d), FQ.panel_builder(spark, d, True)(None)
    table = VersionedTable(spark, fresh_dir(spark, "versioned"), everything.schema)
    table.publish_whole(FQ.stale(everything))
    first = FQ.RUN_DAY - FQ.dt.timedelta(days=13)
    table.publish_days(build(first), first, FQ.RUN_DAY)
    table.publish_whole(build(None))
    out = None
    for v in table.versions():
        rows = table.read(v).select(F.lit(v).alias("version"), "date_utc", "value", "n")
        out = rows if out is None else out.unionByName(rows)
    return out
