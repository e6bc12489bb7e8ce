"""Which rollup a transaction belongs to."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from settlelens import contracts as C
from settlelens.functions.joins import lookup
from settlelens.operators.costs import total_spend


def confidence_rank(confidence: Column) -> Column:
    rank = F.lit(len(C.CONFIDENCE_RANK))
    for name, r in C.CONFIDENCE_RANK.items():
        rank = F.when(confidence == name, r).otherwise(rank)
    return rank




def disjoint_windows(mappings: DataFrame, key: str) -> DataFrame:
    """One winning mapping per address and instant: overlapping windows are cut at their bounds.

    The tie-break (confidence, then rollup_id) is settled here, on the registry, so the join to the
    transactions can match at most one row and needs no de-duplicating shuffle of the fact.

    An event sweep: windows are dealt by address and calendar year, sorted by their start, and a task goes along
    the starts and stops of a year with the open windows in a heap, whose top is the winner. Neither an
    address nor a year is held whole, only what is open at one time. Pieces that a turn of the year
    cut are joined again. A window counts once for each year that it reaches into, up to the last
    year in which a window of its address starts or stops.
    """
    far = F.lit("9999-12-31").cast("timestamp")
    stop = F.coalesce("valid_to_utc", far)
    windows = mappings.filter(F.col("valid_from_utc") < stop).select(
        F.col(key).alias("_key"),
        F.col("valid_from_utc").alias("_from"),
        stop.alias("_to"),
        confidence_rank(F.col("confidence")).alias("_rank"),
        _number(F.col("rollup_id")).alias("_order"),
        "rollup_id",
        "confidence",
    )
    last = windows.groupBy("_key").agg(F.greatest(F.max(F.year("_from")), F.max(F.when(F.col("_to") < far, F.year("_to")))).alias("_last"))
    # Null keys match no transaction.
    years = windows.join(last, "_key").withColumn("_year", F.explode(F.sequence(F.year("_from"), F.least(F.year("_to"), "_last"))))
    turn = lambda y: F.unix_micros(F.make_timestamp(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    edges = years.select(
        "_key", "_year", turn(F.col("_year")).alias("_low"),
        F.when(F.col("_year") == F.col("_last"), F.unix_micros(far)).otherwise(turn(F.col("_year") + 1)).alias("_high"),
        F.unix_micros("_from").alias("_from"), F.unix_micros("_to").alias("_to"), "_rank", "_order", "rollup_id", "confidence",
    )
    dealt = edges.repartition("_key", "_year").sortWithinPartitions("_key", "_year", F.greatest("_from", "_low"))
    key_type = dealt.schema["_key"].dataType.simpleString()
    pieces = dealt.mapInPandas(_sweep, f"_key {key_type}, _start bigint, _stop bigint, rollup_id string, confidence string, _cut boolean")
    number = F.sum(F.col("_cut").cast("bigint")).over(W.partitionBy("_key").orderBy("_start").rowsBetween(W.unboundedPreceding, 0))
    whole = pieces.withColumn("_piece", number).groupBy("_key", "_piece").agg(
        F.timestamp_micros(F.min("_start")).alias("_start"), F.timestamp_micros(F.max("_stop")).alias("_stop"),
        F.first("rollup_id").alias("rollup_id"), F.first("confidence").alias("confidence"),
    )
    return whole.select(F.col("_key").alias(key), "_start", "_stop", "rollup_id", "confidence")


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of the sorted windows of (key, year) groups; ``_cut`` is false where only the turn of the year begins one."""
    names = ["_key", "_start", "_stop", "rollup_id", "confidence", "_cut"]
    group, at, low, natural = None, None, None, False
    active: list[tuple] = []  # by priority
    stops: list[int] = []
    out: list[tuple] = []

    def piece(until: int) -> None:
        nonlocal at
        if until <= at:
            return
        while active and active[0][5] <= at:
            heapq.heappop(active)
        if active:
            out.append((group[0], at, until, active[0][6], active[0][7], at != low or natural))
        at = until

    def finish() -> None:
        while stops:
            piece(heapq.heappop(stops))
        active.clear()

    serial = 0
    for frame in frames:
        for key, year, lo, hi, start, stop, rank, order, rollup, confidence in frame.itertuples(index=False, name=None):
            if (key, year) != group:
                if group is not None:
                    finish()
                group, at, low, natural = (key, year), max(start, lo), lo, False
            begin = max(start, lo)
            while stops and stops[0] <= begin:
                piece(heapq.heappop(stops))
            piece(begin)
            natural = natural or start == lo or stop == lo
            serial += 1  # so that equal priorities never compare further
            heapq.heappush(active, (rank, order, rollup or "", start, serial, stop, rollup, confidence))
            heapq.heappush(stops, min(stop, hi))
        if len(out) >= 10_000:
            yield pd.DataFrame(out, columns=names)
            out = []
    if group is not None:
        finish()
    yield pd.DataFrame(out, columns=names)


def _number(rollup_id: Column) -> Column:
    """The number that an id ends with, -1 without one: numbered ids go in number order, then by text."""
    return F.coalesce(F.regexp_extract(rollup_id, "([0-9]+)$", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))


def _window_join(tx: DataFrame, windows: DataFrame, tx_key: str, key: str, prefix: str) -> DataFrame:
    w = windows.select(
        F.col(key).alias(f"_{prefix}_key"),
        F.col("_start").alias(f"_{prefix}_start"),
        F.col("_stop").alias(f"_{prefix}_stop"),
        F.col("rollup_id").alias(f"{prefix}_rollup"),
        F.col("confidence").alias(f"{prefix}_confidence"),
    )
    # Equality on the address with the window as a residual: never a range-only condition.
    cond = (
        (F.col(tx_key) == F.col(f"_{prefix}_key"))
        & (F.col("ts") >= F.col(f"_{prefix}_start"))
        & (F.col("ts") < F.col(f"_{prefix}_stop"))
    )
    return lookup(tx, w, cond).drop(f"_{prefix}_key", f"_{prefix}_start", f"_{prefix}_stop")


def match_sender(tx: DataFrame, addresses: DataFrame) -> DataFrame:
    return _window_join(tx, disjoint_windows(addresses, "address"), "from_address", "address", "from")


def match_contract(tx: DataFrame, contracts: DataFrame) -> DataFrame:
    return _window_join(tx, disjoint_windows(contracts, "contract_address"), "to_address", "contract_address", "to")


def attribute(tx: DataFrame, addresses: DataFrame, contracts: DataFrame) -> DataFrame:
    """Sender first, then contract with low confidence, else other. ``tx`` needs ``ts``.

    ``rollup_id`` is the cost label (contract-only rows fall in a residual bucket); ``audit_rollup_id``
    keeps the rollup the contract points to. Contracts, few, are looked up first, so that a caller's filter on
    ``to_rollup`` is applied before transactions are shuffled by sender.
    """
    both = match_sender(match_contract(tx, contracts), addresses)
    hit_from, hit_to = F.col("from_rollup").isNotNull(), F.col("to_rollup").isNotNull()
    return both.withColumns(
        {
            "rollup_id": F.when(hit_from, F.col("from_rollup"))
            .when(hit_to, F.lit(C.ROLLUP_LIKE))
            .otherwise(F.lit(C.OTHER)),
            "audit_rollup_id": F.coalesce("from_rollup", "to_rollup"),
            "attribution_rule": F.when(hit_from, "from_match").when(hit_to, "to_match").otherwise("none"),
            "attribution_confidence": F.when(hit_from, F.col("from_confidence")).when(hit_to, F.lit("low")),
        }
    )


def candidate_transactions(tx: DataFrame, addresses: DataFrame, contracts: DataFrame) -> DataFrame:
    """Known sender OR known contract OR type 3, each row once: two look-ups of distinct keys and a filter."""
    senders = addresses.select(F.col("address").alias("from_address")).distinct().withColumn("known_sender", F.lit(True))
    targets = (
        contracts.select(F.col("contract_address").alias("to_address")).distinct().withColumn("known_contract", F.lit(True))
    )
    flagged = lookup(lookup(tx, senders, "from_address"), targets, "to_address").withColumns(
        {
            "known_sender": F.coalesce("known_sender", F.lit(False)),
            "known_contract": F.coalesce("known_contract", F.lit(False)),
        }
    )
    return flagged.filter(F.col("known_sender") | F.col("known_contract") | (F.col("tx_type") == 3))


def new_sender_candidates(attributed: DataFrame, min_days: int = 2) -> DataFrame:
    """Recurrent unknown senders to known contracts, per (sender, rollup).

    These are the rows of the rule ``to_match``, told by the columns of the look-ups, whose filters go below the joins.
    """
    per_day = (
        attributed.filter("from_rollup IS NULL AND to_rollup IS NOT NULL")
        .groupBy("from_address", F.col("to_rollup").alias("rollup_id"), "date_utc")
        .agg(F.count(F.lit(1)).alias("n_tx"), F.sum(total_spend()).alias("spend_wei"))
    )
    return (
        per_day.groupBy("from_address", "rollup_id")
        .agg(
            F.count(F.lit(1)).alias("active_days"),
            F.sum("n_tx").alias("n_tx"),
            F.sum("spend_wei").alias("spend_wei"),
        )
        .filter(F.col("active_days") >= min_days)
    )


def overlapping_windows(mappings: DataFrame, key: str) -> DataFrame:
    """Mappings whose window starts before an earlier one of the same address has ended.

    A running maximum of the ends finds every overlap in one ordered pass, without pairing rows.
    """
    far = F.lit("9999-12-31").cast("timestamp")
    order = W.partitionBy(key).orderBy("valid_from_utc", "rollup_id")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    ended = F.max(F.coalesce("valid_to_utc", far)).over(earlier)
    return mappings.withColumn("covered_until_utc", ended).filter(F.col("valid_from_utc") < F.col("covered_until_utc"))


def seen_on_chain(addresses: DataFrame, attributed: DataFrame) -> DataFrame:
    """Each registry address, flagged by whether it sent to a contract of its own rollup."""
    seen = (
        attributed.filter("to_rollup IS NOT NULL")
        .select(F.col("from_address").alias("address"), F.col("to_rollup").alias("rollup_id"))
        .distinct()
        .withColumn("seen", F.lit(True))
    )
    keys = addresses.select("address", "rollup_id").distinct()
    return keys.join(seen, ["address", "rollup_id"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def first_seen(tx: DataFrame) -> DataFrame:
    return tx.groupBy(F.col("from_address").alias("address")).agg(F.min("ts").alias("valid_from_utc"))
