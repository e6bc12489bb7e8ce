"""Locked definitions: table contracts, units, regime dates and tolerances."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

# Analysis window and regime dates (UTC).
ANALYSIS_START = dt.date(2022, 1, 1)
DENCUN_DATE = dt.date(2024, 3, 13)
DENCUN_INSTANT = dt.datetime(2024, 3, 13, 13, 55, 0, tzinfo=dt.timezone.utc)

# Unit sizes.
WEI_PER_ETH = 10**18
WEI_PER_GWEI = 10**9
GAS_PER_BLOB = 131072
MIN_BLOB_BASE_FEE_WEI = 1

# Blob limits per fork, from the public protocol specifications. ``until`` is exclusive.
# (fork, from, until, max blobs per block, blob base fee update fraction)
BLOB_FORKS = [
    ("cancun", dt.date(2024, 3, 13), dt.date(2025, 5, 7), 6, 3338477),
    ("prague", dt.date(2025, 5, 7), dt.date(2025, 12, 9), 9, 5007716),
    ("bpo1", dt.date(2025, 12, 9), dt.date(2026, 1, 7), 15, 8346193),
    ("bpo2", dt.date(2026, 1, 7), None, 21, 11684671),
]

# Blob fee floor as a share of the execution base fee, 8192 / 131072.
RESERVE_PRICE_RATIO = Decimal("0.0625")

# Tolerances and thresholds.
PROFIT_ABS_TOLERANCE = 1e-9
PROFIT_REL_TOLERANCE = 0.01
FLOOR_FACTOR = Decimal("1.05")
FLOOR_MIN_DAYS = 7
MAX_MISSING_DAYS = 2
RECONCILE_PASS = 0.05
RECONCILE_WARN = 0.10
BLOB_GAS_TOLERANCE = 0.01
PRICE_PASS = 0.01
PRICE_WARN = 0.02
ISSUANCE_PASS = 0.005
ISSUANCE_WARN = 0.01
COVERAGE_VENDOR = 0.95
COVERAGE_SECOND_VENDOR = 0.80
COVERAGE_BLOB_DAYS = 0.95
COVERAGE_ONCHAIN = 0.95
RECEIPT_COVERAGE = 0.999
ATTRIBUTION_POST = 0.90
ATTRIBUTION_PRE = 0.80
MISSING_SHARE_MAX = 0.05

# Attribution labels.
OTHER = "other"
ROLLUP_LIKE = "unattributed_rollup_like"
CONFIDENCE_RANK = {"high": 0, "med": 1, "low": 2}

# Refresh spans in days.
CHAIN_REFRESH_DAYS = 7
PANEL_REFRESH_DAYS = 14

WEI = T.DecimalType(38, 0)
PRICE_WEI = T.DecimalType(17, 0)
GAS = T.DecimalType(12, 0)
ETH = T.DecimalType(38, 18)

_TYPES = {"date": T.DateType(), "string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType()}


def _field(name: str, kind: str, units: str, nullable: bool = False) -> dict:
    return {"name": name, "type": kind, "units": units, "nullable": nullable}


# The two locked table contracts.
PANEL_CONTRACT = {
    "version": 1,
    "table": "daily_rollup_panel",
    "grain": ["date_utc", "rollup_id"],
    "fields": [
        _field("date_utc", "date", "YYYY-MM-DD (UTC)"),
        _field("rollup_id", "string", "slug"),
        _field("l2_fees_eth", "number", "ETH"),
        _field("rent_paid_eth", "number", "ETH"),
        _field("profit_eth", "number", "ETH", True),
        _field("txcount", "integer", "count", True),
    ],
}

DECOMPOSITION_CONTRACT = {
    "version": 1,
    "table": "daily_l1_rent_decomposition",
    "grain": ["date_utc"],
    "fields": [
        _field("date_utc", "date", "YYYY-MM-DD (UTC)"),
        _field("l1_base_fee_burn_eth", "number", "ETH"),
        _field("l1_blob_fee_burn_eth", "number", "ETH"),
        _field("l1_priority_fee_eth", "number", "ETH"),
        _field("l1_total_rent_eth", "number", "ETH"),
        _field("l1_blob_gas_used", "integer", "blob gas", True),
        _field("l1_calldata_gas_used", "integer", "gas", True),
        _field("l1_blob_base_fee_gwei", "number", "gwei", True),
    ],
}


def contract_schema(contract: dict) -> T.StructType:
    """StructType of a parsed contract document, with its nullability."""
    return T.StructType(
        [T.StructField(f["name"], _TYPES[f["type"]], bool(f["nullable"])) for f in contract["fields"]]
    )


def load_contract(path: str, entry: str | None = None, root: str | None = None) -> dict:
    """Parse a contract YAML file. An index of schemas leads on to the file of its ``entry``.

    Paths of an index are relative to ``root``; without one, to the nearest folder above the index that has them.
    An index with one entry needs no name; an unknown name, and one that is lacking among several, are errors.
    """
    import pathlib

    import yaml

    with open(path, encoding="utf-8") as handle:
        found = yaml.safe_load(handle)
    listed = found.get("schemas") if isinstance(found, dict) else None
    if not isinstance(listed, dict):
        return found
    if entry is None and len(listed) == 1:
        entry = next(iter(listed))
    if entry not in listed:
        raise KeyError(f"{path} lists {sorted(listed)}, not {entry}")
    places = [pathlib.Path(root)] if root else list(pathlib.Path(path).resolve().parents)
    target = next((p / listed[entry] for p in places if (p / listed[entry]).is_file()), None)
    if target is None:
        raise FileNotFoundError(listed[entry])
    return load_contract(str(target))


VENDOR_EXPORT = T.StructType(
    [
        T.StructField("metric_key", T.StringType()),
        T.StructField("origin_key", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

COSTS_EXPORT = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("total_cost_eth", T.DoubleType()),
        T.StructField("total_cost_usd", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("source_timestamp", T.StringType()),
        T.StructField("tracked_tx_hashes", T.ArrayType(T.StringType())),
    ]
)

BLOB_DAILY = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("base_fee_per_blob_gas_wei", T.DecimalType(38, 0)),
        T.StructField("blob_gas_used", T.LongType()),
        T.StructField("excess_blob_gas", T.LongType()),
        T.StructField("blob_tx_count", T.LongType()),
        T.StructField("blobs_count", T.LongType()),
    ]
)

# Block level and per rollup, from the blob market source.
BLOB_BLOCKS = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("block_number", T.LongType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("base_fee_per_blob_gas_wei", T.DecimalType(38, 0)),
        T.StructField("blob_gas_used", T.LongType()),
        T.StructField("excess_blob_gas", T.LongType()),
    ]
)

ROLLUP_BLOBS = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("rollup_label", T.StringType()),
        T.StructField("rollup_blob_tx_hashes", T.ArrayType(T.StringType())),
        T.StructField("rollup_blob_gas_used", T.LongType()),
    ]
)

PRICES = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("eth_usd_close", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)

ISSUANCE = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("issuance_eth", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("method", T.StringType()),
    ]
)

BLOCKS = T.StructType(
    [
        T.StructField("block_number", T.LongType()),
        T.StructField("block_hash", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("base_fee_per_gas_wei", PRICE_WEI),
        T.StructField("gas_used", T.LongType()),
        T.StructField("gas_limit", T.LongType()),
        T.StructField("blob_gas_used", T.LongType()),
        T.StructField("excess_blob_gas", T.LongType()),
        T.StructField("base_fee_per_blob_gas_wei", T.DecimalType(17, 0)),
    ]
)

RECEIPTS = T.StructType(
    [
        T.StructField("tx_hash", T.StringType()),
        T.StructField("block_number", T.LongType()),
        T.StructField("from_address", T.StringType()),
        T.StructField("to_address", T.StringType()),
        T.StructField("tx_type", T.IntegerType()),
        T.StructField("gas_used", GAS),
        T.StructField("effective_gas_price_wei", PRICE_WEI),
        T.StructField("status", T.IntegerType()),
    ]
)

BLOB_TX = T.StructType(
    [
        T.StructField("tx_hash", T.StringType()),
        T.StructField("blob_count", T.IntegerType()),
        T.StructField("max_fee_per_blob_gas_wei", T.DecimalType(38, 0)),
        T.StructField("blob_versioned_hashes", T.ArrayType(T.StringType())),
    ]
)

# The registry file is text throughout; dates are checked when typed.
REGISTRY_COLUMNS = [
    "rollup_id",
    "display_name",
    "type",
    "da_posting_method",
    "batcher_addresses_json",
    "evidence_url",
    "verified_utc",
    "status",
    "start_date_utc",
    "end_date_utc",
    "notes",
]
