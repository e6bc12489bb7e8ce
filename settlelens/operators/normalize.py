"""From raw vendor rows to typed facts keyed by rollup."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlelens import contracts as C
from settlelens.functions import columns as X
from settlelens.functions.joins import lookup


def clip_window(df: DataFrame, start: dt.date = C.ANALYSIS_START, end: dt.date | Column | None = None) -> DataFrame:
    """Rows inside the analysis window, both ends included; the end defaults to the run date."""
    stop = F.current_date() if end is None else (end if isinstance(end, Column) else F.lit(end))
    return df.filter(F.col("date_utc").between(F.lit(start), stop))


def map_origins(metrics: DataFrame, universe: DataFrame) -> DataFrame:
    """origin_key -> rollup_id. Origins missing from the universe stay, out of scope until reviewed."""
    dim = universe.select("origin_key", "rollup_id", "in_scope")
    return lookup(metrics, dim, "origin_key").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))


def map_slugs(costs: DataFrame, slugs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Second-vendor slug -> rollup_id after alias rules (alias, slug) rename split or renamed slugs."""
    renamed = (
        lookup(costs.withColumnRenamed("slug", "alias"), aliases.withColumnRenamed("slug", "_canonical"), "alias")
        .withColumn("slug", F.coalesce("_canonical", "alias"))
        .drop("alias", "_canonical")
    )
    return lookup(renamed, slugs.select("slug", "rollup_id"), "slug")


def add_units(metrics: DataFrame, metric_catalog: DataFrame) -> DataFrame:
    """Explicit ``unit`` per row from the metric catalog; 'unknown' where the catalog is silent."""
    return lookup(metrics, metric_catalog.select("metric_key", "unit"), "metric_key").withColumn(
        "unit", F.coalesce("unit", F.lit("unknown"))
    )


def drop_per_operation(costs: DataFrame) -> DataFrame:
    """Rows given per user operation carry no daily total."""
    return costs.filter(~F.col("unit").eqNullSafe("per_user_op"))


def to_usd(df: DataFrame, prices: DataFrame, amounts: dict[str, str]) -> DataFrame:
    """Add USD columns {eth column: usd column} through the price series of the day."""
    priced = lookup(df, prices.select("date_utc", "eth_usd_close"), "date_utc")
    return priced.withColumns({usd: F.col(eth) * F.col("eth_usd_close") for eth, usd in amounts.items()})


def vendor_panel(metrics: DataFrame, metric_keys: list[str]) -> DataFrame:
    """Long -> wide. The key list is passed, so no job runs to find it."""
    return (
        metrics.groupBy("date_utc", "rollup_id")
        .pivot("metric_key", metric_keys)
        .agg(F.max("value"))
    )


def missing_flags(panel: DataFrame, series: list[str]) -> DataFrame:
    return panel.withColumns({f"{s}_missing": F.col(s).isNull() for s in series})


def panel_rows(df: DataFrame, fees: str = "l2_fees_eth", rent: str = "rent_paid_eth") -> DataFrame:
    """A row exists iff both series are present. NaN is a value, so ``dropna`` would be wrong here."""
    return df.filter(F.col(fees).isNotNull() & F.col(rent).isNotNull())


def active_in_scope(panel: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of in-scope rollups on days inside [start_date_utc, end_date_utc], both included.

    Where the registry has a ``status``, a rollup that is not active and has no end date has no known
    active period and is left out; one with an end date counts up to it.
    """
    known = registry.filter("in_scope")
    if "status" in registry.columns:
        known = known.filter("status IS NULL OR lower(trim(status)) = 'active' OR end_date_utc IS NOT NULL")
    r = known.select(
        F.col("rollup_id").alias("_rollup"), F.col("start_date_utc").alias("_start"), F.col("end_date_utc").alias("_end")
    )
    inside = (F.col("_start").isNull() | (F.col("date_utc") >= F.col("_start"))) & (
        F.col("_end").isNull() | (F.col("date_utc") <= F.col("_end"))
    )
    return panel.join(r, (F.col("rollup_id") == F.col("_rollup")) & inside, "left_semi")


def pick_source(df: DataFrame, candidates: list[tuple[str, str]], value: str, source: str) -> DataFrame:
    """First non-null of ``candidates`` [(label, column)] in priority order, and which one won."""
    label = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(name)) for name, c in candidates])
    return df.withColumns({value: F.coalesce(*[F.col(c) for _, c in candidates]), source: label})


def to_contract(df: DataFrame, contract: dict) -> DataFrame:
    """Project onto the contract's columns; optional ones that are absent become null."""
    schema = C.contract_schema(contract)
    out = []
    for field in schema.fields:
        if field.name in df.columns:
            c = F.col(field.name)
            if isinstance(df.schema[field.name].dataType, T.StringType) and not isinstance(
                field.dataType, T.StringType
            ):
                if isinstance(field.dataType, T.DateType):
                    c = X.strict_date(c)
                elif isinstance(field.dataType, T.DoubleType):
                    c = X.parse_number(c)
                else:
                    c = c.try_cast(field.dataType)
            else:
                c = c.try_cast(field.dataType)
        elif field.nullable:
            c = F.lit(None).cast(field.dataType)
        else:
            raise ValueError(f"missing column {field.name}")
        out.append(c.alias(field.name))
    return df.select(*out)


def with_provenance(df: DataFrame, **values) -> DataFrame:
    """Constant provenance columns, for example run dates and the registry version."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})
