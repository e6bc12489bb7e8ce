"""Registration of queries and of the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlelens.session import require_utc

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    oracle: str | None


CATALOGUE: dict[str, Entry] = {}


def query(key: str, oracle: str | None = None, dates: tuple[str, ...] = ()):
    """Register a query. Its date columns leave as ISO text so that results compare across engines."""

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            require_utc(spark)
            return portable(fn(spark, sf_dir))

        text = oracle
        if text is not None and dates:
            fixes = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in dates)
            text = f"SELECT * REPLACE ({fixes}) FROM (\n{oracle}\n) AS result"
        if key in CATALOGUE:
            raise ValueError(f"query {key} registered twice")
        CATALOGUE[key] = Entry(run, text)
        return fn

    return wrap


def portable(df: DataFrame) -> DataFrame:
    """Dates as ISO text, decimals as doubles, small integers as BIGINT."""

    def out(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            return c.cast("string").alias(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return c.cast("double").alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(field.name)
        return c

    return df.select(*[out(f) for f in df.schema.fields])


def sig(c, digits: int = 6):
    """Rounded to significant digits, for floating results that depend on summation order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.format_string(f"%.{digits - 1}e", c).try_cast("double"))


def sig_sql(expr: str, digits: int = 6) -> str:
    return f"CAST(printf('%.{digits - 1}e', {expr}) AS DOUBLE)"
