"""Scalar helpers: units, guarded arithmetic, dates, text and address rules."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from settlelens import contracts as C

def nan() -> Column:
    return F.lit(float("nan"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- units ------------------------------------------------------------------------------------


def wei_to_eth(wei: Column | str) -> Column:
    """Exact wei / 1e18 as DECIMAL(38,18): whole and fractional ETH are kept apart until the sum."""
    wei = col(wei).cast(C.WEI)
    one = F.lit(Decimal(C.WEI_PER_ETH))
    frac = (wei % one).cast("decimal(18,0)")
    whole = ((wei - frac.cast(C.WEI)) / one).cast("decimal(19,0)")
    return whole + (frac * F.lit(Decimal("1E-18"))).cast("decimal(19,18)")


def wei_to_gwei(wei: Column | str) -> Column:
    return (col(wei).cast("decimal(28,0)") * F.lit(Decimal("1E-9"))).cast("decimal(38,9)")


def gwei_to_wei(gwei: Column | str) -> Column:
    return F.round(col(gwei).cast("decimal(28,9)") * F.lit(Decimal(C.WEI_PER_GWEI)), 0).cast(C.WEI)


def eth_double(wei: Column | str) -> Column:
    return wei_to_eth(wei).cast("double")


def blob_gas(blob_count: Column | str) -> Column:
    return col(blob_count).cast("bigint") * F.lit(C.GAS_PER_BLOB).cast("bigint")


def blobs_from_gas(gas: Column | str) -> Column:
    return (col(gas).cast("bigint") / F.lit(C.GAS_PER_BLOB)).cast("bigint")


def blob_base_fee(given: Column | str, excess: Column | str, fraction: Column | str) -> Column:
    """The given fee, else the fee rule on excess blob gas: minimum x e^(excess / fraction) by its integer series.

    Term i is the one before times excess over fraction x i, rounded down, until a term is zero; the sum
    is divided by the fraction and rounded down. All of it is whole-number work in decimals. A fee that
    does not fit 38 digits is null, and so is one without excess gas.
    """
    wide = "decimal(38,0)"
    x, over = col(excess).cast(wide), col(fraction).cast(wide)
    # e^r needs under 3 r + 40 terms for any fraction below 10^9.
    terms = F.sequence(F.lit(1), (F.ceil(x.cast("double") / over.cast("double")) * 3 + 40).cast("int"))

    def whole(num: Column, den: Column) -> Column:
        return ((num - num % den) / den).cast(wide)

    def step(a: Column, i: Column) -> Column:
        product = F.try_multiply(a["term"], x).cast(wide)
        after = F.struct((a["sum"] + a["term"]).cast(wide).alias("sum"), whole(product, (over * i.cast(wide)).cast(wide)).alias("term"))
        return F.when(a["term"] == 0, a).otherwise(after)  # nothing follows a term of zero

    start = F.struct(F.lit(0).cast(wide).alias("sum"), (F.lit(C.MIN_BLOB_BASE_FEE_WEI) * over).cast(wide).alias("term"))
    derived = F.aggregate(terms, start, step, lambda a: whole(a["sum"], over))
    return F.coalesce(col(given).cast(C.WEI), F.when(x.isNotNull(), derived.cast(C.WEI)))


# ---- guarded arithmetic -----------------------------------------------------------------------


def ratio_or_nan(num: Column | str, den: Column | str) -> Column:
    """num / den; NaN on a zero denominator; null when either side is null."""
    num, den = col(num).cast("double"), col(den).cast("double")
    return F.when(num.isNull() | den.isNull(), F.lit(None).cast("double")).when(den == 0, nan()).otherwise(num / den)


def ratio_or_null(num: Column | str, den: Column | str) -> Column:
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def relative_difference(value: Column | str, base: Column | str) -> Column:
    value, base = col(value).cast("double"), col(base).cast("double")
    return F.try_divide(F.abs(value - base), F.abs(base))


def log_positive(x: Column | str) -> Column:
    return F.when(col(x) > 0, F.log(col(x).cast("double")))


def profit_tolerance(fees: Column | str, rent: Column | str) -> Column:
    floor = F.lit(C.PROFIT_ABS_TOLERANCE)
    return F.greatest(
        floor, F.lit(C.PROFIT_REL_TOLERANCE) * F.greatest(F.abs(col(fees)), F.abs(col(rent)), floor)
    )


def not_nan(x: Column | str) -> Column:
    """The value with NaN turned into null, so that averages skip it."""
    return F.when(~F.isnan(col(x)), col(x))


# ---- dates ------------------------------------------------------------------------------------


def strict_date(text: Column | str) -> Column:
    """DATE from YYYY-MM-DD only; null for any other shape or an impossible day."""
    text = col(text)
    return F.when(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), text.try_cast("date"))


def epoch_date(seconds: Column | str) -> Column:
    return F.timestamp_seconds(col(seconds)).cast("date")


def month_of(date: Column | str) -> Column:
    return F.trunc(col(date), "month")


def day_number(date: Column | str) -> Column:
    return F.unix_date(col(date)).cast("bigint")


# ---- text -------------------------------------------------------------------------------------


def normalize_address(address: Column | str) -> Column:
    """Lower-cased 0x + 40 hex digits, or null when the text is not an address."""
    text = F.lower(F.trim(col(address)))
    return F.when(text.rlike(r"\A0x[0-9a-f]{40}\z"), text)


def is_sha256(text: Column | str) -> Column:
    return col(text).rlike(r"\A[0-9a-f]{64}\z")


# Fixed value: the text forms accepted as a number (digits may be grouped by single underscores).
NUMBER_PATTERN = (
    r"(?i)\A[+-]?(?:(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)"
    r"(?:e[+-]?[0-9]+(?:_[0-9]+)*)?|inf(?:inity)?|nan)\z"
)


def parse_number(text: Column | str) -> Column:
    """DOUBLE from text, or null when it is not a number; surrounding white space is allowed."""
    body = F.regexp_replace(col(text), r"\A\s+|\s+\z", "")
    value = F.when(body.rlike(r"(?i)nan\z"), nan()).otherwise(
        F.regexp_replace(body, "_", "").try_cast("double")
    )
    return F.when(body.rlike(NUMBER_PATTERN), value)


def command_line(tokens: Column | str) -> Column:
    """One POSIX command line from an array of tokens. Tokens of harmless characters stand bare; any other is put
    between single quotes, which a quote inside leaves for a moment."""

    def quoted(token: Column) -> Column:
        inner = F.replace(token, F.lit("'"), F.lit("'\"'\"'"))
        return F.when(token.rlike(r"\A[\w@%+=:,./-]+\z"), token).otherwise(F.concat(F.lit("'"), inner, F.lit("'")))

    return F.array_join(F.transform(col(tokens), quoted), " ")


# ---- json, arrays -----------------------------------------------------------------------------


def json_strings(text: Column | str) -> Column:
    return F.from_json(col(text), "array<string>")


def json_object(text: Column | str) -> Column:
    return F.from_json(col(text), "map<string,string>")


def blob_count_from_hashes(hashes: Column | str) -> Column:
    """Number of hashes; null (not -1 or 0) when the array itself is missing."""
    return F.when(col(hashes).isNotNull(), F.size(col(hashes)))


# ---- regimes ----------------------------------------------------------------------------------


def post_regime(date: Column | str, boundary=C.DENCUN_DATE) -> Column:
    return col(date) >= F.lit(boundary)
