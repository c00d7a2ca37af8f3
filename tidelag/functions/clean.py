"""Numbers and dates: coercion without errors, and no NaN beyond ingest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """NULL for NaN and both infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def to_number(value: Column) -> Column:
    """A finite double, else NULL."""
    return finite(value.try_cast("double"))


def leading_number(value: Column) -> Column:
    """The number that a string starts with, as C's strtod reads decimals; else NULL."""
    found = F.regexp_extract(value, r"^[\s\x0b]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return finite(F.nullif(found, F.lit("")).try_cast("double"))


def float_text_id(value: Column, width: int = 6) -> Column:
    """Ids stored as floats: ``2285.0`` gives ``002285``; text and fractions give NULL."""
    number = value.try_cast("double")
    whole = number.try_cast("bigint")  # NULL for what is no number of 64 bits
    text = F.when(number == whole, whole).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), "0")


def log_return(value: Column) -> Column:
    """log(1 + r); NULL at -1 and below, so that no infinity enters a sum."""
    return F.when(value > -1, F.log1p(value))


def clip(value: Column, low: Column, high: Column) -> Column:
    """``value`` within the bounds; NULL stays NULL, and a NULL bound does not bind."""
    return F.when(value.isNotNull(), F.greatest(low, F.least(high, value)))


def capped_share(part: Column, whole: Column, cap: float = 1.0) -> Column:
    """part / whole, at most ``cap``; NULL where there is no positive whole."""
    share = finite(F.when(whole > 0, F.try_divide(part, whole)))
    return F.when(share > cap, cap).otherwise(share)
