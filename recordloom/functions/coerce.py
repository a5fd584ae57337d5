"""Coercions: a value becomes a column of the wanted type, null where it can't; nulls are judged by the caller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import Coerce
from .values import RFC3339, Value, finite, text_whole

MOST, LEAST = (1 << 63) - 1, -(1 << 63)


def truncated(number: Column) -> Column:
    """A double cut to a whole number; what is too large or too small becomes the nearest bigint, NaN 0."""
    return F.when(F.isnan(number), F.lit(0)).when(number >= float(MOST), F.lit(MOST)).when(number <= float(LEAST), F.lit(LEAST)).otherwise(number.try_cast("bigint")).cast("bigint")


def whole(value: Value) -> Column:
    return value.by_kind(text=text_whole, int=lambda c: c.cast("bigint"), float=lambda c: truncated(c.cast("double")), bool=lambda c: c.cast("bigint")).cast("bigint")


def true_or_false(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("true", "1"), F.lit(True)).when(low.isin("false", "0"), F.lit(False))


def coerced(value: Value, to: Coerce) -> Column:
    """The coerced value; null where the coercion fails. A text coercion never fails: null becomes the empty text."""
    if to.type == "string":
        return F.coalesce(value.json_text(), F.lit(""))
    if to.type == "i64":
        return whole(value)
    if to.type == "f64":
        return finite(value.number())
    if to.type == "bool":
        return value.by_kind(text=true_or_false, int=lambda c: c != 0, bool=lambda c: c).cast("boolean")
    if to.format == "iso8601":
        return value.by_kind(text=lambda c: F.unix_millis(F.when(c.rlike(RFC3339), c.try_cast("timestamp")))).cast("bigint")
    if to.format == "unix_ms":
        return whole(value)
    return F.try_multiply(whole(value), F.lit(1000))
