"""Ratios, defaults and display text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab
from .text import drop_nan


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL where the denominator is zero or NULL."""
    return numerator / F.nullif(denominator, F.lit(0))


def fallback(first: Column, *others: Column) -> Column:
    """First value whose leading candidate is not the empty text; a space counts as text."""
    return F.coalesce(F.nullif(first.cast("string"), F.lit("")), *others)


def safe_int(value: Column) -> Column:
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def safe_float(value: Column) -> Column:
    return F.coalesce(drop_nan(value.try_cast("double")), F.lit(0.0))


def money_text(value: Column) -> Column:
    return F.concat(F.lit("¥"), F.format_number(safe_float(value), 2))


def percent_text(value: Column) -> Column:
    number = drop_nan(value.try_cast("double"))
    return F.when(number.isNotNull(), F.format_string("%.1f%%", number)).otherwise(
        F.lit(vocab.MISSING_TEXT))


def signed_percent_text(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%+.1f%%", value)).otherwise(
        F.lit(vocab.MISSING_TEXT))
