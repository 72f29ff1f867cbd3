"""Text expressions. All of them stay on the JVM; none needs a Python worker."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .. import vocab


# Every character with the property White_Space, which (?U)\s stands for in patterns.
_SPACES = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    """Trim every Unicode space, U+3000 included (plain ``trim`` removes U+0020 only). Only both ends of a text are read."""
    return F.trim(text.cast("string"), F.lit(_SPACES))


def lower_strip(text: Column) -> Column:
    return F.lower(strip(text))


def drop_nan(value: Column) -> Column:
    """NULL for NaN: inside the library a missing number is always NULL."""
    return F.nullif(value, F.lit(float("nan")))


def normalize_name(text: Column) -> Column:
    """Lower-case a header or status and delete spaces and punctuation; NULL gives ''."""
    return F.coalesce(F.regexp_replace(F.lower(text), vocab.NAME_NOISE, ""), F.lit(""))


def normalized_literal(text: str) -> str:
    """:func:`normalize_name` of a fixed word, so that plans hold literals only."""
    return re.sub(vocab.NAME_NOISE.removeprefix("(?U)"), "", text.strip().lower())


def is_blank(text: Column) -> Column:
    """True for NULL and for the placeholder words that stand for a missing value."""
    return text.isNull() | lower_strip(text.cast("string")).isin(*vocab.BLANK)


def looks_numeric(text: Column) -> Column:
    """True if a cell is a number with optional currency sign, separators or unit."""
    return F.coalesce(strip(text).rlike(vocab.NUMERIC_CELL), F.lit(False))


def main_category(path: Column) -> Column:
    """First meaningful level of a category path such as ``家居/厨具/水杯``."""
    levels = F.transform(F.split(path, vocab.CATEGORY_SEPARATOR), strip)
    meaningful = F.filter(levels, lambda level: ~F.lower(level).isin(*vocab.BLANK_CATEGORY))
    return F.coalesce(F.try_element_at(meaningful, F.lit(1)), F.lit(vocab.UNCATEGORISED))
