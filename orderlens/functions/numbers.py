"""Number parsing for text cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab
from .text import drop_nan

_IN_PARENTHESES = r"(?Us)^\s*\([^0-9.+\-]*[+\-]?(.*)\)\s*$"


def parse_number(text: Column) -> Column:
    """Read money and quantities: ``￥1,299.00``, ``1.2万``, ``(12)`` for a negative.

    Only one unit applies, the largest that occurs. Text that holds no number gives NULL;
    that includes all the words for a missing value, since none of them holds a digit.
    """
    signed = F.when(text.contains("("), F.regexp_replace(text, _IN_PARENTHESES, "-$1")).otherwise(text)
    # Without a digit there is no number; a cast that fails costs as much as dozens that do not.
    digits = F.when(text.rlike("[0-9]"), F.regexp_replace(signed, r"[^0-9.+\-]", "").try_cast("double"))
    unit = F.lit(1.0)
    for character, factor in reversed(vocab.NUMBER_UNITS):
        unit = F.when(text.contains(character), F.lit(factor)).otherwise(unit)
    return digits * unit


def lenient_number(text: Column, default: float) -> Column:
    """Keep digits, dots and minus signs only. Units are ignored: ``1.2万`` gives 1.2."""
    value = drop_nan(F.regexp_replace(text, r"[^\d.\-]", "").try_cast("double"))
    return F.coalesce(value, F.lit(float(default)))
