"""Column expressions: text, numbers, dates, statuses and formatting."""

from .dates import parse_calendar, parse_datetime, period_label
from .formatting import (
    fallback, money_text, percent_text, safe_float, safe_int, safe_ratio, signed_percent_text,
)
from .numbers import lenient_number, parse_number
from .status import normalize_status
from .text import (
    drop_nan, is_blank, looks_numeric, lower_strip, main_category, normalize_name, strip,
)

__all__ = [
    "drop_nan", "fallback", "is_blank", "lenient_number", "looks_numeric", "lower_strip",
    "main_category", "money_text", "normalize_name", "normalize_status", "parse_calendar",
    "parse_datetime", "parse_number", "percent_text", "period_label", "safe_float", "safe_int", "safe_ratio",
    "signed_percent_text", "strip",
]
