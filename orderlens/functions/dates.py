"""Date parsing and period labels. Everything is zone-free (``timestamp_ntz``).

Cells in ISO form are cast at once. Any other cell is rewritten step by step into ISO text;
those steps run inside an array lambda, which is evaluated only for such cells and keeps a
dozen regular expressions out of the method that is generated for the whole stage (a method
of more than 8000 bytes is never compiled to machine code by the JVM).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from .. import vocab
from .text import strip

_DAY_MICROS = 86_400_000_000
_EXCEL_EPOCH_DAYS = -25_569  # 1899-12-30 in days from 1970-01-01
_UNIX_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_END = r"(?=$|\s)"

# Rewrites into ISO order, applied one after another; the first numbers of day-first dates
# are recognised by a value above twelve.
_REWRITES = (
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (r"^(\d{4})(\d{2})$", "$1-$2"),
    (rf"^(1[3-9]|[23]\d)-(\d{{1,2}})-(\d{{4}}){_END}", "$3-$2-$1"),
    (rf"^(\d{{1,2}})-(\d{{1,2}})-(\d{{4}}){_END}", "$3-$1-$2"),
    (rf"^(1[3-9]|[23]\d)-(\d{{1,2}})-([7-9]\d){_END}", "19$3-$2-$1"),
    (rf"^(1[3-9]|[23]\d)-(\d{{1,2}})-(\d{{2}}){_END}", "20$3-$2-$1"),
    (rf"^(\d{{1,2}})-(\d{{1,2}})-([7-9]\d){_END}", "19$3-$1-$2"),
    (rf"^(\d{{1,2}})-(\d{{1,2}})-(\d{{2}}){_END}", "20$3-$1-$2"),
)
# Years 1678 to 2261, the range of a nanosecond timestamp; other text is left out.
_IN_RANGE = r"^(?:167[89]|16[89]\d|1[7-9]\d\d|2[01]\d\d|22[0-5]\d|226[01])(?:$|[-\sT].*$)"
# Cells that are ISO text already skip the rewrites.
_ISO = r"^\s*((?:1[7-9]|2[01])\d\d-\d\d?-\d\d?(?:[ T]\d\d?:\d\d(?::\d\d)?)?)\s*$"
_MONTH_NAME = r"^([A-Za-z]{3})[A-Za-z]*\.?\s+(\d{1,2}),?\s+(\d{4})$"


def _from_unix_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros.cast("bigint"), F.expr(_UNIX_EPOCH))


def _serial_micros(days: Column) -> Column:
    return F.round((days + F.lit(float(_EXCEL_EPOCH_DAYS))) * F.lit(float(_DAY_MICROS)))


def _from_number(number: Column) -> Column:
    """Excel serial, Unix seconds or Unix milliseconds, told apart by their size."""
    micros = (
        F.when(number.between(20_000, 80_000), _serial_micros(number))
        .when((number >= 1e9) & (number < 1e10), number * 1e6)
        .when((number >= 1e12) & (number < 1e13), number * 1e3)
    )
    return _from_unix_micros(micros)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _from_calendar(text: Column, year: int | None) -> Column:
    cell = strip(text)
    iso = F.regexp_replace(cell, r"(:\d{1,2})[.,]\d+", "$1")
    iso = F.translate(iso, "年月/.：", "----:")
    iso = F.trim(F.regexp_replace(iso, r"(?U)[\s日]+", " "))
    this_year = F.year(F.current_date()) if year is None else F.lit(year)
    month_day = F.concat(this_year.cast("string"), F.lit("-$1"))
    iso = F.regexp_replace(iso, F.lit(r"^(\d{1,2}-\d{1,2}(?:\s.*)?)$"), month_day)

    def year_first(date: Column) -> Column:
        rewritten = date
        for pattern, order in _REWRITES:
            rewritten = F.regexp_replace(rewritten, pattern, order)
        return F.when(date.rlike(r"^\d{4}-"), date).otherwise(rewritten)

    def named(date: Column) -> Column:
        words = F.initcap(F.regexp_replace(date, _MONTH_NAME, "$1 $2 $3"))
        return F.when(date.rlike(_MONTH_NAME), F.try_to_date(words, "MMM d yyyy").cast("timestamp_ntz"))

    return F.coalesce(
        F.regexp_extract(_let(iso, year_first), _IN_RANGE, 0).try_cast("timestamp_ntz"),
        _let(cell, named),
    )


def _iso_first(value: Column, otherwise: Callable[[Column], Column]) -> Column:
    iso = F.regexp_extract(value, _ISO, 1).try_cast("timestamp_ntz")
    return F.coalesce(iso, _let(value, otherwise))


def parse_calendar(text: Column, year: int | None = None) -> Column:
    """Read calendar text, year or month first, with an optional time.

    ``year`` completes dates that name only month and day (default: the current year).
    """
    return _iso_first(text, lambda cell: _from_calendar(cell, year))


def _from_text(value: Column, year: int | None) -> Column:
    text = F.regexp_replace(strip(value), r"\.0$", "")
    number = F.regexp_extract(text, r"^(?:\d{5}(?:\.\d+)?|[1-9]\d{9}|[1-9]\d{12})$", 0)
    # Only a number is cast: a cast that fails costs as much as dozens that do not.
    number = F.nullif(number, F.lit("")).try_cast("double")
    return F.coalesce(_let(number, _from_number), _from_calendar(text, year))


def parse_datetime(value: Column, data_type: T.DataType | None = None,
                   year: int | None = None) -> Column:
    """Read a date cell: calendar text, ``yyyyMMdd``, Excel serial or Unix time.

    ``data_type`` is the type of ``value`` (string if not given); ``year`` as for
    :func:`parse_calendar`. Anything that cannot be read gives NULL.
    """
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return value.cast("timestamp_ntz")
    if isinstance(data_type, T.NumericType):
        number = value.cast("double")
        whole = F.when(number == F.floor(number), number.cast("decimal(30,0)").cast("string"))
        return F.coalesce(_from_number(number), _iso_first(whole, lambda cell: _from_text(cell, year)))
    return _iso_first(value, lambda cell: _from_text(cell, year))


def period_label(timestamp: Column, granularity: str) -> Column:
    """``yyyy-MM`` for months, ``yyyy-MM-dd`` for days."""
    return F.date_format(timestamp, "yyyy-MM" if granularity == vocab.MONTH else "yyyy-MM-dd")
