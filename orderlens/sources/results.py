"""JSON export of results."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import drop_nan

_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss",
}


def _json_value(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return drop_nan(value.cast("double")).alias(field.name)
    return value.alias(field.name)


def json_records(df: DataFrame) -> DataFrame:
    """Every row as one JSON object: ISO timestamps, null for NULL and NaN."""
    record = F.struct(*[_json_value(field) for field in df.schema.fields])
    return df.select(F.to_json(record, _OPTIONS).alias("record"))


def report_payload(results: Mapping[str, DataFrame]) -> DataFrame:
    """All results as (section, record) rows, one row per record.

    The rows stay distributed; nothing is gathered into one document.
    """
    sections = [json_records(df).select(F.lit(name).alias("section"), "record")
                for name, df in results.items()]
    return reduce(DataFrame.unionAll, sections)


def write_results(results: Mapping[str, DataFrame], path: str) -> None:
    """Write the payload as JSON lines, one folder per section."""
    report_payload(results).write.partitionBy("section").text(path)
