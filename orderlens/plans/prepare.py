"""Defensive completion of an order-line table before it is analysed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from .. import vocab
from ..functions import drop_nan, lenient_number, lower_strip, normalize_status, parse_calendar
from ..operators.columns import coalesce_same_named

_NUMBERS = {"is_anomaly": 0, "total_amount": 0.0, "quantity": 1, "unit_price": 0.0}
_TEXTS = {
    "status": "completed",
    "user_id": vocab.UNKNOWN_ID,
    "product_id": vocab.UNKNOWN_ID,
    "city": vocab.UNKNOWN_LABEL,
    "order_id": vocab.UNKNOWN_ID,
    "product_name": None,
    "category": vocab.UNCATEGORISED,
    "user_level": vocab.UNKNOWN_LABEL,
}


def complete_columns(orders: DataFrame) -> DataFrame:
    """Add the columns that are missing, with their defaults, and type the numbers and date."""
    orders = coalesce_same_named(orders)
    types = {field.name: field.dataType for field in orders.schema.fields}
    columns = {}
    for name, default in _NUMBERS.items():
        kind = types.get(name)
        if kind is None:
            columns[name] = F.lit(default)
        elif isinstance(kind, T.StringType):
            columns[name] = lenient_number(F.col(name), default)
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            columns[name] = F.coalesce(drop_nan(F.col(name)), F.lit(float(default)))
        else:
            columns[name] = F.coalesce(F.col(name), F.lit(default).cast(kind))
    for name, default in _TEXTS.items():
        if name not in types:
            columns[name] = F.lit(default).cast("string")
    kind = types.get("order_date")
    if kind is None:
        columns["order_date"] = F.lit(None).cast("timestamp_ntz")
    elif isinstance(kind, T.StringType):
        columns["order_date"] = parse_calendar(F.col("order_date"))
    else:
        columns["order_date"] = F.col("order_date").cast("timestamp_ntz")
    return orders.withColumns(columns)


def recompute_zero_amounts(orders: DataFrame) -> DataFrame:
    """If no line has an amount, all amounts become quantity × unit price.

    The test is an EXISTS subquery, which stops at the first line with an amount.
    """
    amount = F.col("total_amount")
    any_amount = orders.filter(F.coalesce(amount, F.lit(0)) != 0).select("total_amount").exists()
    product = F.col("quantity") * F.col("unit_price")
    return orders.withColumn("total_amount", F.when(any_amount, amount).otherwise(product))


def complete_status(orders: DataFrame) -> DataFrame:
    """Keep a valid normalised status; derive it from the source status otherwise."""
    derived = normalize_status(F.col("status"))
    if "status_norm" not in orders.columns:
        return orders.withColumn("status_norm", derived)
    given = lower_strip(F.col("status_norm").cast("string"))
    return orders.withColumn(
        "status_norm", F.when(given.isin(*vocab.STATUS_DOMAIN), given).otherwise(derived)
    )


def drop_undated(orders: DataFrame) -> DataFrame:
    """Drop lines without a date, unless no line at all has one."""
    dated = F.col("order_date").isNotNull()
    any_date = orders.filter(dated).select("order_date").exists()
    return orders.filter(dated | ~any_date)


def prepare_orders(orders: DataFrame) -> DataFrame:
    completed = complete_columns(orders)
    return drop_undated(complete_status(recompute_zero_amounts(completed)))
