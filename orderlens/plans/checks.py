"""Validation of mapped orders and detection of missing business dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from .. import vocab
from ..functions import is_blank, lenient_number
from ..operators.columns import coalesce_same_named

_AMOUNT_FACTORS = {"quantity", "unit_price"}


def validate_orders(orders: DataFrame) -> DataFrame:
    """Findings as (level, code). An error blocks the analysis, a warning does not."""
    names = set(orders.columns)
    findings = []
    if "order_date" not in names:
        findings.append(("warning", "no_order_date"))
    if "total_amount" not in names and not _AMOUNT_FACTORS <= names:
        findings.append(("error", "no_amount"))
    for column in ("order_id", "status", "user_id"):
        if column not in names:
            findings.append(("warning", f"no_{column}"))
    if not names & {"product_id", "product_name"}:
        findings.append(("warning", "no_product"))
    has_rows = orders.select(F.lit(1).alias("one")).exists()
    spark = orders.sparkSession
    schema = "level string, code string"
    empty = spark.createDataFrame([("error", "no_rows")], schema).filter(~has_rows)
    return spark.createDataFrame(findings, schema).filter(has_rows).unionAll(empty)


def missing_dimensions(orders: DataFrame) -> DataFrame:
    """Business dimensions that are absent or nearly empty, as one row per dimension."""
    orders = coalesce_same_named(orders)
    types = {field.name: field.dataType for field in orders.schema.fields}
    computable = _AMOUNT_FACTORS <= set(types)

    def blank_ratio(column: str):
        return F.avg(is_blank(F.col(column)).cast("int"))

    never, always = F.lit(False), F.lit(True)
    user = blank_ratio("user_id") > vocab.BLANK_RATIO_LIMIT if "user_id" in types else always
    if "product_name" in types:
        product = never
    elif "product_id" in types:
        product = blank_ratio("product_id") > vocab.BLANK_RATIO_LIMIT
    else:
        product = always
    if computable:
        amount = never
    elif "total_amount" in types:
        value = F.col("total_amount")
        if isinstance(types["total_amount"], T.StringType):
            value = lenient_number(value, 0.0)
        valid = F.coalesce(value > 0, F.lit(False)).cast("int")
        amount = F.avg(valid) < vocab.VALID_AMOUNT_RATIO
    else:
        amount = always
    missing = {
        "user": user,
        "product": product,
        "date": never if "order_date" in types else always,
        "amount": amount,
        "category": never if "category" in types else always,
    }
    names = [F.when(test, F.lit(vocab.MISSING_DIMENSIONS[key])) for key, test in missing.items()]
    found = orders.agg(F.array_compact(F.array(*names)).alias("found"))
    return found.select(F.explode("found").alias("dimension"))
