"""Results computed from other results: shares, distributions, views and masking."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import money_text, percent_text


def category_share(categories: DataFrame) -> DataFrame:
    """Categories with a positive GMV and their share of the total."""
    positive = categories.filter(F.col("gmv") > 0)
    total = positive.agg(F.sum("gmv")).scalar()
    return positive.select(
        "category", "orders", "gmv", "qty", (F.col("gmv") / total).alias("share")
    ).orderBy(F.desc("gmv"), "category")


def orders_per_user(users: DataFrame) -> DataFrame:
    """How many users placed one order, two orders, and so on.

    The standard report passes the top users; pass ``top_users(limit=None)`` for all users.
    """
    return (
        users.groupBy("order_count")
        .agg(F.count_distinct("user_id").alias("users"))
        .withColumn("order_count_label", F.concat(F.col("order_count").cast("string"), F.lit(" 单")))
        .orderBy("order_count")
    )


def top_user_chart(users: DataFrame, limit: int = vocab.TOP_USER_CHART) -> DataFrame:
    return users.orderBy(F.desc_nulls_last("total_spend"), "user_id", "user_level", "city").limit(limit)


def user_view(repurchase: DataFrame, user_missing: bool, has_user_level: bool) -> DataFrame:
    """Which user analysis applies: 'unavailable', 'levels' or 'consumption'."""
    some_level = F.coalesce(F.bool_or(F.col("user_level") != vocab.UNKNOWN_LABEL), F.lit(False))
    no_spend = F.bool_and(F.coalesce(F.col("avg_spend"), F.lit(0.0)) == 0)
    no_orders = F.bool_and(F.coalesce(F.col("avg_orders"), F.lit(0.0)) == 0)
    by_level = F.lit(has_user_level) & some_level & ~(no_spend | no_orders)
    view = (
        F.when(F.lit(user_missing), F.lit("unavailable"))
        .when(by_level, F.lit("levels"))
        .otherwise(F.lit("consumption"))
    )
    return repurchase.agg(view.alias("view"))


def visible_kpis(summary: DataFrame, change: DataFrame, availability: DataFrame,
                 dates: DataFrame, user_missing: bool) -> DataFrame:
    """KPI row with NULL for figures that the data cannot support."""
    has_amount = availability.select(F.col("valid_amount_rows") > 0).scalar()
    has_dates = dates.select("has_dates").scalar()
    change_text = change.select("change_text").scalar()

    def shown(test: Column, value: Column) -> Column:
        return F.when(test, value)

    return summary.select(
        "total_orders",
        shown(F.lit(not user_missing), F.col("unique_users")).alias("unique_users"),
        shown(has_amount, F.coalesce("total_gmv", F.lit(0.0))).alias("total_gmv"),
        shown(has_amount, F.coalesce("avg_order_value", F.lit(0.0))).alias("avg_order_value"),
        shown(has_amount & has_dates, change_text).alias("gmv_change"),
    )


def visible_facts(facts: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """The KPI row of ``visible_kpis`` from ``metrics.order_facts``, which reads the lines once.

    ``users`` is one row with ``unique_users``; without it, as without a user dimension, the figure is NULL.
    """
    unique = F.lit(None).cast("bigint") if users is None else users.select("unique_users").scalar()
    has_amount = F.col("valid_amount_rows") > 0
    return facts.select(
        "total_orders", unique.alias("unique_users"),
        F.when(has_amount, F.coalesce("total_gmv", F.lit(0.0))).alias("total_gmv"),
        F.when(has_amount, F.coalesce("avg_order_value", F.lit(0.0))).alias("avg_order_value"),
        F.when(has_amount & F.col("has_dates"), F.col("change_text")).alias("gmv_change"))


def mask_users(results: Mapping[str, DataFrame], user_missing: bool) -> dict[str, DataFrame]:
    """Without a user dimension, user figures must not reach a report."""
    masked = dict(results)
    if not user_missing:
        return masked
    summary = masked["summary"]
    nothing = F.lit(None).cast(summary.schema["unique_users"].dataType)
    masked["summary"] = summary.withColumn("unique_users", nothing)
    message = summary.sparkSession.createDataFrame([(vocab.NO_USER_MESSAGE,)], "message string")
    masked["users"] = message
    masked["repurchase"] = message
    return masked


def display(df: DataFrame, result: str) -> DataFrame:
    """A result as shown to readers: money and percentages as text, labelled columns."""
    formats = {
        **{c: money_text(F.col(c)) for c in vocab.DISPLAY_MONEY.get(result, ())},
        **{c: percent_text(F.col(c)) for c in vocab.DISPLAY_PERCENT.get(result, ())},
    }
    labels = vocab.DISPLAY_LABELS[result]
    return df.select(*[formats.get(c, F.col(c)).alias(labels.get(c, c)) for c in df.columns])
