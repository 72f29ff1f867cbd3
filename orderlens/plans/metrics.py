"""Sales metrics over order lines. Every function returns a lazy DataFrame.

``orders`` is a table of order lines (see :mod:`orderlens.plans.prepare`), ``products`` an
optional dimension with product_id, product_name, category and cost.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import fallback, period_label, safe_ratio, signed_percent_text
from ..operators.joins import join_dimension

STATUS_TEXT = ", "


# --- predicates ------------------------------------------------------------------------
def status_filter(statuses: Iterable[str] | None = None) -> Column:
    """Rows of the selected statuses. No selection means completed orders; a selection
    without any known status matches nothing."""
    chosen = [s for s in (list(statuses or ()) or ["completed"]) if s in vocab.STATUS_DOMAIN]
    return F.col("status_norm").isin(*chosen) if chosen else F.lit(False)


def valid_user() -> Column:
    user = F.col("user_id")
    return user.isNotNull() & ~F.lower(user.cast("string")).isin(*vocab.BAD_USER)


def has_order_dates(orders: DataFrame) -> DataFrame:
    """One row: does any order line have a date? Stops at the first one found."""
    dated = orders.filter(F.col("order_date").isNotNull()).select(F.lit(1).alias("one"))
    return dated.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_dates"))


def status_options(orders: DataFrame) -> DataFrame:
    """Statuses that occur, in order, with the default choice marked."""
    present = orders.filter(F.col("status_norm").isNotNull()).select("status_norm").distinct()
    # At most one row per status value.
    best = present.agg(F.min(F.struct(F.col("status_norm") != "completed", "status_norm"))
                       .getField("status_norm")).scalar()
    return present.select(
        F.col("status_norm").alias("status"), (F.col("status_norm") == best).alias("is_default")
    ).orderBy("status")


# --- money -----------------------------------------------------------------------------
def _as_double(total: Column) -> Column:
    return total.cast("double")


def _amount(total: str = "total_amount") -> Column:
    return F.sum(total)


def _own_category() -> Column:
    return F.nullif(F.col("category").cast("string"), F.lit(""))


def _category_with(product_category: Column) -> Column:
    return fallback(F.col("category"), product_category, F.lit(vocab.UNCATEGORISED))


# --- KPI summary and trend -------------------------------------------------------------
def kpi_summary(orders: DataFrame, statuses: Iterable[str] | None = None) -> DataFrame:
    gmv = _as_double(_amount())
    order_count = F.count_distinct("order_id")
    return orders.filter(status_filter(statuses)).agg(
        order_count.alias("total_orders"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct("product_id").alias("products_sold"),
        gmv.alias("total_gmv"),
        safe_ratio(gmv, order_count.cast("double")).alias("avg_order_value"),
    )


def gmv_trend(orders: DataFrame, granularity: str = vocab.MONTH,
              statuses: Iterable[str] | None = None) -> DataFrame:
    return (
        orders.filter(status_filter(statuses) & F.col("order_date").isNotNull())
        .groupBy(period_label(F.col("order_date"), granularity).alias("period"))
        .agg(
            F.count_distinct("order_id").alias("orders"),
            _as_double(_amount()).alias("gmv"),
            F.count_distinct("user_id").alias("users"),
        )
        .orderBy("period")
    )


def gmv_change(trend: DataFrame) -> DataFrame:
    """Change between the last two periods of a trend, as text and as a number."""
    last_two = trend.select("period", "gmv").orderBy(F.desc("period")).limit(2)
    gmv = F.coalesce(F.col("gmv"), F.lit(0.0))
    ends = last_two.agg(
        F.max_by(gmv, "period").alias("current"),
        F.when(F.count(F.lit(1)) == 2, F.min_by(gmv, "period")).alias("previous"),
    )
    change = F.when(
        F.col("previous") > 0, (F.col("current") - F.col("previous")) / F.col("previous") * 100
    )
    return ends.select(change.alias("change_pct")).select(
        signed_percent_text(F.col("change_pct")).alias("change_text"), "change_pct"
    )


def recommended_granularity(orders: DataFrame) -> DataFrame:
    days = F.count_distinct(F.to_date("order_date"))
    daily = days.between(1, vocab.DAILY_MAX_DATES)
    return orders.agg(
        F.when(daily, F.lit(vocab.DAY)).otherwise(F.lit(vocab.MONTH)).alias("granularity")
    )


# --- products and categories -----------------------------------------------------------
def top_products(orders: DataFrame, products: DataFrame, statuses: Iterable[str] | None = None,
                 limit: int = vocab.TOP_PRODUCTS) -> DataFrame:
    """Best-selling products by revenue.

    Lines are added up per product before the join, so a product with very many lines is
    one row when it meets the product table. A product listed twice still counts twice.
    """
    per_product = (
        orders.filter(status_filter(statuses))
        .groupBy("product_id", "product_name", "category")
        .agg(F.sum("quantity").alias("quantity"), _amount().alias("total_amount"))
    )
    names = products.select("product_id", F.col("product_name").alias("_name"),
                            F.col("category").alias("_category"))
    return (
        join_dimension(per_product, names, "product_id", salts=1)
        .groupBy(
            "product_id",
            fallback(F.col("product_name"), F.col("_name").cast("string"),
                     F.col("product_id").cast("string"),
                     F.lit(vocab.UNKNOWN_PRODUCT_LABEL)).alias("product_name"),
            _category_with(F.col("_category")).alias("category"),
        )
        .agg(F.sum("quantity").alias("total_qty"), _as_double(_amount()).alias("revenue"))
        .orderBy(F.desc("revenue"), "product_id", "product_name", "category")
        .limit(limit)
    )


def category_performance(orders: DataFrame, products: DataFrame,
                         statuses: Iterable[str] | None = None) -> DataFrame:
    categories = products.select("product_id", F.col("category").alias("_category"))
    lines = orders.filter(status_filter(statuses)).select(
        "product_id", "category", "order_id", "total_amount", "quantity"
    )
    return (
        join_dimension(lines, categories, "product_id")
        .groupBy(_category_with(F.col("_category")).alias("category"))
        .agg(
            F.count_distinct("order_id").alias("orders"),
            _as_double(_amount()).alias("gmv"),
            F.sum("quantity").alias("qty"),
        )
        .orderBy(F.desc("gmv"), "category")
    )


def category_margin(orders: DataFrame, products: DataFrame,
                    statuses: Iterable[str] | None = None) -> DataFrame:
    """Revenue, cost and margin per category over products whose cost is known."""
    if "cost" not in products.columns:
        products = products.withColumn("cost", F.lit(None).cast("double"))
    per_product = (
        orders.filter(status_filter(statuses))
        .groupBy("product_id", "category")
        .agg(F.sum("quantity").alias("quantity"), _amount().alias("total_amount"))
    )
    costs = products.filter(F.col("cost").isNotNull()).select(
        "product_id", F.col("category").alias("_category"), "cost"
    )
    totals = (
        join_dimension(per_product, costs, "product_id", "inner", salts=1)
        .groupBy(_category_with(F.col("_category")).alias("category"))
        .agg(
            _amount().alias("revenue"),
            F.sum(F.col("cost") * F.col("quantity")).alias("total_cost"),
        )
        .select("category", "revenue", "total_cost",
                (F.col("revenue") - F.col("total_cost")).alias("gross_profit"))
    )
    revenue, profit = _as_double(F.col("revenue")), _as_double(F.col("gross_profit"))
    return totals.select(
        "category",
        revenue.alias("revenue"),
        _as_double(F.col("total_cost")).alias("total_cost"),
        profit.alias("gross_profit"),
        (safe_ratio(profit, revenue) * 100).alias("gross_margin_pct"),
    ).orderBy(F.desc("gross_profit"), "category")


# --- users -----------------------------------------------------------------------------
def _user_lines(orders: DataFrame, statuses: Iterable[str] | None, *columns: str) -> DataFrame:
    labels = [fallback(F.col(c), F.lit(vocab.UNKNOWN_LABEL)).alias(c) for c in columns]
    return orders.filter(status_filter(statuses) & valid_user()).select(
        "user_id", *labels, "order_id", "total_amount"
    )


def top_users(orders: DataFrame, statuses: Iterable[str] | None = None,
              limit: int | None = vocab.TOP_USERS) -> DataFrame:
    """Users by spend. ``limit=None`` returns every user.

    With a limit, spend alone ranks the users; the distinct orders are then counted only for
    the few that remain, instead of shuffling every user's orders.
    """
    keys = ["user_id", "user_level", "city"]
    lines = _user_lines(orders, statuses, "user_level", "city")
    spend = F.coalesce(_amount(), F.lit(0)).cast("double")
    if limit is None:
        users = lines.groupBy(*keys).agg(
            F.count_distinct("order_id").alias("order_count"), spend.alias("total_spend")
        )
    else:
        best = (
            lines.groupBy(*keys).agg(spend.alias("total_spend"))
            .orderBy(F.desc_nulls_last("total_spend"), *keys)
            .limit(limit)
        )
        # Bounded by the limit, whatever the table holds.
        users = (
            lines.select(*keys, "order_id").join(F.broadcast(best), keys)
            .groupBy(*keys, "total_spend")
            .agg(F.count_distinct("order_id").alias("order_count"))
            .select(*keys, "order_count", "total_spend")
        )
    return users.orderBy(F.desc_nulls_last("total_spend"), *keys)


def repurchase_by_level(orders: DataFrame, statuses: Iterable[str] | None = None) -> DataFrame:
    """Users, average orders and spend, and share of users with two or more orders."""
    per_user = (
        _user_lines(orders, statuses, "user_level")
        .groupBy("user_id", "user_level")
        .agg(
            F.count_distinct("order_id").alias("order_count"),
            F.coalesce(_amount(), F.lit(0)).alias("total_spend"),
        )
    )
    users = F.count(F.lit(1))
    return (
        per_user.groupBy("user_level")
        .agg(
            users.alias("users"),
            (F.sum("order_count").cast("double") / users).alias("avg_orders"),
            (_as_double(F.sum("total_spend")) / users).alias("avg_spend"),
            (F.count_if(F.col("order_count") >= 2) * F.lit(100.0) / users).alias("repurchase_rate"),
        )
        .orderBy(F.desc("avg_spend"), "user_level")
    )


# --- order status and anomalies ----------------------------------------------------------
def status_distribution(orders: DataFrame) -> DataFrame:
    """Distinct orders per status over all rows, with the share of all distinct orders.

    One pass counts both the statuses and the grand total.
    """
    counted = orders.groupingSets([[F.col("status_norm")], []], F.col("status_norm")).agg(
        F.grouping_id().alias("_level"), F.count_distinct("order_id").alias("orders")
    )
    # One row per status plus the total.
    total = F.max(F.when(F.col("_level") == 1, F.col("orders")))
    shares = counted.agg(total.alias("_all"), F.collect_list(
        F.when(F.col("_level") == 0, F.struct(F.col("status_norm").alias("status"), "orders"))
    ).alias("_rows"))
    return shares.select("_all", F.inline("_rows")).select(
        "status", "orders",
        safe_ratio(F.col("orders") * F.lit(100.0), F.col("_all").cast("double")).alias("pct"),
    ).orderBy(F.desc("orders"), "status")


def high_value_orders(orders: DataFrame, statuses: Iterable[str] | None = None,
                      limit: int = vocab.TOP_ORDERS) -> DataFrame:
    """Largest orders above three times the mean order total, from one scan and at most one shuffle of the lines.

    The orders are aggregated once, without a shuffle if the lines lie in buckets by order. Their totals move once more, in one
    pass that gives every order and, as one row, the mean of all; each task passes on its largest orders only.
    """
    totals = orders.filter(status_filter(statuses)).groupBy("order_id").agg(
        _as_double(_amount()).alias("total_amount"),
        F.min("user_id").alias("user_id"),
        F.min("order_date").alias("order_date"),
        F.sum("quantity").alias("quantity"),
        F.array_join(F.array_sort(F.collect_set("status_norm")), STATUS_TEXT).alias("status_norm"),  # one entry per known status
        F.max("is_anomaly").alias("is_anomaly"),
    )
    shown = ["order_id", "user_id", "order_date", "quantity", "total_amount", "status_norm", "is_anomaly"]
    rows = totals.select(F.struct(*shown).alias("order"), "total_amount").groupingSets(
        [[F.col("order")], []], F.col("order")).agg(F.grouping_id().alias("_level"), F.avg("total_amount").alias("_mean"))
    # The row of the mean and the largest orders: limit + 1 rows.
    top = rows.orderBy(F.desc("_level"), F.desc_nulls_last("order.total_amount"), "order.order_id").limit(limit + 1)
    known = top.agg(F.max(F.when(F.col("_level") == 1, F.col("_mean"))).alias("_mean"),
                    F.collect_list(F.when(F.col("_level") == 0, F.col("order"))).alias("_orders"))
    return (
        known.select("_mean", F.inline("_orders"))
        .filter(F.col("total_amount") > F.col("_mean") * vocab.HIGH_VALUE_FACTOR)
        .select(shown)
        .orderBy(F.desc("total_amount"), "order_id")
    )


def order_facts(orders: DataFrame, statuses: Iterable[str] | None = None, granularity: str = vocab.MONTH) -> DataFrame:
    """One row with what the KPI cards need, from one scan: totals of the chosen statuses, the GMV of their last two periods,
    rows with an amount and whether any row has a date, of all statuses.

    Lines are aggregated by period and order first, so distinct orders are counted without a second copy of every line.
    Users are left out; see ``kpi_summary``.
    """
    chosen = F.coalesce(status_filter(statuses), F.lit(False))
    period = F.when(chosen & F.col("order_date").isNotNull(), period_label(F.col("order_date"), granularity))
    amount = F.col("total_amount")
    per_order = orders.groupBy(F.when(chosen, F.col("order_id")).alias("order_id"), period.alias("period")).agg(
        F.sum(F.when(chosen, amount)).alias("gmv"),
        F.count_if(amount > 0).alias("valid_rows"),
        F.max(F.col("order_date").isNotNull()).alias("dated"),
    )
    # An order may have lines in several periods. Grouped by order it counts once, and its periods stay beside it; their
    # number is bounded by the periods one order has.
    by_order = per_order.groupBy("order_id").agg(F.collect_list(F.struct("period", "gmv", "valid_rows", "dated")).alias("parts"))
    first = F.col("order_id").isNotNull() & (F.col("at") == 0)
    per_period = by_order.select("order_id", F.posexplode("parts").alias("at", "part")).select(
        "part.*", first.cast("int").alias("first")).groupBy("period").agg(
        F.sum("gmv").alias("gmv"), F.sum("valid_rows").alias("valid_rows"), F.max("dated").alias("dated"), F.sum("first").alias("orders"))
    dated = F.col("period").isNotNull()
    last = F.max(F.when(dated, F.struct("period", F.coalesce(_as_double(F.col("gmv")), F.lit(0.0)).alias("gmv"))))
    ends = F.slice(F.reverse(F.array_sort(F.collect_list(F.when(dated, F.struct(
        "period", F.coalesce(_as_double(F.col("gmv")), F.lit(0.0)).alias("gmv")))))), 1, 2)  # one entry per period
    total = F.sum("gmv")
    facts = per_period.agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("total_orders"),
        _as_double(total).alias("total_gmv"),
        safe_ratio(_as_double(total), F.sum("orders").cast("double")).alias("avg_order_value"),
        F.coalesce(F.sum("valid_rows"), F.lit(0)).alias("valid_amount_rows"),
        F.coalesce(F.max("dated"), F.lit(False)).alias("has_dates"),
        last["gmv"].alias("current"), ends.alias("_ends"),
    )
    previous = F.get("_ends", F.lit(1))["gmv"]
    change = F.when(previous > 0, (F.col("current") - previous) / previous * 100)
    return facts.withColumn("change_text", signed_percent_text(change)).drop("_ends", "current")


def flagged_orders(orders: DataFrame, statuses: Iterable[str] | None = None) -> DataFrame:
    return orders.filter((F.col("is_anomaly") == 1) & status_filter(statuses)).agg(
        F.count_distinct("order_id").alias("count")
    )


def amount_availability(orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("total_amount") > 0).alias("valid_amount_rows"),
    )


def order_counts(orders: DataFrame) -> DataFrame:
    """Line rows and distinct orders of a loaded table."""
    return orders.agg(
        F.count(F.lit(1)).alias("line_rows"), F.count_distinct("order_id").alias("distinct_orders")
    )
