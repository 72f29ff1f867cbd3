"""Metric queries: summary, trend, products, categories, users, statuses, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlens.plans import derived, metrics

from .views import ORDER_LINES_SQL, PRODUCTS_SQL, order_lines, products

ALL = ["completed", "pending", "refunded"]
SOME = ["completed", "refunded"]


def kpi_summary(spark, sf_dir):
    return metrics.kpi_summary(order_lines(spark, sf_dir))


def gmv_trend_month(spark, sf_dir):
    return metrics.gmv_trend(order_lines(spark, sf_dir), "月")


def gmv_trend_day(spark, sf_dir):
    return metrics.gmv_trend(order_lines(spark, sf_dir), "日", ALL)


def gmv_change(spark, sf_dir):
    change = metrics.gmv_change(metrics.gmv_trend(order_lines(spark, sf_dir), "月", SOME))
    return change.select("change_text", F.round("change_pct", 6).alias("change_pct"))


def granularity(spark, sf_dir):
    return metrics.recommended_granularity(order_lines(spark, sf_dir))


def top_products(spark, sf_dir):
    return metrics.top_products(order_lines(spark, sf_dir), products(spark, sf_dir))


def category_performance(spark, sf_dir):
    return metrics.category_performance(order_lines(spark, sf_dir), products(spark, sf_dir), SOME)


def category_margin(spark, sf_dir):
    return metrics.category_margin(order_lines(spark, sf_dir), products(spark, sf_dir))


def category_share(spark, sf_dir):
    categories = metrics.category_performance(
        order_lines(spark, sf_dir), products(spark, sf_dir), SOME)
    return derived.category_share(categories).select("category", F.round("share", 9).alias("share"))


def top_users(spark, sf_dir):
    return metrics.top_users(order_lines(spark, sf_dir, users=True))


def all_users(spark, sf_dir):
    return metrics.top_users(order_lines(spark, sf_dir, users=True), limit=None)


def top_user_chart(spark, sf_dir):
    return derived.top_user_chart(metrics.top_users(order_lines(spark, sf_dir, users=True), SOME))


def repurchase_by_level(spark, sf_dir):
    return metrics.repurchase_by_level(order_lines(spark, sf_dir, users=True))


def orders_per_user(spark, sf_dir):
    return derived.orders_per_user(
        metrics.top_users(order_lines(spark, sf_dir, users=True), limit=None))


def orders_per_top_user(spark, sf_dir):
    return derived.orders_per_user(metrics.top_users(order_lines(spark, sf_dir, users=True), ALL))


def user_view(spark, sf_dir):
    repurchase = metrics.repurchase_by_level(order_lines(spark, sf_dir, users=True))
    return derived.user_view(repurchase, user_missing=False, has_user_level=True)


def status_distribution(spark, sf_dir):
    return metrics.status_distribution(order_lines(spark, sf_dir))


def status_options(spark, sf_dir):
    return metrics.status_options(order_lines(spark, sf_dir))


def high_value_orders(spark, sf_dir):
    best = metrics.high_value_orders(order_lines(spark, sf_dir), ALL)
    return best.withColumn("order_date", F.to_date("order_date"))


def flagged_orders(spark, sf_dir):
    return metrics.flagged_orders(order_lines(spark, sf_dir))


def amount_availability(spark, sf_dir):
    return metrics.amount_availability(order_lines(spark, sf_dir))


def order_counts(spark, sf_dir):
    return metrics.order_counts(order_lines(spark, sf_dir))


def no_known_status(spark, sf_dir):
    """A selection without a known status matches no rows; unknown ones beside known ones are left out."""
    lines = order_lines(spark, sf_dir)
    chosen = {"unknown": ["shipped?"], "mixed": ["shipped?", "refunded"]}
    parts = [metrics.kpi_summary(lines, statuses).withColumn("selection", F.lit(name)) for name, statuses in chosen.items()]
    return parts[0].unionByName(parts[1])


def visible_kpis(spark, sf_dir):
    return derived.visible_facts(metrics.order_facts(order_lines(spark, sf_dir)))


def display_status_distribution(spark, sf_dir):
    return derived.display(status_distribution(spark, sf_dir), "status_distribution")


def display_margin(spark, sf_dir):
    return derived.display(category_margin(spark, sf_dir), "margin")


QUERIES = {f.__name__: f for f in (
    kpi_summary, gmv_trend_month, gmv_trend_day, gmv_change, granularity, top_products,
    category_performance, category_margin, category_share, top_users, all_users, top_user_chart,
    repurchase_by_level, orders_per_user, orders_per_top_user, user_view, status_distribution,
    status_options, high_value_orders, flagged_orders, amount_availability, order_counts,
    no_known_status, visible_kpis, display_status_distribution, display_margin,
)}

# --- SQL checks ---------------------------------------------------------------------------
_COMPLETED = "status_norm IN ('completed')"
_SOME = "status_norm IN ('completed', 'refunded')"
_USER = "user_id IS NOT NULL AND lower(CAST(user_id AS VARCHAR)) NOT IN ('', 'unknown', 'nan', 'none', 'null', '未知')"
_CATEGORY = "COALESCE(NULLIF(o.category, ''), p.category, '未分类')"


def _with(body: str, *more: str) -> str:
    return "WITH " + ",\n".join((ORDER_LINES_SQL, *more)) + "\n" + body


def _kpi(condition: str) -> str:
    return _with(f"""SELECT count(DISTINCT order_id) AS total_orders, count(DISTINCT user_id) AS unique_users,
  count(DISTINCT product_id) AS products_sold, CAST(sum(total_amount) AS DOUBLE) AS total_gmv,
  CAST(sum(total_amount) AS DOUBLE) / NULLIF(count(DISTINCT order_id), 0) AS avg_order_value
FROM lines WHERE {condition}""")


def _trend(length: int, condition: str) -> str:
    return f"""SELECT substring(CAST(order_date AS VARCHAR), 1, {length}) AS period,
  count(DISTINCT order_id) AS orders, CAST(sum(total_amount) AS DOUBLE) AS gmv,
  count(DISTINCT user_id) AS users
FROM lines WHERE {condition} AND order_date IS NOT NULL GROUP BY 1"""


def _change(condition: str) -> str:
    return f"""trend AS ({_trend(7, condition)}),
ranked AS (SELECT gmv, row_number() OVER (ORDER BY period DESC) AS r FROM trend),
ends AS (SELECT max(CASE WHEN r = 1 THEN gmv END) AS cur, max(CASE WHEN r = 2 THEN gmv END) AS prev FROM ranked),
change AS (SELECT CASE WHEN prev > 0 THEN (cur - prev) / prev * 100 END AS pct FROM ends)"""


_CHANGE_TEXT = "CASE WHEN pct IS NULL THEN '—' ELSE format('{:+.1f}%', pct) END"

_CATEGORIES = f"""cats AS (SELECT {_CATEGORY} AS category, count(DISTINCT o.order_id) AS orders,
  CAST(sum(o.total_amount) AS DOUBLE) AS gmv, CAST(sum(o.quantity) AS BIGINT) AS qty
FROM lines o LEFT JOIN products p ON o.product_id = p.product_id WHERE o.{_SOME} GROUP BY 1)"""

_MARGIN = f"""margin0 AS (SELECT {_CATEGORY} AS category, sum(o.total_amount) AS r, sum(p.cost * o.quantity) AS c
FROM lines o LEFT JOIN products p ON o.product_id = p.product_id
WHERE o.{_COMPLETED} AND p.cost IS NOT NULL GROUP BY 1),
margin AS (SELECT category, CAST(r AS DOUBLE) AS revenue, CAST(c AS DOUBLE) AS total_cost,
  CAST(r - c AS DOUBLE) AS gross_profit,
  CAST(r - c AS DOUBLE) / NULLIF(CAST(r AS DOUBLE), 0) * 100 AS gross_margin_pct FROM margin0)"""


def _users(condition: str) -> str:
    return f"""users AS (SELECT user_id, COALESCE(NULLIF(user_level, ''), '未知') AS user_level,
  COALESCE(NULLIF(city, ''), '未知') AS city, count(DISTINCT order_id) AS order_count,
  CAST(COALESCE(sum(total_amount), 0) AS DOUBLE) AS total_spend
FROM lines WHERE {condition} AND {_USER} GROUP BY 1, 2, 3)"""


_ALL_STATUSES = "status_norm IN ('completed', 'pending', 'refunded')"
_REPURCHASE = f"""per_user AS (SELECT user_id, COALESCE(NULLIF(user_level, ''), '未知') AS user_level,
  count(DISTINCT order_id) AS order_count, COALESCE(sum(total_amount), 0) AS total_spend
FROM lines WHERE {_COMPLETED} AND {_USER} GROUP BY 1, 2),
levels AS (SELECT user_level, count(*) AS users, CAST(sum(order_count) AS DOUBLE) / count(*) AS avg_orders,
  CAST(sum(total_spend) AS DOUBLE) / count(*) AS avg_spend,
  CAST(sum(CASE WHEN order_count >= 2 THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*) AS repurchase_rate
FROM per_user GROUP BY 1)"""
_STATUSES = """statuses AS (SELECT status_norm AS status, count(DISTINCT order_id) AS orders,
  CAST(count(DISTINCT order_id) AS DOUBLE) * 100
    / NULLIF((SELECT count(DISTINCT order_id) FROM lines), 0) AS pct
FROM lines GROUP BY 1)"""
_ORDER_DIST = """SELECT order_count, count(DISTINCT user_id) AS users,
  CAST(order_count AS VARCHAR) || ' 单' AS order_count_label FROM {} GROUP BY 1"""

ORACLE = {
    "kpi_summary": _kpi(_COMPLETED),
    "no_known_status": "SELECT *, 'unknown' AS selection FROM (" + _kpi("1 = 0") + ") UNION ALL SELECT *, 'mixed' AS selection FROM ("
                       + _kpi("status_norm = 'refunded'") + ")",
    "gmv_trend_month": _with(_trend(7, _COMPLETED)),
    "gmv_trend_day": _with(_trend(10, _ALL_STATUSES)),
    "gmv_change": _with(
        f"SELECT {_CHANGE_TEXT} AS change_text, round(pct, 6) AS change_pct FROM change", _change(_SOME)),
    "granularity": _with(
        "SELECT CASE WHEN count(DISTINCT CAST(order_date AS DATE)) BETWEEN 1 AND 31 THEN '日' ELSE '月' END"
        " AS granularity FROM lines"),
    "top_products": _with(f"""SELECT o.product_id,
  COALESCE(NULLIF(o.product_name, ''), p.product_name, CAST(o.product_id AS VARCHAR), '未知商品') AS product_name,
  {_CATEGORY} AS category, CAST(sum(o.quantity) AS BIGINT) AS total_qty,
  CAST(sum(o.total_amount) AS DOUBLE) AS revenue
FROM lines o LEFT JOIN products p ON o.product_id = p.product_id WHERE o.{_COMPLETED}
GROUP BY 1, 2, 3 ORDER BY revenue DESC, 1, 2, 3 LIMIT 10""", PRODUCTS_SQL),
    "category_performance": _with("SELECT * FROM cats", PRODUCTS_SQL, _CATEGORIES),
    "category_margin": _with("SELECT * FROM margin", PRODUCTS_SQL, _MARGIN),
    "display_margin": _with("""SELECT category AS "品类", format('¥{:,.2f}', revenue) AS "销售额",
  format('¥{:,.2f}', total_cost) AS "总成本", format('¥{:,.2f}', gross_profit) AS "毛利",
  format('{:.1f}%', gross_margin_pct) AS "毛利率" FROM margin""", PRODUCTS_SQL, _MARGIN),
    "category_share": _with(
        "SELECT category, round(gmv / (SELECT sum(gmv) FROM cats WHERE gmv > 0), 9) AS share"
        " FROM cats WHERE gmv > 0", PRODUCTS_SQL, _CATEGORIES),
    "top_users": _with(
        "SELECT * FROM users ORDER BY total_spend DESC NULLS LAST, 1, 2, 3 LIMIT 20", _users(_COMPLETED)),
    "all_users": _with("SELECT * FROM users", _users(_COMPLETED)),
    "top_user_chart": _with(
        "SELECT * FROM users ORDER BY total_spend DESC NULLS LAST, 1, 2, 3 LIMIT 10", _users(_SOME)),
    "repurchase_by_level": _with("SELECT * FROM levels", _REPURCHASE),
    "orders_per_user": _with(_ORDER_DIST.format("users"), _users(_COMPLETED)),
    "orders_per_top_user": _with(
        _ORDER_DIST.format("best"), _users(_ALL_STATUSES),
        "best AS (SELECT * FROM users ORDER BY total_spend DESC NULLS LAST, 1, 2, 3 LIMIT 20)"),
    "user_view": _with(
        """SELECT CASE WHEN bool_or(user_level <> '未知') AND NOT (bool_and(avg_spend = 0) OR bool_and(avg_orders = 0))
  THEN 'levels' ELSE 'consumption' END AS view FROM levels""", _REPURCHASE),
    "status_distribution": _with("SELECT * FROM statuses", _STATUSES),
    "display_status_distribution": _with(
        """SELECT status AS "订单状态", orders AS "订单数", format('{:.1f}%', pct) AS "占比" FROM statuses""",
        _STATUSES),
    "status_options": _with(
        "SELECT status, status = (SELECT CASE WHEN bool_or(status = 'completed') THEN 'completed' ELSE min(status) END"
        " FROM statuses) AS is_default FROM statuses WHERE status IS NOT NULL", _STATUSES),
    "high_value_orders": _with(
        """SELECT order_id, user_id, CAST(order_date AS DATE) AS order_date, quantity, total_amount, status_norm, is_anomaly
FROM totals WHERE total_amount > (SELECT avg(total_amount) * 3 FROM totals)
ORDER BY total_amount DESC, order_id LIMIT 10""",
        f"""totals AS (SELECT order_id, min(user_id) AS user_id, min(order_date) AS order_date,
  CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(total_amount) AS DOUBLE) AS total_amount,
  string_agg(DISTINCT status_norm, ', ' ORDER BY status_norm) AS status_norm, max(is_anomaly) AS is_anomaly
FROM lines WHERE {_ALL_STATUSES} GROUP BY order_id)"""),
    "flagged_orders": _with(
        f'SELECT count(DISTINCT order_id) AS "count" FROM lines WHERE is_anomaly = 1 AND {_COMPLETED}'),
    "amount_availability": _with(
        "SELECT count(*) AS total_rows, count(*) FILTER (WHERE total_amount > 0) AS valid_amount_rows FROM lines"),
    "order_counts": _with(
        "SELECT count(*) AS line_rows, count(DISTINCT order_id) AS distinct_orders FROM lines"),
    "visible_kpis": _with(
        f"""SELECT total_orders, CAST(NULL AS BIGINT) AS unique_users, total_gmv, avg_order_value,
  (SELECT {_CHANGE_TEXT} FROM change) AS gmv_change
FROM (SELECT count(DISTINCT order_id) AS total_orders, CAST(sum(total_amount) AS DOUBLE) AS total_gmv,
  CAST(sum(total_amount) AS DOUBLE) / NULLIF(count(DISTINCT order_id), 0) AS avg_order_value
  FROM lines WHERE {_COMPLETED})""", _change(_COMPLETED)),
}
