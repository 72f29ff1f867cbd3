"""From exports to metrics: the steps of one analysis put together."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from .. import vocab
from ..operators.columns import apply_mapping, fill_after_sales_status
from ..operators.staging import cluster
from ..sources.dimensions import complete_products, no_products
from ..sources.exports import Export
from . import checks, clean, metrics, prepare


@dataclass(frozen=True)
class Imported:
    """Order lines ready for analysis, with everything found out on the way."""

    orders: DataFrame
    report: DataFrame
    findings: DataFrame
    missing_dimensions: DataFrame
    mapping: dict[str, str]
    has_user_level: bool


def import_orders(export: Export, mapping: Mapping[str, str | None] | None = None, *,
                  products: DataFrame | None = None, users: DataFrame | None = None,
                  threshold: float | None = None, year: int | None = None) -> Imported:
    """Map, check, clean and complete an export.

    ``mapping`` (standard field to source column) confirms or corrects the suggested one.
    """
    if mapping is None:
        # At most one row per standard field.
        mapping = {row["field"]: row["source"] for row in export.suggestions().collect()}
    confirmed = {field: source for field, source in mapping.items() if source}
    mapped = fill_after_sales_status(apply_mapping(export.rows, confirmed), confirmed)
    visible = mapped.drop(clean.ROW)
    findings = checks.validate_orders(visible)
    errors = [row["code"] for row in findings.filter("level = 'error'").collect()]
    if errors:
        raise ValueError(f"the export cannot be analysed: {', '.join(errors)}")
    cleaned = clean.clean_orders(mapped, products, users, threshold=threshold, year=year)
    orders = prepare.prepare_orders(cleaned.lines.drop(clean.ROW))
    return Imported(orders, cleaned.report, findings, checks.missing_dimensions(visible),
                    confirmed, "user_level" in visible.columns)


def share(imported: Imported) -> Imported:
    """The import with its order lines written once, in buckets by order: all results read these, and per-order figures
    (statuses, high-value orders, facts of the report) group them where they lie."""
    return replace(imported, orders=cluster(imported.orders, "order_id", "orders"))


def analyze(orders: DataFrame, products: DataFrame | None = None, *,
            granularity: str = vocab.MONTH, statuses: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """All standard results of an order table, each as a lazy DataFrame."""
    products = complete_products(no_products(orders.sparkSession) if products is None else products)
    statuses = None if statuses is None else list(statuses)
    return {
        "summary": metrics.kpi_summary(orders, statuses),
        "trend": metrics.gmv_trend(orders, granularity, statuses),
        "top_products": metrics.top_products(orders, products, statuses),
        "categories": metrics.category_performance(orders, products, statuses),
        "margin": metrics.category_margin(orders, products, statuses),
        "users": metrics.top_users(orders, statuses),
        "repurchase": metrics.repurchase_by_level(orders, statuses),
        "order_status": metrics.status_distribution(orders),
        "high_value_orders": metrics.high_value_orders(orders, statuses),
        "flagged_orders": metrics.flagged_orders(orders, statuses),
    }
