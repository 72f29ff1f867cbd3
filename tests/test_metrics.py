import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from orderlens.plans import derived, metrics, prepare
from orderlens.sources.dimensions import no_products


def lines(spark, rows):
    schema = ("order_id string, user_id string, product_id string, product_name string, category string, "
              "order_date timestamp_ntz, quantity double, total_amount double, status_norm string, "
              "is_anomaly int, user_level string, city string")
    return spark.createDataFrame(rows, schema)


def line(order, user="u", product="p", amount=1.0, status="completed", day=dt.datetime(2026, 7, 1), **more):
    values = {"name": None, "category": None, "quantity": 1.0, "anomaly": 0, "level": "金卡", "city": "上海", **more}
    return (order, user, product, values["name"], values["category"], day, values["quantity"], amount, status,
            values["anomaly"], values["level"], values["city"])


def plain(df):
    return [tuple(r) for r in df.collect()]


def test_status_selection(spark):
    orders = lines(spark, [line("A"), line("B", status="refunded"), line("C", status="pending")])

    def total(statuses):
        return metrics.kpi_summary(orders, statuses).first()["total_orders"]

    assert (total(None), total([]), total(["refunded", "pending"]), total(["bogus"]), total(["bogus", "pending"])) == (1, 1, 2, 0, 1)
    empty = metrics.kpi_summary(orders, ["bogus"]).first()
    assert empty["total_gmv"] is None and empty["avg_order_value"] is None


def test_placeholder_user_counts_in_the_summary_but_not_among_users(spark):
    orders = lines(spark, [line("A", user="unknown"), line("B", user="u1"), line("C", user=" "), line("D", user=None)])
    assert metrics.kpi_summary(orders).first()["unique_users"] == 3
    assert sorted(r["user_id"] for r in metrics.top_users(orders).collect()) == [" ", "u1"]


def test_user_with_two_levels_is_split(spark):
    orders = lines(spark, [line("A", level="金卡"), line("B", level="普通"), line("B", level="")])
    assert sorted(plain(metrics.repurchase_by_level(orders))) == [
        ("普通", 1, 1.0, 1.0, 0.0), ("未知", 1, 1.0, 1.0, 0.0), ("金卡", 1, 1.0, 1.0, 0.0)]


def test_limited_and_unlimited_users_agree(spark):
    orders = lines(spark, [line(f"o{i % 37}", user=f"u{i % 7}", amount=float(i), city=f"c{i % 2}") for i in range(200)])
    everyone = plain(metrics.top_users(orders, limit=None))
    assert plain(metrics.top_users(orders, limit=5)) == everyone[:5] and len(everyone) == 14
    assert derived.top_user_chart(metrics.top_users(orders), 3).count() == 3


def test_orders_with_mixed_statuses_push_the_shares_over_one_hundred(spark):
    orders = lines(spark, [line("A"), line("A", status="refunded"), line("B")])
    assert plain(metrics.status_distribution(orders)) == [("completed", 2, 100.0), ("refunded", 1, 50.0)]


def test_repeated_products_fan_out(spark):
    orders = lines(spark, [line("A", product="p", amount=5.0, quantity=2.0), line("B", product="q", amount=1.0, category="自有")])
    products = spark.createDataFrame([("p", "一", "甲类", 1.0), ("p", "二", "乙类", 1.0)],
                                     "product_id string, product_name string, category string, cost double")
    assert sorted(plain(metrics.top_products(orders, products))) == [
        ("p", "一", "甲类", 2.0, 5.0), ("p", "二", "乙类", 2.0, 5.0), ("q", "q", "自有", 1.0, 1.0)]
    assert sorted(plain(metrics.category_performance(orders, products))) == [
        ("乙类", 1, 5.0, 2.0), ("甲类", 1, 5.0, 2.0), ("自有", 1, 1.0, 1.0)]
    assert sorted(plain(metrics.category_margin(orders, products))) == [
        ("乙类", 5.0, 2.0, 3.0, 60.0), ("甲类", 5.0, 2.0, 3.0, 60.0)]
    assert plain(metrics.category_margin(orders, products.drop("cost"))) == []


def test_uncategorised_label_is_not_replaced_by_the_product(spark):
    orders = lines(spark, [line("A", category="未分类"), line("B", category=""), line("C", category=" ")])
    products = spark.createDataFrame([("p", "一", "甲类", None)], "product_id string, product_name string, category string, cost double")
    assert sorted(r["category"] for r in metrics.category_performance(orders, products).collect()) == [" ", "未分类", "甲类"]


def test_category_totals_add_up_to_the_summary(spark):
    orders = lines(spark, [line(f"o{i}", product=f"p{i % 3}", amount=i / 4, category=["", None, "x"][i % 3]) for i in range(50)])
    categories = metrics.category_performance(orders, no_products(spark))
    assert categories.agg(F.sum("gmv")).first()[0] == metrics.kpi_summary(orders).first()["total_gmv"]
    shares = derived.category_share(categories)
    assert abs(shares.agg(F.sum("share")).first()[0] - 1) < 1e-12


def test_change_between_the_last_two_present_periods(spark):
    orders = lines(spark, [line("A", amount=100.0, day=dt.datetime(2026, 1, 1)), line("B", amount=50.0, day=dt.datetime(2026, 5, 1)),
                           line("C", amount=75.0, day=dt.datetime(2026, 7, 1)), line("D", day=None)])
    assert plain(metrics.gmv_change(metrics.gmv_trend(orders))) == [("+50.0%", 50.0)]
    one = orders.filter("order_id = 'A'")
    assert plain(metrics.gmv_change(metrics.gmv_trend(one))) == [("—", None)]
    free = lines(spark, [line("A", amount=0.0, day=dt.datetime(2026, 1, 1)), line("B")])
    assert plain(metrics.gmv_change(metrics.gmv_trend(free))) == [("—", None)]
    none = orders.filter("order_date IS NULL")
    assert plain(metrics.gmv_trend(none)) == [] and plain(metrics.gmv_change(metrics.gmv_trend(none))) == [("—", None)]


def test_granularity_and_dates(spark):
    days = [line(str(i), day=dt.datetime(2026, 1, 1) + dt.timedelta(days=i)) for i in range(32)]
    assert metrics.recommended_granularity(lines(spark, days)).first()[0] == "月"
    assert metrics.recommended_granularity(lines(spark, days[:31])).first()[0] == "日"
    undated = lines(spark, [line("A", day=None)])
    assert metrics.recommended_granularity(undated).first()[0] == "月"
    assert metrics.has_order_dates(undated).first()[0] is False
    assert metrics.has_order_dates(lines(spark, days)).first()[0] is True


def test_high_value_orders_stop_at_ten(spark):
    many = [line(f"s{i:03}", amount=1.0) for i in range(200)] + [line(f"b{i:02}", amount=1000.0) for i in range(12)]
    best = metrics.high_value_orders(lines(spark, many))
    assert [r["order_id"] for r in best.collect()] == [f"b{i:02}" for i in range(10)]
    mixed = lines(spark, [line("x", amount=60.0, anomaly=1), line("x", amount=60.0, status="refunded", quantity=3.0)]
                  + [line(f"s{i}") for i in range(20)])
    row = metrics.high_value_orders(mixed, ["completed", "refunded"]).first()
    assert (row["status_norm"], row["quantity"], row["is_anomaly"], row["total_amount"]) == ("completed, refunded", 4.0, 1, 120.0)


def test_status_options(spark):
    orders = lines(spark, [line("A", status="refunded"), line("B", status="pending"), line("C", status=None)])
    assert plain(metrics.status_options(orders)) == [("pending", True), ("refunded", False)]
    with_done = orders.unionAll(lines(spark, [line("D")]))
    assert plain(metrics.status_options(with_done)) == [("completed", True), ("pending", False), ("refunded", False)]


@pytest.mark.parametrize("amount, missing, expected", [
    (5.0, False, (1, 1, 5.0, 5.0, "—")), (0.0, False, (1, 1, None, None, None)), (5.0, True, (1, None, 5.0, 5.0, "—"))])
def test_visible_kpis(spark, amount, missing, expected):
    orders = lines(spark, [line("A", amount=amount)])
    shown = derived.visible_kpis(
        metrics.kpi_summary(orders), metrics.gmv_change(metrics.gmv_trend(orders)),
        metrics.amount_availability(orders), metrics.has_order_dates(orders), missing)
    assert plain(shown) == [expected]


    users = None if missing else metrics.kpi_summary(orders)
    assert plain(derived.visible_facts(metrics.order_facts(orders), users)) == [expected]


def test_facts_of_one_scan_equal_the_single_results(spark):
    draw = random.Random(3)
    rows = [line(draw.choice(["a", "b", "c", "d", "e", None]), amount=draw.choice([0.0, 1.0, 2.5, None]), status=draw.choice(["completed", "refunded", None]),
                 day=draw.choice([None, dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1), dt.datetime(2026, 5, 1)])) for _ in range(200)]
    for some in (rows, rows[:3], [r for r in rows if "refunded" in r], rows[:0]):
        orders = lines(spark, some)
        for statuses in (None, ["completed", "refunded"], ["no status"]):
            fact = metrics.order_facts(orders, statuses).first()
            summary, availability = metrics.kpi_summary(orders, statuses).first(), metrics.amount_availability(orders).first()
            assert (fact["total_orders"], fact["total_gmv"], fact["avg_order_value"]) == (summary["total_orders"], summary["total_gmv"], summary["avg_order_value"])
            assert fact["valid_amount_rows"] == availability["valid_amount_rows"]
            assert fact["has_dates"] == metrics.has_order_dates(orders).first()[0]
            assert fact["change_text"] == metrics.gmv_change(metrics.gmv_trend(orders, statuses=statuses)).first()["change_text"]
    plan = metrics.order_facts(lines(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 1 and "Expand" not in plan


def test_high_value_orders_read_the_lines_once(spark):
    orders = lines(spark, [line(f"s{i}", amount=float(i % 7)) for i in range(60)])
    plan = metrics.high_value_orders(orders)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 1


def test_prepared_defaults_can_be_analysed(spark):
    orders = prepare.prepare_orders(spark.createDataFrame([("A", 5.0)], "order_id string, total_amount double"))
    assert plain(metrics.kpi_summary(orders)) == [(1, 1, 1, 5.0, 5.0)]
    assert plain(derived.orders_per_user(metrics.top_users(orders))) == []
