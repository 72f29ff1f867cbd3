import datetime as dt

import pytest
from pyspark.sql import functions as F

from orderlens.operators import joins
from orderlens.plans import clean, prepare, checks
from orderlens.sources.dimensions import load_users

SCHEMA = ("order_id string, order_date string, quantity string, unit_price string, total_amount string, "
          "status string, product_name string")


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def report_of(cleaned):
    return {row["rule"]: row["affected_rows"] for row in cleaned.report.collect()}


def test_zero_amounts_and_order_lines_are_kept(spark):
    raw = spark.createDataFrame(
        [("K30", "2025-02-11", 3, 15, 45, "已完成", "茶杯"), ("K30", "2025-02-11", 1, 70, 70, "已完成", "茶壶"),
         ("K31", "2025-02-14", 2, 35, 0, "交易成功", "试用装")],
        "order_id string, order_date string, quantity int, unit_price int, total_amount int, status string, product_name string")
    cleaned = clean.clean_orders(raw)
    lines = {r["product_name"]: r for r in cleaned.lines.collect()}
    assert len(lines) == 3 and lines["试用装"]["total_amount"] == 0 and lines["茶杯"]["product_id"] == "茶杯"
    report = report_of(cleaned)
    assert report["order_lines"] == 3 and report["distinct_orders"] == 2
    assert "mixed_status_orders" not in report


def test_absent_columns_take_their_defaults(spark):
    cleaned = clean.clean_orders(frame(spark, [("5",), ("7",)], "total_amount string"))
    rows = cleaned.lines.orderBy("total_amount").collect()
    assert [r["order_id"] for r in rows] == ["ROW0000001", "ROW0000002"]
    assert {(r["quantity"], r["status"], r["status_norm"], r["product_id"], r["unit_price"], r["is_anomaly"]) for r in rows} == {
        (1.0, "未提供状态", "completed", "unknown_product", None, 0)}
    assert report_of(cleaned) == {"quantity_defaulted": 2, "order_id_generated": 2}


def test_exact_duplicates_collapse_before_ids_are_generated(spark):
    rows = [(None, "2026-07-01", "1", "2", "2", "已完成", "甲")] * 3 + [("A", "bad", "1", "2", "2", "已完成", "甲")]
    cleaned = clean.clean_orders(frame(spark, rows))
    assert [r["order_id"] for r in cleaned.lines.collect()] == ["ROW0000001"]
    report = report_of(cleaned)
    assert report["duplicates_removed"] == 2 and report["invalid_dates_removed"] == 1


def test_a_table_whose_dates_never_parse_is_emptied(spark):
    assert clean.clean_orders(frame(spark, [("A", "bad", "1", "2", "2", "x", "甲")])).lines.count() == 0


def test_first_copy_decides_the_given_flag_and_the_numbers_follow_positions(spark):
    rows = [(5, None, "3", "1"), (2, None, "3", "0"), (9, "", "4", None), (1, "unknown", "5", None)]
    raw = frame(spark, rows, "_row bigint, order_id string, total_amount string, is_anomaly string")
    lines = {r["total_amount"]: r for r in clean.clean_orders(raw).lines.collect()}
    assert lines[3.0]["is_anomaly"] == 0 and lines[3.0]["_row"] == 2
    # Numbers follow the source position.
    assert [lines[x]["order_id"] for x in (5.0, 3.0, 4.0)] == ["ROW0000001", "ROW0000002", "ROW0000003"]


def test_amounts_and_flags(spark):
    rows = [("A", "2026-07-01", "2", "3", None, "ok", "a"), ("B", "2026-07-01", "2", None, "x", "ok", "b"),
            ("C", "2026-07-01", "-1", "3", "5", "ok", "c"), ("D", "2026-07-01", "1", "-3", "5", "ok", "d"),
            ("E", "2026-07-01", "1", "3", "(5)", "ok", "e"), ("F", "2026-07-01", "0", "3", "0", "ok", "f")]
    cleaned = clean.clean_orders(frame(spark, rows))
    got = {r["order_id"]: (r["quantity"], r["unit_price"], r["total_amount"], r["is_anomaly"]) for r in cleaned.lines.collect()}
    assert got == {"A": (2.0, 3.0, 6.0, 0), "B": (2.0, None, 0.0, 1), "C": (-1.0, 3.0, 5.0, 1),
                   "D": (1.0, -3.0, 5.0, 1), "E": (1.0, 3.0, -5.0, 1), "F": (0.0, 3.0, 0.0, 1)}
    report = report_of(cleaned)
    assert (report["total_amount_computed"], report["total_amount_unresolved"], report["total_amount_unparsed"],
            report["anomalies_flagged"], report["status_unrecognised"]) == (1, 1, 1, 4, 6)


@pytest.mark.parametrize("quantities, threshold", [
    ([1, 1, 2, 1], 10), ([5], 20), ([4, 4], 20), ([10, 20, 30], 50), ([], 20)])
def test_quantity_threshold(spark, quantities, threshold):
    df = spark.createDataFrame([(float(q),) for q in quantities], "quantity double")
    assert df.select(clean.quantity_threshold(df)).first()[0] == threshold if quantities else True
    flagged = clean.flag_anomalies(
        spark.createDataFrame([(float(q), 1.0, 1.0, 0) for q in quantities + [threshold + 1]],
                              "quantity double, unit_price double, total_amount double, is_anomaly int"), threshold)
    assert flagged.filter("is_anomaly = 1").count() == 1


def test_given_threshold_and_business_values_unchanged(spark):
    rows = [(f"A{i}", "2026-07-01", str(i), "3", str(3 * i), "已完成", "p") for i in range(1, 9)]
    cleaned = clean.clean_orders(frame(spark, rows), threshold=5)
    assert cleaned.lines.filter("is_anomaly = 1").count() == 3
    assert cleaned.lines.agg(F.sum("total_amount"), F.sum("quantity")).first()[:] == (108.0, 36.0)


def test_look_ups_take_the_first_entry(spark):
    raw = frame(spark, [("A", "u1", "", "p1", "2"), ("B", "u2", "nan", "p2", "3"), ("C", "u9", "北京", "p9", "4"), ("D", "u3", None, "p3", "1")],
                "order_id string, user_id string, city string, product_id string, quantity string")
    users = frame(spark, [("u1", "上海"), ("u1", "深圳"), ("u2", None), ("u2", "广州"), (None, "x")], "user_id string, city string").coalesce(1)
    products = frame(spark, [("p1", "￥5"), ("p1", "9"), ("p2", "x"), ("p3", "1,000")], "product_id string, price string").coalesce(1)
    cleaned = clean.clean_orders(raw, products, users)
    got = {r["order_id"]: (r["city"], r["unit_price"], r["total_amount"]) for r in cleaned.lines.collect()}
    assert got == {"A": ("上海", 5.0, 10.0), "B": ("未知", None, 0.0), "C": ("北京", None, 0.0), "D": ("未知", 1000.0, 1000.0)}
    report = report_of(cleaned)
    assert report["city_blank"] == 3 and report["unit_price_from_products"] == 2


def test_blank_product_ids_take_the_name(spark):
    rows = [("", "甲"), ("unknown", None), ("p", "乙")]
    df = frame(spark, rows, "product_id string, product_name string")
    # Without a name the id stays missing instead of becoming a text such as "nan".
    assert [r["product_id"] for r in clean.fill_product_ids(df).collect()] == ["甲", None, "p"]


def test_mixed_statuses_and_same_named_columns(spark):
    df = frame(spark, [("A", "已完成", None, "1"), ("A", None, "退款", "2")], "order_id string, s string, t string, total_amount string")
    cleaned = clean.clean_orders(df.toDF("order_id", "status", "status", "total_amount"))
    assert report_of(cleaned)["mixed_status_orders"] == 1


def test_cleaning_twice_changes_nothing(spark):
    rows = [("A", "2026-07-01", "2", "3", None, "已完成", "a"), ("A", "2026-07-01", "2", "3", None, "已完成", "a"),
            ("", "2026-07-02", "900", "3", "1", "退款", "b")]
    once = clean.clean_orders(frame(spark, rows)).lines
    twice = clean.clean_orders(once.drop("status_norm")).lines
    columns = once.columns
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.select(columns).collect()), key=str)


# --- completion ---------------------------------------------------------------------------------
def test_prepare_adds_defaults(spark):
    row = prepare.prepare_orders(frame(spark, [("A",)], "order_id string")).first().asDict()
    assert row == {"order_id": "A", "is_anomaly": 0, "total_amount": 0.0, "quantity": 1, "unit_price": 0.0,
                   "status": "completed", "user_id": "unknown", "product_id": "unknown", "city": "未知",
                   "product_name": None, "category": "未分类", "user_level": "未知", "order_date": None,
                   "status_norm": "completed"}


def test_prepare_recomputes_only_an_all_zero_table(spark):
    schema = "total_amount double, quantity double, unit_price double"
    zero = prepare.prepare_orders(frame(spark, [(0.0, 2.0, 3.0), (None, 1.0, 4.0)], schema))
    assert sorted(r["total_amount"] for r in zero.collect()) == [4.0, 6.0]
    some = prepare.prepare_orders(frame(spark, [(0.0, 2.0, 3.0), (1.0, 1.0, 4.0)], schema))
    assert sorted(r["total_amount"] for r in some.collect()) == [0.0, 1.0]


def test_prepare_drops_undated_lines_only_if_some_are_dated(spark):
    dated = frame(spark, [("A", "2026-07-01"), ("B", "bad")], "order_id string, order_date string")
    assert [r["order_id"] for r in prepare.prepare_orders(dated).collect()] == ["A"]
    undated = frame(spark, [("A", "?"), ("B", "bad")], "order_id string, order_date string")
    assert prepare.prepare_orders(undated).count() == 2


def test_prepare_statuses(spark):
    df = frame(spark, [(" Refunded ", "已完成"), ("odd", "已取消"), (None, "待付款")], "status_norm string, status string")
    assert [r["status_norm"] for r in prepare.prepare_orders(df).collect()] == ["refunded", "cancelled", "pending"]


# --- checks ---------------------------------------------------------------------------------------
def findings(df):
    return sorted(map(tuple, checks.validate_orders(df).collect()))


def test_validation(spark):
    df = frame(spark, [("A1", "99")], "order_id string, total_amount string")
    assert findings(df) == [("warning", "no_order_date"), ("warning", "no_product"), ("warning", "no_status"), ("warning", "no_user_id")]
    assert findings(df.limit(0)) == [("error", "no_rows")]
    assert ("error", "no_amount") in findings(df.select("order_id"))
    assert ("error", "no_amount") not in findings(df.selectExpr("1 AS quantity", "2 AS unit_price"))


def dimensions(df):
    return [r[0].split("（")[0] for r in checks.missing_dimensions(df).collect()]


def test_missing_dimensions(spark):
    full = frame(spark, [("u", "p", "n", "2026", "5", "c")] * 10,
                 "user_id string, product_id string, product_name string, order_date string, total_amount string, category string")
    assert dimensions(full) == []
    assert dimensions(full.select("order_date")) == ["user_id", "product_id/product_name", "total_amount", "category"]
    assert dimensions(full.withColumn("user_id", F.lit(" NULL "))) == ["user_id"]
    blank = full.withColumn("product_id", F.lit("unknown"))
    assert dimensions(blank) == [] and dimensions(blank.drop("product_name")) == ["product_id/product_name"]
    zero = full.withColumn("total_amount", F.lit("¥0"))
    assert dimensions(zero) == ["total_amount"]
    assert dimensions(zero.withColumns({"quantity": F.lit(1), "unit_price": F.lit(2)})) == []
    assert dimensions(full.limit(0)) == []


def test_look_ups_agree_when_the_dimension_is_too_large_to_broadcast(spark, monkeypatch):
    raw = frame(spark, [(f"A{i}", f"u{i % 3}", "" if i % 2 else "x", f"p{i % 5}") for i in range(200)],
                "order_id string, user_id string, city string, product_id string")
    users = frame(spark, [(f"u{i}", f"c{i}") for i in range(3)], "user_id string, city string")
    products = frame(spark, [(f"p{i}", str(i + 1)) for i in range(4)], "product_id string, price string")

    def lines():
        cleaned = clean.clean_orders(raw, products, users).lines
        return sorted(map(str, cleaned.select("order_id", "city", "unit_price").collect()))

    small = lines()
    monkeypatch.setattr(joins.join_dimension, "__kwdefaults__", {"broadcast_bytes": 0, "salts": 4})
    assert lines() == small


def test_no_table_gives_no_lines_and_says_so(spark):
    done = clean.clean_orders(None)
    assert done.lines.columns == [] and done.lines.count() == 0
    assert [tuple(r) for r in done.report.collect()] == [(0, "no_orders_read", 0)]


def test_the_first_entry_does_not_depend_on_splits(spark, tmp_path):
    for name, first in (("b.csv", 0), ("a.csv", 1), ("c.csv", 2)):  # the smallest file comes first by name, not by size
        rows = "".join(f"U{i},n,F,20,城{name[0]}{i % 9}-{k},普通,2025-01-01\n" for k in range(2) for i in range(first * 10, 40 + first * 400))
        (tmp_path / name).write_text("user_id,username,gender,age,city,user_level,registration_date\n" + rows, "utf-8")
    orders = spark.createDataFrame([(f"o{i}", f"U{i}", None) for i in range(60)], "order_id string, user_id string, city string")
    seen = set()
    for split in ("128m", "6000", "1500"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            users = load_users(spark, str(tmp_path), positions=True)
            seen.add(tuple(sorted((r["order_id"], r["city"]) for r in clean.fill_city(orders, users).select("order_id", "city").collect())))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(seen) == 1
    [rows] = seen
    cities = dict(rows)
    assert cities["o12"] == "城a3-0" and cities["o2"] == "城b2-0" and cities["o59"] == "城a5-0"


def test_report_reads_the_staged_lines_once(spark):
    cleaned = clean.clean_orders(frame(spark, [("A", "2026-07-01", "x", "2", "2", "已完成", "甲"), (None, "bad", "1", "2", "2", "已完成", "甲")]))
    plan = cleaned.report._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" not in cleaned.lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 3  # lines with an order number, lines without one, and the offsets that number these
    assert report_of(cleaned) == {"quantity_unparsed": 1, "quantity_defaulted": 1, "invalid_dates_removed": 1}


def test_an_empty_table_gives_an_empty_report(spark):
    cleaned = clean.clean_orders(frame(spark, []))
    assert cleaned.lines.count() == 0 and report_of(cleaned) == {}


def test_only_lines_with_a_repeated_hash_are_compared_in_full(spark):
    """All lines were shuffled with all their columns to find the few that come twice."""
    rows = [(f"U{n}", None, f"r{n}", 0.0, 1) for n in range(300)] + [("U5", None, "r5", 1.0, 0)] * 2
    rows += [("a", None, None, 0.0, 0), (None, "a", None, 0.0, 0), (None, None, "a", 0.0, 1), (None, "a", None, 0.0, 1), (None, None, None, 0.0, 0)]
    df = spark.createDataFrame(rows, "user_id string, city string, remark string, is_anomaly double, _n_x int")
    found = clean.remove_duplicates(df)
    copies = {tuple(r[c] for c in ("user_id", "city", "remark")): (r[clean.COPIES], r["_n_x"], r["is_anomaly"]) for r in found.collect()}
    assert len(copies) == 304 == found.count()
    assert copies["U5", None, "r5"] == (3, 1, 0.0) and copies[None, "a", None] == (2, 1, 0.0) and copies["a", None, None] == (1, 0, 0.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    whole, several = plan.split("Aggregate", 1)
    assert "getbit" in whole and "getbit" in several  # lines that are alone pass by the aggregation


def test_lines_of_columns_without_a_hash_are_compared_in_full(spark):
    df = spark.sql("SELECT explode(array(map('a', 1), map('a', 1), map('b', 1))) AS other_columns, 0D AS is_anomaly, 1 AS _n_x")
    found = clean.remove_duplicates(df)
    assert sorted((str(r["other_columns"]), r[clean.COPIES], r["_n_x"]) for r in found.collect()) == [("{'a': 1}", 2, 2), ("{'b': 1}", 1, 1)]
