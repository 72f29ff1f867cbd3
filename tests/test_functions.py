import datetime as dt

import pytest
from pyspark.sql import functions as F

from orderlens import functions as X

T = dt.datetime


def evaluate(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [row[0] for row in df.orderBy("i").select(function(F.col("x"))).collect()]


def test_numbers(spark):
    cases = {
        "￥1,299.00": 1299.0, "1.2万": 12000.0, "3亿": 3e8, "2千件": 2000.0, "(12.5)": -12.5, "(-5)": -5.0,
        "￥(12)": 12.0, "1，299": 1299.0, "+5": 5.0, "5.": 5.0, "1e3": 13.0, "1-2": None, "n/a": None,
        "--": None, "": None, "　88元 ": 88.0, None: None, "1.2万亿": 1.2e8, "0": 0.0, "(1-2)": None,
    }
    assert evaluate(spark, X.parse_number, list(cases)) == list(cases.values())


def test_lenient_number_ignores_units(spark):
    assert evaluate(spark, lambda c: X.lenient_number(c, 1), ["1.2万", "¥3,000", "abc", None, "1-2"]) == [
        1.2, 3000.0, 1.0, 1.0, 1.0]


def test_dates(spark):
    cases = {
        "2026-07-01 10:00:00": T(2026, 7, 1, 10), "45292": T(2024, 1, 1), "45292.5": T(2024, 1, 1, 12),
        "45292.0": T(2024, 1, 1), "20260701": T(2026, 7, 1), "20261301": None, "1700000000": T(2023, 11, 14, 22, 13, 20),
        "1700000000000": T(2023, 11, 14, 22, 13, 20), "2026年7月1日": T(2026, 7, 1), "2026/7/1 9:05": T(2026, 7, 1, 9, 5),
        "2026.07.01": T(2026, 7, 1), "7-1": T(2025, 7, 1), "7月1日 08:30": T(2025, 7, 1, 8, 30), "7-1-2026": T(2026, 7, 1),
        "13-1-2026": T(2026, 1, 13), "01-07-26": T(2026, 1, 7), "01-07-99": T(1999, 1, 7), "July 1 2026": T(2026, 7, 1),
        "jul 1, 2026": T(2026, 7, 1), "2026-07": T(2026, 7, 1), "2026": T(2026, 1, 1), "202607": T(2026, 7, 1),
        "10:00": None, "now": None, "12345": None, "9999-12-31": None, "": None, None: None, "bad": None,
        "2026-07-01T10:00:00": T(2026, 7, 1, 10), "2026-07-01 10：30": T(2026, 7, 1, 10, 30),
        # A fraction of a second is dropped instead of being read as a zone offset.
        "2026-07-01 10:00:00.123": T(2026, 7, 1, 10),
    }
    assert evaluate(spark, lambda c: X.parse_datetime(c, year=2025), list(cases)) == list(cases.values())


def test_dates_of_other_types(spark):
    from pyspark.sql import types
    numbers = evaluate(spark, lambda c: X.parse_datetime(c, types.DoubleType()),
                       [45292.0, 1.7e9, 1.7e12, 20260701.0, 5.5], "double")
    assert numbers == [T(2024, 1, 1), T(2023, 11, 14, 22, 13, 20), T(2023, 11, 14, 22, 13, 20), T(2026, 7, 1), None]
    days = evaluate(spark, lambda c: X.parse_datetime(c, types.DateType()), [dt.date(2026, 7, 1)], "date")
    assert days == [T(2026, 7, 1)]


def test_statuses(spark):
    cases = {
        "交易成功": "completed", "退款中": "refunded", "已取消": "cancelled", "待付款": "pending", "支付失败": "failed",
        # Words of completion are looked for first, wherever they stand.
        "未完成": "completed", "退款完成": "completed", "退款关闭": "cancelled", "incomplete": "completed",
        "[Paid]": "completed", "PARTIALLY_REFUNDED": "refunded", "待 发货": "pending", "xyz": "unknown", "": "unknown",
        None: "unknown", "　已完成　": "completed",
    }
    assert evaluate(spark, X.normalize_status, list(cases)) == list(cases.values())


def test_categories(spark):
    cases = {"家居生活/厨房/水杯": "家居生活", "未知 > 数码": "数码", "||美妆": "美妆", "": "未分类", None: "未分类",
             "未分类": "未分类", "服饰→女装": "服饰", " a ＞ b": "a", "NaN/null": "未分类"}
    assert evaluate(spark, X.main_category, list(cases)) == list(cases.values())


def test_names_and_blanks(spark):
    assert evaluate(spark, X.normalize_name, ["商品（元）_ID", "　Order - Id ", None]) == ["商品元id", "orderid", ""]
    assert evaluate(spark, X.is_blank, ["", " NULL ", "　未知", "x", None]) == [True, True, True, False, True]
    assert evaluate(spark, X.looks_numeric, ["￥1,299.00", "(3)", "1.2万", "12-1", "a1", None]) == [
        True, True, True, False, False, False]


def test_display(spark):
    assert evaluate(spark, X.money_text, [1234.5, None], "double") == ["¥1,234.50", "¥0.00"]
    assert evaluate(spark, X.percent_text, [12.34, None, float("nan")], "double") == ["12.3%", "—", "—"]
    assert evaluate(spark, X.signed_percent_text, [-93.71, 4.0, None], "double") == ["-93.7%", "+4.0%", "—"]
    assert evaluate(spark, X.safe_float, [1.5, float("nan"), None], "double") == [1.5, 0.0, 0.0]
    assert evaluate(spark, lambda c: X.fallback(c, F.lit("d")), ["", " ", None, "x"]) == ["d", " ", "d", "x"]


def test_month_day_dates_take_the_current_year_by_default(spark):
    assert evaluate(spark, X.parse_datetime, ["7-1"])[0].year == dt.date.today().year


@pytest.mark.parametrize("granularity, label", [("月", "2026-07"), ("日", "2026-07-01")])
def test_period_label(spark, granularity, label):
    df = spark.sql("SELECT timestamp_ntz'2026-07-01 10:00:00' AS t")
    assert df.select(X.period_label(F.col("t"), granularity)).first()[0] == label


def test_every_unicode_space_is_trimmed_without_a_pattern(spark):
    cells = [chr(c) + " a" + chr(c) + "b " + chr(c) for c in (*range(0x3100), *range(0xFE00, 0x10000), 0x1F600)] + ["", " ", "\n\n", None]
    pattern = evaluate(spark, lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), cells)
    assert evaluate(spark, X.strip, cells) == pattern
    assert "regexp" not in spark.range(1).select(X.strip(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
