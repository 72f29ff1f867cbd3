import pytest
from pyspark.sql import functions as F

from orderlens.operators import columns, headers, matching

BUSINESS = ["商家订单编号", "买家UID", "SKU编码", "商品标题", "支付成功时间", "成交件数", "成交单价", "订单实收金额",
            "交易状态", "收货城市"]


def mapping_of(spark, names):
    df = spark.createDataFrame([(names,)], "names array<string>")
    return {r["field"]: r["source"] for r in matching.suggest_mapping(df).collect()}


def test_common_business_headers(spark):
    mapping = mapping_of(spark, BUSINESS)
    assert mapping == dict(zip(
        ["order_id", "user_id", "product_id", "product_name", "order_date", "quantity", "unit_price",
         "total_amount", "status", "city"], BUSINESS))


def test_amount_paid_is_preferred_to_list_price(spark):
    assert mapping_of(spark, ["订单号", "商品总价", "用户实付", "售后状态"])["total_amount"] == "用户实付"


def test_guards_between_price_and_amount(spark):
    df = spark.createDataFrame([("商品金额x",), ("成交单价x",), ("金额",)], "name string")
    scores = {(r["name"], f): r[f] for r in df.select(
        "name", *[matching.match_score(F.col("name"), f).alias(f) for f in ("unit_price", "total_amount")]).collect()
        for f in ("unit_price", "total_amount")}
    assert scores[("商品金额x", "unit_price")] == 0
    assert scores[("成交单价x", "total_amount")] == 0
    assert scores[("金额", "total_amount")] == 100


def test_unique_names(spark):
    df = spark.createDataFrame([([" a", None, "a", "b", "a"],)], "cells array<string>")
    assert df.select(matching.unique_names(F.col("cells"))).first()[0] == ["a", "未命名列_2", "a_2", "b", "a_3"]


def test_cells(spark):
    df = spark.createDataFrame([(',a,"b,""c""",,NULL,"x"', ","), ("a|b||c", "|"), ("a\tb", "\t")], "line string, mark string")
    got = [r[0] for r in df.select(headers.split_cells(F.col("line"), F.col("mark"))).collect()]
    assert got == [[None, "a", 'b,"c"', None, None, "x"], ["a", "b", None, "c"], ["a", "b"]]


def find(spark, rows):
    df = spark.createDataFrame([("f", i, row) for i, row in enumerate(rows)], "file string, line int, cells array<string>")
    return headers.find_headers(df, ["file"], "line", "cells").first()


def test_header_below_titles(spark):
    found = find(spark, [["订单导出", None, None], ["订单编号", "成交时间", "成交金额"], ["A1", "2026-07-01", "99"]])
    assert (found["header_row"], found["matched_fields"]) == (2, 3)


def test_repeated_header_prefers_the_later_row(spark):
    found = find(spark, [["订单编号", "成交金额"], ["A1", "99"], ["订单编号", "成交金额"]])
    assert found["header_row"] == 3


def test_unfamiliar_header_is_the_first_steady_row(spark):
    found = find(spark, [["title", None, None], ["x", "y", None], ["q", "w", "e"], ["1", "2", "3"], ["4", "5", "6"]])
    assert found["header_row"] == 2


def test_unfamiliar_header_without_followers(spark):
    assert find(spark, [["title", None], ["x", "y"]])["header_row"] == 2
    assert find(spark, [["title"], ["only"]])["header_row"] == 1


def test_mapping_is_applied_once_per_source(spark):
    df = spark.createDataFrame([("1", "2")], "a string, b string")
    assert columns.apply_mapping(df, {"order_id": "a", "city": None, "status": "missing"}).columns == ["order_id", "b"]
    with pytest.raises(ValueError):
        columns.apply_mapping(df, {"order_id": "a", "status": "a"})


def test_same_named_columns_are_merged(spark):
    df = spark.createDataFrame([(None, "x", "1"), ("y", "z", "2")], "a string, b string, c string").toDF("a", "a", "c")
    assert [tuple(r) for r in columns.coalesce_same_named(df).collect()] == [("x", "1"), ("y", "2")]


def test_after_sales_status(spark):
    df = spark.createDataFrame([(None,), ("",), (" nan",), ("NaN",), ("退款中",)], "status string")
    filled = columns.fill_after_sales_status(df, {"status": "售后状态"})
    assert [r[0] for r in filled.collect()] == ["已完成", "已完成", "已完成", "NaN", "退款中"]
    assert columns.fill_after_sales_status(df, {"status": "订单状态"}) is df
