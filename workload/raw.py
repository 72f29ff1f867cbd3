"""A raw order export with defects, derived from the line items, in Spark and in SQL.

Every cell is text built from integer keys and decimal amounts, so both engines see the
same characters. One order in ten is exported three times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .views import table

# Raw columns as expressions that Spark SQL and DuckDB read alike.
_DAY = "CAST(CAST(l_shipdate AS DATE) AS STRING)"
_QTY = "CAST(CAST(l_quantity AS BIGINT) AS STRING)"
_AMOUNT = "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING)"
_PRICE = "concat(CAST(l_partkey % 900 + 10 AS STRING), '.5')"

RAW_COLUMNS = {
    "order_id": """CASE l_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'NULL'
      ELSE concat('O', CAST(l_orderkey AS STRING)) END""",
    "user_id": "CASE WHEN l_suppkey % 9 = 0 THEN 'unknown' ELSE concat('U', CAST(l_suppkey AS STRING)) END",
    "product_id": """CASE l_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN '未知'
      ELSE concat('P', CAST(l_partkey AS STRING)) END""",
    "product_name": "CASE WHEN l_partkey % 22 <> 0 THEN concat('商品', CAST(l_partkey AS STRING)) END",
    "order_date": f"""CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE CASE l_orderkey % 12
      WHEN 0 THEN replace({_DAY}, '-', '/') WHEN 1 THEN replace({_DAY}, '-', '')
      WHEN 2 THEN CAST(36526 + l_orderkey % 3000 AS STRING)
      WHEN 3 THEN CAST(1000000000 + (l_orderkey % 100000) * 3600 AS STRING)
      WHEN 4 THEN CAST(1000000000000 + (l_orderkey % 100000) * 3600000 AS STRING)
      WHEN 5 THEN concat({_DAY}, ' 10:30:00') WHEN 6 THEN 'not a date'
      WHEN 7 THEN concat(substring({_DAY}, 1, 4), '年', substring({_DAY}, 6, 2), '月', substring({_DAY}, 9, 2), '日')
      WHEN 8 THEN concat({_DAY}, 'T08:05:09')
      WHEN 9 THEN concat(substring({_DAY}, 6, 2), '-', substring({_DAY}, 9, 2), '-', substring({_DAY}, 1, 4))
      WHEN 10 THEN concat(CAST(36526 + l_orderkey % 3000 AS STRING), '.5')
      ELSE concat(' ', substring({_DAY}, 6, 5), ' 7:15 ') END END""",
    "quantity": f"""CASE l_orderkey % 17 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN concat({_QTY}, '件')
      WHEN 3 THEN concat('-', {_QTY}) WHEN 4 THEN '0' WHEN 5 THEN concat('(', {_QTY}, ')')
      WHEN 6 THEN concat({_QTY}, '00') ELSE {_QTY} END""",
    "unit_price": f"""CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN concat('￥', {_PRICE}) WHEN 2 THEN 'abc'
      WHEN 3 THEN concat('-', {_PRICE}) ELSE {_PRICE} END""",
    "total_amount": f"""CASE l_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN concat('¥', {_AMOUNT}, '元')
      WHEN 2 THEN concat({_QTY}, '.2万') WHEN 3 THEN '0' WHEN 4 THEN concat('(', {_AMOUNT}, ')')
      WHEN 5 THEN '--' WHEN 6 THEN concat(' ', {_QTY}, ',250.75') ELSE {_AMOUNT} END""",
    "payment_method": "CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 'None' WHEN 2 THEN '支付宝' ELSE ' 微信 ' END",
    "status": """CASE l_orderkey % 14 WHEN 0 THEN '交易成功' WHEN 1 THEN '已完成' WHEN 2 THEN '退款中' WHEN 3 THEN '待 发货'
      WHEN 4 THEN '交易关闭' WHEN 5 THEN '支付失败' WHEN 6 THEN NULL WHEN 7 THEN '未完成' WHEN 8 THEN '[Paid]'
      WHEN 9 THEN 'PARTIALLY_REFUNDED' WHEN 10 THEN '订单_已取消(系统)' WHEN 11 THEN 'xyz' WHEN 12 THEN '退款关闭'
      ELSE ' 买家确认收货。' END""",
    "city": "CASE l_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' 未知 ' WHEN 2 THEN 'nan' ELSE concat('C', CAST(l_suppkey % 50 AS STRING)) END",
    "category": """CASE l_partkey % 8 WHEN 0 THEN '家居生活/厨房餐具/水杯' WHEN 1 THEN '未知 > 数码 > 手机' WHEN 2 THEN NULL
      WHEN 3 THEN '  ' WHEN 4 THEN '服饰→女装' WHEN 5 THEN '||美妆' WHEN 6 THEN '未分类' ELSE concat('类目', CAST(l_partkey % 5 AS STRING)) END""",
    "is_anomaly": "CASE WHEN l_orderkey % 29 = 0 THEN '1' WHEN l_orderkey % 29 = 1 AND copy = 2 THEN '1' END",
    "remark": "concat('batch ', CAST(l_suppkey % 3 AS STRING))",
}
_COPIES = "CASE WHEN l_orderkey % 10 = 0 THEN 3 ELSE 1 END"


def raw_lines(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The raw export, or some of its columns, straight from one scan of the line items.

    Texts are made once per line, before it is copied, beside the list of copies: a projection with a lambda is generated
    as many small methods, while in one method for the whole stage the JVM would never compile them (see ``session``).
    """
    wanted = list(columns or RAW_COLUMNS)
    late = [c for c in wanted if "copy" in RAW_COLUMNS[c]]
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", *[f"{RAW_COLUMNS[c]} AS {c}" for c in wanted if c not in late],
        f"transform(sequence(1, {_COPIES}), copy -> copy) AS _copies")
    copied = lines.selectExpr("*", "explode(_copies) AS copy")
    return copied.selectExpr(*[f"{RAW_COLUMNS[c]} AS {c}" if c in late else c for c in wanted])


RAW_SQL = "raw AS (SELECT {} FROM lineitem JOIN (VALUES (1), (2), (3)) v(copy) ON copy <= {})".format(
    ",\n  ".join(f"{text} AS {name}" for name, text in RAW_COLUMNS.items()), _COPIES)
