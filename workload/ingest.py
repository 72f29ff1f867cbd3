"""Header search, column matching, export loading and JSON results."""

from __future__ import annotations

import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from orderlens import vocab
from orderlens.operators import headers, matching
from orderlens.operators.staging import shared_folder
from orderlens.plans import derived, metrics, workflow
from orderlens.sources import dimensions
from orderlens.sources.exports import leading_lines, load_order_exports
from orderlens.sources.results import report_payload

from . import sqltext as S
from .views import ORDER_LINES_SQL, order_lines, table

# --- column matching --------------------------------------------------------------------------
# Column names put together from parts by order and part keys.
_FRONT = ("", "商家", "平台 ", "sku", "实付", "(原)", "用户", "支付")
_CORE = ("订单编号", "金额", "单价", "数量", "时间", "UID", "状态", "商品名称", "城市", "Total_Amount", "备注", "价格")
_BACK = ("", "_2", "（元）", "说明")


def _choose(words: tuple[str, ...], key: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{word}'" for i, word in enumerate(words))
    return f"CASE {key} % {len(words)} {cases} END"


def _name(a: str, b: str, c: str) -> str:
    return f"concat({_choose(_FRONT, a)}, {_choose(_CORE, b)}, {_choose(_BACK, c)})"


_NAME = _name("l_orderkey", "l_partkey", "l_suppkey")
_HEADER = [_name("o_orderkey", "o_custkey", "o_orderkey"), _name("o_custkey", "o_orderkey", "1"),
           _name("1", "(o_custkey + 5)", "o_custkey"), _name("o_custkey", "(o_orderkey + 7)", "0"),
           "concat('订单', 'ID')", _name("0", "(o_orderkey + o_custkey)", "0")]


def match_scores(spark, sf_dir):
    names = table(spark, sf_dir, "lineitem").selectExpr(f"{_NAME} AS name").groupBy("name").agg(
        F.count(F.lit(1)).alias("uses"))
    scored = names.select("name", "uses", F.explode(matching.field_scores(F.col("name"))).alias("m"))
    return scored.select("name", "uses", F.col("m.field").alias("field"), F.col("m.score").alias("score"))


def suggest_mapping(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    headers_used = orders.selectExpr(f"array({', '.join(_HEADER)}) AS names").groupBy("names").agg(
        F.count(F.lit(1)).alias("uses"))
    suggested = matching.suggest_mapping(headers_used)
    return suggested.withColumn("names", F.array_join("names", ","))


def unique_column_names(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    blank = "CASE WHEN o_orderkey % 3 = 0 THEN ' ' END"
    cells = orders.selectExpr(f"array({_HEADER[0]}, {blank}, {_HEADER[0]}, {_HEADER[2]}, {_HEADER[0]}) AS cells")
    return cells.select(F.array_join(matching.unique_names(F.col("cells")), ",").alias("names"))


# --- header search ------------------------------------------------------------------------------
_HEADERS = (("订单号", "下单时间", "实付金额", "交易状态"), ("Order ID", "Order Date", "Total Amount", "Status"),
            ("甲列", "乙列", "丙列", "丁列"))


def _export_lines(spark, sf_dir):
    """One small export per customer: title lines, a header and the customer's orders."""
    mark = "element_at(array(',', '\\t', ';', '|'), CAST({} % 4 + 1 AS INT))"
    names = "CASE {} % 3 " + " ".join(
        f"WHEN {i} THEN array({', '.join(repr(n) for n in h)})" for i, h in enumerate(_HEADERS)) + " END"
    top = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS file", "explode(sequence(0, CAST(c_custkey % 5 AS INT))) AS n").selectExpr(
        "file", "CAST(n AS BIGINT) - 10 AS line",
        f"CASE WHEN n < file % 5 THEN concat('报表 ', n) ELSE array_join({names.format('file')}, {mark.format('file')}) END AS text")
    body = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS file", "o_orderkey AS line",
        f"concat_ws({mark.format('o_custkey')}, concat('O', o_orderkey), CAST(o_orderdate AS DATE), "
        "CAST(o_totalprice AS DECIMAL(12,2)), o_orderstatus) AS text")
    return top.unionAll(body)


def detect_header(spark, sf_dir):
    lines = _export_lines(spark, sf_dir).withColumns({"block": F.lit(0), "filled": F.lit(True)})
    found = headers.choose_delimiters(leading_lines(lines), ["file"], "line", "text")
    return found.select("file", "delimiter", "header_row", "matched_fields", "width",
                        F.array_join("header_cells", "/").alias("header"))


# --- export loading --------------------------------------------------------------------------------
_EXPORT = {
    "商家订单编号": "concat('O', CAST(l_orderkey AS STRING))",
    "买家UID": "concat('U', CAST(l_suppkey AS STRING))",
    "商品标题": "CASE WHEN l_partkey % 4 = 0 THEN concat('礼盒, \"', CAST(l_partkey AS STRING), '\" 装') ELSE concat('商品', CAST(l_partkey AS STRING)) END",
    "支付成功时间": "CAST(CAST(l_shipdate AS DATE) AS STRING)",
    "成交件数": "CAST(CAST(l_quantity AS BIGINT) AS STRING)",
    "订单实收金额": "CASE WHEN l_linenumber = 1 THEN concat('￥', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING), '.50') ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) END",
    "交易状态": "CASE l_returnflag WHEN 'A' THEN '交易成功' WHEN 'N' THEN '待发货' ELSE '退款中' END",
    "备注": "CASE WHEN l_linenumber % 2 = 0 THEN 'N/A' ELSE concat('行', CAST(l_linenumber AS STRING)) END",
}


def _write_export(spark, sf_dir, code: str, mark: str, columns: dict[str, str] = _EXPORT,
                  above: int = 0, more: tuple[str, ...] = ()) -> str:
    """Write the line items as delimited text; every file starts with titles and a header.

    ``above`` lines of delimiters stand before the titles. ``more`` are expressions over ``text``, the number ``at`` of the line
    in its file and the columns of the line item that give a further line or NULL.
    """
    quoted = [f"CASE WHEN contains({e}, '{mark}') OR contains({e}, '\"') OR contains({e}, chr(10)) THEN concat('\"', replace({e}, '\"', '\"\"'), '\"') ELSE {e} END"
              for e in columns.values()]
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "*", "monotonically_increasing_id() & 8589934591 AS at", f"concat_ws('{mark}', {', '.join(quoted)}) AS text").selectExpr(
        f"explode(filter(array({', '.join(['text', *more])}), line -> line IS NOT NULL)) AS text")
    names = ['"' + c.replace('"', '""') + '"' if "\n" in c else c for c in columns]
    head = [mark * 3] * above + ["订单明细导出", "统计周期" + mark + "全部", mark.join(names)]

    def encode(batches):
        first = True
        for batch in batches:
            texts = batch["text"].tolist()
            if first:
                texts, first = head + texts, False
            yield pd.DataFrame({"bytes": [t.encode(code) for t in texts]})

    folder = f"{shared_folder(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    lines.mapInPandas(encode, "bytes binary").select(F.col("bytes").cast("string")).write.text(folder)
    return folder


def load_exports(spark, sf_dir):
    export = load_order_exports(spark, _write_export(spark, sf_dir, "gb18030", ";"))
    return export.rows.drop("_row")


def load_mixed_exports(spark, sf_dir):
    """Two folders that differ in encoding and delimiter, lined up by column name."""
    folders = [_write_export(spark, sf_dir, "utf-8", ","), _write_export(spark, sf_dir, "gb18030", "\t")]
    rows = load_order_exports(spark, folders, standard_names=True).rows
    return rows.groupBy("status", "备注").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("order_id").alias("orders"))


def export_files(spark, sf_dir):
    export = load_order_exports(spark, _write_export(spark, sf_dir, "gb18030", "|"))
    return export.files.groupBy("file_type", "encoding", "delimiter", "header_row", "columns").agg(
        F.sum("rows").alias("rows"))


_TWICE = {
    "订单号": "CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE concat('H', CAST(l_orderkey AS STRING)) END",
    "order_id": "concat('K', CAST(l_orderkey AS STRING))",
    "实付金额": _EXPORT["成交件数"],
}


def load_padded_exports(spark, sf_dir):
    """Empty lines above the header and in between, and lines with too many cells."""
    folder = _write_export(spark, sf_dir, "utf-8", ",", above=40, more=(
        "CASE WHEN l_linenumber = 2 THEN ',,,' END", "CASE WHEN l_linenumber = 3 THEN concat(text, ',多,余') END"))
    export = load_order_exports(spark, folder)
    rows = export.rows.groupBy(F.col("交易状态").alias("what")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("商家订单编号").alias("orders"))
    facts = export.files.groupBy("header_row").agg(F.sum("malformed_lines").alias("lines"))
    return rows.unionAll(facts.select(F.lit("malformed"), "lines", F.col("header_row").cast("bigint")))


def load_same_field_twice(spark, sf_dir):
    """Two columns that stand for one field: the leftmost value of every row counts."""
    rows = load_order_exports(spark, _write_export(spark, sf_dir, "utf-8", ",", _TWICE), standard_names=True).rows
    return rows.select("order_id", "total_amount")


_MULTILINE = {
    "订单\n编号": _EXPORT["商家订单编号"],
    "实付金额": _EXPORT["成交件数"],
    "备注": """CASE l_linenumber WHEN 1 THEN concat('第', CAST(l_partkey AS STRING), '件', chr(10), chr(10), '请"尽快"', chr(10), '发货,谢谢')
      WHEN 2 THEN concat(chr(10), CAST(l_suppkey AS STRING)) WHEN 3 THEN concat(CAST(l_suppkey AS STRING), '" 屏') ELSE '无' END""",
}


def load_multiline_export(spark, sf_dir):
    """Quoted cells with line breaks, in a header too, read in many splits that end anywhere."""
    folder = _write_export(spark, sf_dir, "gb18030", ",", _MULTILINE)
    splits = {"spark.sql.files.maxPartitionBytes": "256k", "spark.sql.files.openCostInBytes": "64k"}
    before = {key: spark.conf.get(key) for key in splits}
    for key, value in splits.items():
        spark.conf.set(key, value)
    try:
        rows = load_order_exports(spark, folder).rows.drop("_row")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return rows.toDF("order_id", "paid", "remark")


_AWKWARD = {
    "订单号": _EXPORT["商家订单编号"], "实付金额": _EXPORT["成交件数"], "file": "concat('f', CAST(l_suppkey AS STRING))",
    "_row": "CAST(l_linenumber AS STRING)", "Remark": "concat('R', CAST(l_partkey AS STRING))", "remark": "concat('r', CAST(l_partkey AS STRING))",
    "a`b": "concat('`', CAST(l_suppkey AS STRING))", "cells": "concat('c', CAST(l_linenumber AS STRING))",
}


def load_awkward_names(spark, sf_dir):
    """Names that the loader uses itself, that differ in case only, or that hold a backtick."""
    rows = load_order_exports(spark, _write_export(spark, sf_dir, "utf-8", ",", _AWKWARD)).rows.drop("_row")
    if rows.columns != ["订单号", "实付金额", "file", "_row_2", "Remark", "remark_2", "a`b", "cells"]:
        raise ValueError(f"other names: {rows.columns}")
    return rows.toDF("order_id", "paid", "file", "line", "remark_upper", "remark_lower", "quoted", "cells")


def load_by_kept_lines(spark, sf_dir):
    """Two delimiters find headers of equal worth; only the number of lines that fit decides."""
    columns = {"订单号甲": _EXPORT["商家订单编号"], "乙,丙实付金额": f"concat({_EXPORT['成交件数']}, ',1,2,3')"}
    export = load_order_exports(spark, _write_export(spark, sf_dir, "utf-8", ";", columns))
    return export.rows.drop("_row").toDF("order_id", "paid")


def load_repeated_headers(spark, sf_dir):
    """The header comes again in the data, behind the search window (in which the later one would count); such lines are not rows."""
    again = f"CASE WHEN l_linenumber = 4 AND at > 100 THEN '{','.join(_EXPORT)}' END"
    export = load_order_exports(spark, _write_export(spark, sf_dir, "utf-8", ",", more=(again,)))
    return export.rows.groupBy("交易状态").agg(F.count(F.lit(1)).alias("lines"))


_LAYOUTS = 40


def load_many_layouts(spark, sf_dir):
    """A folder in which every file has a column of its own: standard fields, and a map for the others."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        f"l_suppkey % {_LAYOUTS} AS layout", "1 AS n",
        f"concat_ws(',', {_EXPORT['商家订单编号']}, {_EXPORT['成交件数']}, concat('x', l_partkey), CASE WHEN l_linenumber = 1 THEN 'first' END) AS text")
    heads = lines.select("layout").distinct().selectExpr("layout", "0 AS n", "concat('订单号,实付金额,列', layout, ',说明') AS text")
    folder = f"{shared_folder(spark).rstrip('/')}/layouts-{uuid.uuid4().hex}"
    lines.unionAll(heads).repartition("layout").sortWithinPartitions("layout", "n").select("layout", "text").write.partitionBy("layout").text(folder)
    rows = load_order_exports(spark, folder, others_as_map=True).rows
    return rows.select("order_id", "total_amount", F.explode("other_columns").alias("name", "value"))


def load_dimensions(spark, sf_dir):
    """Products from a file with a header, as SQL users see them: beside the order lines, through registered views."""
    folder = f"{shared_folder(spark).rstrip('/')}/products-{uuid.uuid4().hex}"
    table(spark, sf_dir, "part").selectExpr(
        "concat('P', p_partkey) AS product_id", "p_name AS product_name", "p_type AS category", "p_brand AS brand",
        "p_size AS price", "p_size - 1 AS cost").write.option("header", True).csv(folder)
    orders = order_lines(spark, sf_dir).select(F.concat(F.lit("P"), F.col("product_id")).alias("product_id"), "quantity")
    dimensions.register_views(orders, dimensions.load_products(spark, folder))
    return spark.sql("""SELECT p.brand, count(*) AS lines, sum(o.quantity) AS quantity, sum(o.quantity * (p.price - p.cost)) AS margin
FROM orders o JOIN products p USING (product_id) GROUP BY p.brand""")


def import_and_summarise(spark, sf_dir):
    """The whole way from text files to the KPI summary."""
    export = load_order_exports(spark, _write_export(spark, sf_dir, "utf-8", ","))
    imported = workflow.import_orders(export, year=2024)
    return metrics.kpi_summary(imported.orders)


def analyze_import(spark, sf_dir):
    """All results of one import: the lines are written once, in buckets by order, and every result reads them."""
    export = load_order_exports(spark, _write_export(spark, sf_dir, "utf-8", ","))
    imported = workflow.share(workflow.import_orders(export, year=2024))
    done = workflow.analyze(imported.orders, statuses=list(vocab.STATUS_DOMAIN))
    figure = lambda df, result, key, value: df.select(
        F.lit(result).alias("result"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
    parts = [
        figure(done["summary"].withColumn("key", F.lit("orders")), "summary", "key", "total_orders"),
        figure(done["summary"].withColumn("key", F.lit("gmv")), "summary", "key", "total_gmv"),
        figure(done["trend"], "trend", "period", "gmv"),
        figure(done["top_products"], "top_products", "product_id", "total_qty"),
        figure(done["users"], "users", "user_id", "total_spend"),
        figure(done["order_status"], "order_status", "status", "orders"),
        figure(done["high_value_orders"], "high_value_orders", "order_id", "total_amount"),
    ]
    return reduce(DataFrame.unionAll, parts)


# --- results as JSON ----------------------------------------------------------------------------------
def result_payload(spark, sf_dir):
    lines = order_lines(spark, sf_dir)
    trend = metrics.gmv_trend(lines).select("period", "orders", "users")
    summary = metrics.kpi_summary(lines).select("total_orders", "unique_users", "products_sold")
    results = {"trend": trend, "summary": summary, "users": summary, "repurchase": summary}
    return report_payload(derived.mask_users(results, user_missing=True))


QUERIES = {f.__name__: f for f in (
    match_scores, suggest_mapping, unique_column_names, detect_header, load_exports, load_mixed_exports,
    export_files, load_padded_exports, load_same_field_twice, load_multiline_export, load_awkward_names, load_by_kept_lines,
    load_repeated_headers, load_many_layouts, load_dimensions, analyze_import, import_and_summarise, result_payload)}

# --- SQL checks -------------------------------------------------------------------------------------------
_FIELD_ROWS = ", ".join(f"({i}, '{field}')" for i, field in enumerate(vocab.STANDARD_FIELDS))
_ALIAS_ROWS = ", ".join(f"('{field}', '{alias}')" for field, aliases in vocab.FIELD_ALIASES.items() for alias in aliases)
_SCORES = f"""fields(pos, field) AS (VALUES {_FIELD_ROWS}),
aliases AS (SELECT DISTINCT field, {S.name('alias')} AS alias FROM (VALUES {_ALIAS_ROWS}) v(field, alias)),
scored AS (SELECT name, field, CASE
    WHEN bool_or(n = alias) AND n <> '' THEN 100
    WHEN n = '' THEN 0
    WHEN field = 'unit_price' AND contains(n, '金额') AND NOT contains(n, '单价') THEN 0
    WHEN field = 'total_amount' AND (contains(n, '单价') OR contains(n, '价格')) THEN 0
    ELSE max(CASE WHEN length(alias) < 2 THEN 0 WHEN contains(n, alias) THEN 70 + least(length(alias), 20)
      WHEN length(n) >= 3 AND contains(alias, n) THEN 45 + least(length(n), 20) ELSE 0 END) END AS score
  FROM (SELECT name, {S.name('name')} AS n FROM names) CROSS JOIN aliases GROUP BY name, n, field)"""
_EXPORT_SQL = {name: text.replace("STRING", "VARCHAR") for name, text in _EXPORT.items()}
_HEADER_SQL = "[" + ", ".join(_HEADER) + "]"


def _header_case(key: str) -> str:
    return f"CASE {key} % 3 " + " ".join(f"WHEN {i} THEN '{'/'.join(h)}'" for i, h in enumerate(_HEADERS)) + " END"


ORACLE = {
    "match_scores": f"""WITH used AS (SELECT {_NAME} AS name, count(*) AS uses FROM lineitem GROUP BY 1),
names AS (SELECT name FROM used), {_SCORES}
SELECT name, uses, field, CAST(score AS INT) AS score FROM scored JOIN used USING (name)""",
    "suggest_mapping": f"""WITH RECURSIVE used AS (SELECT {_HEADER_SQL} AS names, count(*) AS uses FROM orders GROUP BY 1),
names AS (SELECT DISTINCT unnest(names) AS name FROM used), {_SCORES},
cand AS (SELECT u.names, s.name AS source, s.field, s.score,
    row_number() OVER (PARTITION BY u.names ORDER BY s.score DESC, s.name DESC, s.field DESC) AS r
  FROM (SELECT names, unnest(list_distinct(names)) AS name FROM used) u JOIN scored s USING (name) WHERE s.score >= 50),
steps AS (
  SELECT names, CAST(0 AS BIGINT) AS r, CAST([] AS VARCHAR[]) AS sources, CAST([] AS VARCHAR[]) AS taken, FALSE AS took,
    CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS INT) AS score FROM used
  UNION ALL
  SELECT names, r, CASE WHEN ok THEN list_append(sources, source) ELSE sources END,
    CASE WHEN ok THEN list_append(taken, field) ELSE taken END, ok, source, field, score
  FROM (SELECT s.names, c.r, s.sources, s.taken, c.source, c.field, CAST(c.score AS INT) AS score,
      NOT list_contains(s.sources, c.source) AND NOT list_contains(s.taken, c.field) AS ok
    FROM steps s JOIN cand c ON s.names = c.names AND c.r = s.r + 1))
SELECT array_to_string(names, ',') AS names, uses, field, source, score FROM steps JOIN used USING (names) WHERE took""",
    "unique_column_names": f"""SELECT array_to_string(list_transform(range(1, 6), lambda i:
    CASE WHEN len(list_filter(base[1:i-1], lambda y: y = base[i])) = 0 THEN base[i]
    ELSE base[i] || '_' || CAST(len(list_filter(base[1:i-1], lambda z: z = base[i])) + 1 AS VARCHAR) END), ',') AS names
FROM (SELECT [trim({_HEADER[0]}), '未命名列_2', trim({_HEADER[0]}), trim({_HEADER[2]}), trim({_HEADER[0]})] AS base FROM orders)""",
    "detect_header": f"""SELECT c_custkey AS file, CASE c_custkey % 4 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN ';' ELSE '|' END AS delimiter,
  CAST(c_custkey % 5 + 1 AS INT) AS header_row, CASE WHEN c_custkey % 3 = 2 THEN 0 ELSE 4 END AS matched_fields,
  4 AS width, {_header_case('c_custkey')} AS header FROM customer""",
    "load_exports": "SELECT " + ", ".join(
        f"NULLIF({e}, 'N/A') AS \"{n}\"" for n, e in _EXPORT_SQL.items()) + " FROM lineitem",
    "load_mixed_exports": f"""SELECT {_EXPORT_SQL['交易状态']} AS status, NULLIF({_EXPORT_SQL['备注']}, 'N/A') AS "备注",
  2 * count(*) AS lines, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1, 2""",
    "export_files": """SELECT 'CSV' AS file_type, 'gb18030' AS encoding, '|' AS delimiter, 3 AS header_row, 8 AS columns,
  count(*) AS "rows" FROM lineitem""",
    "load_padded_exports": f"""SELECT {_EXPORT_SQL['交易状态']} AS what, count(*) AS lines, count(DISTINCT l_orderkey) AS orders
FROM lineitem GROUP BY 1
UNION ALL SELECT 'malformed', count(*), 3 FROM lineitem WHERE l_linenumber = 3""",
    "load_same_field_twice": """SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'K' ELSE 'H' END || CAST(l_orderkey AS VARCHAR) AS order_id,
  CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS total_amount FROM lineitem""",
    "load_multiline_export": "SELECT " + ", ".join(
        f"{e.replace('STRING', 'VARCHAR')} AS {n}" for n, e in zip(("order_id", "paid", "remark"), _MULTILINE.values())) + " FROM lineitem",
    "load_awkward_names": "SELECT " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {n}" for n, e in zip(
        ("order_id", "paid", "file", "line", "remark_upper", "remark_lower", "quoted", "cells"), _AWKWARD.values())) + " FROM lineitem",
    "load_by_kept_lines": f"SELECT {_EXPORT_SQL['商家订单编号']} AS order_id, {_EXPORT_SQL['成交件数']} || ',1,2,3' AS paid FROM lineitem",
    "load_repeated_headers": f"""SELECT {_EXPORT_SQL['交易状态']} AS "交易状态", count(*) AS lines FROM lineitem GROUP BY 1""",
    "load_many_layouts": f"""WITH cells AS (SELECT {_EXPORT_SQL['商家订单编号']} AS order_id, {_EXPORT_SQL['成交件数']} AS total_amount,
    '列' || (l_suppkey % {_LAYOUTS}) AS own, 'x' || l_partkey AS value, l_linenumber FROM lineitem)
SELECT order_id, total_amount, own AS name, value FROM cells
UNION ALL SELECT order_id, total_amount, '说明', 'first' FROM cells WHERE l_linenumber = 1""",
    "load_dimensions": """SELECT p_brand AS brand, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
  CAST(sum(l_quantity) AS DOUBLE) AS margin FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    "analyze_import": f"""WITH lines AS MATERIALIZED (SELECT DISTINCT {_EXPORT_SQL['商家订单编号']} AS order_id, {_EXPORT_SQL['买家UID']} AS user_id,
    {_EXPORT_SQL['商品标题']} AS product_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, l_quantity, {_EXPORT_SQL['备注']} AS remark,
    CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'pending' ELSE 'refunded' END AS status,
    CASE WHEN l_linenumber = 1 THEN floor(l_extendedprice) + 0.5 ELSE floor(l_extendedprice) END AS amount FROM lineitem),
totals AS MATERIALIZED (SELECT order_id, CAST(sum(amount) AS DOUBLE) AS total FROM lines GROUP BY 1)
SELECT 'summary' AS result, 'orders' AS key, CAST(count(DISTINCT order_id) AS DOUBLE) AS value FROM lines
UNION ALL SELECT 'summary', 'gmv', CAST(sum(amount) AS DOUBLE) FROM lines
UNION ALL SELECT 'trend', day[1:7], CAST(sum(amount) AS DOUBLE) FROM lines GROUP BY ALL
UNION ALL SELECT 'top_products', product_id, qty FROM (SELECT product_id, CAST(sum(l_quantity) AS DOUBLE) AS qty, sum(amount) AS revenue
  FROM lines GROUP BY 1 ORDER BY revenue DESC, product_id LIMIT 10)
UNION ALL SELECT 'users', user_id, spend FROM (SELECT user_id, CAST(sum(amount) AS DOUBLE) AS spend FROM lines GROUP BY 1 ORDER BY spend DESC, user_id LIMIT 20)
UNION ALL SELECT 'order_status', status, CAST(count(DISTINCT order_id) AS DOUBLE) FROM lines GROUP BY ALL
UNION ALL SELECT 'high_value_orders', order_id, total FROM (SELECT * FROM totals WHERE total > 3 * (SELECT avg(total) FROM totals)
  ORDER BY total DESC, order_id LIMIT 10)""",
    "import_and_summarise": f"""WITH lines AS (SELECT DISTINCT {_EXPORT_SQL['商家订单编号']} AS order_id, {_EXPORT_SQL['买家UID']} AS user_id,
    {_EXPORT_SQL['商品标题']} AS product_id, l_shipdate, l_quantity, l_returnflag, {_EXPORT_SQL['备注']} AS remark,
    CASE WHEN l_linenumber = 1 THEN floor(l_extendedprice) + 0.5 ELSE floor(l_extendedprice) END AS amount FROM lineitem)
SELECT count(DISTINCT order_id) AS total_orders, count(DISTINCT user_id) AS unique_users,
  count(DISTINCT product_id) AS products_sold, CAST(sum(amount) AS DOUBLE) AS total_gmv,
  CAST(sum(amount) AS DOUBLE) / NULLIF(count(DISTINCT order_id), 0) AS avg_order_value
FROM lines WHERE l_returnflag = 'A'""",
    "result_payload": f"""WITH {ORDER_LINES_SQL},
done AS (SELECT * FROM lines WHERE status_norm = 'completed')
SELECT 'trend' AS section, CAST(json_object('period', period, 'orders', orders, 'users', users) AS VARCHAR) AS record
FROM (SELECT substring(CAST(order_date AS VARCHAR), 1, 7) AS period, count(DISTINCT order_id) AS orders,
  count(DISTINCT user_id) AS users FROM done WHERE order_date IS NOT NULL GROUP BY 1)
UNION ALL SELECT 'summary', CAST(json_object('total_orders', count(DISTINCT order_id), 'unique_users', NULL,
  'products_sold', count(DISTINCT product_id)) AS VARCHAR) FROM done
UNION ALL SELECT section, CAST(json_object('message', '原数据缺乏用户维度，无法分析') AS VARCHAR)
FROM (VALUES ('users'), ('repurchase')) v(section)""",
}
