"""Text functions, cleaning, completion and checks over a defective export."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from orderlens import functions as X, vocab
from orderlens.operators.columns import apply_mapping, coalesce_same_named, fill_after_sales_status
from orderlens.operators.staging import DENSE, stage
from orderlens.plans import checks, clean, prepare

from . import sqltext as S
from .raw import RAW_COLUMNS, RAW_SQL, raw_lines
from .views import table

YEAR = 2024  # completes dates that name only month and day
_ISO = "yyyy-MM-dd HH:mm:ss"


def _users(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("U"), F.col("s_suppkey").cast("string")).alias("user_id"),
        F.col("n_name").alias("city"))


def _products(spark, sf_dir):
    price = F.concat(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("元"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("product_id"),
        F.when(F.col("p_partkey") % 5 != 0, price).alias("price"))


# --- text functions -------------------------------------------------------------------------
def parse_number(spark, sf_dir):
    raw = raw_lines(spark, sf_dir, ["quantity", "unit_price", "total_amount"])
    return raw.select("total_amount", *[X.parse_number(F.col(c)).alias(f"{c}_value") for c in raw.columns])


def lenient_number(spark, sf_dir):
    raw = raw_lines(spark, sf_dir, ["quantity", "total_amount"])
    return raw.select("quantity", "total_amount", X.lenient_number(F.col("quantity"), 1).alias("quantity_value"),
                      X.lenient_number(F.col("total_amount"), 0).alias("amount_value"))


def parse_datetime(spark, sf_dir):
    raw = raw_lines(spark, sf_dir, ["order_date"])
    return raw.select("order_date", F.date_format(X.parse_datetime(F.col("order_date"), year=YEAR), _ISO).alias("parsed"))


def normalize_status(spark, sf_dir):
    return raw_lines(spark, sf_dir, ["status"]).select(
        "status", X.normalize_status(F.col("status")).alias("status_norm"))


def normalize_name(spark, sf_dir):
    return raw_lines(spark, sf_dir, ["status", "category"]).select(
        X.normalize_name(F.col("status")).alias("status_name"),
        X.normalize_name(F.col("category")).alias("category_name"))


def main_category(spark, sf_dir):
    return raw_lines(spark, sf_dir, ["category"]).select(
        "category", X.main_category(F.col("category")).alias("main"))


def blank_mask(spark, sf_dir):
    columns = ["order_id", "user_id", "product_id", "city", "category"]
    raw = raw_lines(spark, sf_dir, columns)
    return raw.agg(*[F.count_if(X.is_blank(F.col(c))).alias(c) for c in columns])


def looks_numeric(spark, sf_dir):
    columns = ["quantity", "unit_price", "total_amount", "order_date", "status"]
    raw = raw_lines(spark, sf_dir, columns)
    return raw.agg(*[F.count_if(X.looks_numeric(F.col(c))).alias(c) for c in columns])


def display_text(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice").cast("decimal(12,2)"))
    return lines.select(
        X.money_text(value).alias("money"),
        X.percent_text(F.when(F.col("l_linenumber") != 2, F.col("l_discount") * 128)).alias("percent"),
        X.safe_int(F.when(F.col("l_linenumber") != 4, F.col("l_quantity"))).alias("whole"),
        X.safe_float(F.when(F.col("l_linenumber") != 5, F.col("l_tax"))).alias("number"),
        X.safe_ratio(F.col("l_quantity"), F.col("l_linenumber") - 1).alias("ratio"))


# --- cleaning ---------------------------------------------------------------------------------
def _valued(spark, sf_dir):
    return clean.standardise_values(raw_lines(spark, sf_dir), _users(spark, sf_dir))


def _deduplicated(spark, sf_dir):
    return clean.remove_duplicates(_valued(spark, sf_dir))


def _dated(spark, sf_dir):
    return clean.parse_dates(clean.normalise_statuses(_deduplicated(spark, sf_dir)), YEAR)


def _amounts(spark, sf_dir):
    return clean.fill_amounts(clean.fill_prices(_dated(spark, sf_dir), _products(spark, sf_dir)))


def _cleaned(spark, sf_dir):
    return clean.clean_orders(
        raw_lines(spark, sf_dir), _products(spark, sf_dir), _users(spark, sf_dir), year=YEAR)


def clean_defaults(spark, sf_dir):
    return _valued(spark, sf_dir).select(
        "order_id", "quantity", "unit_price", "total_amount", "is_anomaly", "status", "payment_method", "category")


def clean_fill_city(spark, sf_dir):
    return _valued(spark, sf_dir).groupBy("user_id", "city").agg(F.count(F.lit(1)).alias("rows"))


def clean_dedup(spark, sf_dir):
    return _deduplicated(spark, sf_dir).select(
        "order_id", "user_id", "product_id", "order_date", "quantity", "unit_price", "total_amount",
        "city", "remark", "is_anomaly", F.col(clean.COPIES).alias("copies"))


def clean_dates(spark, sf_dir):
    kept = _dated(spark, sf_dir).filter(F.col(clean.KEPT))
    return kept.select("order_id", "product_id", F.date_format("order_date", _ISO).alias("order_date"), "status_norm")


def clean_fill_price(spark, sf_dir):
    priced = clean.fill_prices(_dated(spark, sf_dir), _products(spark, sf_dir)).filter(F.col(clean.KEPT))
    return priced.select("order_id", "product_id", "quantity", "unit_price")


def clean_fill_amount(spark, sf_dir):
    return _amounts(spark, sf_dir).filter(F.col(clean.KEPT)).select(
        "order_id", "product_id", "quantity", "unit_price", "total_amount", "is_anomaly")


def clean_product_ids(spark, sf_dir):
    return clean.fill_product_ids(_deduplicated(spark, sf_dir)).select("order_id", "product_id", "product_name")


_ORDER = ["remark", "user_id", "product_id", "product_name", "order_date", "quantity", "unit_price",
          "total_amount", "payment_method", "status", "city", "category"]


def clean_order_ids(spark, sf_dir):
    numbered = clean.assign_order_ids(stage(_dated(spark, sf_dir), "dated", DENSE), _ORDER).filter(F.col(clean.KEPT))
    return numbered.select("order_id", "user_id", "product_id", "quantity", "total_amount", "remark")


def clean_anomaly(spark, sf_dir):
    flagged = clean.flag_anomalies(stage(_amounts(spark, sf_dir), "amounts", DENSE).filter(F.col(clean.KEPT)))
    return flagged.select("order_id", "product_id", "quantity", "unit_price", "total_amount", "is_anomaly")


def clean_lines(spark, sf_dir):
    lines = _cleaned(spark, sf_dir).lines
    return lines.withColumns({
        "order_date": F.date_format("order_date", _ISO),
        "order_id": F.when(F.col("order_id").startswith("ROW"), F.lit("ROW")).otherwise(F.col("order_id")),
    })


def clean_report(spark, sf_dir):
    return _cleaned(spark, sf_dir).report


# --- completion and checks ----------------------------------------------------------------------
def prepare_defaults(spark, sf_dir):
    raw = raw_lines(spark, sf_dir, ["order_id", "quantity", "total_amount", "order_date", "status"])
    done = prepare.complete_status(prepare.complete_columns(raw))
    return done.select("order_id", "quantity", "total_amount", "status_norm", "user_id", "city", "category",
                       "user_level", "unit_price", "is_anomaly", F.col("order_date").isNotNull().alias("dated"))


def prepare_zero_amounts(spark, sf_dir):
    raw = raw_lines(spark, sf_dir, ["order_id", "quantity", "unit_price"])
    done = prepare.prepare_orders(raw.withColumn("total_amount", F.lit("0")))
    return done.select("order_id", "quantity", "unit_price", "total_amount")


def prepare_dates(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    dated = lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_shipdate")).alias("order_date"),
        F.lit(2).alias("total_amount"),
        F.when(F.col("l_linenumber") > 2, F.lit(" Refunded ")).otherwise(F.lit("odd")).alias("status_norm"),
        F.when(F.col("l_linenumber") == 1, F.lit("已取消")).otherwise(F.lit("已付款")).alias("status"))
    done = prepare.prepare_orders(dated)
    return done.select("order_id", F.to_date("order_date").alias("order_date"), "status_norm", "total_amount")


def missing_dimensions(spark, sf_dir):
    raw = raw_lines(spark, sf_dir, ["user_id", "product_id", "quantity", "total_amount"])
    blank_users = raw.withColumn("user_id", F.when(F.col("quantity") == "7", F.col("user_id")))
    return checks.missing_dimensions(blank_users.drop("quantity"))


def validate_orders(spark, sf_dir):
    return checks.validate_orders(raw_lines(spark, sf_dir, ["order_id", "quantity", "city"]))


def apply_mapping_after_sales(spark, sf_dir):
    raw = raw_lines(spark, sf_dir, ["order_id", "status", "remark", "total_amount"]).toDF(
        "订单号", "售后状态", "备注", "实付金额")
    mapping = {"order_id": "订单号", "status": "售后状态", "total_amount": "实付金额", "city": "城市"}
    return fill_after_sales_status(apply_mapping(raw, mapping), mapping)


def coalesce_columns(spark, sf_dir):
    raw = raw_lines(spark, sf_dir, ["order_id", "city", "category", "payment_method"])
    return coalesce_same_named(raw.toDF("order_id", "label", "label", "label"))


QUERIES = {f.__name__: f for f in (
    parse_number, lenient_number, parse_datetime, normalize_status, normalize_name, main_category,
    blank_mask, looks_numeric, display_text, clean_defaults, clean_fill_city, clean_dedup, clean_dates,
    clean_fill_price, clean_fill_amount, clean_product_ids, clean_order_ids, clean_anomaly, clean_lines,
    clean_report, prepare_defaults, prepare_zero_amounts, prepare_dates, missing_dimensions,
    validate_orders, apply_mapping_after_sales, coalesce_columns,
)}

# --- SQL checks -----------------------------------------------------------------------------------
_KEYS = [c for c in RAW_COLUMNS if c != "is_anomaly"]
_STATUS = S.strip("COALESCE(status, '未知')")
_ID = "CASE WHEN {} THEN product_name ELSE product_id END".format(S.blank("product_id"))

_CHAIN = ["""dims_users AS (SELECT 'U' || CAST(s_suppkey AS VARCHAR) AS user_id, n_name AS city
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
          """dims_products AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS product_id,
  CASE WHEN p_partkey % 5 <> 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) END AS price FROM part)""",
          RAW_SQL]


def _chain_sql() -> list[str]:
    valued = f"""valued AS (SELECT r.order_id, r.user_id, r.product_id, r.product_name, r.order_date,
  COALESCE({S.number('r.quantity')}, 1.0) AS quantity, {S.number('r.unit_price')} AS unit_price,
  {S.number('r.total_amount')} AS total_amount,
  CASE WHEN {S.blank('r.payment_method')} THEN '未知' ELSE r.payment_method END AS payment_method,
  {S.strip("COALESCE(r.status, '未知')")} AS status,
  CASE WHEN {S.blank('r.city')} THEN CASE WHEN {S.blank('u.city')} THEN '未知' ELSE u.city END ELSE r.city END AS city,
  {S.category('r.category')} AS category, COALESCE({S.number('r.is_anomaly')}, 0.0) AS is_anomaly, r.remark,
  CAST(r.quantity IS NOT NULL AND {S.number('r.quantity')} IS NULL AS INT) AS n_bad_quantity,
  CAST(r.unit_price IS NOT NULL AND {S.number('r.unit_price')} IS NULL AS INT) AS n_bad_price,
  CAST(r.total_amount IS NOT NULL AND {S.number('r.total_amount')} IS NULL AS INT) AS n_bad_amount,
  CAST({S.number('r.quantity')} IS NULL AS INT) AS n_quantity,
  CAST({S.blank('r.payment_method')} AS INT) AS n_payment, CAST({S.blank('r.city')} AS INT) AS n_city,
  CAST({S.strip("COALESCE(r.category, '')")} <> {S.category('r.category')} AS INT) AS n_category
FROM raw r LEFT JOIN dims_users u ON r.user_id = u.user_id)"""
    keys = ", ".join(_KEYS)
    sums = ", ".join(f"sum({c}) AS {c}" for c in (
        "n_bad_quantity", "n_bad_price", "n_bad_amount", "n_quantity", "n_payment", "n_city", "n_category"))
    unique = f"""uniq AS MATERIALIZED (SELECT {keys}, min(is_anomaly) AS is_anomaly, count(*) AS copies, {sums}
FROM valued GROUP BY {keys})"""
    dated = f"""named AS (SELECT *, {S.name('status')} AS status_name FROM uniq),
dated AS MATERIALIZED (SELECT * EXCLUDE (order_date), {S.normalised_status('status_name')} AS status_norm,
  {S.timestamp('order_date', YEAR)} AS order_date FROM named)"""
    priced = """priced AS (SELECT d.* REPLACE (COALESCE(d.unit_price, p.price) AS unit_price),
  CAST(d.unit_price IS NULL AND p.price IS NOT NULL AS INT) AS n_priced
FROM dated d LEFT JOIN dims_products p ON d.product_id = p.product_id WHERE d.order_date IS NOT NULL)"""
    amounts = f"""amounts AS MATERIALIZED (SELECT * REPLACE (
  COALESCE(total_amount, quantity * unit_price, 0.0) AS total_amount,
  CASE WHEN COALESCE(total_amount, quantity * unit_price) IS NULL THEN 1.0 ELSE is_anomaly END AS is_anomaly),
  CAST(total_amount IS NULL AND quantity * unit_price IS NOT NULL AS INT) AS n_computed,
  CAST(COALESCE(total_amount, quantity * unit_price) IS NULL AS INT) AS n_unresolved FROM priced)"""
    # The threshold comes from windows over the lines themselves, so that the step is read once.
    positive = "FILTER (WHERE quantity > 0) OVER ()"
    limits = f"""limited AS (SELECT *, COALESCE(CASE WHEN count(*) {positive} >= 2 AND stddev_samp(quantity) {positive} > 0
  THEN greatest(CAST(round_even(avg(quantity) {positive} + 3 * stddev_samp(quantity) {positive}, 0) AS DOUBLE), 10.0) END, 20.0) AS threshold
FROM amounts)"""
    flagged = """abnormal AS (SELECT *, COALESCE(quantity <= 0 OR quantity > threshold
  OR COALESCE(unit_price < 0, FALSE) OR total_amount < 0, FALSE) AS odd FROM limited),
flagged AS (SELECT * REPLACE (CASE WHEN odd THEN 1 ELSE CAST(trunc(is_anomaly) AS INT) END AS is_anomaly) FROM abnormal)"""
    return [valued, unique, dated, priced, amounts, limits, flagged]


_STEPS = _CHAIN + _chain_sql()


def _with(body: str) -> str:
    return "WITH " + ",\n".join(_STEPS) + "\n" + body


def _raw(body: str) -> str:
    return f"WITH {RAW_SQL}\n{body}"



_ORDER_SQL = ", ".join(f"{c} ASC NULLS FIRST" for c in _ORDER)

_REPORT = f"""counts AS (SELECT (SELECT sum(n_bad_quantity) FROM valued) AS c1, (SELECT sum(n_bad_price) FROM valued) AS c2,
  (SELECT sum(n_bad_amount) FROM valued) AS c3, (SELECT sum(n_quantity) FROM valued) AS c4,
  (SELECT sum(copies) FROM dated WHERE status_norm = 'unknown') AS c5, (SELECT sum(n_payment) FROM valued) AS c6,
  (SELECT sum(n_city) FROM valued) AS c7, (SELECT sum(n_category) FROM valued) AS c8,
  (SELECT sum(copies - 1) FROM uniq) AS c9, (SELECT count(*) FROM dated WHERE order_date IS NULL) AS c10,
  (SELECT sum(n_priced) FROM priced) AS c11, (SELECT sum(n_computed) FROM amounts) AS c12,
  (SELECT sum(n_unresolved) FROM amounts) AS c13, (SELECT count(*) FROM amounts WHERE {S.blank('order_id')}) AS c14,
  (SELECT count(*) FROM amounts) AS c15,
  (SELECT count(DISTINCT order_id) FROM amounts WHERE NOT {S.blank('order_id')})
    + (SELECT count(*) FROM amounts WHERE {S.blank('order_id')}) AS c16,
  (SELECT count(*) FROM (SELECT order_id FROM amounts WHERE NOT {S.blank('order_id')} GROUP BY order_id
     HAVING count(DISTINCT status_norm) > 1)) AS c17, (SELECT count(*) FROM abnormal WHERE odd) AS c18)"""
_RULE_NAMES = [(step, rule) for step, rule in clean.RULES] + [
    (8, "order_lines"), (8, "distinct_orders"), (8, "mixed_status_orders"), (9, "anomalies_flagged")]
_REPORT_ROWS = " UNION ALL ".join(
    f"SELECT {step} AS step, '{rule}' AS rule, CAST(c{i} AS BIGINT) AS affected_rows FROM counts WHERE c{i} > 0"
    for i, (step, rule) in enumerate(_RULE_NAMES, start=1))

_NUMERIC_RE = vocab.NUMERIC_CELL.replace("\\s", r"[\s\x{3000}]")

ORACLE = {
    "parse_number": _raw("SELECT total_amount, " + ", ".join(
        f"{S.number(c)} AS {c}_value" for c in ("quantity", "unit_price", "total_amount")) + " FROM raw"),
    "lenient_number": _raw(
        f"SELECT quantity, total_amount, {S.lenient('quantity', '1.0')} AS quantity_value, "
        f"{S.lenient('total_amount', '0.0')} AS amount_value FROM raw"),
    "parse_datetime": _raw(f"SELECT order_date, {S.iso(S.timestamp('order_date', YEAR))} AS parsed FROM raw"),
    "normalize_status": _raw(
        f"SELECT status, {S.normalised_status('n')} AS status_norm FROM (SELECT status, {S.name('status')} AS n FROM raw)"),
    "normalize_name": _raw(f"SELECT {S.name('status')} AS status_name, {S.name('category')} AS category_name FROM raw"),
    "main_category": _raw(f"SELECT category, {S.category('category')} AS main FROM raw"),
    "blank_mask": _raw("SELECT " + ", ".join(
        f"count(*) FILTER (WHERE {S.blank(c)}) AS {c}"
        for c in ("order_id", "user_id", "product_id", "city", "category")) + " FROM raw"),
    "looks_numeric": _raw("SELECT " + ", ".join(
        f"count(*) FILTER (WHERE regexp_matches({S.strip(c)}, '{_NUMERIC_RE}')) AS {c}"
        for c in ("quantity", "unit_price", "total_amount", "order_date", "status")) + " FROM raw"),
    "display_text": """SELECT format('¥{:,.2f}', CASE WHEN l_linenumber <> 3 THEN l_extendedprice ELSE 0.0 END) AS money,
  CASE WHEN l_linenumber <> 2 THEN format('{:.1f}%', l_discount * 128) ELSE '—' END AS percent,
  CAST(CASE WHEN l_linenumber <> 4 THEN l_quantity ELSE 0 END AS BIGINT) AS whole,
  CASE WHEN l_linenumber <> 5 THEN l_tax ELSE 0.0 END AS number,
  l_quantity / NULLIF(l_linenumber - 1, 0) AS ratio FROM lineitem""",
    "clean_defaults": _with(
        "SELECT order_id, quantity, unit_price, total_amount, is_anomaly, status, payment_method, category FROM valued"),
    "clean_fill_city": _with('SELECT user_id, city, count(*) AS "rows" FROM valued GROUP BY 1, 2'),
    "clean_dedup": _with(
        "SELECT order_id, user_id, product_id, order_date, quantity, unit_price, total_amount, city, remark, is_anomaly, copies FROM uniq"),
    "clean_dates": _with(
        f"SELECT order_id, product_id, {S.iso('order_date')} AS order_date, status_norm FROM dated WHERE order_date IS NOT NULL"),
    "clean_fill_price": _with("SELECT order_id, product_id, quantity, unit_price FROM priced"),
    "clean_fill_amount": _with(
        "SELECT order_id, product_id, quantity, unit_price, total_amount, is_anomaly FROM amounts"),
    "clean_product_ids": _with(f"SELECT order_id, {_ID} AS product_id, product_name FROM uniq"),
    "clean_order_ids": _with(f"""SELECT CASE WHEN {S.blank('order_id')} THEN 'ROW' || lpad(CAST(row_number() OVER (
    PARTITION BY {S.blank('order_id')} ORDER BY {_ORDER_SQL}) AS VARCHAR), 7, '0') ELSE order_id END AS order_id,
  user_id, product_id, quantity, total_amount, remark FROM dated WHERE order_date IS NOT NULL"""),
    "clean_anomaly": _with(
        "SELECT order_id, product_id, quantity, unit_price, total_amount, is_anomaly FROM flagged"),
    "clean_lines": _with(f"""SELECT CASE WHEN {S.blank('order_id')} THEN 'ROW' ELSE order_id END AS order_id, user_id,
  {_ID} AS product_id, product_name, {S.iso('order_date')} AS order_date, quantity, unit_price, total_amount,
  payment_method, status, city, category, remark, is_anomaly, status_norm FROM flagged"""),
    "clean_report": "WITH " + ",\n".join(_STEPS + [_REPORT]) + "\n" + _REPORT_ROWS,
    "prepare_defaults": _raw(f"""SELECT order_id, {S.lenient('quantity', '1.0')} AS quantity,
  {S.lenient('total_amount', '0.0')} AS total_amount, {S.normalised_status('n')} AS status_norm, 'unknown' AS user_id,
  '未知' AS city, '未分类' AS category, '未知' AS user_level, 0.0 AS unit_price, 0 AS is_anomaly,
  NOT regexp_matches({S.strip('order_date')}, '^(\\d{{5}}(\\.5)?|\\d{{10}}|\\d{{13}})$')
    AND {S.timestamp('order_date', datetime.date.today().year)} IS NOT NULL AS dated
FROM (SELECT *, {S.name('status')} AS n FROM raw)"""),
    "prepare_zero_amounts": _raw(f"""SELECT order_id, {S.lenient('quantity', '1.0')} AS quantity,
  {S.lenient('unit_price', '0.0')} AS unit_price,
  {S.lenient('quantity', '1.0')} * {S.lenient('unit_price', '0.0')} AS total_amount FROM raw"""),
    "prepare_dates": """SELECT l_orderkey AS order_id, CAST(l_shipdate AS DATE) AS order_date,
  CASE WHEN l_linenumber > 2 THEN 'refunded' WHEN l_linenumber = 1 THEN 'cancelled' ELSE 'completed' END AS status_norm,
  2 AS total_amount FROM lineitem WHERE l_orderkey % 5 <> 0""",
    "missing_dimensions": _raw(f"""SELECT dimension FROM (
  SELECT unnest([CASE WHEN avg(CAST(CASE WHEN quantity = '7' THEN {S.blank('user_id')} ELSE TRUE END AS INT)) > 0.9
      THEN 'user_id（用户维度）' END,
    CASE WHEN avg(CAST({S.blank('product_id')} AS INT)) > 0.9 THEN 'product_id/product_name（商品维度）' END,
    'order_date（时间维度）',
    CASE WHEN avg(CAST({S.lenient('total_amount', '0.0')} > 0 AS INT)) < 0.1 THEN 'total_amount（金额维度）' END,
    'category（品类维度）']) AS dimension FROM raw) WHERE dimension IS NOT NULL"""),
    "validate_orders": _raw("""SELECT level, code FROM (VALUES ('warning', 'no_order_date'), ('error', 'no_amount'),
  ('warning', 'no_status'), ('warning', 'no_user_id'), ('warning', 'no_product')) v(level, code)
WHERE EXISTS (SELECT 1 FROM raw)"""),
    "apply_mapping_after_sales": _raw("""SELECT order_id, CASE WHEN status IS NULL THEN '已完成' ELSE status END AS status,
  remark AS "备注", total_amount FROM raw"""),
    "coalesce_columns": _raw("SELECT order_id, COALESCE(city, category, payment_method) AS label FROM raw"),
}
