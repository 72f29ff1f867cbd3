"""Order lines over the given tables, in Spark and as an SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlens.functions import normalize_status


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str, users: bool = False) -> DataFrame:
    """Order lines with typed amounts; ``users`` adds level and city of the customer.

    Customers join the orders before the lines do, so the widest table is shuffled once.
    """
    heads = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("order_date"),
        "o_orderstatus", "o_orderpriority",
    )
    extra = []
    if users:
        customer = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("user_level"), "c_nationkey"
        )
        nation = table(spark, sf_dir, "nation").select(
            F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city")
        )
        heads = heads.join(customer.join(nation, "c_nationkey", "left"), "user_id", "left")
        extra = ["user_level", "city"]
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"
    )
    status = (
        F.when(F.col("o_orderstatus") == "F", F.lit("交易成功"))
        .when(F.col("o_orderstatus") == "O", F.lit("待发货"))
        .otherwise(F.lit("退款中"))
    )
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    quantity = F.col("l_quantity").cast("bigint")
    return lines.join(heads, order == F.col("o_orderkey"), "left").select(
        order.alias("order_id"),
        part.alias("product_id"),
        "user_id",
        "order_date",
        F.when(part % 3 == 0, F.lit("")).when(
            part % 3 == 2, F.concat(F.lit("item "), part.cast("string"))).alias("product_name"),
        F.when(order % 7 == 1, F.lit("")).when(
            order % 7 != 0, F.col("o_orderpriority")).alias("category"),
        quantity.alias("quantity"),
        (price * (1 - discount)).alias("total_amount"),
        status.alias("status"),
        normalize_status(status).alias("status_norm"),
        F.when(quantity >= 49, 1).otherwise(0).alias("is_anomaly"),
        *extra,
    )


ORDER_LINES_SQL = """lines AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, o_custkey AS user_id,
         o_orderdate AS order_date,
         CASE WHEN l_partkey % 3 = 0 THEN ''
              WHEN l_partkey % 3 = 2 THEN 'item ' || CAST(l_partkey AS VARCHAR) END AS product_name,
         CASE WHEN l_orderkey % 7 = 1 THEN ''
              WHEN l_orderkey % 7 <> 0 THEN o_orderpriority END AS category,
         CAST(l_quantity AS BIGINT) AS quantity,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS total_amount,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending'
              ELSE 'refunded' END AS status_norm,
         CASE WHEN l_quantity >= 49 THEN 1 ELSE 0 END AS is_anomaly,
         c_mktsegment AS user_level, n_name AS city
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
)"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("cost"),
    )


PRODUCTS_SQL = """products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
         CAST(p_retailprice AS DECIMAL(12,2)) AS cost
  FROM part
)"""
