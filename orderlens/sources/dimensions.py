"""Product and user dimensions, and the views that SQL users query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import vocab
from ..operators.joins import ROW

PRODUCT_SCHEMA = ("product_id string, product_name string, category string, brand string, "
                  "price double, cost double")
USER_SCHEMA = ("user_id string, username string, gender string, age int, city string, "
               "user_level string, registration_date date")
_PRODUCT_DEFAULTS = {
    "product_id": (vocab.UNKNOWN_ID, "string"),
    "product_name": (vocab.UNKNOWN_ID, "string"),
    "category": (vocab.UNCATEGORISED, "string"),
    "cost": (None, "double"),
}


def _read(spark: SparkSession, paths: str | list[str], schema: str, positions: bool) -> DataFrame:
    rows = spark.read.option("header", True).schema(schema).csv(paths)
    if not positions:
        return rows
    # Files by path, parts of a file by offset, rows by their order in the part: no other split or number of tasks
    # changes which of two rows comes first.
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))
    return rows.select(*rows.columns, place.alias(ROW))


def load_products(spark: SparkSession, paths: str | list[str], positions: bool = False) -> DataFrame:
    """Products from CSV files with a header; ``positions`` adds where each row stands, so that "first entry" has one meaning."""
    return _read(spark, paths, PRODUCT_SCHEMA, positions)


def load_users(spark: SparkSession, paths: str | list[str], positions: bool = False) -> DataFrame:
    """Users, as ``load_products``."""
    return _read(spark, paths, USER_SCHEMA, positions)


def complete_products(products: DataFrame) -> DataFrame:
    """Add the product columns that the metrics need, with their defaults."""
    missing = {name: F.lit(value).cast(kind) for name, (value, kind) in _PRODUCT_DEFAULTS.items()
               if name not in products.columns}
    return products.withColumns(missing) if missing else products


def no_products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PRODUCT_SCHEMA)


def no_users(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "user_id string, user_level string, city string")


def register_views(orders: DataFrame, products: DataFrame | None = None,
                   users: DataFrame | None = None) -> None:
    """Make ``orders``, ``products`` and ``users`` available to SQL queries."""
    spark = orders.sparkSession
    orders.createOrReplaceTempView("orders")
    complete_products(no_products(spark) if products is None else products).drop(ROW).createOrReplaceTempView("products")
    (no_users(spark) if users is None else users).drop(ROW).createOrReplaceTempView("users")
