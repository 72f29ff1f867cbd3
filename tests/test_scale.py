"""Properties that keep the plans sound on large and skewed tables."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from orderlens.operators.joins import join_dimension, measured_bytes
from orderlens.operators.numbering import number_rows
from orderlens.operators.staging import cluster, shared_folder
from orderlens.plans import clean, metrics, prepare
from orderlens.sources.exports import leading_lines
from workload.raw import raw_lines

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_shared_folder_is_the_one_of_the_session(spark):
    assert shared_folder(spark) in (spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir())


def facts(spark, rows=6000):
    """One key holds a third of the rows, another third has no key at all."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 50))
    return spark.range(0, rows, numPartitions=6).select(key.alias("key"), F.col("id").alias("value"))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_large_dimension_join_gives_the_same_rows(spark, how):
    dimension = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), ("k7", 4)], "key string, extra int")
    small = join_dimension(facts(spark), dimension, "key", how)
    large = join_dimension(facts(spark), dimension, "key", how, broadcast_bytes=0, salts=8)
    assert "BroadcastHashJoin" in plan_of(small)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.select(small.columns).collect()))


@pytest.mark.parametrize("salts", [1, 32])
def test_large_dimension_is_never_broadcast(spark, tmp_path, salts):
    """Its file is small enough for the planner to broadcast it, repeats and all."""
    path = str(tmp_path / "dimension")
    spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, extra int").write.parquet(path)
    dimension = spark.read.parquet(path)
    joined = join_dimension(facts(spark), dimension, "key", broadcast_bytes=0, salts=salts)
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(str, joined.collect())) == sorted(map(str, join_dimension(facts(spark), dimension, "key").select(joined.columns).collect()))


def test_hot_key_of_a_large_dimension_join_is_spread(spark):
    dimension = spark.createDataFrame([("hot", 1)], "key string, extra int")
    # Keep the sort-merge join that a large dimension would have.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = join_dimension(facts(spark), dimension, "key", broadcast_bytes=0, salts=64)
        assert "SortMergeJoin" in plan_of(joined)
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in sizes) == 6000 and max(r["count"] for r in sizes) < 6000 / 3


def test_measured_bytes_covers_texts_and_arrays(spark):
    df = spark.createDataFrame([("x" * 1000, ["y" * 1000] * 3)], "a string, b array<string>")
    assert measured_bytes(df) > 4000


def test_numbers_are_consecutive_over_many_partitions(spark):
    df = spark.range(0, 20000, numPartitions=16).select(
        F.pmod(F.xxhash64("id"), F.lit(5000)).alias("k"), F.col("id").alias("v"))
    numbered = number_rows(df, ["k", "v"], "n")
    rows = sorted(numbered.collect(), key=lambda r: r["n"])
    assert [r["n"] for r in rows] == list(range(1, 20001))
    assert [(r["k"], r["v"]) for r in rows] == sorted((r["k"], r["v"]) for r in rows)
    assert number_rows(df.limit(0), ["k"], "n").count() == 0


def test_copies_collapse_before_the_shuffle(spark):
    """A third of all rows are copies of one line."""
    raw = spark.range(0, 9000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("order_id"),
        F.lit("5").alias("total_amount"), F.col("id").alias(clean.ROW))
    unique = clean.remove_duplicates(clean.standardise_values(raw))
    assert plan_of(unique).count("HashAggregate") == 2 and "SortAggregate" not in plan_of(unique)
    assert unique.count() == 6001
    same = unique.filter("order_id = 'same'").first()
    assert same[clean.COPIES] == 3000 and same[clean.ROW] == 0


def test_existence_tests_read_only_until_the_first_hit(spark):
    orders = spark.range(0, 1000, numPartitions=50).select(
        F.col("id").cast("string").alias("order_id"), F.lit(1.0).alias("total_amount"), F.lit(None).cast("timestamp_ntz").alias("order_date"))
    plan = plan_of(prepare.prepare_orders(orders))
    assert "Join" not in plan and "Subquery" in plan and "Limit" in plan


def test_header_search_limits_rows_before_the_shuffle(spark):
    lines = spark.range(1000).selectExpr("concat('f', id % 3) AS file", "id AS line", "0 AS block", "'x' AS text", "true AS filled")
    found = leading_lines(lines)
    assert "WindowGroupLimit" in plan_of(found)
    assert found.count() == 90


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "orders")
    spark.sql("SELECT 'A' AS order_id, 'u' AS user_id, 'p' AS product_id, 1.0D AS total_amount, 'completed' AS status_norm, "
              "0 AS is_anomaly, 'x' AS unused").write.parquet(path)
    plan = plan_of(metrics.kpi_summary(spark.read.parquet(path)))
    assert "In(status_norm" in plan or "EqualTo(status_norm" in plan
    assert "unused" not in plan and "is_anomaly" not in plan


METRICS = __import__("workload.metrics").metrics.QUERIES


@pytest.mark.parametrize("name", sorted(METRICS))
def test_metric_plans(spark, name):
    plan = plan_of(METRICS[name](spark, SF_DIR))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "Window ["):
        assert unwanted not in plan


def test_lines_in_buckets_by_order_are_grouped_without_a_shuffle(spark):
    orders = spark.range(500).select(
        (F.col("id") % 60).cast("string").alias("order_id"), F.lit("u").alias("user_id"), F.lit("completed").alias("status_norm"),
        F.lit(None).cast("timestamp_ntz").alias("order_date"), F.lit(1.0).alias("quantity"), F.col("id").cast("double").alias("total_amount"),
        F.lit(0).alias("is_anomaly"))
    shared = cluster(orders, "order_id", "test", 4)
    assert sorted(map(str, shared.collect())) == sorted(map(str, orders.collect()))
    per_order = shared.groupBy("order_id").agg(F.sum("total_amount"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in per_order
    plan = metrics.high_value_orders(shared)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(order_id" not in plan and plan.count("FileScan parquet") == 1
    assert sorted(map(str, metrics.high_value_orders(shared).collect())) == sorted(map(str, metrics.high_value_orders(orders).collect()))


def test_raw_lines_are_made_by_methods_the_jvm_compiles(spark):
    """The JVM never compiles a method of more than 8000 bytes; sessions without the recommended limit generate larger ones."""
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = raw_lines(spark, SF_DIR)._jdf.queryExecution().executedPlan()
        code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenString(plan)
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
