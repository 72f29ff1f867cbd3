"""Consecutive numbers over a distributed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .staging import DENSE, stage

_POSITION_BITS = 33  # the low bits of monotonically_increasing_id hold the row position


def number_rows(df: DataFrame, order_by: Sequence[str], name: str) -> DataFrame:
    """Add ``name`` = 1, 2, 3, ... in the order of ``order_by``.

    The rows are split into ordered ranges, and each task counts within its own range. The
    positions are written with the rows, so a rerun cannot renumber them. Every row then adds
    the number of rows in earlier ranges: a table with one row per shuffle partition.
    """
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    staged = stage(ordered.withColumn("_slot", F.monotonically_increasing_id()), "numbered", DENSE)
    placed = staged.select(
        *df.columns,
        F.shiftright("_slot", _POSITION_BITS).alias("_range"),
        F.col("_slot").bitwiseAND((1 << _POSITION_BITS) - 1).alias("_position"),
    )
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    # Bounded by spark.sql.shuffle.partitions rows of two numbers, whatever the table holds.
    return (
        placed.join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_before") + F.col("_position") + 1)
        .select(*df.columns, name)
    )
