"""A global order over a distributed table: row numbers, running totals, last rows of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from orderlens.operators.staging import stage

_BITS = 33  # the low bits of monotonically_increasing_id hold the row position in its task


def number(df: DataFrame, order: Sequence[str], *, totals: Sequence[str] = (), group: str | None = None) -> DataFrame:
    """Add ``_row`` (from 0), the running total ``_to_<c>`` of every column in ``totals`` (the row
    included), and with ``group`` a boolean ``_last``: the next row has another ``group``.

    Ranges of the order go to different tasks, each counts within its range, and every row adds
    what lies in earlier ranges: a table of one row per shuffle partition. The ranges are written
    before anything is counted, so a task that runs again cannot deal the rows out differently.
    No task holds more than its range, however many rows share a key.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn(
        "_part", F.shiftright("_at", _BITS))
    within = Window.partitionBy("_part").orderBy("_at")
    for name in totals:
        placed = placed.withColumn(f"_in_{name}", F.sum(name).over(within))
    if group:
        following = F.lead(F.struct(F.col(group).alias("_key"))).over(within)
        placed = placed.withColumn("_next", following)
    summary = placed.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.max(f"_in_{name}").alias(f"_all_{name}") for name in totals],
        *([F.min_by(F.struct(F.col(group).alias("_key")), "_at").alias("_first")] if group else []),
    )
    parts = Window.orderBy("_part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    offsets = summary.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_all_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in totals],
        *([F.lead("_first").over(parts).alias("_next_part")] if group else []),
    )
    # As many rows as there are shuffle partitions.
    joined = placed.join(F.broadcast(offsets), "_part")
    position = F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))
    columns = [*df.columns, (F.col("_rows_before") + position).alias("_row")]
    columns += [(F.col(f"_before_{name}") + F.col(f"_in_{name}")).alias(f"_to_{name}") for name in totals]
    if group:
        other = F.coalesce("_next", "_next_part")
        columns.append((other.isNull() | ~other["_key"].eqNullSafe(F.col(group))).alias("_last"))
    return joined.select(*columns)
