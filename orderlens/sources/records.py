"""Records of delimited files that stay split: quoted cells with line breaks, put together in parallel.

Whether a line starts inside a quoted cell depends on all lines before it, so it seems to need one reader per file. But a
line only maps one of two states (outside, inside) to another: it keeps the state, swaps it, or sets it. Every
block of a file sums its lines up to such a map, the maps of the blocks are combined in order, and then each block knows the
state in which it starts. Lines of records that go over several lines are grouped; all others stay where they are.
The lines are brought in order within their blocks once and written with both answers, for a block that starts outside and inside;
the facts of the blocks, one row each, then choose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..operators.headers import ends_inside
from ..operators.joins import join_dimension
from ..operators.staging import DENSE, stage

LONGEST_RECORD = 100_000  # lines; a quoted cell with more is taken for a stray quote, and the file is refused


def quote_maps(text: Column) -> list[Column]:
    """``opens`` and ``stays``: one bit per delimiter, for the state after a line that starts outside or inside a quoted cell."""
    def bits(line: Column) -> Column:
        return sum((F.when(ends_inside(line, mark), 1 << i).otherwise(0) for i, mark in enumerate(vocab.DELIMITERS)), F.lit(0))

    quoted = text.contains('"')
    every = (1 << len(vocab.DELIMITERS)) - 1
    return [F.when(quoted, bits(text)).otherwise(0).alias("opens"),
            F.when(quoted, bits(F.concat(F.lit('"'), text))).otherwise(every).alias("stays")]


def _bit(bits: str, delimiter: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(mark) for mark in vocab.DELIMITERS]), delimiter)
    return F.getbit(F.col(bits), (at - 1).cast("int")).cast("int")


def _after(before: Column) -> Column:
    return F.when(before == 0, F.col("_opens")).otherwise(F.col("_stays"))


def _running(df: DataFrame, keys: list[str], order: str, start: Column) -> DataFrame:
    """``_before``: the state in which every row starts, if the first one of ``keys`` starts in ``start``."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    swaps = (F.col("_opens") == 1) & (F.col("_stays") == 0)
    sets = F.col("_opens") == F.col("_stays")
    df = df.withColumn("_swaps", F.coalesce(F.count_if(swaps).over(earlier), F.lit(0)))
    last = F.last(F.when(sets, F.struct(F.col("_opens").alias("state"), "_swaps")), ignorenulls=True).over(earlier)
    df = df.withColumn("_last", last)
    since = F.col("_swaps") - F.coalesce("_last._swaps", F.lit(0))
    return df.withColumn("_before", ((F.coalesce("_last.state", start) + since) % 2).cast("int"))


def line_states(lines: DataFrame) -> DataFrame:
    """``file, block, line, text, before, after, start``: the states around every line, for lines with their ``delimiter``, and the
    position of the first line of its record."""
    maps = lines.withColumns({"_opens": _bit("opens", F.col("delimiter")), "_stays": _bit("stays", F.col("delimiter"))})
    local = _running(maps, ["file", "block"], "line", F.lit(0)).withColumnRenamed("_before", "_if_outside")
    free = F.col("_last").isNull()  # no line before it in the block sets the state
    local = local.withColumn("_if_inside", F.when(free, 1 - F.col("_if_outside")).otherwise(F.col("_if_outside")))
    so_far = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    for state in ("outside", "inside"):
        first = F.when(F.col(f"_if_{state}") == 0, F.col("line"))
        local = local.withColumn(f"_start_{state}", F.last(first, ignorenulls=True).over(so_far))
    local = stage(local.select("file", "block", "line", "text", "_opens", "_stays", "_if_outside", "_if_inside", "_start_outside", "_start_inside"),
                  "quote-lines", DENSE)
    # What the block does to the other state: the same if it sets a state anywhere, else the opposite.
    ends = local.groupBy("file", "block").agg(
        F.max_by(_after(F.col("_if_outside")), "line").alias("_opens"), F.max(F.col("_opens") == F.col("_stays")).alias("_sets"),
        *[F.max(f"_start_{state}").alias(f"_start_{state}") for state in ("outside", "inside")])
    blocks = ends.withColumn("_stays", F.when(F.col("_sets"), F.col("_opens")).otherwise(1 - F.col("_opens")))
    known = _running(blocks, ["file"], "block", F.lit(0)).withColumnRenamed("_before", "_enters")

    def chosen(name: str) -> Column:
        return F.when(F.col("_enters") == 1, F.col(f"{name}_inside")).otherwise(F.col(f"{name}_outside"))

    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = stage(known.select(F.struct("file", "block").alias("_of_block"), "_enters", F.last(
        chosen("_start"), ignorenulls=True).over(earlier).alias("_carried")), "quote-blocks")
    placed = join_dimension(local.withColumn("_of_block", F.struct("file", "block")), known, "_of_block", "inner")
    placed = placed.withColumn("before", chosen("_if"))
    return placed.select("file", "block", "line", "text", "before", _after(F.col("before")).alias("after"),
                         F.coalesce(chosen("_start"), "_carried").alias("start"))


def unclosed(states: DataFrame) -> DataFrame:
    """Files whose last line ends inside a quoted cell."""
    return states.groupBy("file").agg(F.max_by("after", F.struct("block", "line")).alias("after")).filter("after = 1").select("file")


def _started(states: DataFrame) -> DataFrame:
    """Lines of records with several lines, each with the position of the record's first line in ``start``."""
    return states.filter("before = 1 OR after = 1").select("file", "start", "block", "line", "text")


def overlong(states: DataFrame) -> DataFrame:
    """Files with a record of more than LONGEST_RECORD lines."""
    return _started(states).groupBy("file", "start").count().filter(F.col("count") > LONGEST_RECORD).select("file").distinct()


def records(states: DataFrame) -> DataFrame:
    """``file, line, text`` of every record; its lines are joined by line feeds, its position is that of its first line."""
    single = states.filter("before = 0 AND after = 0").select("file", "line", "text")
    grouped = _started(states).groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("block", "line", "text"))).alias("lines"))
    return single.unionAll(grouped.select(
        "file", F.col("start").alias("line"), F.array_join(F.transform("lines", lambda one: one["text"]), "\n").alias("text")))
