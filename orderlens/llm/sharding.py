"""Shards of nearly equal bytes that keep equal texts together: minimax contiguous partition.

The atomic groups (documents of equal text) lie in one order, and a shard is a contiguous run of
them. The smallest capacity with which the shards suffice is found by binary search, each capacity
being checked greedily, and the cuts keep to it.

Greedy checks ask again and again for the last group end up to some position. The driver answers
from a summary of the ends in cells of equal width (at most 65,536 cells). Where an answer lies inside a
cell of several ends, that cell is fetched in finer cells and the search runs again, until a whole
run needs no unknown end. Then its result is exact, and the driver has held a bounded summary only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from orderlens.operators.staging import stage

from .sequences import number

_CELL_BITS = 16
_FINER_BITS = 6


class Ends:
    """Group ends (running bytes) as far as they are known: per cell the largest end and how many there are."""

    def __init__(self, fetch: Callable, start: int, total: int):
        self.fetch, self.start, self.total = fetch, start, total
        self.shift = max(0, (total - start).bit_length() - _CELL_BITS)
        # (first position, shift, largest end, ends); a cell covers (first, first + 2 ** shift]
        self.cells = self._cells(self.shift, None)
        self.wanted: set[int] = set()
        self._index()

    def _cells(self, shift: int, inside: tuple[int, list[int]] | None) -> list[tuple]:
        return [(self.start + (cell << shift), shift, end, n) for cell, end, n in self.fetch(shift, inside)]

    def _index(self) -> None:
        self.cells.sort()
        self.firsts = [c[0] for c in self.cells]
        self.largest = [c[2] for c in self.cells]

    def refine(self) -> bool:
        """Fetch the cells that the last run needed. False if it needed none."""
        wanted = [self.cells[i] for i in self.wanted]
        self.cells = [c for i, c in enumerate(self.cells) if i not in self.wanted]
        for shift in {c[1] for c in wanted}:
            inside = [(c[0] - self.start) >> shift for c in wanted if c[1] == shift]
            self.cells += self._cells(max(0, shift - _FINER_BITS), (shift, inside))
        self.wanted = set()
        self._index()
        return bool(wanted)

    def up_to(self, position: int) -> int:
        """The last end at or before ``position``."""
        if position >= self.total:
            return self.total
        i = bisect_right(self.largest, position)
        if i < len(self.cells) and self.firsts[i] < position and self.cells[i][3] > 1:
            self.wanted.add(i)
        return self.largest[i - 1] if i else self.start

    def after(self, position: int) -> int:
        """The first end after ``position``."""
        i = bisect_right(self.largest, position)
        if i == len(self.cells):
            return self.total
        if self.cells[i][3] > 1:
            self.wanted.add(i)
        return self.largest[i]

    def suffice(self, position: int, shards: int, capacity: int) -> bool:
        """The greedy check: can ``shards`` of ``capacity`` hold all groups after ``position``?"""
        for _ in range(shards):
            if position >= self.total:
                return True
            reached = self.up_to(position + capacity)
            if reached <= position:
                return False
            position = reached
        return position >= self.total

    def capacity(self, shards: int) -> int:
        """The smallest capacity that suffices, by binary search."""
        low, high = -(-(self.total - self.start) // shards), self.total - self.start
        while low < high:
            middle = (low + high) // 2
            if self.suffice(self.start, shards, middle):
                high = middle
            else:
                low = middle + 1
        return low

    def cuts(self, shards: int) -> list[int]:
        """The last position of every shard. None is larger than the smallest capacity; under it, cuts lie
        as near to equal shares of what is left as the groups allow."""
        capacity, position, found = self.capacity(shards), self.start, []
        for left in range(shards, 1, -1):
            share = position + (self.total - position) / left
            near = [c for c in (self.up_to(int(share)), self.after(int(share))) if position < c <= position + capacity]
            near.sort(key=lambda c: (abs(c - share), c))
            cut = next((c for c in near if self.suffice(c, left - 1, capacity)), self.up_to(position + capacity))
            position = max(position, cut)
            found.append(position)
        return [*found, self.total]


def _oversized(groups: DataFrame, total: int, shards: int) -> list:
    """Groups above the mean of what is left: each can only fill a shard alone. Fewer than ``shards``."""
    largest = groups.orderBy(F.desc("bytes"), "first", "text_digest").limit(shards).collect()
    alone, left = [], total
    for group in largest:
        if len(alone) == shards - 1 or group["bytes"] * (shards - len(alone)) <= left:
            break
        alone.append(group)
        left -= group["bytes"]
    return alone


def shard(docs: DataFrame, shards: int, *, id: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: every row of ``docs`` in one of ``shards`` shards.

    ``size`` is the number of UTF-8 bytes plus ``overhead``; a null text has none and counts as a text of
    its own. Rows of equal text share a shard; slots are gapless from 0 in every shard. A group above the mean of
    what is left gets a shard of its own, and the other shards share the remaining groups, which are ordered by
    their smallest id. With fewer groups than shards, the last shards stay empty; an empty table gives an
    empty table. Rows equal in all columns, null ids included, each get a slot.

    Copies meet in an aggregation with a map side. The join that tells copies their group touches groups
    of several rows only, and adaptive execution splits a group that is too large. All that follows goes
    by ranges of rows.
    """
    body = F.col(text)
    rows = stage(docs.select(
        F.col(id).alias("doc_id"), (F.coalesce(F.octet_length(body), F.lit(0)) + overhead).cast("bigint").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(body, 256)), F.lit(b"none").cast("binary")).alias("text_digest"),
    ), "shard-rows")
    groups = stage(rows.groupBy("text_digest").agg(
        F.sum("size").alias("bytes"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    alone = _oversized(groups, total, shards)
    turn = F.lit(len(alone))
    for i, group in enumerate(alone):
        turn = F.when(F.col("text_digest") == F.lit(group["text_digest"]), i).otherwise(turn)
    copies = groups.filter(F.col("rows") > 1).select("text_digest", F.struct("first").alias("group"))
    placed = rows.join(copies, "text_digest", "left").select(
        "doc_id", "size", "text_crc32", "text_digest", turn.cast("int").alias("turn"),
        F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("group.first")).alias("first"))
    numbered = number(placed, ["turn", "first", "text_digest", "doc_id"], totals=["size"], group="text_digest")
    rows = stage(numbered.select("doc_id", "size", "text_crc32", "turn", "_row", "_to_size", "_last"), "shard-order")
    ends = rows.filter("_last").select(F.col("_to_size").alias("end"), "_row", "turn")
    fixed, start = [], 0
    for group in alone:
        start += group["bytes"]
        fixed.append(start)

    def fetch(shift: int, inside: tuple[int, list[int]] | None) -> list:
        beyond = ends.filter(F.col("turn") == len(alone)).withColumn("at", F.col("end") - 1 - start)
        if inside:
            cells = docs.sparkSession.createDataFrame([(c,) for c in sorted(inside[1])], "cell bigint")
            beyond = beyond.join(F.broadcast(cells), F.shiftright("at", inside[0]) == F.col("cell"), "left_semi")
        return beyond.groupBy(F.shiftright("at", shift).alias("cell")).agg(F.max("end"), F.count(F.lit(1))).collect()

    rest = Ends(fetch, start, total)
    while True:
        cuts = fixed + rest.cuts(shards - len(alone))
        if not rest.refine():
            break
    at_cut = {r["end"]: r["_row"] + 1 for r in ends.filter(F.col("end").isin(cuts)).collect()}
    first_rows = [0] + [at_cut.get(c, 0) for c in cuts[:-1]]
    number_of = sum(((F.col("_to_size") > c).cast("int") for c in cuts[:-1]), F.lit(0))
    return rows.withColumn("shard", number_of).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("_row") - F.element_at(F.array(*map(F.lit, first_rows)), F.col("shard") + 1)).alias("slot"))
