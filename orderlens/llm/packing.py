"""Packing of token ids into windows: best-fit decreasing over all documents at once.

Every document is cut into full windows and one rest. Best-fit decreasing needs only to know how
many pieces of each length there are, because pieces of one length are interchangeable. So the plan
is made from a histogram with one entry per possible length (2,048 numbers at most, whatever the
size of the corpus), and the distributed rows find their place in the plan by length and rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

from pyspark.sql import DataFrame, functions as F

from orderlens.operators.staging import stage

from .bytelevel import ByteLevel
from .columns import by_position, restored
from .memory import tidy
from .sequences import number
from .vocabulary import some

WINDOW = 2048
END_ID = 1
_PLAN_BROADCAST = 200_000


def cut(docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", window: int = WINDOW,
        end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """Pieces of at most ``window`` ids: ``doc_id, start, length, doc_tokens, ids_crc32, ids``.

    ``tokenizer`` is the text of a byte-level tokenizer's JSON file; ``ids`` holds little-endian unsigned
    32-bit numbers and ``ids_crc32`` their checksum; with ``ids=False`` only the checksum leaves the worker.
    The ids of a document are those of its whole text and then ``end_id``. A null or empty text gives the piece
    ``[end_id]``; equal rows and null ids of documents are kept as they are. Python encodes in Arrow batches and
    keeps nothing but the vocabulary and the texts of a batch.
    """
    end = int(end_id).to_bytes(4, "little")

    @tidy
    def pieces(batches):
        import pyarrow as pa

        encode = ByteLevel(tokenizer).encode

        def rows(batch):
            for doc, body in zip(batch.column(0), batch.column(1)):
                whole = (encode(body.as_py()).astype("<u4", copy=False).tobytes() if body.is_valid else b"") + end
                total = len(whole) // 4
                for start in range(0, total, window):
                    part = whole[4 * start:4 * (start + window)]
                    yield doc.as_py(), start, len(part) // 4, total, zlib.crc32(part), part

        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            for block in some(rows(batch)):
                columns = [pa.array(c, k) for c, k in zip(zip(*block), kinds)]
                yield pa.RecordBatch.from_arrays(columns[:len(names)], names)

    source = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids_crc32 bigint" + (", ids binary" if ids else "")
    names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"][:6 if ids else 5]
    return source.mapInArrow(pieces, schema)


class _Tightest:
    """Segment tree over remaining capacities: the smallest one, not below a length, that is open."""

    def __init__(self, window: int):
        self.size = 1 << (window + 1).bit_length()
        self.open = [False] * (2 * self.size)

    def put(self, capacity: int, is_open: bool) -> None:
        node = self.size + capacity
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def find(self, least: int) -> int | None:
        node = self.size + least
        if self.open[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` pieces of every length.

    Returns ``(length, from_rank, pieces, sequence, offset)``: the pieces of that length with ranks from
    ``from_rank`` on go to the sequences from ``sequence`` on, one each, at ``offset``. Windows in the same
    state are handled as a range of sequence numbers, so the work depends on the window size alone.
    """
    tree, ranges, next_sequence, placed = _Tightest(window), defaultdict(list), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.find(length)
            if capacity is None:
                # All windows that pieces of this length fill as far as they can; then one for the rest.
                fresh = max(1, left // (window // length))
                ranges[window].append((next_sequence, fresh))
                tree.put(window, True)
                next_sequence += fresh
                continue
            first, free = ranges[capacity].pop()
            taken = min(free, left)
            if taken < free:
                ranges[capacity].append((first + taken, free - taken))
            if not ranges[capacity]:
                tree.put(capacity, False)
            placed.append((length, rank, taken, first, window - capacity))
            ranges[capacity - length].append((first, taken))
            tree.put(capacity - length, capacity > length)
            rank, left = rank + taken, left - taken
    return placed


def pack(pieces: DataFrame, *, window: int = WINDOW, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``window`` tokens (column ``length``).

    All other columns, ``ids`` among them, pass through, whatever their names. The rows are sorted by length once,
    in ranges, so a length that a third of all pieces share is still split over tasks. Offsets in a sequence are
    gapless from 0. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    inner, at = by_position(pieces)
    length = at["length"]
    inner = stage(inner, "pieces")  # finding the ranges reads them a first time
    ranked = number(inner, [length, *[at[c] for c in order]])
    counts = {r[length]: r["count"] for r in ranked.groupBy(length).count().collect()}  # window rows at most
    if any(not n or not 0 < n <= window for n in counts):
        raise ValueError(f"lengths have to lie between 1 and {window}")
    start, starts = 0, {}
    for n in sorted(counts):
        starts[n], start = start, start + counts[n]
    placed = [(n, starts[n] + rank, starts[n] + rank + k, s, o) for n, rank, k, s, o in plan(counts, window)]
    table = spark.createDataFrame(placed, "_length bigint, _from bigint, _till bigint, _sequence bigint, _offset bigint")
    if len(placed) <= _PLAN_BROADCAST:
        table = F.broadcast(table)
    here = (F.col(length) == F.col("_length")) & (F.col("_row") >= F.col("_from")) & (F.col("_row") < F.col("_till"))
    return ranked.join(table, here).select(
        *restored(pieces.columns),
        (F.col("_sequence") + F.col("_row") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset"))
