"""How filters on texts act together: what each removes in every order, from a sparse document-term matrix.

1. Every task turns its documents into blocks with a dictionary of their own: a matrix in compressed rows over local
   word numbers, and per document its other marks.
2. The words of all blocks meet in buckets by their hash. Copies of a word collapse up a tree with a fixed number of
   children, so that no task sees more than that many blocks at once, and the words left get one global number each.
3. The global numbers go back to the blocks, again by bucket and groups of blocks, which makes the matrix global.
4. Row sums (words) and nonzero counts (distinct words) of the matrix decide filters A and B; C and D were marked with the
   texts, E comes from digests of whole texts. Counts by part and set of failed filters answer all 120 orders.

No word, document or dictionary passes the driver; the counts of failed sets are at most 32 per part.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orderlens.operators.joins import join_dimension
from orderlens.operators.staging import stage

from .memory import parts, tidy

FILTERS = "ABCDE"
BLOCK_BYTES = 16 << 20  # text in a block, unless one document is longer
BLOCK_WORDS = 65_000  # distinct words after which a block ends, so that two bytes number them
FAN = 512  # blocks, or inner nodes, whose words of one bucket meet in one task
BUCKET_WORDS = 1 << 18
BUCKET_BITS = 12  # a bucket is at most so many leading bits of a word's hash
_CONTINUING = bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def blocks(docs: DataFrame, *, id: str = "doc_id", text: str = "text", part: str = "source",
           capitals_percent: int = 5, symbols: str = "#$%&*|") -> DataFrame:
    """``rows, words, n_words, starts, at, ends, terms, counts``: documents in blocks, words numbered within their block.

    ``rows`` holds per document its id, part, SHA-256 and marks (4: capitals, 8: symbols); ``ends``, ``terms`` and
    ``counts`` are its matrix in compressed rows. Words are in the order of their hashes; ``starts`` has the number of the first
    word of every finest bucket, ``at`` its place in ``words``. A null text is the empty one, a null part the empty string.
    """
    unwanted = symbols.encode("ascii")

    @tidy
    def build(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        class Block:
            def __init__(self):
                self.number = _Numbers()
                self.rows, self.ends, self.terms, self.counts, self.bytes = [], [0], [], [], 0

            def add(self, doc, body, name):
                at, many = np.unique(np.fromiter(map(self.number.__getitem__, body.split()), np.uint32), return_counts=True)
                length = len(body) - (len(body) - len(body.translate(None, _CONTINUING)))
                large = len(body) - len(body.translate(None, _CAPITALS))
                odd = len(body) != len(body.translate(None, unwanted))
                marks = (4 if 100 * large > capitals_percent * length else 0) + (8 if odd else 0)
                self.rows.append({"doc_id": doc, "part": name or "", "digest": hashlib.sha256(body).digest(), "marks": marks})
                self.terms.append(at)
                self.counts.append(many)
                self.ends.append(self.ends[-1] + len(at))
                self.bytes += len(body)

            def full(self):
                return self.bytes >= BLOCK_BYTES or len(self.number) >= BLOCK_WORDS

            def batch(self):
                words, hashes, order = _by_hash(list(self.number))
                number = np.empty(len(words), np.int64)
                number[order] = np.arange(len(words))
                ends, terms, counts = np.array(self.ends), number[np.concatenate(self.terms)], np.concatenate(self.counts)
                order = np.argsort(np.repeat(np.arange(len(self.rows)), np.diff(ends)) * len(words) + terms)
                starts = np.searchsorted(hashes >> np.uint32(32 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1))
                places = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])[starts]
                columns = [[self.rows], [b"\n".join(words)], [len(words)], *[[a.astype("<i4").tobytes()] for a in (starts, places, ends)],
                           [terms[order].astype(_width(len(words))).tobytes()], [counts[order].astype("<u4").tobytes()]]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        block = Block()
        for batch in batches:
            row = pa.struct([("doc_id", batch.schema.field(0).type), ("part", pa.string()), ("digest", pa.binary()), ("marks", pa.int32())])
            kinds = [pa.list_(row), pa.binary(), pa.int64(), *[pa.binary()] * 5]
            for doc, body, name in (row for part in parts(batch) for row in zip(*[c.to_pylist() for c in part.columns])):
                block.add(doc, body or b"", name)
                if block.full():
                    yield block.batch()
                    block = Block()
        if block.rows:
            yield block.batch()

    names = ["rows", "words", "n_words", "starts", "at", "ends", "terms", "counts"]
    source = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.col(part).cast("string").alias("part"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(build, f"rows array<struct<doc_id:{kind},part:string,digest:binary,marks:int>>, words binary, n_words bigint, "
                                    "starts binary, at binary, ends binary, terms binary, counts binary")


class _Numbers(dict):
    """Words and their numbers in the order they came."""

    def __missing__(self, word):
        self[word] = found = len(self)
        return found


def _width(n_words: int) -> str:
    return "<u2" if n_words <= 1 << 16 else "<u4"


def _by_hash(words):
    """Distinct words in the order of hash and word, their hashes, and where each one was."""
    from zlib import crc32

    import numpy as np

    hashes = np.fromiter(map(crc32, words), np.uint32, len(words))
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    found = [words[i] for i in order.tolist()]
    ties = np.flatnonzero(hashes[1:] == hashes[:-1]).tolist()
    for at in ties:  # few words share a hash
        if at == 0 or hashes[at - 1] != hashes[at]:
            till = at + 1 + int(np.argmin(np.append(hashes[at:] == hashes[at], False))) - 1
            run = sorted(zip(found[at:till], order[at:till].tolist()))
            found[at:till], order[at:till] = [w for w, _ in run], [i for _, i in run]
    return found, hashes, order


def _asked(staged: DataFrame, bits: int, groups: int) -> DataFrame:
    """``bucket, node, block, start, words``: the words of every block by bucket, from number ``start`` of the block on."""

    @tidy
    def split(batches):
        import numpy as np
        import pyarrow as pa

        names = ["bucket", "block", "start", "words"]
        for batch in batches:
            for block, words, starts, at in zip(*[batch.column(c) for c in ("block", "words", "starts", "at")]):
                words, (starts, at) = words.as_py(), (np.frombuffer(x.as_py(), "<i4")[::1 << BUCKET_BITS - bits].tolist() for x in (starts, at))
                rows = [(b, block.as_py(), starts[b], words[at[b]:at[b + 1] - 1]) for b in range(1 << bits) if starts[b] < starts[b + 1]]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names)

    asked = staged.select("block", "words", "starts", "at").mapInArrow(split, "bucket int, block bigint, start bigint, words binary")
    return asked.withColumn("node", F.pmod(F.xxhash64("block"), F.lit(groups)))


def _distinct(key, table):
    import pyarrow as pa

    words = set()
    for blob in table.column("words").to_pylist():
        words.update(blob.split(b"\n"))
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([len(words)], pa.int64()),
                     pa.array([b"\n".join(_by_hash(list(words))[0])], pa.binary())], names=["bucket", "node", "n", "words"])


def dictionary(asked: DataFrame, groups: int) -> DataFrame:
    """``bucket, n, words, first``: the distinct words of every bucket, by hash and word; the first one has the number ``first``.

    The numbers of all words are 0, 1, 2, ... without gaps, and ascend in the same order as those within a block.
    """
    found = asked.select("bucket", "node", "words")
    while True:
        found = found.groupBy("bucket", "node").applyInArrow(_distinct, "bucket int, node bigint, n bigint, words binary")
        if groups <= 1:
            break
        groups = -(-groups // FAN)
        found = found.select("bucket", F.floor(F.col("node") / FAN).alias("node"), "words")
    found = stage(found.select("bucket", "n", "words"), "audit-dictionary")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = found.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # 2 ** BUCKET_BITS rows at most
    return found.join(F.broadcast(firsts), "bucket")


@tidy
def _numbered(asked, known):
    """The global numbers, less the bucket's first, of the words that some blocks have in one bucket."""
    import numpy as np
    import pyarrow as pa

    rows = []
    if asked.num_rows:
        first = known.column("first")[0].as_py()
        words = known.column("words")[0].as_py().split(b"\n")
        number = dict(zip(words, range(len(words))))
        for block, start, words in zip(asked.column("block"), asked.column("start"), asked.column("words")):
            words = words.as_py().split(b"\n")
            rows.append((block.as_py(), start.as_py(), first, np.fromiter(map(number.__getitem__, words), "<u4", len(words)).tobytes()))
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.binary()])], names=["block", "start", "first", "numbers"])


def _globally(block, found):
    """A block whose words have their global numbers."""
    import numpy as np
    import pyarrow as pa

    if not block.num_rows:
        return block.drop_columns(["n_words"])
    n_words = block.column("n_words")[0].as_py()
    number = np.full(n_words, -1, "<i8")
    for start, first, numbers in zip(*[found.column(c).to_pylist() for c in ("start", "first", "numbers")]):
        numbers = np.frombuffer(numbers, "<u4")
        number[start:start + len(numbers)] = first + numbers.astype(np.int64)
    if n_words and number.min() < 0:
        raise RuntimeError("a word of a block is missing in the dictionary")
    terms = number[np.frombuffer(block.column("terms")[0].as_py(), _width(n_words))]
    return pa.table([block.column("block"), block.column("rows"), block.column("ends"), pa.array([terms.tobytes()], pa.binary()), block.column("counts")],
                    names=["block", "rows", "ends", "terms", "counts"])


def matrix(docs: DataFrame, *, id: str = "doc_id", text: str = "text", part: str = "source", capitals_percent: int = 5,
           symbols: str = "#$%&*|") -> tuple[DataFrame, DataFrame]:
    """The document-term matrix in shards of compressed rows, and the dictionary of its terms.

    Shards: ``block, rows, ends (int32), terms (int64, global numbers, ascending in a row), counts (uint32)``, all little-endian.
    """
    built = blocks(docs, id=id, text=text, part=part, capitals_percent=capitals_percent, symbols=symbols)
    staged = stage(built.withColumn("block", F.monotonically_increasing_id()), "audit-blocks")
    sizes = staged.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    groups = max(1, math.ceil(sizes["blocks"] / FAN))
    bits = min(BUCKET_BITS, max(3, math.ceil(math.log2(sizes["words"] / BUCKET_WORDS + 1e-9))))
    asked = _asked(staged, bits, groups)
    known = dictionary(asked, groups)
    spread = known.withColumn("node", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    found = asked.groupBy("bucket", "node").cogroup(spread.groupBy("bucket", "node")).applyInArrow(
        _numbered, "block bigint, start bigint, first bigint, numbers binary")
    rows = staged.schema["rows"].dataType.simpleString()
    shards = staged.select("block", "rows", "n_words", "ends", "terms", "counts").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        _globally, f"block bigint, rows {rows}, ends binary, terms binary, counts binary")
    return shards, known


def failures(shards: DataFrame, *, least_words: int = 50, distinct_percent: int = 65) -> DataFrame:
    """``doc_id, part, digest, failed`` of every document: bits of the filters A to D that its row fails."""

    def measure(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for rows, ends, counts in zip(batch.column("rows"), batch.column("ends"), batch.column("counts")):
                ends = np.frombuffer(ends.as_py(), "<i4").astype(np.int64)
                running = np.concatenate([[0], np.cumsum(np.frombuffer(counts.as_py(), "<u4"), dtype=np.int64)])
                words, distinct = running[ends[1:]] - running[ends[:-1]], np.diff(ends)
                doc = rows.values
                failed = doc.field("marks").to_numpy(zero_copy_only=False) + (words < least_words) + 2 * (100 * distinct < distinct_percent * words)
                yield pa.RecordBatch.from_arrays([doc.field("doc_id"), doc.field("part"), doc.field("digest"), pa.array(failed, pa.int32())],
                                                 ["doc_id", "part", "digest", "failed"])

    kind = shards.schema["rows"].dataType.elementType["doc_id"].dataType.simpleString()
    return shards.select("rows", "ends", "counts").mapInArrow(measure, f"doc_id {kind}, part string, digest binary, failed int")


def failed_sets(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, failed, n, good, toxic``: documents by part and set of failed filters, E among them.

    A document fails E if a smaller id has its text. Null ids are neither smaller nor larger than any. Copies are counted before
    they meet, so a text that a third of all documents share is one row per part and label.
    """
    truth = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    each = join_dimension(marked, truth, "doc_id").select(
        "doc_id", "part", "digest", "failed", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    alike = ["digest", "part", "failed", "good", "toxic"]
    ids = each.groupBy(*alike, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = ids.groupBy(*alike, F.col("doc_id").isNull().alias("none")).agg(
        F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least"))
    smallest = F.min(F.when(~F.col("none"), F.col("least.doc_id"))).over(Window.partitionBy("digest"))
    first = F.when(F.col("none"), F.col("n")).when(F.col("least.doc_id") == F.col("_smallest"), F.col("least.n")).otherwise(F.lit(0))
    both = groups.withColumn("_smallest", smallest).withColumn("first", first).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("failed"), F.col("first").alias("n")),
            F.struct(F.col("failed").bitwiseOR(16).alias("failed"), (F.col("n") - F.col("first")).alias("n")))).alias("set"))
    n = F.col("set.n")
    return both.filter(n > 0).groupBy("part", F.col("set.failed").alias("failed")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def orders(sets: DataFrame) -> DataFrame:
    """Every part, order and step with its counts, from at most 32 sets a part."""
    per_part = sets.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sets"))
    every = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    bit = f"shiftleft(1, instr('{FILTERS}', substr(filter_order, %s, 1)) - 1)"
    steps = f"sequence(1, {len(FILTERS)})"
    grid = per_part.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.expr(steps)))
    grid = grid.withColumn("bit", F.expr(bit % "step")).withColumn("before", F.expr(
        f"aggregate(transform({steps}, i -> if(i < step, {bit % 'i'}, 0)), 0, (a, b) -> a + b)"))
    own = lambda s: s["failed"].bitwiseAND(F.col("bit")) != 0
    earlier = lambda s: s["failed"].bitwiseAND(F.col("before")) != 0

    def total(chosen, value) -> Column:
        return F.aggregate(F.filter("sets", chosen), F.lit(0).cast("bigint"), lambda sum_, s: sum_ + value(s))

    n = lambda s: s["n"]
    leads = lambda s: s["n"] * (F.lit(math.factorial(len(FILTERS))) / F.bit_count(s["failed"])).cast("bigint")
    return grid.select(
        "part", "filter_order", "step",
        total(lambda s: ~own(s) & ~earlier(s), n).alias("kept"),
        total(lambda s: own(s) & ~earlier(s), n).alias("removed"),
        total(lambda s: own(s) & earlier(s), n).alias("redundant"),
        total(lambda s: s["failed"] == F.col("bit"), n).alias("unique_fails"),
        total(lambda s: own(s) & ~earlier(s), lambda s: s["good"]).alias("good_lost"),
        total(lambda s: own(s) & ~earlier(s), lambda s: s["toxic"]).alias("toxic_lost"),
        total(own, leads).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    Filters fail a text A: of fewer than 50 words, B: with fewer than 65 distinct words in 100, C: with more than 5 capitals
    A-Z in 100 code points, D: with one of ``#$%&*|``, E: that a smaller id has too. One row for every part, order and step, zeros
    included. Null and empty texts have no words (A fails, B to D hold) and equal each other; a null part is the empty
    string. Repeated rows count each; of rows with one id and text none is a copy of the other. A document is good or toxic if any
    of its labels says so. Other columns are not read; an empty table gives an empty table.
    """
    shards, _ = matrix(docs, id=id, text=text, part=part)
    return orders(failed_sets(failures(shards), labels))
