"""Alignment of two tokenizers over a corpus: which tokens of one cover the bytes of which tokens of the other.

1. Every document is encoded by both; the ids are written once. Byte offsets where tokens of both end cut them into groups,
   and all pairs of tokens in a group are linked.
2. The distinct pairs of all documents meet in buckets by their first id, up a tree with a fixed number of children. Every
   bucket makes a minimal perfect hash function of its pairs, with the pairs in the order of the hash to verify by.
3. Blocks count the documents of their pairs; the counts become dense vectors indexed by the hash, and vectors are summed up the
   same tree.
4. A second pass aligns the written ids again and looks the counts up, with keys verified. The table of counts is broadcast if its
   measured size allows; beyond that, blocks ask the buckets for the counts of their distinct pairs and meet the answers.

The number of pairs is bounded by the product of the two vocabularies, so no bucket can hold more than its share of that.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, functions as F

from orderlens.operators.staging import stage

from .memory import parts, tidy

BUCKETS = 256
FAN = 64  # blocks, or inner nodes, that meet in one task
BLOCK_BYTES = 16 << 20  # text in a block, unless one document is longer
SLICE = 1 << 19  # tokens aligned at once, unless one document has more
WIDE = 64  # pairs in a group from which repeated ids are counted before they are paired
BROADCAST_BYTES = 64 << 20
_ENTRY = 26  # bytes of one pair in a table that is unfolded for look-ups


class Coders:
    """Ids by both tokenizers, and the bytes of their tokens as the contract of the alignment has them."""

    def __init__(self, bytelevel: str, pieces: bytes):
        import sentencepiece

        from .bytelevel import ByteLevel

        self.a, self.b = ByteLevel(bytelevel, special=False), sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.bytes_a = self.a.token_bytes
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(len(self.b)))]

    def encode(self, texts: list[str | None]):
        """Both lists of ids of every text; empty ones where there is no text or the bytes are not those of blank and text."""
        filled = [t for t in texts if t]
        other = iter(self.b.encode(filled, num_threads=1) if filled else [])
        for text in texts:
            a, b = [], []
            if text:
                a, b, whole = self.a.encode(" " + text).tolist(), next(other), b" " + text.encode()
                if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
                    a, b = [], []
            yield a, b


@functools.lru_cache(maxsize=1)
def _coders(bytelevel: str, pieces: bytes) -> Coders:
    return Coders(bytelevel, pieces)


@functools.lru_cache(maxsize=1)
def _widths(bytelevel: str, pieces: bytes):
    import numpy as np

    known = _coders(bytelevel, pieces)
    return np.array([len(t) for t in known.bytes_a]), np.array([len(t) for t in known.bytes_b])


class Links:
    """Groups and links of a run of documents with ids ``a`` and ``b``, ``many_a`` and ``many_b`` of each."""

    def __init__(self, a, b, many_a, many_b, widths, base: int):
        import numpy as np

        ends_a, ends_b = np.cumsum(widths[0][a]), np.cumsum(widths[1][b])
        total = int(ends_a[-1]) if len(a) else 0
        both = np.zeros(total + 1, np.int8)
        both[ends_a] += 1
        both[ends_b] += 1
        both = both == 2
        self.a, self.b, self.base = a.astype(np.int64), b.astype(np.int64), base
        self.group_a = np.cumsum(both[ends_a]) - both[ends_a]
        self.group_b = np.cumsum(both[ends_b]) - both[ends_b]
        self.n_groups = int(both.sum())
        self.in_a = np.bincount(self.group_a, minlength=self.n_groups)
        self.in_b = np.bincount(self.group_b, minlength=self.n_groups)
        until_a = np.cumsum(many_a)
        self.group_ends = np.concatenate([[0], np.cumsum(self.in_a)]).searchsorted(until_a)  # groups up to each document's end

    def pairs(self):
        """Group, key and number of occurrences of linked ids; keys are base * a + b. In narrow groups every link is one entry."""
        import numpy as np

        first_a, first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        wide = self.in_a * self.in_b > WIDE
        repeat = np.where(wide, 0, self.in_b)[self.group_a]
        at_a = np.repeat(np.arange(len(self.a)), repeat)
        within = np.arange(len(at_a)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        group = self.group_a[at_a]
        key = self.a[at_a] * self.base + self.b[first_b[group] + within]
        yield group, key, np.ones(len(key), np.int64)
        for g in np.flatnonzero(wide).tolist():
            left, some = np.unique(self.a[first_a[g]:first_a[g] + self.in_a[g]], return_counts=True)
            right, more = np.unique(self.b[first_b[g]:first_b[g] + self.in_b[g]], return_counts=True)
            step = max(1, SLICE // len(right))
            for i in range(0, len(left), step):
                key = (left[i:i + step, None] * self.base + right).ravel()
                yield np.full(len(key), g), key, (some[i:i + step, None] * more).ravel()

    def documents(self, group):
        """The document of every group number."""
        return self.group_ends.searchsorted(group, "right")

    def written(self, names: list[str]) -> list[str]:
        """Every document's groups as ``a1,a2|b1;a3|b2,b3``. ``names`` are numbers with a comma, a bar and a semicolon after them."""
        import numpy as np

        third = len(names) // 3
        until_a, until_b = np.cumsum(self.in_a), np.cumsum(self.in_b)
        sign_a, sign_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        sign_a[until_a - 1], sign_b[until_b - 1] = third, 2 * third
        mixed = np.empty(len(self.a) + len(self.b), np.int64)
        mixed[np.arange(len(self.a)) + (until_b - self.in_b)[self.group_a]] = self.a + sign_a
        mixed[np.arange(len(self.b)) + until_a[self.group_b]] = self.b + sign_b
        ends = np.concatenate([[0], until_a + until_b])[self.group_ends]
        mixed, found, at = mixed.tolist(), [], 0
        for end in ends.tolist():
            found.append("".join(map(names.__getitem__, mixed[at:end]))[:-1])
            at = end
        return found


def _slices(batch):
    """Runs of rows with about SLICE tokens: first row, row after, ids and their numbers."""
    import numpy as np

    def column(name):
        cells = batch.column(name)
        offsets, data = cells.buffers()[1:]
        if not len(cells) or offsets is None:
            return np.zeros(1, np.int64), b""
        ends = np.frombuffer(offsets, "<i4")[cells.offset:cells.offset + len(cells) + 1].astype(np.int64)
        return ends, memoryview(data) if data is not None else b""

    (ends_a, data_a), (ends_b, data_b) = column("a"), column("b")
    running, start = np.cumsum((np.diff(ends_a) + np.diff(ends_b)) // 2), 0
    while start < len(running):
        till = max(start + 1, int(running.searchsorted((running[start - 1] if start else 0) + SLICE, "right")))
        cut = lambda ends, data: np.frombuffer(data[ends[start]:ends[till]], "<u2")
        yield start, till, cut(ends_a, data_a), cut(ends_b, data_b), np.diff(ends_a[start:till + 1]) // 2, np.diff(ends_b[start:till + 1]) // 2
        start = till


def encoded(docs: DataFrame, bytelevel: str, pieces: bytes, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``block, doc_id, a, b``: ids of both tokenizers as little-endian unsigned 16-bit numbers, written once."""

    @tidy
    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        own = _coders(bytelevel, pieces)
        if max(len(own.bytes_a), len(own.bytes_b)) > 1 << 16:
            raise ValueError("a vocabulary of more than 65,536 tokens")
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in parts(batch):
                texts = part.column(1).to_pylist()
                ids = list(own.encode(texts))
                cells = [pa.array([np.array(side, "<u2").tobytes() for side in sides], pa.binary()) for sides in zip(*ids)]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(texts), pa.int64()), part.column(0), *cells], ["block", "doc_id", "a", "b"])
                held += sum(len(t) for t in texts if t)
                if held >= BLOCK_BYTES:
                    block, held = block + 1, 0

    source = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return stage(source.mapInArrow(encode, f"block bigint, doc_id {kind}, a binary, b binary"), "alignment-ids")


def _block_pairs(written: DataFrame, bytelevel: str, pieces: bytes) -> DataFrame:
    """``block, bucket, keys, docs``: the distinct pairs of every block, ascending, with their documents in the block."""

    @tidy
    def count(batches):
        import numpy as np
        import pyarrow as pa

        widths = _widths(bytelevel, pieces)
        base, kinds = len(widths[1]), [pa.int64(), pa.int32(), pa.binary(), pa.binary()]

        def counted(block, found):
            key, many = (np.concatenate(c) for c in zip(*found))
            key, at = np.unique(key, return_inverse=True)
            many = np.bincount(at, many).astype(np.int64)
            bucket = key // base % BUCKETS
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
            rows = [(block, b, key[order[ends[b]:ends[b + 1]]].astype("<u4").tobytes(), many[order[ends[b]:ends[b + 1]]].astype("<u4").tobytes())
                    for b in range(BUCKETS) if ends[b] < ends[b + 1]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["block", "bucket", "keys", "docs"])

        current, found = None, []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for start, till, a, b, many_a, many_b in _slices(batch):
                links = Links(a, b, many_a, many_b, widths, base)
                of_doc = [[] for _ in range(till - start)]
                for group, key, _ in links.pairs():
                    ends = links.documents(group).searchsorted(np.arange(till - start + 1))
                    for n in np.flatnonzero(np.diff(ends)).tolist():
                        of_doc[n].append(np.unique(key[ends[n]:ends[n + 1]]))
                for n, own in enumerate(of_doc):
                    block = int(blocks[start + n])
                    if block != current:
                        if found:
                            yield counted(current, found)
                        current, found = block, []
                    if own:
                        own = own[0] if len(own) == 1 else np.unique(np.concatenate(own))
                        found.append((own, np.ones(len(own), np.int64)))
                if found:  # few arrays are left of every slice
                    key, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                    found = [(key, np.bincount(at, np.concatenate([f[1] for f in found])).astype(np.int64))]
        if found:
            yield counted(current, found)

    return written.select("block", "a", "b").mapInArrow(count, "block bigint, bucket int, keys binary, docs binary")


def _slots(keys, level: int, sizes):
    """A place of every key on one level, below the size of the level."""
    import numpy as np

    with np.errstate(over="ignore"):
        h = (keys.astype(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((h >> np.uint64(32)) * np.asarray(sizes).astype(np.uint64)) >> np.uint64(32)


def hash_levels(keys) -> list:
    """A minimal perfect hash of distinct keys: on every level a bit for each place that one remaining key alone has.

    The number of a key is the number of bits before its own, so n keys have the numbers 0 to n - 1.
    """
    import numpy as np

    levels, left = [], keys
    while len(left):
        size = 2 * len(left) + 1
        slot = _slots(left, len(levels), size).astype(np.int64)
        alone = np.bincount(slot, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[slot]]
        if len(levels) > 200:
            raise RuntimeError("keys that are not distinct")
    return levels


class Table:
    """Look-ups in one or more buckets: ``find`` gives the number of every key, counted through the buckets, or -1."""

    def __init__(self, rows, base: int):
        import numpy as np

        self.base, rows = base, sorted(rows, key=lambda r: r["bucket"])
        self.keys = np.concatenate([np.frombuffer(r["keys"], "<u4") for r in rows]) if rows else np.zeros(0, "<u4")
        depth = max([len(r["levels"]) for r in rows], default=0)
        self.first, self.size, self.index = [], [], []
        given = np.zeros(BUCKETS, np.int64)
        n = 0
        for r in rows:
            given[r["bucket"]], n = n, n + r["n"]
        for level in range(depth):
            size, first, index, at = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), [], 0
            for r in rows:
                if level < len(r["levels"]):
                    width, bits = r["sizes"][level], np.frombuffer(r["levels"][level], np.uint8)
                    bits = np.unpackbits(bits, count=width).astype(bool)
                    places = np.full(width, -1, np.int32)
                    places[bits] = given[r["bucket"]] + np.arange(bits.sum())
                    given[r["bucket"]] += int(bits.sum())
                    size[r["bucket"]], first[r["bucket"]], at = width, at, at + width
                    index.append(places)
            self.size.append(size)
            self.first.append(first)
            self.index.append(np.concatenate(index))

    def find(self, keys):
        import numpy as np

        found, left, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys)), keys
        for level, (size, first, index) in enumerate(zip(self.size, self.first, self.index)):
            bucket = open_ // self.base % BUCKETS
            here = size[bucket]
            place = np.where(here > 0, index[np.minimum(first[bucket] + _slots(open_, level, here).astype(np.int64), len(index) - 1)], -1)
            found[left] = place
            on = np.flatnonzero((place < 0) & (here > 0))
            left, open_ = left[on], open_[on]
            if not len(left):
                break
        good = found >= 0
        good[good] = self.keys[found[good]] == keys[good]  # the verified key
        found[~good] = -1
        return found


def _node(groups: int):
    return F.pmod(F.xxhash64("block"), F.lit(groups))


def _tree(df: DataFrame, groups: int, columns: list[str], merge, schema: str) -> DataFrame:
    """Merge the rows of every bucket, FAN nodes at a time, until one node is left."""
    while True:
        df = df.groupBy("bucket", "node").applyInArrow(merge, schema)
        if groups <= 1:
            return df
        groups = -(-groups // FAN)
        df = df.select("bucket", F.floor(F.col("node") / FAN).alias("node"), *columns)


def _distinct_keys(key, table):
    import numpy as np
    import pyarrow as pa

    keys = np.unique(np.concatenate([np.frombuffer(k, "<u4") for k in table.column("keys").to_pylist()]))
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([keys.tobytes()], pa.binary())],
                    names=["bucket", "node", "keys"])


def _summed(key, table):
    import numpy as np
    import pyarrow as pa

    vector = sum(np.frombuffer(v, "<i8") for v in table.column("vector").to_pylist())
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([vector.tobytes()], pa.binary())],
                    names=["bucket", "node", "vector"])


_FUNCTION = "bucket int, n bigint, sizes array<bigint>, levels array<binary>, keys binary"


def _function(batches, base: int):
    """The hash function of every bucket, with its keys in the order of their numbers."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        rows = []
        for bucket, keys in zip(*[c.to_pylist() for c in batch.columns]):
            keys = np.frombuffer(keys, "<u4").astype(np.int64)
            levels = hash_levels(keys)
            row = {"bucket": bucket, "n": len(keys), "sizes": [len(x) for x in levels], "levels": [np.packbits(x).tobytes() for x in levels],
                   "keys": keys.astype("<u4").tobytes()}
            table = Table([row], base)
            order = np.empty(len(keys), np.int64)
            table.keys = np.full(len(keys), -1)  # not known yet: numbers first
            found = np.full(len(keys), -1)
            left = np.arange(len(keys))
            for level, index in enumerate(table.index):
                place = index[_slots(keys[left], level, len(index)).astype(np.int64)]
                found[left], left = place, left[place < 0]
            order[found] = keys
            rows.append((bucket, len(keys), row["sizes"], row["levels"], order.astype("<u4").tobytes()))
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary()]
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["bucket", "n", "sizes", "levels", "keys"])


def counts(asked: DataFrame, groups: int, base: int) -> DataFrame:
    """``bucket, n, sizes, levels, keys, counts, best``: per bucket the hash function, its keys, the documents of each and
    whether no other pair of its first id is in more. A bucket holds all pairs of a first id."""
    import pyarrow as pa

    def vectors(key, blocks, function):
        import numpy as np

        if not blocks.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["bucket", "node", "vector"])
        own = Table(function.to_pylist(), base)
        vector = np.zeros(len(own.keys), "<i8")
        for keys, docs in zip(blocks.column("keys").to_pylist(), blocks.column("docs").to_pylist()):
            at = own.find(np.frombuffer(keys, "<u4").astype(np.int64))
            if (at < 0).any():
                raise RuntimeError("a pair without a number")
            vector[at] += np.frombuffer(docs, "<u4")  # the pairs of a row are distinct
        return pa.table([blocks.column("bucket")[:1], blocks.column("node")[:1], pa.array([vector.tobytes()], pa.binary())], names=["bucket", "node", "vector"])

    def finished(batches):
        import numpy as np

        for batch in batches:
            best = []
            for keys, vector in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                keys, vector = np.frombuffer(keys, "<u4").astype(np.int64) // base, np.frombuffer(vector, "<i8")
                ids, at = np.unique(keys, return_inverse=True)
                most = np.zeros(len(ids), np.int64)
                np.maximum.at(most, at, vector)
                best.append((vector == most[at]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.binary())], [*batch.schema.names, "best"])

    keys = _tree(asked.select("bucket", "node", "keys"), groups, ["keys"], _distinct_keys, "bucket int, node bigint, keys binary")
    functions = stage(keys.select("bucket", "keys").mapInArrow(lambda b: _function(b, base), _FUNCTION), "alignment-hash")
    local = asked.groupBy("bucket", "node").cogroup(_spread(functions, groups).groupBy("bucket", "node")).applyInArrow(
        vectors, "bucket int, node bigint, vector binary")
    total = _tree(local, groups, ["vector"], _summed, "bucket int, node bigint, vector binary")
    joined = functions.join(total.select("bucket", F.col("vector").alias("counts")), "bucket")
    return stage(joined.mapInArrow(finished, f"{_FUNCTION}, counts binary, best binary"), "alignment-counts")


def _spread(buckets: DataFrame, groups: int) -> DataFrame:
    """Every bucket once for each node."""
    return buckets.withColumn("node", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))


def pair_counts(table: DataFrame, base: int) -> DataFrame:
    """``a, b, n_docs, best`` of every linked pair of ids."""

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for keys, many, best in zip(*[c.to_pylist() for c in batch.columns]):
                keys = np.frombuffer(keys, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys // base, pa.int32()), pa.array(keys % base, pa.int32()), pa.array(np.frombuffer(many, "<i8")), pa.array(np.frombuffer(best, bool))],
                    ["a", "b", "n_docs", "best"])

    return table.select("keys", "counts", "best").mapInArrow(rows, "a int, b int, n_docs bigint, best boolean")


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _scores(batch, look_up, widths, names, whole: bool):
    """The result rows of documents; ``look_up`` gives the counts and the best flags of keys."""
    from hashlib import sha256

    import numpy as np
    import pyarrow as pa

    for start, till, a, b, many_a, many_b in _slices(batch):
        links, n = Links(a, b, many_a, many_b, widths, len(widths[1])), till - start
        sums = np.zeros((3, n), np.int64)
        for group, key, times in links.pairs():
            count, best = look_up(key)
            doc = links.documents(group)
            for i, value in enumerate((times, times * best, times * count)):
                running = np.concatenate([[0], np.cumsum(value)])
                ends = doc.searchsorted(np.arange(n + 1))
                sums[i] += running[ends[1:]] - running[ends[:-1]]
        groups = np.diff(links.group_ends, prepend=0)
        written = links.written(names)
        digests = [sha256(w.encode()).hexdigest() if w else "" for w in written]
        columns = [batch.column("doc_id").slice(start, n), *[pa.array(np.asarray(c, np.int64)) for c in (many_a, many_b, groups, *sums)], pa.array(digests, pa.string())]
        columns += [pa.array(written, pa.string())] if whole else []
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_NUMBERS, "groups_sha256", *(["groups"] if whole else [])])


def align(docs: DataFrame, bytelevel: str, pieces: bytes, *, id: str = "doc_id", text: str = "text", whole: bool = True,
          broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Two tables: per row of ``docs`` its alignment, and all linked pairs of ids with their counts.

    ``bytelevel`` is the text of a byte-level tokenizer's JSON file (A, which encodes a blank and the text), ``pieces`` a sentencepiece
    model (B, which adds the blank). Rows: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and, with ``whole``,
    ``groups``. The count of a pair is the number of rows, copies each, that hold it linked. Null and empty texts, and texts whose bytes
    one of the tokenizers changes, have no tokens: zeros and an empty string. Other columns are not read; an empty table gives empty tables.
    """
    import pyarrow as pa

    own = Coders(bytelevel, pieces)
    base = len(own.bytes_b)
    if len(own.bytes_a) * base > 1 << 32:
        raise ValueError("vocabularies whose pairs do not fit in four bytes")
    written = encoded(docs, bytelevel, pieces, id=id, text=text)
    pairs = stage(_block_pairs(written, bytelevel, pieces), "alignment-pairs")
    groups = max(1, math.ceil(pairs.select("block").distinct().count() / FAN))
    asked = pairs.withColumn("node", _node(groups))
    table = counts(asked, groups, base)
    size = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kind = written.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in _NUMBERS) + ", groups_sha256 string" + (", groups string" if whole else "")

    def names_of(widths):
        return [f"{i}{sign}" for sign in ",|;" for i in range(max(map(len, widths)))]

    def known(rows):
        import numpy as np

        found = Table(rows, base)
        many = np.concatenate([np.frombuffer(r["counts"], "<i8") for r in sorted(rows, key=lambda r: r["bucket"])] or [np.zeros(0, "<i8")])
        best = np.concatenate([np.frombuffer(r["best"], bool) for r in sorted(rows, key=lambda r: r["bucket"])] or [np.zeros(0, bool)])

        def look_up(keys):
            at = found.find(keys)
            if (at < 0).any():
                raise RuntimeError("a pair without a number")
            return many[at], best[at]

        return look_up

    if size * _ENTRY <= broadcast_bytes:
        shared = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in table.collect()])

        @tidy
        def score(batches):
            widths = _widths(bytelevel, pieces)
            names, look_up = names_of(widths), known(shared.value)
            for batch in batches:
                yield from _scores(batch, look_up, widths, names, whole)

        return written.select("doc_id", "a", "b").mapInArrow(score, schema), pair_counts(table, base)

    def answer(key, blocks, function):
        import numpy as np

        kinds, names = [pa.int64(), pa.binary(), pa.binary(), pa.binary()], ["block", "keys", "counts", "best"]
        look_up, rows = known(function.to_pylist()) if blocks.num_rows else None, []
        for block, keys in zip(blocks.column("block").to_pylist(), blocks.column("keys").to_pylist()):
            many, best = look_up(np.frombuffer(keys, "<u4").astype(np.int64))
            rows.append((block, keys, many.tobytes(), best.tobytes()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=names)

    @tidy
    def meet(block, answers):
        import numpy as np

        widths = _widths(bytelevel, pieces)
        read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in answers.column(name).to_pylist()] or [np.zeros(0, kind)])
        keys, many, best = read("keys", "<u4").astype(np.int64), read("counts", "<i8"), read("best", bool)
        order = np.argsort(keys, kind="stable")
        keys, many, best = keys[order], many[order], best[order]

        def look_up(asked):
            at = keys.searchsorted(asked)
            if len(asked) and (at.max() >= len(keys) or (keys[at] != asked).any()):
                raise RuntimeError("a pair without an answer")
            return many[at], best[at]

        made = [part for batch in block.to_batches() for part in _scores(batch, look_up, widths, names_of(widths), whole)]
        return pa.Table.from_batches(made)

    answers = asked.select("bucket", "node", "block", "keys").groupBy("bucket", "node").cogroup(
        _spread(table, groups).groupBy("bucket", "node")).applyInArrow(answer, "block bigint, keys binary, counts binary, best binary")
    scored = written.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)
    return scored, pair_counts(table, base)
