"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector passes it if their inner product exceeds a threshold, which only a small cap
of the sphere does. The directions are a product code: a random rotation splits a vector into two halves,
each half has its own random code words, and every pair of words is a direction whose score is the sum of
two. So all directions a vector passes are listed without trying all: the words of one half in falling
order end where even the best word of the other half cannot reach the threshold.

Vectors that share a filter are verified by their cosine. The code grows with the number of vectors, so
buckets keep their size; the threshold is set on random pairs at the required cosine so that the
wanted share of them meets in a filter. Several independent codes share the work, so that this holds for
the pairs of a single tight group too and not only on average over groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orderlens.operators.staging import stage

from .components import connected

TILE = 512  # vectors of one side of a tile
CODES = 16  # independent codes, each with a share of the filters


class Code:
    """``CODES`` independent product codes for vectors of one length. Everything follows from the arguments and the seed.

    Vectors of one tight group see the same few filters of a code, so their misses are shared. The codes have rotations
    and words of their own, so a group that one code serves badly is found by the others. ``threshold`` is measured
    unless it is given.
    """

    def __init__(self, dim: int, words: int, cosine: float, found: float, threshold: float | None = None, seed: int = 7):
        import numpy as np

        self.half, self.words, self.turns = max(1, dim // 2), words, []
        unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        for number in range(CODES):
            draw = np.random.default_rng([seed, dim, words, number])
            rotation = np.linalg.qr(draw.standard_normal((dim, dim)))[0]
            self.turns.append((rotation, [unit(draw.standard_normal((words, n))) for n in (self.half, dim - self.half) if n]))
        if threshold is None:
            pairs = unit(draw.standard_normal((25 * CODES, dim)))
            side = draw.standard_normal(pairs.shape)
            side = unit(side - (side * pairs).sum(1, keepdims=True) * pairs) if dim > 1 else pairs
            threshold = self._threshold(pairs, unit(cosine * pairs + (1 - cosine ** 2) ** 0.5 * side), 1 - (1 - found) ** (1 / CODES))
        self.threshold = threshold

    def scores(self, unit, number: int):
        rotation, codes = self.turns[number]
        turned = unit @ rotation
        return [part @ code.T for part, code in zip((turned[:, :self.half], turned[:, self.half:]), codes)]

    def _threshold(self, one, other, found: float) -> float:
        """The threshold at which the share ``found`` of the pairs, dealt over the codes, has a filter that both pass."""
        import numpy as np

        meets = []
        for number in range(CODES):
            first, second = self.scores(one[number::CODES], number), self.scores(other[number::CODES], number)
            for p in range(len(first[0])):
                best = [np.argsort(-(a[p] + b[p]))[:64] for a, b in zip(first, second)]
                sums = [np.add.outer(*[s[p][w] for s, w in zip(side, best)]) if len(best) == 2 else side[0][p][best[0]] for side in (first, second)]
                meets.append(np.minimum(*sums).max())
        return float(np.quantile(meets, 1 - found))

    def decode(self, unit):
        """For every vector the sorted numbers of all filters it passes; of a code none of which it passes, its best filter."""
        import numpy as np

        each = [self._decode(unit, number) for number in range(CODES)]
        for passed in zip(*each):
            yield np.concatenate([p + number * self.words ** 2 for number, p in enumerate(passed)])

    def _decode(self, unit, number: int):
        import numpy as np

        scores = self.scores(unit, number)
        if len(scores) == 1:
            return [np.flatnonzero(s >= min(self.threshold, s.max())) for s in scores[0]]
        tops = [s.max(1, keepdims=True) for s in scores]
        threshold = np.minimum(self.threshold, tops[0] + tops[1])
        (row, left), (rows, right) = np.nonzero(scores[0] + tops[1] >= threshold), np.nonzero(scores[1] + tops[0] >= threshold)
        begin, end = np.searchsorted(rows, row), np.searchsorted(rows, row, "right")
        passed = []
        starts = np.searchsorted(row, np.arange(len(unit) + 1))
        pairs = np.r_[0, np.cumsum(end - begin)][starts]
        at = 0
        while at < len(unit):
            till = max(at + 1, int(np.searchsorted(pairs, pairs[at] + (1 << 20), "right")) - 1)
            some = slice(starts[at], starts[till])
            many = end[some] - begin[some]
            i = np.repeat(np.arange(starts[at], starts[till]), many)
            j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + begin[i]
            good = scores[0][row[i], left[i]] + scores[1][row[i], right[j]] >= threshold[row[i], 0]
            i, j = i[good], j[good]
            passed += np.split(left[i] * self.words + right[j], np.searchsorted(row[i], np.arange(at + 1, till)))
            at = till
        return passed


def _units(vectors):
    import numpy as np

    matrix = np.array(vectors, dtype=np.float64)
    scale = np.abs(matrix).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    matrix = matrix / scale
    return matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True))


def verify(ids, counts, vectors, sides, current, cosine, code):
    """Of one tile: (id, copies of linked vectors) for links that meet here first, and (id, id) that span its links.

    The filters of linked vectors are listed again rather than sent along, since few vectors link.
    """
    import numpy as np

    units = _units(vectors)
    near = units @ units.T >= cosine
    near &= ids[:, None] != ids[None, :]
    if sides is not None:
        near &= sides[:, None] != sides[None, :]
    a, b = np.nonzero(near)
    if not len(a):
        return [], []
    linked = np.unique(a)
    before = [passed[passed < current] for passed in code.decode(units[linked])]
    row = np.repeat(linked, [len(passed) for passed in before])
    _, column, many = np.unique(np.concatenate(before), return_inverse=True, return_counts=True)
    row, column = row[many[column] > 1], column[many[column] > 1]
    column = np.unique(column, return_inverse=True)[1]
    first = np.ones(len(a), dtype=bool)
    for at in range(0, column.max(initial=-1) + 1, 4096):
        some = (column >= at) & (column < at + 4096)
        earlier = np.zeros((len(ids), min(4096, column.max() + 1 - at)), dtype=np.float32)
        earlier[row[some], column[some] - at] = 1
        first &= (earlier @ earlier.T)[a, b] == 0
    links = np.bincount(a[first], weights=counts[b[first]], minlength=len(ids)).astype(np.int64)
    label = np.arange(len(ids))
    while len(a):
        lower = label.copy()
        np.minimum.at(lower, a, label[b])
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    spans = np.flatnonzero(label != np.arange(len(ids)))
    some = np.flatnonzero(links)
    return list(zip(ids[some].tolist(), links[some].tolist())), list(zip(ids[spans].tolist(), ids[label[spans]].tolist()))


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.95, found: float = 0.93, id: str = "vec_id",
                    vector: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``.

    Rows link if their cosine in double precision is at least ``cosine``; of the pairs just at it, the share
    ``found`` is expected to be found, also within one tight group, of nearer ones more, and none below it. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, as do vectors of different lengths. Equal vectors are one class
    with a number of copies, so copies are counted and never paired; rows that are equal altogether are copies
    too. A null id is no node: its row has no component unless its copies have one. An empty table gives an empty table.

    Buckets above ``TILE`` vectors are cut into tiles of two blocks each, so no task holds more than one tile.
    """
    body = F.col(vector)
    good = body.isNotNull() & F.forall(body, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(body, lambda x: x != 0)
    key = F.when(F.coalesce(good, F.lit(False)), F.struct(F.xxhash64(body).alias("x"), F.xxhash64(F.lit(1), body).alias("y")))
    rows = vectors.select(F.col(id).alias("vec_id"), key.alias("key"), body.alias("vector"))
    classes = rows.filter("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    classes = stage(classes.withColumn("class", F.monotonically_increasing_id()), "cap-classes")
    sizes = {r["dim"]: r["count"] for r in classes.groupBy(F.size("vector").alias("dim")).count().collect()}
    words = {dim: max(8, int(2 * (n / CODES) ** 0.5) + 1) for dim, n in sizes.items()}
    limits = {dim: Code(dim, words[dim], cosine, found).threshold for dim in sizes}

    kind = next(f for f in classes.schema.fields if f.name == "vector").dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"

    def code_of(codes, dim):
        if dim not in codes:
            codes[dim] = Code(dim, words[dim], cosine, found, limits[dim])
        return codes[dim]

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        codes: dict[int, Code] = {}
        for batch in batches:
            ids, copies, values = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            at, flat = values.offsets.to_numpy(), values.values.to_numpy()
            dims = np.diff(at)
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                matrix = flat[at[mine][:, None] + np.arange(dim)]
                for first in range(0, len(mine), 256):
                    part = matrix[first:first + 256]
                    passed = list(code_of(codes, dim).decode(_units(part)))
                    row = np.repeat(np.arange(len(part)), [len(p) for p in passed])
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * dim), pa.array(part[row].reshape(-1)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), dim, np.int32)), pa.array(np.concatenate(passed).astype(np.int64)), pa.array(ids[mine][first:first + 256][row]),
                         pa.array(copies[mine][first:first + 256][row]), vectors], ["dim", "filter", "class", "copies", "vector"])

    vectors_only = classes.select("class", "copies", F.col("vector").cast(f"array<{kind}>").alias("vector"))
    entries = stage(vectors_only.mapInArrow(decode, f"dim int, filter bigint, class bigint, copies bigint, vector array<{kind}>"), "cap-filters")
    full = entries.groupBy("dim", "filter").count().filter("count > 1")
    blocks = F.ceil(F.col("count") / F.lit(TILE)).cast("int")
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    tiles = entries.join(full, ["dim", "filter"]).withColumn("blocks", blocks).withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select(
        "dim", "filter", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block",
        "class", "copies", "vector")
    keys = ["dim", "filter", "low", "high"]

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        codes: dict[int, Code] = {}

        def groups():
            """Tiles, whose rows follow each other; the last of a batch may go on in the next."""
            now, held = None, []
            for batch in batches:
                columns = [batch.column(i).to_numpy() for i in range(7)]
                at, flat = batch.column(7).offsets.to_numpy(), batch.column(7).values.to_numpy()
                changes = np.zeros(batch.num_rows, bool)
                for c in columns[:4]:
                    changes[1:] |= c[1:] != c[:-1]
                starts = np.flatnonzero(np.r_[True, changes[1:]]) if batch.num_rows else []
                for i, j in zip(starts, [*starts[1:], batch.num_rows]):
                    key = tuple(int(c[i]) for c in columns[:4])
                    if key != now and held:
                        yield now, held
                        held = []
                    now = key
                    held.append((columns[4][i:j], columns[5][i:j], columns[6][i:j], flat[at[i]:at[j]].reshape(j - i, key[0])))
            if held:
                yield now, held

        def pack(lines):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*lines)], ["class", "links", "other"])

        lines = []
        for (dim, current, low, high), held in groups():
            block, ids, copies, vectors = (np.concatenate(x) for x in zip(*held))
            if len(ids) > 1:
                counted, spans = verify(ids, copies, vectors, block if low != high else None, current, cosine, code_of(codes, dim))
                lines += [(c, n, None) for c, n in counted] + [(c, None, o) for c, o in spans]
                if len(lines) > 10_000:
                    yield pack(lines)
                    lines = []
        if lines:
            yield pack(lines)

    verified = stage(tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        compare, "class bigint, links bigint, other bigint"), "cap-links")
    links = verified.filter("links is not null").groupBy("class").agg(F.sum("links").alias("links"))
    members = connected(verified.filter("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))
    named = classes.select("key", "class", "first", "copies").join(members, F.col("class") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "class"))
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    result = named.join(smallest, "component").join(links, "class", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("found"), "smallest")
    joined = rows.select("vec_id", "key").join(result, "key", "left")
    component = F.coalesce("smallest", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("found", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
