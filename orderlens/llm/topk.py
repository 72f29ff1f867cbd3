"""Exact top-k search by inner product, block at a time.

Vectors are ordered by id and cut into blocks; every component is a term, and a block keeps the largest and
the smallest value of each term. The bound of a block for a query is the sum over terms of the query's
weight times the largest value (the smallest, for a negative weight). The blocks of a run are taken a few at a time in the
order of their bounds and scored through their forward indexes (plain matrices); a block whose bound lies below the k-th
score of a query so far is left out for it. Blocks whose bound equals it are scored, as ties go to smaller ids.

Queries meet the vectors in cells: a group of queries and a group of vectors. Each cell is one partition of an ordinary shuffle.
Its task holds the queries and their best k so far and streams the vectors, run by run; a cell gives at most k rows per query,
from which the best k are taken. A group of queries is bounded in bytes, so nothing but a few totals reaches the driver,
and nothing is broadcast. Vectors are shuffled once per group of queries, queries once per group of vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orderlens.operators.staging import stage

from .memory import tidy

BLOCK = 128
RUN = 32  # blocks in a run
STEP = 8  # blocks that are scored at once
QUERIES = 1024  # queries that are scored at once
GROUP = 1 << 18  # vectors in a group, about
_SPREAD = 64  # groups of a smaller table, at most
_CHUNK = 1024  # neighbouring vectors that go to the same group
_HELD = 64 * 1024 * 1024  # bytes of the queries of a group, and of their best k


def whole_numbers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, x as double; null if the vector or a component is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    numbers = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return F.when(vector.isNotNull() & good, numbers)


class _Best:
    """The best k (score, id) so far of every query of a group, for vectors of one length."""

    def __init__(self, query_ids, queries, k: int, block: int):
        import numpy as np

        self.ids, self.queries, self.k, self.block = query_ids, queries, k, block
        self.least = np.iinfo(np.int64).min  # the score of a place that is not taken yet
        self.scores = np.full((len(query_ids), k), self.least)
        self.found = np.full((len(query_ids), k), np.iinfo(np.int64).max)
        self.largest = float(np.abs(queries.astype(np.float64)).max(initial=0))
        self.longest = float(np.sqrt((queries.astype(np.float64) ** 2).sum(1).max(initial=0)))
        self.cast: dict = {}

    def _as(self, kind):
        if kind not in self.cast:
            self.cast = {kind: self.queries.astype(kind)}
        return self.cast[kind]

    def take(self, ids, matrix) -> None:
        """Score a run: vectors in the order of their ids."""
        import numpy as np

        wide = matrix.astype(np.float64)
        # Whole numbers below 2 ** 24 and 2 ** 53 are exact in floats and doubles; no partial sum exceeds the product of the lengths.
        length = self.longest * float(np.sqrt((wide ** 2).sum(1).max())) * (1 + 1e-9)
        bound = self.largest * float(np.abs(wide).max(initial=0)) * max(1, matrix.shape[1])
        exact = np.float32 if length < 2 ** 24 else np.float64 if bound < 2 ** 53 else np.int64
        rough = np.float64 if bound < 2 ** 53 else np.int64
        starts = np.arange(0, len(ids), self.block)
        tops, bottoms = (f.reduceat(matrix, starts, axis=0).astype(rough) for f in (np.maximum, np.minimum))
        vectors, queries = matrix.astype(exact), self._as(exact)
        for a in range(0, len(self.ids), QUERIES):
            asking = slice(a, a + QUERIES)
            weights = self.queries[asking].astype(rough)
            bounds = np.maximum(weights, 0) @ tops.T + np.minimum(weights, 0) @ bottoms.T
            order = np.argsort(-bounds.max(0), kind="stable")
            for s in range(0, len(order), STEP):
                chosen = order[s:s + STEP]
                reach = bounds[:, chosen] >= self.scores[asking, -1:]
                rows, blocks = np.flatnonzero(reach.any(1)), np.sort(chosen[reach.any(0)])
                if len(rows):
                    at = np.concatenate([np.arange(b * self.block, min((b + 1) * self.block, len(ids))) for b in blocks])
                    self._merge(a + rows, queries[a + rows] @ vectors[at].T, ids[at])

    def _merge(self, rows, scores, ids) -> None:
        """Take the ``scores`` of the queries at ``rows`` with the vectors ``ids``; a vector is not found for its own id."""
        import numpy as np

        kth = self.scores[rows, -1]
        limit = kth.astype(scores.dtype)
        if scores.dtype != np.int64:
            limit[kth == self.least] = -np.inf
        new = np.flatnonzero(kth == self.least)
        if len(new) and len(ids) > 2 * self.k:  # the k-th of the step already bounds a query that has fewer than k yet
            others = np.where(ids[None, :] == self.ids[rows[new], None], limit[new, None], scores[new])
            limit[new] = np.partition(others, -self.k, axis=1)[:, -self.k]
        q, v = np.divmod(np.flatnonzero(scores >= limit[:, None]), len(ids))
        kept = ids[v] != self.ids[rows[q]]
        q, v = q[kept], v[kept]
        if not len(q):
            return
        values, keys = scores[q, v].astype(np.int64), ids[v]
        sort = np.lexsort((keys, -values, q))
        q, values, keys = q[sort], values[sort], keys[sort]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        q, values, keys, place = q[kept], values[kept], keys[kept], place[kept]
        touched, row = np.unique(q, return_inverse=True)
        both = np.full((len(touched), 2 * self.k), self.least)
        names = np.full((len(touched), 2 * self.k), np.iinfo(np.int64).max)
        both[:, :self.k], names[:, :self.k] = self.scores[rows[touched]], self.found[rows[touched]]
        both[row, self.k + place], names[row, self.k + place] = values, keys
        # The complement turns the order round without running over.
        first = np.lexsort((names, ~both), axis=1)[:, :self.k]
        self.scores[rows[touched]] = np.take_along_axis(both, first, 1)
        self.found[rows[touched]] = np.take_along_axis(names, first, 1)

    def rows(self, most: int = 10_000):
        """Arrays of query id, vector id and score, some thousand rows each."""
        import numpy as np

        step = max(1, most // self.k)
        for a in range(0, len(self.ids), step):
            scores = self.scores[a:a + step]
            q, place = np.nonzero(scores != self.least)
            if len(q):
                yield self.ids[a:a + step][q], self.found[a:a + step][q, place], scores[q, place]


def _runs(batches, most: int):
    """``(cell, kind, dim), ids, matrix`` from sorted rows: all neighbours of a kind, for the vectors at most ``most`` of them."""
    import numpy as np

    at, held, count = None, [], 0

    def whole():
        return at, np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held])

    for batch in batches:
        cells, kinds, dims, ids = (batch.column(i).to_numpy() for i in range(4))
        numbers = batch.column(4).flatten().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0) | (np.diff(dims) != 0)) + 1
        ends = np.concatenate([[0], np.cumsum(dims.astype(np.int64))])
        for a, b in zip([0, *cuts], [*cuts, len(ids)]):
            if a == b:
                continue
            key = int(cells[a]), int(kinds[a]), int(dims[a])
            if held and key != at:
                yield whole()
                held, count = [], 0
            at = key
            matrix = numbers[ends[a]:ends[b]].reshape(b - a, key[2])
            while a < b:
                n = b - a if key[1] == 0 else min(b - a, most - count)
                held.append((ids[a:a + n], matrix[:n]))
                a, matrix, count = a + n, matrix[n:], count + n
                if key[1] and count == most:
                    yield whole()
                    held, count = [], 0
    if held:
        yield whole()


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id: str = "vec_id", vector: str = "embedding",
           block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest scores of every query (all, if fewer), from rank 1.

    ``queries`` are rows like ``vectors``; a vector is not a candidate for its own id. Null ids, and vectors that are
    null or hold null or non-finite components, take no part; vectors of different lengths do not meet. Repeated
    rows count as often as they occur, on both sides, and the rows of one query id share its ``k`` ranks. Ties go to the smaller id. Empty tables give an empty table.
    """
    def prepared(df, label):
        numbers = df.select(F.col(id).cast("bigint").alias("id"), whole_numbers(F.col(vector)).alias("numbers"))
        kept = numbers.filter(F.col("id").isNotNull() & F.col("numbers").isNotNull())
        return stage(kept.withColumn("_at", F.monotonically_increasing_id()), label)

    def totals(df):
        largest = F.greatest(F.array_max("numbers"), F.bitwise_not(F.array_min("numbers")))
        return df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("numbers")), F.lit(0)), F.coalesce(F.max(largest), F.lit(0))).first()

    every, asked = prepared(vectors, "topk-vectors"), prepared(queries, "topk-queries")
    (n_vectors, _, most_v), (n_queries, dim, most_q) = totals(every), totals(asked)
    number = next((kind for kind, bits in (("smallint", 15), ("int", 31)) if max(most_v, most_q) < 1 << bits), "bigint")
    # Groups of queries are bounded by what a task holds of them, groups of vectors by the work of a task.
    at_once = max(1, _HELD // max(8 * dim, 16 * k))
    query_groups = max(1, -(-n_queries // at_once))
    tasks = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vector_groups = max(1, -(-n_vectors // GROUP), min(-(-n_vectors // _CHUNK), -(-tasks // query_groups), _SPREAD))

    def dealt(df, kind, own, groups, others, width):
        """Every row once for each group of the other side; ``own`` is the place of its own group in a cell's number."""
        group = F.pmod(F.xxhash64(F.shiftright("_at", width)), F.lit(groups))
        other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        numbers = F.col("numbers").cast(f"array<{number}>").alias("numbers")
        rows = df.select("id", numbers, group.alias("_own"), other.alias("_other"))
        cell = F.col("_own") * others + F.col("_other") if own else F.col("_other") * groups + F.col("_own")
        return rows.select(cell.cast("int").alias("cell"), F.lit(kind).alias("kind"), F.size("numbers").alias("dim"), "id", "numbers")

    # A cell is numbered by its group of vectors, then its group of queries.
    both = dealt(asked, 0, False, query_groups, vector_groups, 0).unionAll(
        dealt(every, 1, True, vector_groups, query_groups, _CHUNK.bit_length() - 1))
    cells = both.repartitionById(vector_groups * query_groups, F.col("cell")).sortWithinPartitions("cell", "kind", "dim", "id")

    @tidy
    def score(batches):
        import pyarrow as pa

        def results(best):
            for held in best.values():
                for row in held.rows():
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in row], ["query_id", "vec_id", "score"])

        cell, best = None, {}
        for (at, kind, dim), ids, matrix in _runs(batches, RUN * block):
            if at != cell:
                yield from results(best)
                cell, best = at, {}
            if kind == 0:
                best[dim] = _Best(ids, matrix, k, block)
            elif dim in best:
                best[dim].take(ids, matrix)
        yield from results(best)

    scored = cells.mapInArrow(score, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
