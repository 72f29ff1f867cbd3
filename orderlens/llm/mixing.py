"""A mixture of sources at target weights by weighted fair queueing.

Every source is a queue of shuffled documents. A document's virtual finish time is the number of
tokens its source has sent up to it, divided by the source's target weight. Taking documents in
the order of these times serves all sources in proportion to their weights at every moment, so
the order can be cut at any budget.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

from orderlens.operators.staging import stage

from .sequences import number

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights: list[int], total: int, most: int) -> list[Fraction]:
    """Shares of ``total`` by weight; a source stops at ``most`` times its size, and what is too much goes to the
    others by weight, until none is above."""
    found: list[Fraction | None] = [None] * len(sizes)
    open_, left = set(range(len(sizes))), Fraction(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        for i in full or open_:
            found[i] = Fraction(most * sizes[i]) if full else left * weights[i] / weight
        left -= sum(found[i] for i in full)
        open_ = open_ - full if full else set()
    return found


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", id: str = "doc_id",
        text: str = "text", source: str = "source", shuffle: str | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``docs``.

    The sources in code point order, null last, get ``weights`` in turn and share as many words as there are in all; a
    source stops at ``most`` times its size. ``taken`` is the number of words the mixture takes of the row: its
    size times the number of its passes that come before the budget ends.

    The shuffle is a hash of seed, ``shuffle`` (default: the id) and text, so reruns agree; equal rows follow each other. Passes are whole
    rounds over a source. A source goes over tasks in ranges, whatever its share of the rows, and so does the order
    of all finish times. Texts without words take part with size 0 and are never taken; a source without words has the
    target 0. An empty table gives an empty table. The driver holds one number per source: sources are named by the
    mixture's weights, not by the data's size.
    """
    spark = docs.sparkSession
    shuffled = F.sha2(F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col(shuffle or id).cast("string"), F.lit("")),
                                  F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))), 256)
    rows = stage(docs.select(
        F.col(id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"),
        F.substring(shuffled, 1, 16).alias("turn")), "mix-rows")
    sums = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    total = sum(r["size"] for r in sums)
    shares = targets([r["size"] for r in sums], [weights[i % len(weights)] for i in range(len(sums))], total, most)
    before, table = 0, []
    for r, share in zip(sums, shares):
        table.append((r["source"], r["source"] is None, len(table), r["size"], before, float(share)))
        before += r["size"]
    known = F.broadcast(spark.createDataFrame(
        table, "_source string, _none boolean, number int, source_size bigint, before bigint, target double"))
    same = F.col("source").eqNullSafe(F.col("_source"))
    queues = rows.join(known, same).drop("_source", "_none", "source")
    sent = number(queues, ["number", "turn", "doc_id"], totals=["size"]).withColumn(
        "sent", F.col("_to_size") - F.col("before"))
    entry = stage(sent.withColumnRenamed("_row", "entry").select(
        "entry", "doc_id", "size", "number", "source_size", "target", "sent"), "mix-queues")
    passes = entry.filter(F.col("size") > 0).select(
        "entry", "size", "number",
        F.explode(F.transform(
            F.sequence(F.lit(0), F.lit(most - 1)),
            lambda n: (F.col("sent") + n * F.col("source_size")) / F.col("target"))).alias("finish"),
        (F.col("size") / F.col("target")).alias("takes"))
    # The targets add up to the budget, so it ends before a pass that starts after its source has its target.
    ordered = number(passes.filter(F.col("finish") - F.col("takes") < 1), ["finish", "number", "entry"], totals=["size"])
    chosen = ordered.filter(F.col("_to_size") <= total).groupBy("entry").agg(F.sum("size").alias("taken"))
    return entry.join(chosen, "entry", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
