"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orderlens.operators.staging import stage


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``links`` (columns ``a`` and ``b``); a component is named by its smallest node.

    In every round each node with a smaller neighbour hooks on to the smallest one, paths are shortened by
    following parents, and both ends of all links move to their parents; links inside a component vanish
    and equal links merge, so a node with very many links is gone after few rounds. Every round is written to the shared
    folder, so lineage stays short. No links give no rows. Nulls are no nodes.
    """
    def simple(df):
        ends = df.filter(F.col("a") != F.col("b"))
        return ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    open_ = stage(simple(links.select("a", "b")), "links")
    labels = open_.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not open_.isEmpty():
        parent = open_.groupBy("a").agg(F.min("b").alias("up"))
        for _ in range(2):
            above = parent.select(F.col("a").alias("_a"), F.col("up").alias("_up"))
            parent = parent.join(above, parent["up"] == above["_a"], "left").select("a", F.coalesce("_up", "up").alias("up"))
        parent = stage(parent.select(F.col("a").alias("_from"), F.col("up").alias("_to")), "parents")
        labels = stage(labels.join(parent, F.col("component") == F.col("_from"), "left").select(
            "node", F.coalesce("_to", "component").alias("component")), "labels")
        moved = open_.join(parent, F.col("a") == F.col("_from")).select(F.col("_to").alias("a"), "b")
        moved = moved.join(parent, F.col("b") == F.col("_from"), "left").select("a", F.coalesce("_to", "b").alias("b"))
        open_ = stage(simple(moved), "links")
    return labels
