"""Joins of large fact tables with dimensions of unknown size and skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32
ROW = "_row"  # position of a row in its source, where a table has one


def measured_bytes(df: DataFrame) -> int:
    """Size of a table in memory, from one aggregate: row count and lengths of texts and arrays."""
    sizes = [F.lit(0)]
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            column = column.cast("string")
        elif not isinstance(field.dataType, (T.StringType, T.BinaryType)):
            continue
        sizes.append(F.coalesce(F.octet_length(column), F.lit(0)))
    text_bytes = sum(sizes[1:], sizes[0])
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(text_bytes.cast("bigint")), F.lit(0)).alias("bytes"),
    ).first()
    return row["bytes"] + row["rows"] * (16 + 16 * len(df.columns))


def join_dimension(facts: DataFrame, dimension: DataFrame, key: str, how: str = "left", *,
                   broadcast_bytes: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """Equi-join facts with a dimension on ``key`` without overloading any one task.

    The dimension is measured first. One that fits is broadcast, so that the facts are not
    shuffled at all. A larger one is repeated once per salt while each fact row takes one
    salt from its own values, which spreads the rows of a hot key over ``salts`` tasks. Fact
    rows without a key match nothing and are spread over all tasks. Identical fact rows share a
    salt; adaptive execution splits a partition that they make too large. Facts that are added up
    per key already need one salt only. The hint keeps the planner, which guesses the size from the
    files and does not see the repeats, from broadcasting the large table after all.
    """
    if measured_bytes(dimension) <= broadcast_bytes:
        return facts.join(F.broadcast(dimension), key, how)
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns])
    salt = F.when(F.col(key).isNull(), row_hash).otherwise(F.pmod(row_hash, F.lit(salts)))
    salted = facts.withColumn("_salt", salt)
    repeated = dimension.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    return salted.join(repeated.hint("merge"), [key, "_salt"], how).drop("_salt")


def first_per_key(dimension: DataFrame, key: str, value: str, order: Column | None = None) -> DataFrame:
    """First ``value`` of every non-null ``key``: by ``order``, else by the positions of the table, else in scan order.

    Scan order depends on how files are split and packed; tables loaded with positions do not.
    """
    if order is None:
        order = F.col(ROW) if ROW in dimension.columns else F.monotonically_increasing_id()
    position = order
    return (
        dimension.filter(F.col(key).isNotNull())
        .select(key, value, position.alias("_position"))
        .groupBy(key)
        .agg(F.min_by(value, "_position").alias(value))
    )
