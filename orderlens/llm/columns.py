"""Inner column names that no name of the caller can clash with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def by_position(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns called c0, c1, ... and the inner name of every outer one. Helpers of the operators add
    names with an underscore before them, so neither can meet a column of the caller."""
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return inner, dict(zip(df.columns, inner.columns))


def restored(names: list[str]) -> list[Column]:
    """The columns c0, c1, ... under their outer names again."""
    return [F.col(f"c{i}").alias(name) for i, name in enumerate(names)]
