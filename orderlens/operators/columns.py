"""Column renaming and merging."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..functions import strip


def coalesce_same_named(df: DataFrame) -> DataFrame:
    """Merge columns that share a name: per row, the leftmost value that is present."""
    names = df.columns
    if len(set(names)) == len(names):
        return df
    numbered = df.toDF(*[f"_{i}" for i in range(len(names))])
    merged = []
    for name in dict.fromkeys(names):
        parts = [F.col(f"_{i}") for i, other in enumerate(names) if other == name]
        merged.append(F.coalesce(*parts).alias(name))
    return numbered.select(*merged)


def apply_mapping(df: DataFrame, mapping: Mapping[str, str | None]) -> DataFrame:
    """Rename source columns to standard fields. Columns without a field are kept as they
    are, sources that do not exist are ignored, and no source may serve two fields."""
    chosen = {field: source for field, source in mapping.items() if source and source in df.columns}
    if len(set(chosen.values())) != len(chosen):
        raise ValueError("one source column cannot be mapped to several standard fields")
    fields = {source: field for field, source in chosen.items()}
    return df.toDF(*[fields.get(name, name) for name in df.columns])


def fill_after_sales_status(df: DataFrame, mapping: Mapping[str, str | None]) -> DataFrame:
    """An export with an after-sales column leaves it empty for orders without a claim:
    those orders are complete."""
    source = mapping.get("status")
    if not source or vocab.AFTERSALE_MARK not in source or "status" not in df.columns:
        return df
    status = F.col("status")
    no_claim = status.isNull() | strip(status.cast("string")).isin(*vocab.BLANK_AFTERSALE)
    return df.withColumn("status", F.when(no_claim, F.lit(vocab.AFTERSALE_DONE)).otherwise(status))
