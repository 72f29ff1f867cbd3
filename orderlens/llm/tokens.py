"""Token counts with a cache keyed by digests of content and tokenizer version."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .vocabulary import Words

_CACHE = "content binary, version string, n_tokens bigint"


def version_of(tokenizer: str) -> str:
    """Digest of everything that decides the ids: the text of the tokenizer's file."""
    return hashlib.sha256(tokenizer.encode()).hexdigest()


def content_digest(text: Column) -> Column:
    """Digest of the normalised content: no text is the empty text, and runs of blanks and line feeds, which
    this kind of tokenizer drops, are one blank."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \n]+", " "), 256))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts, one row per content and version; none before the first append."""
    try:
        stored = spark.read.schema(_CACHE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], _CACHE)
    return stored.groupBy("content", "version").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(docs: DataFrame, tokenizer: str, cache: str, *, text: str = "text") -> None:
    """Count the tokens of every distinct content that ``cache`` lacks and append the counts to it.

    Copies collapse in the map side of an aggregation before any text is shuffled, so a text that a
    third of all rows hold reaches one task once per map task. A run that is repeated, or two runs at
    once, append equal rows, which ``read_cache`` merges.
    """
    version = version_of(tokenizer)
    contents = docs.select(content_digest(F.col(text)).alias("content"), F.col(text).alias("text"))
    known = read_cache(docs.sparkSession, cache).filter(F.col("version") == version).select("content")
    distinct = contents.groupBy("content").agg(F.first("text").alias("text"))

    def count(batches):
        import pyarrow as pa

        words = Words(tokenizer, spaced=False)
        for batch in batches:
            counts = [len(ids) // 4 for ids in words.of(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    counted = distinct.join(known, "content", "left_anti").mapInArrow(count, "content binary, n_tokens bigint")
    counted.select("content", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, *, id: str = "doc_id", text: str = "text",
                 limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    ``tokenizer`` is the text of the JSON file of a tokenizer that drops white space, ``cache`` a folder
    all executors share. Misses are encoded and appended first, then all rows join their digests to the
    stored counts. Null and empty texts have no tokens; equal rows are counted each; an empty table
    gives an empty table.
    """
    encode_misses(docs, tokenizer, cache, text=text)
    rows = docs.select(
        F.col(id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
        content_digest(F.col(text)).alias("content"))
    stored = read_cache(docs.sparkSession, cache).filter(F.col("version") == version_of(tokenizer))
    return rows.join(stored.select("content", "n_tokens"), "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
