"""Written intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder. A cluster must name one,
    since a folder of one machine would be lost with that machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="orderlens-"))
    return context.getCheckpointDir()


DENSE = "zstd"  # for wide tables: less disk for some more time


def stage(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet and read it back.

    Used where several later jobs need the same expensive result, or where values such as
    row positions must not change if a task runs again. Unlike a checkpoint the table is
    columnar, so later jobs read only the columns they use.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/orderlens-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Delete a table of ``stage`` that nothing reads any more, neither later jobs nor tables made from it that are not written yet."""
    spark = staged.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in staged.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("orderlens-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_observed(df: DataFrame, label: str, totals: dict[str, Column], codec: str | None = None) -> tuple[DataFrame, dict]:
    """Like ``stage``, with ``totals`` (aggregates by name) over the rows gathered while they are written, so that no second read is needed.

    The totals are taken in the stage that writes, where each partition counts once even if its task runs again.
    """
    seen = Observation()
    staged = stage(df.observe(seen, *[total.alias(name) for name, total in totals.items()]), label, codec)
    return staged, seen.get


def cluster(df: DataFrame, key: str, label: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` once as a table in buckets by ``key`` and read it back: later groupings and joins by the key need no shuffle.

    One shuffle brings the rows of a bucket together, so every bucket is one file. The table lies in the shared folder under
    a name of its own in the session's catalog. A key with very many rows fills its bucket, whose task streams them.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"orderlens_{label}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.option("path", f"{shared_folder(spark).rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name)
