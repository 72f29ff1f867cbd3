"""Session settings that suit this library."""

from __future__ import annotations

from pyspark.sql import SparkSession

RECOMMENDED = {
    # Dates and periods are zone-free; this pins what is left to the session.
    "spark.sql.session.timeZone": "UTC",
    # Runtime choice of join, partition number and split of skewed partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles a method of more than 8000 bytes to machine code. Stages with
    # many text expressions would pass that; per-operator code is then much faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the recommended settings to a session builder."""
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder
