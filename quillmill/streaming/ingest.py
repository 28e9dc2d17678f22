"""Optional additions: papers ingested as files land, each DOI once within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landed(spark: SparkSession, path: str, schema, fmt: str = "json", per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def first_within(papers: DataFrame, at: str, delay: str = "7 days", key: str = "doi") -> DataFrame:
    """The first row of each key; keys older than the watermark are forgotten, which bounds the state."""
    return papers.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def to_zone(papers: DataFrame, path: str, checkpoint: str, partitions: tuple[str, ...] = ("database",)):
    return papers.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*partitions).outputMode("append").trigger(availableNow=True).start()


def arrivals(papers: DataFrame, at: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """How many papers of each database arrived in each window."""
    return papers.withWatermark(at, delay).groupBy(F.window(at, window), "database").agg(F.count("*").alias("n"))
