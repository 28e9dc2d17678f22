"""The folder that all executors share, and tables that are written there between steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path under the cluster's shared folder, spark.checkpoint.dir.

    Where no folder is set, a local run gets one of its own; a cluster must name one, as executors don't share local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        root = spark.sparkContext.getCheckpointDir()
    if "://" not in root:
        root = "file://" + root.removeprefix("file:") if root.startswith(("/", "file:/")) else root
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Arrow batches bounded in rows and bytes: a batch of the default 10,000 long texts takes a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def settle(df: DataFrame, *by: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later plans start from the files, whichever executor is lost.

    by: columns whose values get folders of their own, so that filters on them read no other files.
    """
    path = f"{shared_dir(df.sparkSession)}.parquet"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
