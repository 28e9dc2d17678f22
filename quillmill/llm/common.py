"""What the operators of this subpackage share: inputs, scratch tables, Arrow text buffers."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import settle, shared_dir  # noqa: F401  (the operators take them from here)

#: White space of the word and line contracts: space and the bytes 09 to 0D.
BLANK = b" \t\n\x0b\x0c\r"
#: Rows and bytes of an Arrow batch; they bound a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: texts are long, so a batch of the default 10,000 rows can take a worker's memory.

    A batch is bounded in bytes too; a longer text is a batch of its own. Workers also get the folder that holds this package
    on their path, as the driver has it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, held]))


def parts(df: DataFrame) -> int:
    """Number of shuffle partitions to deal by, as the session says."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators read, as doc_id and text; other columns are never touched."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of a column, one after the other, and where each starts (one more at the end). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[bytes]:
    """Each string of a column as bytes; nulls are empty."""
    data, at = utf8(column)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def batches(rows: Iterator[pa.RecordBatch], size: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about size bytes of text at most, or one row."""
    for b in rows:
        if not b.num_rows:
            continue
        _, at = utf8(b.column(b.schema.get_field_index(column)))
        start = 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + size, "right")) - 1)
            yield b.slice(start, end - start)
            start = end
