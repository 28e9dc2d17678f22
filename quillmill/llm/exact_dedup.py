"""Exact dedup: rows are grouped by a 128-bit hash of their normalised text, and texts are compared byte by byte in the groups.

Texts are normalised by putting one space for each run of white space. The hash is the first half of the SHA-256 that the
result carries anyway. The text itself is the second grouping key: of one hash, only equal bytes fall into one class, and
copies are counted before they are shuffled, so a text that a third of all rows has is sent once a task. Classes are then
joined to slim rows (id, hash, digest) by hash alone, a join whose large partitions Spark can split. Hashes that stand for
two texts or more are found from the classes, and their rows, and only theirs, are joined by the whole text.

Defined results: a null text is empty; empty texts are equal to each other, not to a text of blanks (one space). Rows whose
id is null are rows like others, but a class has a null keep_id only if all its ids are null. Of several rows with the least
id of a class, one has kept. Extra columns of any name are never read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, settle, table

#: Equal rows are counted out again in steps of so many.
STEP = 65_536


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_digest(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def content_hash(norm: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.substring(text_digest(norm), 1, 32))


def _counted_out(rows: DataFrame, n: str) -> DataFrame:
    """Each row n times, the first with again = false; no array is longer than STEP."""
    steps = rows.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / STEP))))
    left = F.least(F.lit(STEP).cast("long"), F.col(n) - F.col("step") * STEP)
    return steps.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), left))).withColumn("again", (F.col("step") > 0) | (F.col("nth") > 1)).drop("step", "nth", n)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash128: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): a row for each row of docs.

    hash128 may be any function of the normalised text: one that puts unequal texts together costs time, not rightness.
    """
    keyed = id_text(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("h", hash128(F.col("norm")))
    group = [F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    classes = settle(keyed.groupBy("h", "norm").agg(*group).drop("norm"))
    mixed = settle(classes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    slim = keyed.groupBy("doc_id", "h", text_digest(F.col("norm")).alias("text_sha256")).agg(F.count("*").alias("n_same"))
    # Most texts have no copy: their classes needn't be joined.
    found = slim.join(classes.filter("group_size > 1"), "h", "left")
    if not mixed.isEmpty():
        apart = keyed.join(mixed, "h")
        own = apart.groupBy("h", "norm").agg(*group)
        apart = apart.groupBy("doc_id", "h", "norm").agg(F.count("*").alias("n_same")).join(own, ["h", "norm"]).withColumn("text_sha256", text_digest(F.col("norm")))
        found = slim.join(mixed, "h", "left_anti").join(classes.filter("group_size > 1"), "h", "left").unionByName(apart.select(*found.columns))
    alone = F.col("group_size").isNull()
    found = found.withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    return _counted_out(found, "n_same").select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("again")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less the rows of every text but that with the least id; rows that share that id and text all stay."""
    groups = exact_groups(docs, id_col, text_col).filter("not kept").filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    gone = groups.select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_sha")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(gone["_gone_id"]) & (text_digest(normalised(docs[text_col].cast("string"))) == gone["_gone_sha"])
    return docs.join(gone, same, "left_anti")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE_OP11 = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM texts
"""
