"""Line dedup over levelled sorted runs of line hashes.

A run is a table (h1, h2, n, last) that is bucketed and sorted by a line's hash: n distinct documents of its batch hold the
line, and last is the largest doc_id among them, or null if an earlier run had the line. Batches are ranges of doc_ids,
the greatest first, so the first run that has a line also has the last document that holds it. Each new batch is reduced to
one row a line and merge-anti-joined with the runs there are: what is left are its new lines, which name their last holder,
the others only add to the counts. It then becomes a run of level 0. When a level has FANOUT runs, they are merged to one
run of the next level. Runs are read bucket by bucket in their order, so old runs are neither shuffled nor sorted again.
The merge of all runs says which lines go, and which document keeps each.

Lines of a third of all documents: a line's rows are counted before they are shuffled. Of the lines that go, those with more
than one row in HOT_SHARE (so there are fewer than HOT_SHARE of them) are sent to all tasks; only the others are shuffled.

Defined results: a null or empty text is one empty line. A document is a doc_id: several rows of one doc_id count once for a
line, and all lose the line if a larger doc_id holds it. Rows whose doc_id is null count for nothing and lose no line. Lines
shorter than min_chars are never dropped. Extra columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANK, batches, fresh_name, id_text, parts, settle, shared_dir, table, texts, tune

FANOUT = 2
BATCHES = 4
HOT_SHARE = 10_000
KEY = ["h1", "h2"]
#: Bucketed tables are read in their buckets' order, without another sort, while this is set.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # of bytes, lower() changes A-Z alone


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id): the distinct long lines of each document, as 128-bit hashes."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            keys, owner = [], []
            for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                own = {k for line in text.split(b"\n") if len(line) >= min_chars and long_enough(k := line_key(line), min_chars)}
                keys += [xxhash.xxh3_128_digest(k) for k in own]
                owner += [doc] * len(own)
            h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.record_batch([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(owner, pa.int64())], names=["h1", "h2", "doc_id"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long")


class LineRuns:
    """The levelled runs; levels[i] lists the runs of level i, oldest first."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout, self.levels = spark, buckets, max(2, fanout), [[]]

    def runs(self) -> list[DataFrame]:
        """All runs, the oldest first: those of higher levels are older."""
        return [r for level in reversed(self.levels) for r in level]

    def _written(self, run: DataFrame) -> DataFrame:
        """A run in the shared folder: one sorted file a bucket. The catalog's entry isn't needed after it is read back."""
        path = shared_dir(self.spark)
        name = f"line_run_{path.rsplit('/', 1)[-1]}"
        held = self.spark.conf.get(ORDERED, "false")
        self.spark.conf.set(ORDERED, "true")
        try:
            run.select(*KEY, "n", "last").write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        finally:
            self.spark.conf.set(ORDERED, held)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return out

    def fresh(self, run: DataFrame) -> DataFrame:
        """run without the last holders of lines that some run has: a merge join with each run."""
        known = []
        for k, r in enumerate(self.runs()):
            known.append(F.col(f"known{k}").isNotNull())
            run = run.join(r.select(*KEY, F.lit(True).alias(f"known{k}")), KEY, "left")
        some = F.lit(False)
        for x in known:
            some = some | x
        return run.select(*KEY, "n", F.when(~some, F.col("last")).alias("last"))

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of distinct (h1, h2, doc_id), all less than those before; returns its run."""
        run = self._written(self.fresh(lines.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))))
        self.levels[0].append(run)
        self.compact()
        return run

    def compact(self) -> None:
        i = 0
        while i < len(self.levels):
            if len(self.levels[i]) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._merged(self.levels[i]))
                self.levels[i] = []
            i += 1

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several, oldest first, two by two: a merge of sorted buckets."""
        out = runs[0]
        for r in runs[1:]:
            other = r.select(*KEY, F.col("n").alias("n2"), F.col("last").alias("last2"))
            none = F.lit(0).cast("long")
            out = self._written(out.join(other, KEY, "full_outer").select(*KEY, (F.coalesce("n", none) + F.coalesce("n2", none)).alias("n"), F.coalesce("last", "last2").alias("last")))
        return out

    def totals(self) -> DataFrame:
        """All runs as one; last is never null there."""
        self.levels = [[self._merged(self.runs())]]
        return self.levels[0][0]


def lost_lines(spark: SparkSession, docs: DataFrame, min_chars: int, min_docs: int, n_batches: int) -> DataFrame:
    """(doc_id, h1, h2): the lines that documents lose. docs: (doc_id, text)."""
    at = F.percentile_approx("doc_id", [k / n_batches for k in range(1, n_batches)], 1000) if n_batches > 1 else F.array().cast("array<long>")
    bounds = sorted(set(docs.agg(at.alias("at")).first().at or []))
    batch = sum((F.when(F.col("doc_id") < b, 1).otherwise(0) for b in bounds), F.lit(0))
    # Distinct by all three columns: a frequent line is dealt by its documents.
    lines = settle(line_hashes(docs.filter("doc_id is not null"), min_chars).distinct().withColumn("batch", batch), "batch")
    runs = LineRuns(spark, parts(docs))
    for k in range(len(bounds) + 1):
        runs.add(lines.filter(F.col("batch") == k).drop("batch"))
    common = settle(runs.totals().filter(F.col("n") >= min_docs))
    limit = max(min_docs, lines.count() // HOT_SHARE)
    hot = F.broadcast(common.filter(F.col("n") > limit).select(*KEY, "last"))  # fewer than HOT_SHARE rows
    rest = lines.join(hot, KEY, "left_anti").join(common.filter(F.col("n") <= limit).select(*KEY, "last"), KEY)
    return lines.join(hot, KEY).select("doc_id", *KEY, "last").unionByName(rest.select("doc_id", *KEY, "last")).filter(F.col("doc_id") < F.col("last")).drop("last")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, n_batches: int = BATCHES) -> DataFrame:
    """docs with text_col rewritten, and two more columns, n_lines and n_dropped (renamed with leading _ if docs has them)."""
    tune(docs.sparkSession)
    lost = lost_lines(docs.sparkSession, id_text(docs, id_col, text_col), min_chars, min_docs, n_batches)
    lost = lost.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct(*KEY)).alias("_lost"))
    extra = fresh_name(docs, "lost")
    n_lines, n_dropped = (c if c not in {x.lower() for x in docs.columns} else fresh_name(docs, c) for c in ("n_lines", "n_dropped"))
    joined = docs.join(lost.select(F.col("_id").alias(f"{extra}_id"), F.col("_lost").alias(extra)), F.col(id_col) == F.col(f"{extra}_id"), "left").drop(f"{extra}_id")
    at = docs.columns.index(text_col)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, column=text_col):
            out, n, gone = [], [], []
            drops = b.column(b.num_columns - 1)
            for text, lost in zip(texts(b.column(at)), drops, strict=True):
                kept = split = text.split(b"\n")
                if lost.is_valid:
                    h = {(x["h1"], x["h2"]) for x in lost.as_py()}
                    kept = []
                    for line in split:
                        if len(line) < min_chars or not long_enough(k := line_key(line), min_chars) or tuple(np.frombuffer(xxhash.xxh3_128_digest(k), "<i8").tolist()) not in h:
                            kept.append(line)
                out.append(b"\n".join(kept))
                n.append(len(split))
                gone.append(len(split) - len(kept))
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            columns[at] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.record_batch([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=names)

    schema = T.StructType([*(f if f.name != text_col else T.StructField(text_col, T.StringType()) for f in docs.schema.fields), T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    names = schema.names
    return joined.mapInArrow(run, schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_OP3 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ln
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.k IS NOT NULL AND doc_id < c.last) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE c.k IS NULL OR doc_id >= c.last), '')) AS kept_sha256
FROM keyed LEFT JOIN common c ON keyed.k = c.k
GROUP BY doc_id
"""
