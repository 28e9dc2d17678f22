"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Every byte starts three triplets, taken from a window of five bytes; each is hashed by tabulation into one of BUCKETS
buckets. The digest is the logarithmic length (two hex digits) and, for each bucket, which quarter of the sorted bucket
counts it falls in (two bits). Two digests differ by the sum of the buckets' quarter distances (two for opposite ends
count double) and a bounded part for length; likeness is 1 less the share of the greatest difference.

Defined results: a null text is empty; an empty text has an all-zero digest. The next document is the next row by
(doc_id, sha-256 of the text), null ids first; after the last comes the first. Repeated rows follow each other. Other
columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, sha256, table, texts, tune

BUCKETS = 128
#: Offsets of the second and third byte of each triplet.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))
#: Distance of two quarters, by their difference.
STEPS = np.array([0, 1, 2, 6])
#: What each unit of logarithmic length counts, and at most.
LENGTH_STEP, LENGTH_MOST = 12, 120
_T = np.random.default_rng(20240117).integers(0, BUCKETS, (1 + 2 * len(TRIPLETS), 256)).astype(np.uint16 if BUCKETS > 256 else np.uint8)


def counts(data: bytes) -> np.ndarray:
    """How many of the triplets fall in each bucket."""
    b = np.frombuffer(data, np.uint8)
    out = np.zeros(BUCKETS, np.int64)
    if len(b) < 3:
        return out
    first = _T[0][b]
    for k, (x, y) in enumerate(TRIPLETS):
        if (n := len(b) - y) > 0:
            out += np.bincount(first[:n] ^ _T[1 + 2 * k][b[x : x + n]] ^ _T[2 + 2 * k][b[y : y + n]], minlength=BUCKETS)
    return out


def digest(data: bytes) -> bytes:
    """One byte of length, then four buckets a byte."""
    c = counts(data)
    q = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (c > q[0]).astype(np.uint8) + (c > q[1]) + (c > q[2])
    code = code.reshape(-1, 4)
    return bytes([min(255, round(8 * math.log2(1 + len(data))))]) + (code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).astype(np.uint8).tobytes()


def _quarters(d: bytes) -> np.ndarray:
    x = np.frombuffer(d, np.uint8)[1:]
    return np.stack([x & 3, x >> 2 & 3, x >> 4 & 3, x >> 6], 1).ravel().astype(np.int64)


def difference(a: bytes, b: bytes) -> int:
    """From 0 to MOST."""
    return int(STEPS[np.abs(_quarters(a) - _quarters(b))].sum()) + min(LENGTH_MOST, LENGTH_STEP * abs(a[0] - b[0]) // 8)


MOST = int(STEPS[-1]) * BUCKETS + LENGTH_MOST


def likeness(a: bytes, b: bytes) -> float:
    return 1.0 - difference(a, b) / MOST


def edited(text: str, following: str) -> str:
    """text with its last half of code points replaced by the first as many, or all, of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_runs(docs: DataFrame, n_runs: int) -> DataFrame:
    """(run, ord, doc_id, text): rows cut by doc_id into runs, each followed by the first row of the next (ord 1).

    Only the cuts, one id a run, come to the driver; texts are shuffled once.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n_runs for i in range(1, n_runs)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts)) if n_runs > 1 else []
    run = F.lit(0)
    if cuts:
        run = F.coalesce(F.expr(f"array_size(filter(array({','.join(f'{c}L' for c in cuts)}), c -> c <= doc_id))"), F.lit(0))
    # One row a run: the least (doc_id, sha) of each.
    low = {r[0]: (r[1], r[2]) for r in docs.select(run.alias("run"), F.struct(F.col("doc_id").alias("a"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("b")).alias("k")).groupBy("run").agg(F.min("k").alias("k")).select("run", "k.a", "k.b").collect()}
    order = sorted(low)
    if not order:
        return docs.select(F.lit(0).alias("run"), F.lit(0).alias("ord"), "doc_id", "text")
    before = {order[i]: order[i - 1] for i in range(len(order))}  # the first run's head follows the last run
    heads = spark.createDataFrame([(low[r][0], low[r][1], before[r]) for r in order], "head_id long, head_sha string, before int")
    rows = docs.withColumn("run", run.cast("int"))
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    ghosts = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head_id")) & (sha == F.col("head_sha"))).select(F.col("before").alias("run"), F.lit(1).alias("ord"), "doc_id", "text")
    return rows.select("run", F.lit(0).alias("ord"), "doc_id", "text").unionByName(ghosts)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row of docs."""
    spark = docs.sparkSession
    tune(spark)
    n = max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = in_runs(id_text(docs, id_col, text_col), n).repartition(max(1, n // 4), "run").sortWithinPartitions("run", "ord", "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: run, doc_id, text, digest
        for b in rows:
            out = []
            for r, o, doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), texts(b.column(3)), strict=True):
                text, own = raw.decode("utf-8", "replace"), digest(raw)
                if held is not None and held[0] == r:
                    new = edited(held[2], text).encode()
                    print_ = digest(new)
                    out.append((held[1], len(held[2]), sha256(new), held[3].hex(), print_.hex(), likeness(held[3], print_), likeness(held[3], own)))
                held = (r, doc, text, own) if o == 0 else None
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
