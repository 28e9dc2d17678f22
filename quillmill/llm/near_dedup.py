"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each document's distinct word shingles are hashed once; under each permutation both the least and the greatest value are
kept, so half as many permutations give a signature. Bands of the signature make buckets; there are so many bands that a
pair at the asked similarity shares no bucket with a chance below MISS. Texts with equal sets are one class first, known by
its set's hash of 128 bits. Classes that share buckets, taken transitively, are a candidate group; within groups every
pair's exact similarity is computed from the full sets, in blocks of bounded size, and linked classes' components are found.

Groups of more than BLOCK classes are cut into blocks that are compared two by two, each pair of blocks a task of its own.
First each member is compared with one pivot, the member with the fullest buckets; those linked with it needn't be compared
with each other, only with those that aren't.

Defined results: null or blank texts have no shingles, are linked with nothing and are their own component. Texts with
fewer words than a shingle are one shingle. Null doc_ids count in a class but never name it; a row without any named
member has itself (null) as component and is kept. Repeated rows (equal doc_id and text) share a class and are all kept
or all not; different texts under one doc_id are each compared. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import mix, word_units
from .common import batches, id_text, parts, settle, table, tune, utf8
from .components import components

MISS = 1e-6
BLOCK = 128
SHINGLES_AT_ONCE = 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(4)
def multipliers(n: int) -> np.ndarray:
    """Odd numbers, each a permutation of the 64-bit hashes."""
    return np.random.default_rng(77).integers(1 << 60, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def layout(percent: int) -> tuple[int, int]:
    """(rows, bands) that keep the chance to miss a pair of this similarity below MISS: long bands while they are few."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is from 1 to 100")
    for rows in (5, 4, 3, 2, 1):
        alike = (percent / 100) ** rows
        bands = 1 if alike >= 1 else math.ceil(math.log(MISS) / math.log(1 - alike))
        if bands <= 400 or rows == 1:
            break
    return rows, bands


def shingles(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of texts that lie one after the other, sorted by row and hash."""
    u, before = word_units(_LOWER[data], at)
    n = np.diff(before)
    sizes = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), sizes)
    first = before[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    u = np.concatenate([u, np.zeros(width, np.uint64)])
    h = np.zeros(len(row), np.uint64)
    for k in range(width):
        unit = u[first + k]
        if k:
            unit = np.where(k < n[row], unit, np.uint64(k))  # texts shorter than a shingle
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + unit + np.uint64(k + 1))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def signatures(row: np.ndarray, h: np.ndarray, values: int) -> np.ndarray:
    """Per row that has shingles, in order: least and greatest value under each permutation, side by side."""
    perms = -(-values // 2)
    odd = multipliers(perms)
    head = np.flatnonzero(np.diff(row, prepend=-1))
    out = np.empty((len(head), 2 * perms), np.uint64)
    a = 0
    while a < len(head):  # whole rows, about SHINGLES_AT_ONCE at a time
        b = max(a + 1, int(np.searchsorted(head, head[a] + SHINGLES_AT_ONCE)))
        lo, hi = head[a], head[b] if b < len(head) else len(h)
        own, part = h[lo:hi], head[a:b] - lo
        for j in range(perms):
            x = own * odd[j]
            out[a:b, 2 * j] = np.minimum.reduceat(x, part)
            out[a:b, 2 * j + 1] = np.maximum.reduceat(x, part)
        a = b
    return out


def bands(sig: np.ndarray, rows: int, n_bands: int) -> np.ndarray:
    """A hash of each band, with the band's number in it."""
    out = np.empty((len(sig), n_bands), np.uint64)
    for k in range(n_bands):
        x = np.full(len(sig), k + 1, np.uint64)
        for j in range(rows):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, rows * k + j])
        out[:, k] = x
    return out


def signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, row_key, n_shingles, h1, h2, bands); h1 and h2 hash the set, null if it's empty."""
    n_rows, n_bands = layout(percent)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, 4 << 20):
            row, h = shingles(*utf8(b.column(1)), width)
            n = np.bincount(row, minlength=b.num_rows)
            some = n > 0
            head = np.flatnonzero(np.diff(row, prepend=-1))
            sums = [np.zeros(b.num_rows, np.uint64) for _ in range(2)]
            if len(head):
                for s, odd in zip(sums, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), strict=True):
                    s[some] = np.add.reduceat(mix(h * np.uint64(odd)), head)
            made = bands(signatures(row, h, n_rows * n_bands), n_rows, n_bands) if len(head) else np.zeros((0, n_bands), np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, some * n_bands)).astype(np.int32)), pa.array(made.view(np.int64).ravel()))
            yield pa.record_batch([b.column(0), b.column(2), pa.array(n.astype(np.int64)), *(pa.array(s.view(np.int64), mask=~some) for s in sums), lists], names=["doc_id", "row_key", "n_shingles", "h1", "h2", "bands"])

    return docs.mapInArrow(run, "doc_id long, row_key long, n_shingles long, h1 long, h2 long, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, set) for the wanted rows (doc_id, row_key, node): all shingle hashes, sorted, as bytes."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, 4 << 20):
            row, h = shingles(*utf8(b.column(1)), width)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.record_batch([b.column(0), pa.array([h[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["node", "set"])

    return docs.join(wanted, ["doc_id", "row_key"]).select("node", "text").mapInArrow(run, "node long, set binary")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share. Elements of many sets are counted by a matrix product, others by lists."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.float32)
    heavy = df > max(2, n // 16)
    number = np.cumsum(heavy) - 1
    for a in range(0, int(heavy.sum()), 4096):
        x = heavy[token] & (number[token] >= a) & (number[token] < a + 4096)
        m = np.zeros((n, min(4096, int(heavy.sum()) - a)), np.float32)
        m[owner[x], number[token[x]] - a] = 1
        out += m @ m.T
    light = ~heavy & (df > 1)
    x = light[token]
    token, owner = token[x], owner[x]
    order = np.argsort(token, kind="stable")
    holders, starts = owner[order], np.searchsorted(token[order], np.arange(len(df) + 1))
    ends = np.searchsorted(owner, np.arange(n + 1))
    for i in range(n):
        own = token[ends[i] : ends[i + 1]]
        if len(own):
            lo, k = starts[own], df[own]
            at = np.arange(k.sum()) + np.repeat(lo - (np.cumsum(k) - k), k)
            out[i] += np.bincount(holders[at], minlength=n)
    return out


def forest(linked: np.ndarray) -> np.ndarray:
    """The least index that each index reaches through a symmetric link matrix."""
    n = len(linked)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            label[i] = i
            front = np.array([i])
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & (label < 0))
                label[front] = i
    return label


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return (100 * shared >= percent * (a + b - shared)) & (shared > 0)


def link_table(sets: DataFrame, groups: DataFrame, pivots: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): links enough to connect what the true links connect. groups: (node, grp, size); pivots: (grp, pivot)."""
    spark = sets.sparkSession
    keys = 4 * parts(sets)
    members = sets.join(groups, "node")

    def kernel(t: pa.Table) -> pa.Table:
        out = [[], []]
        task, node = t.column("task").to_numpy(), t.column("node").to_numpy()
        raw = t.column("set").to_pylist()
        order = np.lexsort((node, task))
        for part in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
            own = [np.frombuffer(raw[i], np.uint64) for i in part]
            if len(own) < 2:
                continue
            sizes = np.array([len(s) for s in own])
            label = forest(similar(intersections(own), sizes[:, None], sizes[None, :], percent))
            far = np.flatnonzero(label != np.arange(len(own)))
            out[0] += node[part[far]].tolist()
            out[1] += node[part[label[far]]].tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    salts = 32  # a group may hold a third of all rows

    def salted(rows: DataFrame, facts: DataFrame) -> DataFrame:
        """rows joined with the few facts of their group, each group dealt to many tasks."""
        facts = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(facts, ["grp", "salt"]).drop("salt")

    tasks, links = members.filter(F.col("size") <= block).select(F.col("grp").alias("task"), "node", "set", "size"), None
    if not groups.filter(F.col("size") > block).isEmpty():
        heads = pivots.join(sets, F.col("pivot") == F.col("node")).select("grp", "pivot", F.col("set").alias("pivot_set"))

        def against(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows:
                told = []
                for own, pivot in zip(b.column(2), b.column(4), strict=True):
                    x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (own, pivot))
                    n = len(np.intersect1d(x, y, assume_unique=True))
                    told.append(bool(similar(np.array(n), np.array(len(x)), np.array(len(y)), percent)))
                yield pa.record_batch([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(told)], names=["node", "grp", "set", "pivot", "near"])

        dealt = salted(members.filter(F.col("size") > block), heads).select("node", "grp", "set", "pivot", "pivot_set")
        judged = settle(dealt.mapInArrow(against, "node long, grp long, set binary, pivot long, near boolean"))
        links = judged.filter("near").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        # Blocks of those near the pivot are 0 to k-1, of the others k to k+m-1; two blocks of the first kind needn't meet.
        n_blocks = lambda near: F.ceil(F.sum(F.when(F.col("near") == near, 1).otherwise(0)) / block).cast("int")
        counts = settle(judged.groupBy("grp").agg(n_blocks(True).alias("k"), n_blocks(False).alias("m")).filter("m > 0"))
        at = lambda n: F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.col(n), F.lit(1))).cast("int")
        mine = F.when(F.col("near"), at("k")).otherwise(at("m") + F.col("k"))
        last = F.col("k") + F.col("m") - 1
        other = F.explode(F.when(F.col("near"), F.sequence("k", last)).otherwise(F.sequence(F.lit(0), last)))
        met = salted(judged, counts).select("node", "set", "grp", mine.alias("mine"), other.alias("other"))
        met = met.select(F.xxhash64("grp", F.least("mine", "other"), F.greatest("mine", "other"), F.lit("blocks")).alias("task"), "node", "set", F.lit(2 * block).cast("long").alias("size"))
        tasks = tasks.unionByName(met)
    # Small groups share a call of the kernel, the others have one of their own.
    bucket = F.when(F.col("size") <= 32, F.pmod(F.xxhash64("task"), F.lit(keys))).otherwise(F.xxhash64("task", F.lit("own")))
    found = tasks.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(kernel, "a long, b long")
    return settle(found if links is None else found.unionByName(links))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id, kept): a row for each row of docs; row_key tells rows of equal id apart."""
    tune(docs.sparkSession)
    docs = id_text(docs, id_col, text_col).withColumn("row_key", F.xxhash64("doc_id", "text"))
    sig = settle(signed(docs, width, percent))
    first = F.min(F.struct("doc_id", "row_key", "bands"))
    classes = sig.filter("h1 is not null and doc_id is not null").groupBy("h1", "h2").agg(first.alias("x")).select("h1", "h2", "x.*")
    # Numbers of classes: written once with them, so they are the same whoever reads them.
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()))
    band = classes.select("node", F.explode("bands").alias("band"))
    full = settle(band.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("low")).filter("n > 1"))
    # Buckets are linked through their least nodes alone: a class links those of its own buckets in a chain, which many
    # classes of a group do alike, so a large group has few links.
    held = settle(band.join(full, "band").groupBy("node").agg(F.array_sort(F.collect_set("low")).alias("lows"), F.sum("n").alias("fill")))
    pair = F.explode(F.arrays_zip(F.slice("lows", 1, F.size("lows") - 1).alias("a"), F.slice("lows", 2, F.size("lows")).alias("b")))
    chain = held.filter(F.size("lows") > 1).select(pair.alias("x")).select("x.a", "x.b").distinct()
    named = components(chain).select(F.col("node").alias("first"), "label")
    groups = held.select("node", "fill", F.get("lows", F.lit(0)).alias("first")).join(named, "first", "left")
    groups = settle(groups.select("node", "fill", F.coalesce("label", "first").alias("grp")))
    sizes = settle(groups.groupBy("grp").agg(F.count("*").alias("size"), F.max(F.struct("fill", "node")).alias("x")))
    pivots = sizes.filter(F.col("size") > block).select("grp", F.col("x.node").alias("pivot"))
    groups = settle(groups.join(sizes.select("grp", "size"), "grp").select("node", "grp", "size"))
    wanted = classes.select("doc_id", "row_key", "node").join(held.select("node"), "node", "left_semi")
    sets = settle(full_sets(docs, wanted, width).dropDuplicates(["node"]))
    labels = components(link_table(sets, groups, pivots, percent, block))
    # A component is named by the least doc_id of its classes.
    least = settle(labels.join(classes.select("node", "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("component")))
    named = classes.select("h1", "h2", "node", "doc_id").join(labels.join(least, "label").select("node", "component"), "node", "left").select("h1", "h2", F.coalesce("component", "doc_id").alias("component"))
    out = sig.select("doc_id", "row_key", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "row_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")

ORACLE_OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS i, len(ws) AS n FROM w),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS k FROM u) WHERE i + 3 <= n OR (n < 3 AND i = 0)),
sets AS (SELECT doc_id, md5(string_agg(k, chr(10) ORDER BY k)) AS set, count(*) AS n FROM s GROUP BY 1),
class AS (SELECT set, n, min(doc_id) AS doc_id FROM sets GROUP BY 1, 2),
df AS (SELECT k, count(*) AS df FROM s JOIN class USING (doc_id) GROUP BY 1 HAVING count(*) > 1),
c AS (SELECT s.doc_id, n, s.k, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(df, 1), s.k) AS pos FROM s JOIN class USING (doc_id) LEFT JOIN df ON s.k = df.k),
prefix AS (SELECT doc_id, n, k FROM c WHERE pos <= n - (85 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.k = b.k AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
shared AS (SELECT a, b, count(*) AS m FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.k = y.k GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN class x ON x.doc_id = a JOIN class y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
named AS (SELECT set, least(class.doc_id, coalesce(min(b), class.doc_id)) AS component_id FROM class LEFT JOIN reach ON reach.a = class.doc_id GROUP BY set, class.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM (SELECT doc_id FROM documents) d LEFT JOIN sets ON sets.doc_id = d.doc_id LEFT JOIN named ON named.set = sets.set
"""


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stand for their component: those with its least id, and rows without an id if none there has one."""
    found = near_duplicates(docs, id_col, text_col, width, percent)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("row_key").alias("_gone_key")).distinct()
    key = F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string"))
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(F.col("_gone_id")) & (key == F.col("_gone_key")), "left_anti")
