"""A stored vector index: inverted lists of cells with residual codes, appended to without a rewrite, searched by cell.

Cells are the means of k-means, fitted by Spark rounds on a bounded sample of the vectors (SAMPLE_PER_CELL for each cell, those
with the least hash of their key). Every vector, sampled or not, is then written to the folder of its nearest cell: its key, a
code of one signed byte a dimension (what it differs from the cell by, in steps that are fitted too) and the vector itself.
Parquet keeps these columns apart, so a search reads the codes of the cells it probes, and vectors only to re-rank.

A search takes the cells of greatest inner product with each query, scores their rows by cell and code, keeps `rerank` rows a
query and orders those by the exact inner product. The index is never shuffled: queries, at most MOST_QUERIES at a time, go to
the tasks that read the cells, and each task returns no more than `rerank` rows a query. An exact search reads the vectors of the
cells it probes; with all cells probed its answer is exact.

Nothing in the driver grows with the vectors: it holds the cells (at most MOST_CELLS) and one block of queries.

Defined results: null vectors, and vectors of another length than the first fitted one's, aren't indexed or asked; null keys are
kept, as one key. Repeated keys stay several rows. An index of an empty table has no cells, and finds nothing. Ties are in
key order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import settle

MOST_CELLS, MOST_QUERIES = 4096, 1024
SAMPLE_PER_CELL = 128
ROUNDS = 8
#: A code's steps: the residuals of this share of the sample lie within their bounds.
INSIDE = 0.999


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest_cells(x: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The nearest cell of each row, the first of equals."""
    return np.argmin((cells**2).sum(1) - 2 * x @ cells.T, axis=1)


def _usable(vectors: DataFrame, vector: str, size: int) -> DataFrame:
    return vectors.filter(F.col(vector).isNotNull() & (F.size(vector) == size))


def fit_cells(vectors: DataFrame, n_cells: int, key: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(cells, step): k-means of a bounded sample. Each round is a Spark job that sums the vectors of each cell.

    Sums are of numbers rounded to 2 ** -30, so they are exact and the cells are the same however the rows are dealt.
    """
    if not 0 < n_cells <= MOST_CELLS:
        raise ValueError(f"{n_cells} cells; from 1 to {MOST_CELLS} are allowed")
    first = vectors.filter(F.col(vector).isNotNull()).select(vector).first()
    if first is None:
        return np.zeros((0, 0)), 1.0
    size = len(first[0])
    drawn = _usable(vectors, vector, size).select(F.col(vector).cast("array<double>").alias("x"), F.xxhash64(key, vector).alias("h")).orderBy("h", "x").limit(n_cells * SAMPLE_PER_CELL)
    sample = settle(drawn)
    start = sample.dropDuplicates(["x"]).orderBy("h", "x").limit(n_cells)
    cells = np.array([r.x for r in start.select("x").collect()])  # n_cells rows

    def sums_to(held: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((len(held), size), np.int64), np.zeros(len(held), np.int64)
            for b in batches:
                x = matrix(b.column(0))
                at = nearest_cells(x, held)
                np.add.at(total, at, np.round(x * (1 << 30)).astype(np.int64))
                np.add.at(count, at, 1)
            some = np.flatnonzero(count)
            yield pa.record_batch([pa.array(some, pa.int32()), pa.array(list(total[some]), pa.list_(pa.int64())), pa.array(count[some], pa.int64())], names=["cell", "total", "n"])

        parts = sample.select("x").mapInArrow(run, "cell int, total array<long>, n long")
        return parts.select("cell", "n", F.posexplode("total").alias("at", "x")).groupBy("cell", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))

    for _ in range(rounds):
        new = cells.copy()
        for r in sums_to(cells).collect():  # one number a cell and dimension
            new[r.cell, r["at"]] = r.x / (1 << 30) / r.n
        if np.array_equal(new, cells):
            break
        cells = new

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0))
            yield pa.record_batch([pa.array(np.abs(x - cells[nearest_cells(x, cells)]).max(1))], names=["far"])

    far = sample.select("x").mapInArrow(bounds, "far double").agg(F.expr(f"percentile(far, {INSIDE})").alias("far")).first().far
    return cells, max(far, 1e-12) / 127


class VectorIndex:
    """An index under a path that Spark can read and write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._held: tuple[np.ndarray, float] | None = None

    def fit(self, vectors: DataFrame, n_cells: int, key: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> VectorIndex:
        """Choose the cells; no vector is written yet."""
        cells, step = fit_cells(vectors, n_cells, key, vector, rounds)
        rows = [(k, c.tolist(), step) for k, c in enumerate(cells)]
        self.spark.createDataFrame(rows, "cell int, centre array<double>, step double").coalesce(1).write.parquet(f"{self.root}/cells")
        return self

    def cells(self) -> tuple[np.ndarray, float]:
        if self._held is None:
            rows = self.spark.read.parquet(f"{self.root}/cells").orderBy("cell").collect()  # at most MOST_CELLS
            self._held = (np.array([r.centre for r in rows]) if rows else np.zeros((0, 0)), rows[0].step if rows else 1.0)
        return self._held

    def append(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> VectorIndex:
        """Write more vectors; the files that are there stay as they are. A cell with very many rows gets several files."""
        cells, step = self.cells()
        if not len(cells):
            return self
        rows = _usable(vectors, vector, cells.shape[1]).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("vector"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column(1))
                at = nearest_cells(x, cells) if len(x) else np.zeros(0, np.int64)
                code = np.clip(np.round((x - cells[at]) / step), -127, 127).astype(np.int8) if len(x) else []
                yield pa.record_batch([pa.array(at, pa.int32()), b.column(0), pa.array([c.tobytes() for c in code], pa.binary()), b.column(1)], names=["cell", "key", "code", "vector"])

        dealt = rows.mapInArrow(run, "cell int, key long, code binary, vector array<float>").hint("rebalance", "cell")
        dealt.sortWithinPartitions("cell", "key").write.mode("append").partitionBy("cell").parquet(f"{self.root}/lists")
        return self

    def lists(self) -> DataFrame:
        """(key, code, vector, cell) of all rows."""
        return self.spark.read.schema("key long, code binary, vector array<float>, cell int").parquet(f"{self.root}/lists")

    def search(self, queries: DataFrame, k: int, probes: int, rerank: int | None = None, query_key: str = "query_id", vector: str = "vector", exact: bool = False) -> DataFrame:
        """(query_id, key, score, rank): for each query the k rows of greatest inner product among its `probes` cells.

        rerank: rows of each query that are scored exactly, 4 * k by default. exact: all rows of those cells are, by their vectors in
        place of their codes; a task holds k rows a query. With all cells probed that is the exact answer, whatever the rows.
        """
        rerank = max(k, rerank or 4 * k)
        cells, step = self.cells()
        schema = "query_id long, key long, score double, rank int"
        if not len(cells):
            return self.spark.createDataFrame([], schema)
        asked = settle(_usable(queries, vector, cells.shape[1]).select(F.col(query_key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("q")))
        n_blocks = asked.count() // MOST_QUERIES + 1
        out = None
        for block in range(n_blocks):  # of about MOST_QUERIES queries each
            own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block).orderBy("query_id").collect()
            if own:
                found = self._search(np.array([r.query_id for r in own]), np.array([r.q for r in own]), cells, step, k, probes, None if exact else rerank)
                out = found if out is None else out.unionByName(found)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The cells of greatest inner product for each row of q."""
        cells, _ = self.cells()
        return np.argsort(-(q @ cells.T), axis=1, kind="stable")[:, :probes]

    def probes_for(self, queries: DataFrame, k: int, least: float = 0.95, query_key: str = "query_id", vector: str = "vector") -> int:
        """How many cells have to be probed so that at least this share of the k nearest rows lie in them, on average over at
        most MOST_QUERIES queries, which are answered exactly."""
        cells, _ = self.cells()
        asked = queries.filter(F.col(vector).isNotNull()).orderBy(query_key).limit(MOST_QUERIES).select(F.col(query_key).cast("long").alias("query_id"), F.col(vector).alias("vector"))
        exact = self.search(asked, k, probes=MOST_CELLS, exact=True).select("query_id", "key").distinct()
        lie = exact.join(self.lists().select("key", "cell"), "key").select("query_id", "cell").collect()  # k rows a query
        rows = {r.query_id: r.vector for r in asked.collect()}
        if not lie:
            return len(cells)
        order = {q: {int(c): n for n, c in enumerate(self.probed(np.array([v], np.float64), len(cells))[0])} for q, v in rows.items()}
        needed = np.sort([order[r.query_id][r.cell] + 1 for r in lie])
        return int(needed[min(len(needed) - 1, int(np.ceil(least * len(needed))) - 1)])

    def _search(self, ids: np.ndarray, q: np.ndarray, cells: np.ndarray, step: float, k: int, probes: int, rerank: int | None) -> DataFrame:
        probed = self.probed(q, probes)
        takers = {int(c): np.flatnonzero((probed == c).any(1)) for c in np.unique(probed)}
        base = q @ cells.T
        lists = self.lists().filter(F.col("cell").isin(list(takers)))
        rank = F.row_number().over(W.partitionBy("query_id", "place").orderBy(F.col("score").desc(), "key"))
        if rerank is None:
            whole = probes >= len(cells)

            def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                # Of each query the k best rows so far, all in one: places, scores, and rows as (no null key, key).
                at, score, some, key = (np.zeros(0, t) for t in (np.int64, np.float64, np.int8, np.int64))
                least = np.full(len(q), -np.inf)
                for b in (b.slice(n, 1000) for b in batches for n in range(0, b.num_rows, 1000)):
                    of, x = b.column(0).to_numpy(), matrix(b.column(2))
                    keyed, keys = ~np.asarray(b.column(1).is_null()), b.column(1).fill_null(0).to_numpy()
                    for rows, own in [(np.arange(len(of)), np.arange(len(q)))] if whole else [(np.flatnonzero(of == c), takers[c]) for c in np.unique(of).tolist()]:
                        scores = np.round(q[own] @ x[rows].T, 6)
                        i, j = np.nonzero(scores >= least[own][:, None])
                        at, score, some, key = (np.concatenate(p) for p in ((at, own[i]), (score, scores[i, j]), (some, keyed[rows[j]].astype(np.int8)), (key, keys[rows[j]])))
                        order = np.lexsort((key, some, -score, at))
                        place = np.arange(len(order)) - np.searchsorted(at[order], at[order])
                        at, score, some, key = (v[order[place < k]] for v in (at, score, some, key))
                        full = place[place < k] == k - 1
                        least[at[full]] = score[full]
                yield pa.record_batch([pa.array(ids[at], pa.int64()), pa.array(at, pa.int32()), pa.array(key, pa.int64(), mask=some == 0), pa.array(score)], names=["query_id", "place", "key", "score"])

            found = lists.select("cell", "key", "vector").mapInArrow(best_of, "query_id long, place int, key long, score double")
            return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "key", "score", "rank")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple]] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                of, keys = b.column(0).to_numpy(), b.column(1).to_pylist()
                code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int8).reshape(b.num_rows, -1)
                for c in np.unique(of).tolist():
                    rows, own = np.flatnonzero(of == c), takers[c]
                    scores = base[own, c][:, None] + step * (q[own] @ code[rows].T.astype(np.float64))
                    for i, s in zip(own.tolist(), scores, strict=True):
                        top = range(len(rows)) if len(rows) <= rerank else np.argpartition(-s, rerank - 1)[:rerank]
                        held = best.setdefault(i, [])
                        held += [(float(s[j]), keys[rows[j]], c) for j in top]
                        if len(held) > 2 * rerank:
                            held.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
                            del held[rerank:]
            for i, held in best.items():
                held.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
                score, key, cell = zip(*held[:rerank], strict=True)
                yield pa.record_batch([pa.array([int(ids[i])] * len(key), pa.int64()), pa.array([i] * len(key), pa.int32()), pa.array(key, pa.int64()), pa.array(cell, pa.int32()), pa.array(score)], names=["query_id", "place", "key", "cell", "about"])

        near = lists.select("cell", "key", "code").mapInArrow(scan, "query_id long, place int, key long, cell int, about double")
        order: list[Column] = [F.col("about").desc(), F.col("key")]
        near = near.withColumn("at", F.row_number().over(W.partitionBy("query_id", "place").orderBy(*order))).filter(F.col("at") <= rerank).select("query_id", "place", "key", "cell").distinct()

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, place = matrix(b.column(3)), b.column(1).to_numpy()
                exact = np.einsum("ij,ij->i", x, q[place]) if len(x) else np.zeros(0)
                yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(np.round(exact, 6))], names=["query_id", "place", "key", "score"])

        exact = near.join(lists.select("cell", "key", "vector"), (near.key.eqNullSafe(lists.key)) & (near.cell == lists.cell)).select("query_id", "place", near.key, "vector")
        exact = exact.mapInArrow(score, "query_id long, place int, key long, score double")
        return exact.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "key", "score", "rank")

    def read_share(self, queries: DataFrame, probes: int, vector: str = "vector") -> float:
        """The share of all rows that one of a block of queries reads on average."""
        q = np.array([r[0] for r in queries.select(vector).limit(MOST_QUERIES).collect()])
        n = {r.cell: r["count"] for r in self.lists().groupBy("cell").count().collect()}  # one row a cell
        return float(np.mean([sum(n.get(int(c), 0) for c in p) for p in self.probed(q, probes)])) / max(1, sum(n.values()))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, n_exact, n_found, recall) of each query of exact; both tables have query_id and key."""
    hits = found.select("query_id", "key", F.lit(1).alias("hit")).distinct()
    out = exact.join(hits, ["query_id", "key"], "left").groupBy("query_id").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
    return out.withColumn("recall", F.col("n_found") / F.col("n_exact"))
