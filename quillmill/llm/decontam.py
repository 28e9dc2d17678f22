"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are the runs of letters, digits and _ of the lower-cased text. Seeds are the n-grams of an item that are rare: the
product of their words' shares in the corpus lets fewer than one occurrence by chance be expected (and the rarest few of
each item in any case). Rarity is judged from the words, so a passage that leaked into a third of all documents still
has seeds. Around each run of seed hits the item is aligned with the document's words; the score is the local alignment's
share of the score that a full copy has. Items are taken in blocks of a bounded size, which are sent to all tasks; the
corpus is never shuffled.

Defined results: null or empty texts and items without words match nothing. Items with fewer words than n are one seed.
Repeated rows give repeated results; equal items each give their own. Null ids pass through. Ties go to the first best
span. Other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, table, tune

SEED_WORDS = 3
MIN_SEEDS = 4
MIN_SCORE = 0.5
#: Bounds of a block of items that is sent to all tasks.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _table(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local score, with the ends in a and b (the first best by b's end, then a's)."""
    if not len(b):
        return 0, 0, 0
    j = np.arange(1, len(b) + 1) * -GAP
    row, best, at_a, at_b = np.zeros(len(b) + 1, np.int64), 0, 0, 0
    for i, x in enumerate(a):
        new = np.maximum(0, np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), row[1:] + GAP))
        new = np.maximum.accumulate(new + j) - j  # gaps along b
        k = int(new.argmax())
        if new[k] > best:
            best, at_a, at_b = int(new[k]), i + 1, k + 1
        row = np.concatenate([row[:1], new])
    return best, at_a, at_b


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: the best score of a local alignment, and its start and end in the passage."""
    score, i, j = _table(item, passage)
    if not score:
        return 0, 0, 0
    _, _, back = _table(item[:i][::-1], passage[:j][::-1])
    return score, j - back, j


class Seeds:
    """Items, their words as numbers, and the sorted seed keys with the places they stand for."""

    def __init__(self, items: list[tuple[int, str]], shares: dict[str, float], total: float, n: int = SEED_WORDS):
        self.n = n
        self.items = [(i, w) for i, t in items if (w := words(t))]
        self.vocab = {w: k for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.ids = [np.array([self.vocab[w] for w in ws], np.int64) for _, ws in self.items]
        bits = np.array([-math.log2(max(shares.get(w, 0.0), 0.5 / max(total, 1))) for w in self.vocab] or [0.0])
        rare = math.log2(max(total, 2))
        places: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for k, own in enumerate(self.ids):
            m = min(n, len(own))
            grams = [(float(bits[own[p : p + m]].sum()), p) for p in range(len(own) - m + 1)]
            chosen = {p for b, p in grams if b >= rare} | {p for _, p in sorted(grams, reverse=True)[:MIN_SEEDS]}
            for p in sorted(chosen):
                places[m, self.key(own[p : p + m])].append((k, p))
        self.by_length = {}
        for m in {x[0] for x in places}:
            keys = np.array(sorted(key for q, key in places if q == m), np.int64)
            self.by_length[m] = keys, [places[m, int(key)] for key in keys]

    def key(self, ids) -> int:
        out = 0
        for x in ids:
            out = (out * (len(self.vocab) + 1) + int(x) + 1) & 0x7FFFFFFFFFFFFFFF
        return out

    def hits(self, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, place in the item, place in the document) of every seed in the document's words."""
        base = len(self.vocab) + 1
        for m, (keys, places) in self.by_length.items():
            if len(doc) < m:
                continue
            got = np.zeros(len(doc) - m + 1, np.int64)
            known = np.ones(len(got), bool)
            for x in range(m):
                part = doc[x : x + len(got)]
                got = (got * base + part + 1) & 0x7FFFFFFFFFFFFFFF
                known &= part >= 0
            at = np.flatnonzero(known)
            k = np.minimum(np.searchsorted(keys, got[at]), len(keys) - 1)
            for p, q in zip(at[keys[k] == got[at]].tolist(), k[keys[k] == got[at]].tolist(), strict=True):
                for item, place in places[q]:
                    yield item, place, p

    def matches(self, doc: np.ndarray, min_score: float) -> Iterator[tuple[int, float, int, int, int]]:
        """(item, score, start, end, regions): the best span of each item whose score is enough, and how many there are."""
        by_item = defaultdict(list)
        for item, place, p in self.hits(doc):
            by_item[item].append((p - place, p))
        for item, found in sorted(by_item.items()):
            own = self.ids[item]
            slack = len(own) // 3 + 2
            spans: list[list[int]] = []
            for start in sorted({s for s, _ in found}):
                lo, hi = max(0, start - slack), min(len(doc), start + len(own) + slack)
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
            good = []
            for lo, hi in spans:
                score, a, b = align(own, doc[lo:hi])
                if (share := score / (MATCH * len(own))) >= min_score:
                    good.append((-share, lo + a, lo + b))
            if good:
                best = min(good)
                yield item, -best[0], best[1], best[2], len(good)


def word_shares(docs: DataFrame, vocab: set[str]) -> tuple[dict[str, float], float]:
    """Each word's share of all words of all documents, for the words of a bounded vocabulary; and the count of all words."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = Counter(), 0
        for b in rows:
            for text in b.column(1).to_pylist():
                found = words(text)
                total += len(found)
                n.update(w for w in found if w in vocab)
        yield pa.record_batch([pa.array([*n, ""], pa.string()), pa.array([*n.values(), total], pa.int64())], names=["word", "n"])

    got = {r.word: r.n for r in docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = float(got.pop("", 0) or 0)
    return {w: n / max(total, 1.0) for w, n in got.items()}, total


def seed_blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, n: int) -> Iterator[Seeds]:
    """The seeds of each block of items; docs: (doc_id, text)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(1, -(-size.n // BLOCK_ITEMS), -(-(size.b or 0) // BLOCK_BYTES))
    for k in range(blocks):
        block = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        block.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        yield Seeds(block, *word_shares(docs, {w for _, t in block for w in words(t)}), n)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_score: float = MIN_SCORE, n: int = SEED_WORDS) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word, n_regions): a row for each document and item that it holds."""
    tune(docs.sparkSession)
    docs = id_text(docs, id_col, text_col)
    out = None
    for seeds in seed_blocks(docs, benchmark, item_col, item_text_col, n):
        ids = [i for i, _ in seeds.items]

        def run(rows: Iterator[pa.RecordBatch], seeds=seeds, ids=ids) -> Iterator[pa.RecordBatch]:
            get = seeds.vocab.get
            for b in rows:
                found = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    own = np.array([get(w, -1) for w in words(text)], np.int64)
                    found += [(doc, ids[item], *rest) for item, *rest in seeds.matches(own, min_score)]
                if found:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "item_id", "score", "start_word", "end_word", "n_regions"]
        part = docs.mapInArrow(run, "doc_id long, item_id long, score double, start_word long, end_word long, n_regions long")
        out = part if out is None else out.unionByName(part)
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_score: float = MIN_SCORE, n: int = SEED_WORDS) -> DataFrame:
    """The rows of docs that hold no item; all their columns pass through and nothing is shuffled."""
    tune(docs.sparkSession)
    at, out = docs.columns.index(text_col), docs
    for seeds in seed_blocks(id_text(docs, id_col, text_col), benchmark, item_col, item_text_col, n):

        def run(rows: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            get = seeds.vocab.get
            for b in rows:
                clean = [next(seeds.matches(np.array([get(w, -1) for w in words(t)], np.int64), min_score), None) is None for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
