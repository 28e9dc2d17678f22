"""Substring dedup by compressed FM-indexes: matching statistics by backward search over wavelet matrices.

A shard's segments (see anchors) are indexed: the Burrows-Wheeler transform of their words, in a wavelet matrix whose bit
rows are packed 64 to a word with a count before each word. The documents' segments are then streamed against the index:
for all places at once, the search interval is extended to the left by one word at a time as long as it isn't empty, up to
the threshold; that length is the matching statistic of the place (capped at the threshold). Where it reaches the
threshold, the least doc_id in the interval, from a table of minima over powers of two, tells whether a smaller document
has the window.

Defined results: a null or blank text has no words. Rows with a null doc_id lose nothing and cover nothing. Repeated rows
(equal doc_id) don't cover each other. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import without_repeats, words_kind
from .common import table
from .suffix_dedup import suffix_array

WINDOW = 13


class Bits:
    """A bit row with rank: how many ones stand before a place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class Wavelet:
    """A wavelet matrix over integers below 2^levels."""

    def __init__(self, s: np.ndarray, levels: int):
        self.levels, self.rows, self.zeros = levels, [], []
        for k in reversed(range(levels)):
            bit = (s >> k & 1).astype(bool)
            self.rows.append(Bits(bit))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros_like(at)
        for k, (row, zeros) in enumerate(zip(self.rows, self.zeros, strict=True)):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            a, b = row.rank(low), row.rank(at)
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return at - low


class FMIndex:
    """s: integers from 0, whose suffixes are all different (it ends in a unique mark)."""

    def __init__(self, s: np.ndarray):
        self.order = suffix_array(s + 1)
        sigma = int(s.max()) + 1
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        self.bwt = Wavelet(s[self.order - 1], max(1, (sigma - 1).bit_length()))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the strings with one more symbol in front."""
        return self.starts[symbol] + self.bwt.rank(symbol, lo), self.starts[symbol] + self.bwt.rank(symbol, hi)


def statistics(index: FMIndex, s: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each end (exclusive) in s: the length of the longest match that ends there, at most `most`, and its interval."""
    lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), len(index.order), np.int64)
    length, going = np.zeros(len(ends), np.int64), np.arange(len(ends))
    for k in range(1, most + 1):
        going = going[ends[going] >= k]
        a, b = index.extend(s[ends[going] - k], lo[going], hi[going])
        found = b > a
        going = going[found]
        lo[going], hi[going], length[going] = a[found], b[found], k
    return length, lo, hi


def least_in(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least value in each non-empty interval, from minima over powers of two."""
    rows, step = [values], 1
    while 2 * step <= len(values):
        rows.append(np.minimum(rows[-1][:-step], rows[-1][step:]))
        step *= 2
    k = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for level in np.unique(k):
        x = k == level
        out[x] = np.minimum(rows[level][lo[x]], rows[level][hi[x] - (1 << level)])
    return out


def shared_windows(segs: list[bytes], ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each word of all segments: does the window that starts there occur in a segment with a smaller id?"""
    words = [x.split() for x in segs]
    sizes = np.array([len(w) for w in words], np.int64)
    known: dict[bytes, int] = {}
    flat = np.array([known.setdefault(w, len(known)) for own in words for w in own], np.int64)
    base = np.cumsum(np.append(0, sizes + 1))
    s = np.empty(int(base[-1]), np.int64)
    mark = np.zeros(len(s), bool)
    mark[base[1:] - 1] = True
    s[mark] = np.arange(len(segs))  # each segment's own end mark, below all words
    s[~mark] = flat + len(segs)
    index = FMIndex(s)
    owner = np.repeat(np.arange(len(segs)), sizes + 1)
    place = np.arange(len(s)) - base[owner]
    starts = np.flatnonzero(place + window <= sizes[owner])
    covered = np.zeros(len(flat), bool)
    for a in range(0, len(starts), 1 << 18):
        x = starts[a : a + (1 << 18)]
        length, lo, hi = statistics(index, s, x + window, window)
        x, lo, hi = x[length >= window], lo[length >= window], hi[length >= window]
        hit = least_in(ids[owner[index.order]], lo, hi) < ids[owner[x]]
        covered[x[hit] - owner[x[hit]]] = True
    return covered


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, kept), of words; kept joins the kept words by a space."""

    def kernel(segs: list[bytes], ids: np.ndarray) -> np.ndarray:
        return shared_windows(segs, ids, window)

    return without_repeats(docs, words_kind(window), kernel, id_col, text_col)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_OP7 = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS i, len(ws) AS n FROM w),
win AS (SELECT *, CASE WHEN i + 13 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS k FROM u),
least AS (SELECT k, min(doc_id) AS least FROM win WHERE k IS NOT NULL GROUP BY k HAVING min(doc_id) < max(doc_id)),
bad AS (SELECT win.*, coalesce(win.doc_id > least, false) AS bad FROM win LEFT JOIN least ON win.k = least.k),
gone AS (SELECT *, bool_or(bad) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM bad)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id GROUP BY w.doc_id, len(ws)
"""
