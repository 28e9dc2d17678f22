"""Suffix-array dedup: the difference-cover algorithm, then a comparison of neighbours' prefixes.

Suffixes at places 1 and 2 modulo 3 are sorted by their triples and given names; where names repeat, the string of names
is sorted the same way; the remaining suffixes are sorted by a unit and the rank that follows, and merged in. Neighbours
in that order with equal prefixes of a window's length are one string's occurrences.

suffix_sort does this for all suffixes of a corpus in one order, over the cluster; it moves some hundred times the text. So
the corpus query distributes by content (see anchors): the texts' segments are dealt to buckets so that equal windows meet,
and each bucket's segments are sorted as one string here, to the depth of a window.

Defined results: a null text is empty and has no windows. Rows with a null doc_id lose nothing and cover nothing. Repeated
rows (equal doc_id) don't cover each other. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import bytes_kind, least_by, without_repeats
from .common import table

WINDOW = 50


def order_by(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows by non-negative integer keys, the first counts most; and where new keys start. Ties in any order.

    Keys are packed into one number of 64 bits, with the place if there is room: that sorts ten times faster than rows do.
    """
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    place = n.bit_length()
    key, width = keys[0].astype(np.uint64), int(keys[0].max()).bit_length()
    for k in keys[1:]:
        more = int(k.max()).bit_length()
        if width + more > 64:  # what there is so far becomes its rank
            key = rank_of(key)[0].astype(np.uint64)
            width = place
            if width + more > 64:
                k, more = rank_of(k)[0], place
        key = (key << np.uint64(more)) | k.astype(np.uint64)
        width += more
    if width + place <= 64:
        packed = np.sort((key << np.uint64(place)) | np.arange(n, dtype=np.uint64))
        order, found = (packed & np.uint64((1 << place) - 1)).astype(np.int64), packed >> np.uint64(place)
    else:
        order = np.argsort(key)
        found = key[order]
    new = np.ones(n, bool)
    new[1:] = found[1:] != found[:-1]
    return order, new


def rank_of(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of tuples: ranks from 1, equal for equals; and how many differ."""
    order, new = order_by(*keys)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum())


def suffix_array(s: np.ndarray, depth: int = 0) -> np.ndarray:
    """Starts of the suffixes of s (positive integers), sorted. A suffix that is a prefix of another comes first.

    With a depth, suffixes that agree in so many units stand together, in any order, and the names need cover no more.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(6, np.int64)])
    ones, twos = np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)  # one place past the end may be sampled; it sorts first
    sample = np.concatenate([ones, twos])
    sample = sample[sample < n + (n % 3 == 1)]
    rank, distinct = rank_of(t[sample], t[sample + 1], t[sample + 2])
    if distinct < len(sample):
        order = np.argsort(rank) if 0 < depth <= 3 else suffix_array(rank, -(-depth // 3))
        rank = np.empty(len(sample), np.int64)
        rank[order] = np.arange(1, len(sample) + 1)
    sorted12 = np.empty(len(sample), np.int64)
    sorted12[rank - 1] = sample
    at = np.zeros(n + 4, np.int64)  # rank of each sampled place
    at[sample] = rank
    zeros = np.arange(0, n, 3)
    zeros = zeros[order_by(t[zeros], at[zeros + 1])[0]]
    wide = len(sample) + 2
    # Places of the others among those at 1 and at 2 modulo 3: (unit, rank after) and (unit, unit, rank after) compare.
    first, second = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    lower = np.searchsorted(t[first] * wide + at[first + 1], t[zeros] * wide + at[zeros + 1])
    pairs, _ = rank_of(np.concatenate([t[second], t[zeros]]), np.concatenate([t[second + 1], t[zeros + 1]]))
    lower = lower + np.searchsorted(pairs[: len(second)] * wide + at[second + 2], pairs[len(second) :] * wide + at[zeros + 2])
    # Among suffixes that agree in depth units the sampled ones' order may not be that of the keys: places stay in order.
    lower = np.maximum.accumulate(lower)
    out = np.empty(len(sample) + len(zeros), np.int64)
    place = lower + np.arange(len(zeros))
    rest = np.ones(len(out), bool)
    rest[place] = False
    out[place] = zeros
    out[rest] = sorted12
    return out[out < n]


def shared_windows(segs: list[bytes], ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each byte of all segments: does the window that starts there occur in a segment with a smaller id?"""
    sizes = np.array([len(x) for x in segs], np.int64)
    base = np.cumsum(np.append(0, sizes + 1))
    raw = np.frombuffer(b"\0".join(segs) + b"\0", np.uint8)
    text = raw.astype(np.int64) + 1
    text[base[1:] - 1] = 257  # end marks; no window that counts has one
    order = suffix_array(text, window)
    seg = np.repeat(np.arange(len(segs)), sizes + 1)[order]
    fits = order - base[seg] + window <= sizes[seg]
    order, seg = order[fits], seg[fits]
    covered = np.zeros(int(sizes.sum()), bool)
    if not len(order):
        return covered
    views = np.lib.stride_tricks.sliding_window_view(raw, window)
    same = np.zeros(len(order), bool)
    for a in range(0, len(order) - 1, 1 << 17):  # compare neighbours' prefixes, in blocks
        x = order[a : a + (1 << 17) + 1]
        same[a + 1 : a + len(x)] = (views[x[1:]] == views[x[:-1]]).all(axis=1)
    low = least_by(np.cumsum(~same), ids[seg])
    hit = ids[seg] > low
    covered[order[hit] - seg[hit]] = True  # without the end marks before
    return covered


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, kept), of bytes."""

    def kernel(segs: list[bytes], ids: np.ndarray) -> np.ndarray:
        return shared_windows(segs, ids, window)

    return without_repeats(docs, bytes_kind(window), kernel, id_col, text_col)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_OP4 = r"""
WITH h AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, n, k, substr(h, 1000 * k + 1, 1098) AS b FROM (SELECT doc_id, n, h, unnest(range(0, (n + 499) // 500)) AS k FROM h)),
u AS (SELECT doc_id, n, 500 * k + j AS i, substr(b, 2 * j + 1, 2) AS c, CASE WHEN 500 * k + j + 50 <= n THEN substr(b, 2 * j + 1, 100) END AS w FROM (SELECT doc_id, n, k, b, unnest(range(0, least(500, n - 500 * k))) AS j FROM blocks)),
least AS (SELECT w, min(doc_id) AS least FROM u WHERE w IS NOT NULL GROUP BY w HAVING min(doc_id) < max(doc_id)),
bad AS (SELECT doc_id, i, c, coalesce(doc_id > least, false) AS bad FROM u LEFT JOIN least ON u.w = least.w),
gone AS (SELECT *, bool_or(bad) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM bad),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM gone)
SELECT h.doc_id, CAST(n AS BIGINT) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, sha256(unhex(coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE NOT gone), ''))) AS kept_sha256
FROM h LEFT JOIN runs ON h.doc_id = runs.doc_id GROUP BY h.doc_id, n
"""
