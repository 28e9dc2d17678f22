"""The phrases of documents and in how many documents each stands, without moving the phrases themselves.

Documents are dealt to blocks of some megabytes by the hash of their key. A block's distinct phrases are 96 bits of hashes each,
in order, as differences; they are dealt to buckets by their first bits. A bucket adds up the documents of each phrase over all
blocks, and answers each block with numbers alone, in the order it was asked in. A block is then gone through again, with the
numbers beside it, and gives the few phrases of each document that can be among its best. A phrase that is in every document
is one row a block, so none is a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import terms
from ..shared import small_batches

#: Bytes of text of a block, and those whose phrases a bucket adds up.
BLOCK, BUCKET = 8 << 20, 12 << 20
#: Scores that differ by less may be equal when rounded to six digits.
NEAR = 2e-6
ASKED = "bucket int, block int, n int, phrases binary"
TOLD = "block int, bucket int, n int, counts binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(raw: bytes, kind: str, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(kind).ravel()


def packed(high: np.ndarray, low: np.ndarray, count: np.ndarray) -> bytes:
    """Phrases in the order of their hashes, and in how many documents of the block each is."""
    return pa.compress(_planes(np.diff(high, prepend=np.uint64(0)).astype("<u8")) + low.astype("<u4").tobytes() + _planes(count.astype("<u4")), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(raw, 16 * n, codec="zstd", asbytes=True)
    return np.cumsum(_unplaned(raw[: 8 * n], "<u8", n), dtype=np.uint64), np.frombuffer(raw[8 * n : 12 * n], "<u4"), _unplaned(raw[12 * n :], "<u4", n)


def named(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of phrases by hashes, and the number of each in that order, from 0."""
    order = np.argsort(high, kind="stable")
    a, b = high[order], low[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # equal in 64 bits only
        order = np.lexsort((low, high))
        a, b = high[order], low[order]
        same = a[1:] == a[:-1]
    new = np.ones(len(order), np.int64)
    new[1:] = ~(same & (b[1:] == b[:-1]))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new == 1], number


class Block:
    """The phrases of a block's documents (key, terms): of each document and phrase how often it is there, and where first."""

    def __init__(self, t: pa.Table, width: tuple[int, int]):
        self.width = width
        keys = t.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        self.keys = keys.dictionary
        lists = t.column("terms").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        self.code, self.terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        ends = np.repeat(np.cumsum(sizes), sizes)
        row = np.repeat(keys.indices.to_numpy().astype(np.int64), sizes)
        lanes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode()) for x in self.terms), "<u8").reshape(-1, 2)
        high, low = (lanes[:, k][self.code] for k in range(2))
        one = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
        found, now, n = [], (high, low), len(self.code)
        for w in range(1, width[1] + 1):
            if w > 1:  # a phrase's hashes with those of the term after it
                now = tuple(mix(x[: max(0, n - w + 1)] * c + y[w - 1 :]) for x, c, y in zip(now, one, (high, low), strict=True))
            if w >= width[0]:
                at = np.flatnonzero(np.arange(len(now[0])) + w <= ends[: len(now[0])])
                found.append((now[0][at], now[1][at] >> np.uint64(32), at, np.full(len(at), w)))
        high, low, at, size = (np.concatenate(c) for c in zip(*found, strict=True))
        picked, number = named(high, low)
        #: The distinct phrases' hashes, in order.
        self.high, self.low = high[picked], low[picked]
        pairs, first, self.tf = np.unique(row[at] * max(1, len(picked)) + number, return_index=True, return_counts=True)
        self.doc, self.phrase = pairs // max(1, len(picked)), pairs % max(1, len(picked))
        self.at, self.size = at[first], size[first]

    def asked(self, block: int, buckets: int) -> pa.RecordBatch:
        count = np.bincount(self.phrase, minlength=len(self.high))
        bucket = ((self.high >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(cuts[1:], len(bucket))
        raw = [packed(self.high[a:b], self.low[a:b], count[a:b]) for a, b in zip(cuts, ends, strict=False)]
        return pa.record_batch([pa.array(bucket[cuts]), pa.array(np.full(len(cuts), block, np.int32)), pa.array((ends[: len(cuts)] - cuts).astype(np.int32)), pa.array(raw, pa.binary())], names=["bucket", "block", "n", "phrases"])

    def best(self, df: np.ndarray, total: int, n: int) -> pa.Table:
        """(key, phrase, tf, df): of each document the phrases that can be among its n best; of those that score alike the n least."""
        df = df[self.phrase]
        score = self.tf * (np.log((1 + total) / (1 + df)) + 1)
        order = np.lexsort((-score, self.doc))
        head = np.flatnonzero(np.diff(self.doc[order], prepend=-1))
        sizes = np.diff(np.append(head, len(order)))
        bound = np.repeat(score[order][head + np.minimum(n, sizes) - 1], sizes)
        kept = order[score[order] >= bound - NEAR]
        rank = np.empty(len(self.terms) + 1, np.int64)
        rank[sorted(range(len(self.terms)), key=self.terms.__getitem__)] = np.arange(len(self.terms))
        rank[-1] = -1
        # A term has no sign below a space, so phrases stand as their terms do.
        parts = [np.where(k < self.size[kept], self.code[np.minimum(self.at[kept] + k, len(self.code) - 1)], -1) for k in range(self.width[1])]
        order = np.lexsort((*(rank[p] for p in reversed(parts)), df[kept], self.tf[kept], self.doc[kept]))
        kept, parts = kept[order], [p[order] for p in parts]
        new = np.ones(len(kept), bool)
        new[1:] = (np.diff(self.doc[kept]) != 0) | (np.diff(self.tf[kept]) != 0) | (np.diff(df[kept]) != 0)
        head = np.flatnonzero(new)
        place = np.arange(len(kept)) - np.repeat(head, np.diff(np.append(head, len(kept))))
        few = np.flatnonzero(place < n)
        phrases = [" ".join(self.terms[c] for c in row if c >= 0) for row in zip(*(p[few].tolist() for p in parts), strict=True)]
        kept = kept[few]
        return pa.table({"key": self.keys.take(pa.array(self.doc[kept])), "phrase": pa.array(phrases, pa.string()), "tf": pa.array(self.tf[kept].astype(np.int64)), "df": pa.array(df[kept].astype(np.int64))})


def _add_up(t: pa.Table) -> pa.Table:
    """Of a bucket: the documents of each phrase over all blocks, for each block in its order."""
    sizes = t.column("n").to_pylist()
    got = [unpacked(x.as_py(), n) for x, n in zip(t.column("phrases"), sizes, strict=True)]
    high, low, count = (np.concatenate(c) for c in zip(*got, strict=True))
    del got
    picked, number = named(high, low)
    df = np.zeros(len(picked), np.int64)
    np.add.at(df, number, count)
    df = df[number].astype("<u4")
    raw = [pa.compress(_planes(x), codec="zstd", asbytes=True) for x in np.split(df, np.cumsum(sizes)[:-1])]
    return pa.table([t.column("block"), t.column("bucket"), t.column("n"), pa.array(raw, pa.binary())], names=["block", "bucket", "n", "counts"])


def candidates(docs: DataFrame, key: str, text: Column, n: int, width: tuple[int, int]) -> tuple[DataFrame, int]:
    """((key, phrase, tf, df), number of documents): of each key the phrases of terms that can be among its n best by tf-idf.

    df is exact: the rows, put together by key, that have the phrase. Scores of n or more phrases are rounded by the caller.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), text.cast("string").alias("text"))
    total, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks, buckets = (-(-(size or 1) // x) for x in (BLOCK, BUCKET))
    # Moved once, as texts; both passes read what was moved.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).repartition("block").select("block", "key", terms("text").alias("terms"))

    def ask(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield Block(pa.Table.from_batches(batches), width).asked(group[0].as_py(), buckets)

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        df = [_unplaned(pa.decompress(x.as_py(), 4 * m, codec="zstd", asbytes=True), "<u4", m) for x, m in zip(right.column("counts"), right.column("n").to_pylist(), strict=True)]
        return Block(left, width).best(np.concatenate([np.zeros(0, np.int64), *df]).astype(np.int64), total, n)

    told = dealt.groupBy("block").applyInArrow(ask, ASKED).groupBy("bucket").applyInArrow(_add_up, TOLD)
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("phrase", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("df", T.LongType())])
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(choose, schema), total
