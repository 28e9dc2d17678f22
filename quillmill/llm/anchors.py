"""Windows of W units that repeat across documents: the part that substring and suffix-array dedup share.

A document is a row; units are bytes or words. A unit window is removed if the same W units also start in a document with
a smaller doc_id. Sorting or indexing every suffix of the corpus would move several times its size, so the corpus is cut
by content first, which loses no window:

1. Each window is given to the K-gram of its units with the least hash (the first of equals), its anchor. Equal windows
   have equal anchors. The neighbouring windows of one anchor make a segment, W units and a few more.
2. Per anchor, the smallest doc_id of each distinct segment is found; in every other document the segment is covered as a
   whole. Tasks do this for their own rows before anything is shuffled, so hot passages and copies shrink to one segment.
3. Only anchors with two or more distinct segments need a closer look: the first holders' segments are cut from the texts
   and brought together by anchor, where a kernel (suffix sorting or an index) finds windows that segments share. Anchors
   with very many distinct segments are taken window by window, dealt by the window's own hash, each batch's least document
   alone; the batch's others are told where they are read.

Whole segments are compared by the hashes of their anchor and of themselves, 128 bits together; kernels compare units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, id_text, parts, settle, tune, utf8

#: Units that are hashed at once, and bytes of text that a task gathers before it sends a block.
CHUNK, GATHER = 1 << 18, 24 << 20
#: Distinct segments of an anchor from which its windows are dealt one by one.
HOT_SEGMENTS = 20_000
_R = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_R, pow(_R, -1, 1 << 64))):
            x = np.full(max(n, CHUNK + 4096), base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of texts that lie one after the other, and how many words stand before each text."""
    blank = _IS_BLANK[data]
    edge = np.ones(len(data) + 1, bool)
    if len(data):
        edge[1:-1] = blank[:-1]
        edge[at] = True  # words never cross texts
    starts = np.flatnonzero(~blank & edge[:-1])
    after = np.ones(len(data) + 1, bool)
    if len(data):
        after[:-1] = blank
        after[at] = True
    ends = np.flatnonzero(~blank & after[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def byte_units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, at


def word_units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and how many words stand before each text."""
    starts, ends, before = word_bounds(data, at)
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):  # in blocks, to bound memory
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        p, inverse = powers(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * p, out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        a = b
    return out, before


def byte_slices(text: bytes, starts: list[int], lengths: list[int]) -> list[bytes]:
    return [text[s : s + n] for s, n in zip(starts, lengths, strict=True)]


def word_slices(text: bytes, starts: list[int], lengths: list[int]) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[s : s + n]) for s, n in zip(starts, lengths, strict=True)]


def byte_rest(text: bytes, gone: np.ndarray) -> bytes:
    return np.frombuffer(text, np.uint8)[~gone].tobytes()


def word_rest(text: bytes, gone: np.ndarray) -> bytes:
    return b" ".join(w for w, x in zip(text.split(), gone.tolist(), strict=True) if not x)


def all_words(text: bytes) -> bytes:
    return b" ".join(text.split())


@dataclass(frozen=True)
class Kind:
    """What the units are, and how many make a window and an anchor."""

    window: int
    gram: int
    units: Callable
    slices: Callable
    rest: Callable
    count: Callable
    whole: Callable
    sep: bytes


def bytes_kind(window: int) -> Kind:
    return Kind(window, max(1, min(20, window // 2)), byte_units, byte_slices, byte_rest, len, lambda t: t, b"")


def words_kind(window: int) -> Kind:
    return Kind(window, max(1, min(5, window // 2)), word_units, word_slices, word_rest, lambda t: len(t.split()), all_words, b" ")


def segments(u: np.ndarray, before: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, segment, start, length) of all windows of the texts: hashes, and places among the units."""
    out = []
    span = window - gram + 1
    for lo in range(0, max(0, len(u) - window + 1), CHUNK):
        own = u[lo : lo + CHUNK + window - 1].astype(np.uint64)
        n = len(own)
        p, inverse = powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((own + np.uint64(1)) * p, out=total[1:])
        grams = mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
        key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        least, width = key, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(key) - span + 1], least[span - width :])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # Windows that cross the edge of a text don't count.
        inside = np.ones(len(place), bool)
        first = np.searchsorted(before, lo, "right")
        for edge in before[first:]:
            if edge - lo >= n:
                break
            inside[max(0, edge - lo - window + 1) : edge - lo] = False
        s = np.flatnonzero(inside)
        if not len(s):
            continue
        own_place = place[s]
        new = np.ones(len(s), bool)
        new[1:] = (own_place[1:] != own_place[:-1]) | (s[1:] != s[:-1] + 1)
        head = np.flatnonzero(new)
        start, end = s[head], s[np.append(head[1:], len(s)) - 1] + window
        seg = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
        out.append((grams[own_place[head]], seg, start + lo, end - start))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def joined(owner: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each owner, those that overlap or touch made one."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], (start + length)[order]
    if not len(owner):
        return owner, start, end
    # Owners follow each other on one axis, so that a running greatest end works for all at once.
    shift = owner.astype(np.int64) * (int(end.max()) + 2)
    far = np.maximum.accumulate(end + shift)
    new = np.ones(len(owner), bool)
    new[1:] = (start + shift)[1:] > far[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(owner)) - 1
    return owner[head], start[head], (far[last] - shift[last]) - start[head]


def least_by(groups: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For sorted groups: the least value of each row's group."""
    new = np.ones(len(groups), bool)
    new[1:] = groups[1:] != groups[:-1]
    head = np.flatnonzero(new)
    return np.repeat(np.minimum.reduceat(value, head), np.diff(np.append(head, len(groups))))


ROW = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("block", pa.binary())])
ROW_DDL = "bucket int, doc_id long, row_key long, start int, length int, block binary"
FOUND = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("bucket", pa.int32()), ("single", pa.bool_())])
FOUND_DDL = "doc_id long, row_key long, start int, length int, bucket int, single boolean"
SPAN = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()), ("length", pa.int32())])
SPAN_DDL = "doc_id long, row_key long, start int, length int"


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)


def _block(anchor: np.ndarray, seg: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> bytes:
    """A block of segments of rows that stand by id, in the order of rows and places: hashes of segments, and differences.

    The anchors of a bucket lie close together, so what they are above the least of the block has fewer bytes. Numbers lie
    in planes of a byte each: those of few values take little room. Hashes have nothing to compress but the anchors' first.
    """
    used, row = np.unique(row, return_inverse=True)
    step, low = np.diff(start, prepend=0), anchor.min()
    above = np.ascontiguousarray((anchor - low).astype("<u8").view(np.uint8).reshape(-1, 8).T)
    wide = max(1, -(-int((anchor - low).max()).bit_length() // 8))
    fields = [np.diff(ids[used], prepend=0).astype("<i8"), keys[used].astype("<i8"), np.diff(row, prepend=0).astype("<u4"), step.astype("<i4"), length.astype("<u2") if length.max() < 65536 else length.astype("<u4")]
    plain = above[: wide - 1].tobytes() + seg.astype("<u8").tobytes()
    raw = b"".join([above[wide - 1].tobytes(), *(np.ascontiguousarray(f.view(np.uint8).reshape(len(f), -1).T).tobytes() for f in fields)])
    head = np.array([len(anchor), len(used), fields[4].itemsize, wide, len(raw)], "<u4").tobytes()
    return head + low.astype("<u8").tobytes() + plain + pa.compress(raw, codec="zstd", asbytes=True)


def _unblock(block: bytes) -> tuple[np.ndarray, ...]:
    n, rows, size, wide, most = np.frombuffer(block[:20], "<u4").tolist()
    low, at = np.frombuffer(block[20:28], "<u8")[0], 28 + n * (wide - 1)
    above = np.zeros((8, n), np.uint8)
    above[: wide - 1] = np.frombuffer(block[28:at], np.uint8).reshape(wide - 1, n)
    seg = np.frombuffer(block[at : at + 8 * n], "<u8")
    raw = np.frombuffer(pa.decompress(block[at + 8 * n :], most, codec="zstd", asbytes=True), np.uint8)
    above[wide - 1], at = raw[:n], n
    anchor = np.ascontiguousarray(above.T).view("<u8").ravel() + low

    def field(count: int, kind: str) -> np.ndarray:
        nonlocal at
        width = np.dtype(kind).itemsize
        x = np.ascontiguousarray(raw[at : at + count * width].reshape(width, count).T).view(kind).ravel()
        at += count * width
        return x

    ids, keys = np.cumsum(field(rows, "<i8")), field(rows, "<i8")
    row = np.cumsum(field(n, "<u4").astype(np.int64))
    start = np.cumsum(field(n, "<i4").astype(np.int64))
    return anchor, seg, ids[row], keys[row], start, field(n, "<u2" if size == 2 else "<u4").astype(np.int64)


def _gather(kind: Kind, buckets: int) -> Callable:
    """Map side: segments of the task's documents. What a smaller document of the block covers is told at once."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        ids, keys = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        sizes = [len(h[0]) for h in held]
        shift = np.cumsum([0, *sizes[:-1]])
        row = np.concatenate([h[2] + s for h, s in zip(held, shift, strict=True)])
        by_id = np.lexsort((keys, ids))  # rows stand by id, so that ids are small differences
        ids, keys, row = ids[by_id], keys[by_id], np.argsort(by_id)[row]
        anchor, seg, start, length = (np.concatenate([h[k] for h in held]) for k in (3, 4, 5, 6))
        anchor = mix(anchor)  # anchors are least hashes, so their high bits are uneven; buckets go by those
        order = np.lexsort((seg, anchor))
        new = np.ones(len(order), bool)
        new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (seg[order][1:] != seg[order][:-1])
        low = np.empty(len(order), np.int64)
        if len(order):
            low[order] = least_by(np.cumsum(new), ids[row][order])
        covered = ids[row] > low
        r, s, n = joined(row[covered], start[covered], length[covered])
        yield pa.record_batch([pa.array((r % buckets).astype(np.int32)), pa.array(ids[r]), pa.array(keys[r]), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.nulls(len(r), pa.binary())], schema=ROW)
        kept = np.flatnonzero(~covered)
        if not len(kept):
            return
        bucket = bucket_of(anchor[kept], buckets)
        order = kept[np.lexsort((row[kept], bucket))]
        bucket = np.sort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        blocks = [_block(anchor[x], seg[x], row[x], start[x], length[x], ids, keys) for x in np.split(order, cuts[1:])]
        n = len(blocks)
        yield pa.record_batch([pa.array(bucket[cuts]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(blocks, pa.binary())], schema=ROW)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches(rows, 4 << 20):
            b = b.filter(b.column(0).is_valid())
            data, at = utf8(b.column(1))
            u, before = kind.units(data, at)
            anchor, seg, start, length = segments(u, before, kind.window, kind.gram)
            row = np.searchsorted(before, start, "right") - 1
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False), row, anchor, seg, start - before[row], length))
            size += len(data)
            if size >= GATHER:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _compare(t: pa.Table) -> pa.Table:
    """Of a bucket: spans that a smaller document covers (bucket null), and segments to look at more closely."""
    told = t.filter(t.column("block").is_null())
    out = [pa.Table.from_arrays([told.column(c) for c in ("doc_id", "row_key", "start", "length")] + [pa.nulls(told.num_rows, pa.int32()), pa.nulls(told.num_rows, pa.bool_())], schema=FOUND)]
    blocks = [_unblock(x) for x in t.column("block").drop_null().to_pylist()]
    if blocks:
        anchor, seg, doc, key, start, length = (np.concatenate(c) for c in zip(*blocks, strict=True))
        del blocks
        order = np.lexsort((doc, seg, anchor))
        anchor, seg, doc, key, start, length = (x[order] for x in (anchor, seg, doc, key, start, length))
        new_anchor = np.ones(len(anchor), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new = new_anchor.copy()
        new[1:] |= seg[1:] != seg[:-1]
        group = np.cumsum(new)
        low = doc[np.flatnonzero(new)][group - 1]  # rows of a group stand by doc_id
        covered = doc > low
        _, owner = np.unique(key[covered] ^ (doc[covered] * 31), return_inverse=True)
        pick = np.flatnonzero(covered)
        first = np.zeros(owner.max() + 1 if len(owner) else 0, np.int64)
        first[owner] = pick
        r, s, n = joined(owner, start[covered], length[covered])
        r = first[r]
        out.append(pa.table([pa.array(doc[r]), pa.array(key[r]), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.nulls(len(r), pa.int32()), pa.nulls(len(r), pa.bool_())], schema=FOUND))
        head = np.flatnonzero(new_anchor)
        distinct = np.add.reduceat(new.astype(np.int64), head)
        distinct = np.repeat(distinct, np.diff(np.append(head, len(anchor))))
        look = np.flatnonzero(~covered & (distinct > 1))
        deal = (mix(anchor[look]) >> np.uint64(33)).astype(np.int32)
        out.append(pa.table([pa.array(doc[look]), pa.array(key[look]), pa.array(start[look].astype(np.int32)), pa.array(length[look].astype(np.int32)), pa.array(deal), pa.array(distinct[look] > HOT_SEGMENTS)], schema=FOUND))
    return pa.concat_tables(out)


def _cut(kind: Kind, buckets: int) -> Callable:
    """The wanted segments' units, from the texts; windows of anchors with very many segments one by one.

    A window of these that a smaller document of the batch also has is told at once, without its units.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            b = b.filter(b.column(3).is_valid())
            out: list[list] = [[], [], [], [], []]
            alone: list[tuple] = []
            for doc, text, key, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3), strict=True):
                w = wanted.values
                starts, lengths, deal, single = (w.field(k).to_pylist() for k in ("start", "length", "bucket", "single"))
                got = kind.slices(text.as_buffer().to_pybytes() if text.is_valid else b"", starts, lengths)
                for s, n, d, one, seg in zip(starts, lengths, deal, single, got, strict=True):
                    if one:
                        alone += [(doc, key, s + k, x) for k, x in enumerate(kind.slices(seg, list(range(n - kind.window + 1)), [kind.window] * (n - kind.window + 1)))]
                    else:
                        for c, v in zip(out, (d % buckets, doc, key, s, seg), strict=True):
                            c.append(v)
            least: dict[bytes, int] = {}
            for doc, _, _, x in alone:
                if least.get(x, doc) >= doc:
                    least[x] = doc
            for doc, key, at, x in alone:
                row = ((doc ^ key) % buckets, doc, key, at, None) if doc > least[x] else (xxhash.xxh3_64_intdigest(x) % buckets, doc, key, at, x)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "doc_id", "row_key", "start", "seg"])

    return run


def repeats(docs: DataFrame, kind: Kind, kernel: Callable[[list[bytes], np.ndarray], np.ndarray]) -> DataFrame:
    """(doc_id, text, row_key, spans): spans of units that a window of a smaller document covers, null if there are none.

    kernel gets segments and their doc_ids, and tells for each unit of all segments, one after the other, whether a window
    that starts there also occurs in a segment with a smaller doc_id.
    """
    tune(docs.sparkSession)
    buckets = 4 * parts(docs)
    # Rows of one id are told apart by their texts' hash; where no id is repeated that needs no room.
    repeated = not docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "text") if repeated else F.lit(0).cast("long"))
    found = settle(docs.mapInArrow(_gather(kind, buckets), ROW_DDL).groupBy("bucket").applyInArrow(_compare, FOUND_DDL))
    keys = ["doc_id", "row_key"] if repeated else ["doc_id"]
    wanted = found.filter("bucket is not null").groupBy(*keys).agg(F.collect_list(F.struct("start", "length", "bucket", "single")).alias("wanted"))

    def near(t: pa.Table) -> pa.Table:
        told = t.filter(t.column("seg").is_null())
        told = pa.Table.from_arrays([*(told.column(c) for c in ("doc_id", "row_key", "start")), pa.array(np.full(told.num_rows, kind.window, np.int32))], schema=SPAN)
        t = t.filter(t.column("seg").is_valid())
        if not t.num_rows:
            return told
        segs, ids = t.column("seg").to_pylist(), t.column("doc_id").to_numpy()
        covered = kernel(segs, ids)
        sizes = np.array([kind.count(x) for x in segs], np.int64)
        base = np.cumsum(np.append(0, sizes))
        at = np.flatnonzero(covered)
        seg = np.searchsorted(base, at, "right") - 1
        r, s, n = joined(seg, at - base[seg], np.full(len(at), kind.window))
        return pa.concat_tables([told, pa.table([pa.array(ids[r]), pa.array(t.column("row_key").to_numpy()[r]), pa.array((s + t.column("start").to_numpy()[r]).astype(np.int32)), pa.array(n.astype(np.int32))], schema=SPAN)])

    cut = docs.join(wanted, keys, "left").select("doc_id", "text", "row_key", "wanted").mapInArrow(_cut(kind, buckets), "bucket int, doc_id long, row_key long, start int, seg binary")
    spans = found.filter("bucket is null").select(*keys, "start", "length").unionByName(cut.groupBy("bucket").applyInArrow(near, SPAN_DDL).select(*keys, "start", "length"))
    spans = spans.groupBy(*keys).agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    return docs.join(spans, keys, "left").select("doc_id", "text", "row_key", "spans")


def without_repeats(docs: DataFrame, kind: Kind, kernel: Callable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, kept): kept is the rest as bytes; n_spans counts maximal removed runs."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(b.column(1), b.column(3), strict=True):
                text = text.as_buffer().to_pybytes() if text.is_valid else b""
                n = kind.count(text)
                if not spans.is_valid:
                    row = (n, 0, 0, kind.whole(text))
                else:
                    edge = np.zeros(n + 1, np.int32)
                    start = spans.values.field("start").to_numpy()
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + spans.values.field("length").to_numpy(), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    row = (n, int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)), kind.rest(text, gone))
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["doc_id", "n_units", "n_removed", "n_spans", "kept"])

    return repeats(id_text(docs, id_col, text_col), kind, kernel).mapInArrow(run, "doc_id long, n_units long, n_removed long, n_spans long, kept binary")
