"""A trained tagger of words: an averaged perceptron, fitted by iterative parameter mixing.

Rows are dealt to `shards` by the hash of their key and sorted there. In a round each shard is read once, from the weights that
all shards agreed on: words are tagged from left to right, and where the tag is wrong the features' weights move, after some
words (STEP at first, more later), so that a step's scores are looked up at once. A round's results are summed by feature over
the shards and divided by their number. The model has the mean of the weights that were in use, over all words, shards and
rounds; it is measured on rows that aren't trained on after each round, and training stops
when it hasn't become better for `patience` rounds.

Weights are whole numbers, UNIT a step, so sums don't depend on the order they are made in: the same rows give the same
weights however they lie in partitions. Features are hashed to 2 ** BITS places, so a model has at most as many rows (of a
number for each tag), whatever the corpus: that is what goes to the driver and to all tasks each round.

Defined results: rows whose text or tags are null, or whose numbers of words and tags differ, teach nothing and aren't
measured. An unknown tag is O. A text without words has no tags. Without rows to train on all words are O.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import settle
from .tables import pinned
from .training import TAGS, split

BITS, UNIT = 16, 1 << 16
SHARDS, ROUNDS, PATIENCE = 8, 8, 2
#: Words that are tagged at once, and words whose features are numbered at once.
BLOCK, CHUNK = 1024, 1 << 16
#: Weights move after so many words of a shard at first, and after a SHARE-th of the words it has seen later, up to a bound.
STEP, SHARE, MOST_STEP = 16, 64, 256
#: Bytes of a word that a table of shifted check sums is made for.
LONG_WORD = 64
#: With more rows than so many a shard there are more shards, up to a bound, so that a round grows with the cores' number.
ROWS, MOST_SHARDS = 2_000, 256


def word_features(words: list[str]) -> list[list[str]]:
    """What is known of each word before its tag: the word, its ends, its neighbours, its place in sentence and text."""
    n, out, sentence, start = len(words), [], 0, True
    ends = [w.endswith((".", "!", "?")) for w in words]
    total = max(1, sum(ends) or 1)
    low = ["", "", *(w.lower() for w in words), "", ""]
    for k in range(n):
        w = low[k + 2]
        out.append(["1", f"w={w}", f"p={w[:4]}", f"s={w[-3:]}", f"b={low[k + 1]}", f"a={low[k + 3]}", f"bw={low[k + 1]} {w}", f"place={k * 12 // n}", f"sent={min(sentence, 12)}", f"share={min(11, sentence * 12 // total)}", f"start={start}", f"left={min(8, total - sentence)}"])
        start = ends[k]
        sentence += start
    return out


def hashed(name: str, bits: int) -> int:
    return zlib.crc32(name.encode()) & ((1 << bits) - 1)


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """What each byte of a check sum becomes when so many bytes follow."""
    one = np.arange(256, dtype=np.int64)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ 0xEDB88320, one >> 1)
    out = [np.arange(256, dtype=np.int64) << np.arange(0, 32, 8)[:, None]]
    for _ in range(LONG_WORD):
        out.append(one[out[-1] & 255] ^ out[-1] >> 8)
    return np.stack(out)


def _chained(start: np.ndarray, own: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The check sums of texts that begin with texts of the sums start, and end with ones of the sums own and so many bytes."""
    shifts = _shifts()

    def shifted(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return shifts[by, 0, x & 255] ^ shifts[by, 1, x >> 8 & 255] ^ shifts[by, 2, x >> 16 & 255] ^ shifts[by, 3, x >> 24]

    start = shifted(start, np.minimum(size, LONG_WORD))
    rest = size - LONG_WORD
    while len(long := np.flatnonzero(rest > 0)):  # by parts
        start[long] = shifted(start[long], np.minimum(rest[long], LONG_WORD))
        rest = rest - LONG_WORD
    return start ^ own


@lru_cache(maxsize=8)
def _tables(bits: int) -> list:
    """The places of word_features' features of few values."""
    ranges = {"place": range(12), "sent": range(13), "share": range(12), "start": (False, True), "left": range(9)}
    return [hashed("1", bits), *(np.array([hashed(f"{k}={x}", bits) for x in r], np.int64) for k, r in ranges.items())]


def summed(weights: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each row of places the sum of their weights."""
    out = weights.take(places[:, 0], axis=0)
    for k in range(1, places.shape[1]):
        out += weights.take(places[:, k], axis=0)
    return out


class Perceptron:
    """Weights by hashed feature and tag, and how to tag with them. It can be pickled and sent to tasks."""

    def __init__(self, weights: np.ndarray, tags: tuple[str, ...] = TAGS):
        self.weights, self.tags = weights, tags
        self.bits = int(len(weights)).bit_length() - 1

    def numbers(self, words: list[str]) -> np.ndarray:
        """word_features of each word of a text as places, a row a word."""
        return self.numbers_of(pa.array(words, pa.string()), np.array([len(words)]))

    def numbers_of(self, words: pa.Array, sizes: np.ndarray) -> np.ndarray:
        """numbers of texts whose words lie one after the other, so many words (at least one) each: for all words at once."""
        n, size = len(words), (1 << self.bits) - 1
        if not n:
            return np.zeros((0, 12), np.int64)
        first, *kinds = _tables(self.bits)
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy()
        known = coded.dictionary.to_pylist()
        low = [w.lower() for w in known]
        raw = [w.encode() for w in low]
        whole, long = np.array([zlib.crc32(x) for x in raw], np.int64), np.array([len(x) for x in raw], np.int64)
        ends = np.array([w.endswith((".", "!", "?")) for w in known], np.int64)[code]
        of = lambda head: _chained(np.full(len(known), zlib.crc32(head), np.int64), whole, long)
        cut = [np.array([zlib.crc32(x.encode(), zlib.crc32(head)) for x in some], np.int64) for head, some in ((b"p=", [w[:4] for w in low]), (b"s=", [w[-3:] for w in low]))]
        plain = (np.stack([of(b"w="), *cut, of(b"b="), of(b"a=")], axis=1) & size)[code]
        head = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(sizes)), sizes)
        before, after = np.roll(plain[:, 3], 1), np.roll(plain[:, 4], -1)
        before[head], after[head - 1] = hashed("b=", self.bits), hashed("a=", self.bits)
        start = np.roll(_chained(of(b"bw="), np.array(zlib.crc32(b" ")), np.ones(len(known), np.int64))[code], 1)
        start[head] = zlib.crc32(b"bw= ")
        pairs = _chained(start, whole[code], long[code]) & size
        sentence = np.cumsum(ends) - ends
        sentence -= sentence[head][text]
        total = np.maximum(1, np.add.reduceat(ends, head))[text]
        begins = np.roll(ends, 1)
        begins[head] = 1
        small = ((np.arange(n) - head[text]) * 12 // sizes[text], np.minimum(sentence, 12), np.minimum(11, sentence * 12 // total), begins, np.minimum(8, total - sentence))
        return np.stack([np.full(n, first), *plain[:, :3].T, before, after, pairs, *(t[x] for t, x in zip(kinds, small, strict=True))], axis=1)

    def after(self, tag: np.ndarray, fs: np.ndarray) -> np.ndarray:
        """The features of the tag before, alone and with the word and the sentence's start, a row a word."""
        size = (1 << self.bits) - 1
        t = (tag + 1) * 0x9E3779B1
        return np.stack([t & size, (t ^ fs[:, 1] * 31) & size, (t ^ fs[:, 10] * 131) & size], axis=1)

    def best(self, weights: np.ndarray, fs: np.ndarray) -> np.ndarray:
        """The best tag of each word after each tag, no tag first."""
        size, starts = (1 << self.bits) - 1, _tables(self.bits)[4]
        t = np.arange(len(self.tags) + 1) * 0x9E3779B1
        begun = weights[t & size] + weights[(t ^ starts[:, None] * 131) & size]  # for each value of a sentence's start
        linked = weights.take((t ^ fs[:, 1, None] * 31) & size, axis=0)
        linked += begun.take(fs[:, 10] == starts[1], axis=0)
        linked += summed(weights, fs)[:, None, :]
        return linked.argmax(2)

    def tag_all(self, words: pa.Array, sizes: np.ndarray) -> np.ndarray:
        """The tags of texts whose words lie one after the other, so many words (at least one) each."""
        fs, before, out = self.numbers_of(words, sizes), 0, []
        first = np.zeros(len(fs), bool)
        first[np.cumsum(sizes) - sizes] = True
        for k in range(0, len(fs), BLOCK):
            for row, new in zip(self.best(self.weights, fs[k : k + BLOCK]).tolist(), first[k : k + BLOCK].tolist(), strict=True):
                found = row[0 if new else before]
                out.append(found)
                before = found + 1
        return np.array(out, np.int64)

    def tag(self, words: list[str]) -> list[int]:
        return self.tag_all(pa.array(words, pa.string()), np.array([len(words)] if words else [], np.int64)).tolist()

    def __call__(self, texts: list[str]) -> list[list[str]]:
        """As a model's slot calls it: the tags of each text's words."""
        rows = [(text or "").split() for text in texts]
        out: list[list[str]] = [[] for _ in rows]
        some = [k for k, r in enumerate(rows) if r]
        for at, words, sizes, _ in chunks(pa.array([rows[k] for k in some], pa.list_(pa.string()))):
            tags, ends = self.tag_all(words, sizes).tolist(), np.cumsum(sizes).tolist()
            for k, lo, hi in zip(some[at : at + len(sizes)], [0, *ends], ends, strict=False):
                out[k] = [self.tags[t] for t in tags[lo:hi]]
        return out

    def __getstate__(self):
        return {"weights": self.weights, "tags": self.tags, "bits": self.bits}


def usable(rows: DataFrame, key: str, text: str, entities: str) -> DataFrame:
    """(key, words, tags): rows that can teach. Words are parted by white space."""
    words = F.split(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")), " ")
    out = pinned(rows.filter(F.col(text).isNotNull() & F.col(entities).isNotNull()), _words=words)  # parted once a row
    out = out.select(F.col(key).cast("string").alias("key"), F.col("_words").alias("words"), F.col(entities).alias("tags"))
    return out.filter((F.size("words") == F.size("tags")) & (F.size("words") > 0) & (F.col("words")[0] != ""))


def chunks(words: pa.ListArray, y: pa.ListArray | None = None) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray | None]]:
    """(first text, words, sizes, numbers of tags) of some whole texts at a time: about CHUNK words, or one text."""
    at = words.offsets.to_numpy().astype(np.int64)
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        own = None if y is None else y.values[y.offsets[lo].as_py() : y.offsets[hi].as_py()].to_numpy()
        yield lo, words.values[at[lo] : at[hi]], np.diff(at[lo : hi + 1]), own
        lo = hi


class _Pass:
    """One pass over a shard: the weights at its end, and their mean over its words. Texts have a word at least.

    Weights move between whole texts, or within long ones; after how many words depends on the texts before only, not on the
    batches they come in. Every second word sees the true tag before it, the others the one found, so a step has no loop.
    """

    def __init__(self, model: Perceptron):
        self.model, self.w = model, model.weights.copy()
        self.late = np.zeros_like(self.w)  # the moves, each times the words before it
        self.seen, self.last = 0, (0, 0)  # the true tag of the word before, and the one found
        self.held: list[tuple[np.ndarray, ...]] = []

    def learn(self, words: pa.ListArray, y: pa.ListArray) -> None:
        for _, own, sizes, gold in chunks(words, y):
            first = np.zeros(len(own), bool)
            first[np.cumsum(sizes) - sizes] = True
            self.held.append((self.model.numbers_of(own, sizes), gold, first))
            fs, gold, first = (np.concatenate(c) for c in zip(*self.held, strict=True))
            ends = np.append(np.flatnonzero(first)[1:], len(first))
            at = 0
            while (k := int(np.searchsorted(ends, at + self.step()))) < len(ends):
                self._walk(fs[at : ends[k]], gold[at : ends[k]], first[at : ends[k]])
                at = ends[k]
            self.held = [(fs[at:], gold[at:], first[at:])]

    def step(self) -> int:
        return min(MOST_STEP, max(STEP, self.seen // SHARE))

    def _walk(self, fs: np.ndarray, gold: np.ndarray, first: np.ndarray) -> None:
        step, n_tags = self.step(), self.w.shape[1]
        for k in range(0, len(fs), step):
            own, y, new = fs[k : k + step], gold[k : k + step].astype(np.int64), first[k : k + step]
            n = len(y)
            at, alone = np.arange(self.seen, self.seen + n), summed(self.w, own)
            before, found = np.where(new, 0, np.append(self.last[0], y[:-1]) + 1), np.empty(n, np.int64)
            told = (at % 2 == 0) & ~new  # these see what was found for the word before, which is none of these
            for some in (np.flatnonzero(~told), np.flatnonzero(told)):
                if len(some) and told[some[0]]:
                    before[some] = np.where(some > 0, found[some - 1], self.last[1]) + 1
                found[some] = (alone[some] + summed(self.w, self.model.after(before[some] - 1, own[some]))).argmax(1)
            self.seen, self.last = self.seen + n, (int(y[-1]), int(found[-1]))
            j = np.flatnonzero(found != y)
            if len(j):
                places = np.concatenate([own[j], self.model.after(before[j] - 1, own[j])], axis=1) * n_tags
                for tags, sign in ((y[j], UNIT), (found[j], -UNIT)):
                    moved = (places + tags[:, None]).ravel()
                    np.add.at(self.w.reshape(-1), moved, sign)
                    np.add.at(self.late.reshape(-1), moved, np.repeat(sign * at[j], places.shape[1]))

    def moved(self) -> pa.RecordBatch:
        """(feature, last, mean): by how much the weights have moved, at the end and in the mean."""
        for fs, gold, first in self.held:
            self._walk(fs, gold, first)
        self.held = []
        last = self.w - self.model.weights
        mean = last - self.late // max(1, self.seen)
        at = np.flatnonzero((last != 0).any(1) | (mean != 0).any(1))
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.shape[1] * (len(at) + 1), x.shape[1], dtype=np.int32)), pa.array(x[at].ravel())) for x in (last, mean)]
        return pa.record_batch([pa.array(at, pa.int32()), *lists], names=["feature", "last", "mean"])


def mixed(model: Perceptron, shards: DataFrame, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """One round over all shards: the mean of their last weights, and of their mean weights. shards: (shard, key, words, y)."""
    n_tags = len(model.tags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A shard is read once, and no more than a chunk of it is held.
        own, shard = None, None
        for b in batches:
            shards = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(shards, prepend=-1, append=-1)).tolist()
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if own is not None and shards[lo] != shard:
                    yield own.moved()
                    own = None
                own, shard = own or _Pass(model), shards[lo]
                own.learn(b.column(2).slice(lo, hi - lo), b.column(3).slice(lo, hi - lo))
        if own is not None:
            yield own.moved()

    parts = shards.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "key", "words").mapInArrow(run, "feature int, last array<long>, mean array<long>")
    sums = parts.groupBy("feature").agg(*(F.sum(F.col(c)[t]).alias(f"{c}{t}") for c in ("last", "mean") for t in range(n_tags)))
    out = [np.zeros_like(model.weights), np.zeros_like(model.weights)]
    for r in sums.collect():  # at most 2 ** BITS rows
        out[0][r.feature], out[1][r.feature] = r[1 : 1 + n_tags], r[1 + n_tags :]
    return model.weights + out[0] // n_shards, model.weights + out[1] // n_shards


def accuracy(model: Perceptron, rows: DataFrame) -> tuple[int, int]:
    """(right, all): words of rows (words, y) that the model tags right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = n = 0
        for b in batches:
            for _, words, sizes, y in chunks(b.column(0), b.column(1)):
                right += int((model.tag_all(words, sizes) == y).sum())
                n += len(y)
        yield pa.record_batch([pa.array([right], pa.int64()), pa.array([n], pa.int64())], names=["right", "n"])

    r = rows.select("words", "y").mapInArrow(run, "right long, n long").agg(F.sum("right"), F.sum("n")).first()
    return r[0] or 0, r[1] or 0


def train(rows: DataFrame, key: str = "doi", text: str = "text", entities: str = "entities", tags: tuple[str, ...] = TAGS, shards: int | None = None, rounds: int = ROUNDS, patience: int = PATIENCE, bits: int = BITS) -> tuple[Perceptron, list[float]]:
    """The model, and its accuracy on the rows held out (20 of 100, by hash of the key) after each round.

    shards: SHARDS by default, and more for more than ROWS rows a shard.
    """
    number = F.create_map(*(F.lit(x) for k, t in enumerate(tags) for x in (t, k)))
    ready = usable(rows, key, text, entities)
    y = F.transform("tags", lambda t: F.coalesce(F.try_element_at(number, t), F.lit(0)))
    ready = settle(ready.select("key", "words", y.alias("y")))
    shards = shards or min(MOST_SHARDS, max(SHARDS, ready.count() // ROWS))
    own, held = split(ready.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", "words", "y"), "key")
    model = Perceptron(np.zeros((1 << bits, len(tags)), np.int64), tags)
    best, found, total, since = model, [], np.zeros_like(model.weights), 0
    for k in range(rounds):
        last, mean = mixed(model, own, shards)
        total += mean
        model = Perceptron(last, tags)
        now = Perceptron(total // (k + 1), tags)
        right, n = accuracy(now, held)
        found.append(right / n if n else 0.0)
        if k == 0 or found[-1] > max(found[:-1]):
            best, since = now, 0
        else:
            since += 1
            if since >= patience:
                break
    return best, found
