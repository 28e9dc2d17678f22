"""A stored positional index of texts, which answers the searches of operators.search without reading the texts.

A text is lower-cased and cut at single spaces; each piece is a term, and its place is its number among the pieces (two
spaces have an empty piece between them, which is a term too, so that phrases match as they are written). The
postings of a block of texts (term, and the keys and places where it stands) are written to BUCKETS folders by the hash of their term,
sorted by term, so that a reader skips row groups by their least and greatest term; so is the vocabulary, with each term's number of texts. More texts are appended
as more files.

A search looks its words up in the vocabulary (terms that contain, end with, are or start with a part of what is asked), reads
the postings of those terms' buckets only, and joins places: the words of a phrase have to follow each other; the parts of an ordered search are merged by the least place each can have after the one before. Nothing but bucket
numbers goes to the driver. Postings are dealt by text, so a frequent term is no hot key.

Defined results: null texts are empty and match nothing; null keys aren't indexed. Keys must be unique over all that is
written: a text that is appended again is found twice. An empty query matches every text.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import pinned

BUCKETS = 64
#: Places that a block of texts has at least, but for the last; they bound what a task holds.
BLOCK = 3_000_000


def _ints(lists: list[array]) -> pa.Array:
    flat = np.concatenate([np.frombuffer(x, np.int32) for x in lists])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(flat))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, t) to the postings of blocks of texts. A text is a row, so nothing is shuffled to put its terms together."""
    held: dict[str, list] = {}  # keys and places of a term, and how many texts have it
    size, kind = 0, None

    def done() -> Iterator[pa.RecordBatch]:
        terms = list(held)
        for k in range(0, len(terms), 10_000):
            own = [held[t] for t in terms[k : k + 10_000]]
            columns = [pa.array(terms[k : k + 10_000], pa.string()), pa.array([x[0] for x in own], pa.list_(kind)), _ints([x[1] for x in own]), pa.array([x[2] for x in own], pa.int64())]
            yield pa.record_batch(columns, names=["term", "keys", "places", "n"])
        held.clear()

    for b in batches:
        kind = b.schema.field(0).type
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for at, term in enumerate(text.split(" ")):
                own = held.get(term)
                if own is None:
                    own = held[term] = [[], array("i"), 0]
                own[2] += not own[0] or own[0][-1] != key
                own[0].append(key)
                own[1].append(at)
                size += 1
            if size >= BLOCK:
                yield from done()
                size = 0
    yield from done()


class TextIndex:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def append(self, texts: DataFrame, key: str, text: str | Column) -> TextIndex:
        """Write the postings of more texts."""
        lower = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
        rows = texts.select(F.col(key).alias("key"), lower.alias("t")).filter("key is not null")
        blocks = rows.mapInArrow(_blocks, f"term string, keys array<{rows.schema['key'].dataType.simpleString()}>, places array<int>, n long")
        self._write(blocks, "postings")
        self._write(self.spark.read.parquet(f"{self.root}/postings").groupBy("term").agg(F.sum("n").alias("n")), "terms", "overwrite")
        return self

    def _write(self, rows: DataFrame, name: str, mode: str = "append") -> None:
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")).hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", "term").write.mode(mode).partitionBy("bucket").parquet(f"{self.root}/{name}")

    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/terms")

    def postings(self, terms: DataFrame) -> DataFrame:
        """The postings of some terms (term, bucket): of their buckets' folders only."""
        buckets = [r.bucket for r in terms.select("bucket").distinct().collect()]  # at most self.buckets
        held = self.spark.read.parquet(f"{self.root}/postings").filter(F.col("bucket").isin(buckets))
        return held.join(terms, ["bucket", "term"])

    def _word(self, word: str, kind: str) -> DataFrame:
        """(key, at, inside, term): each place where a word, or the end, start or inside of one, stands."""
        term = F.col("term")
        hit = {"is": term == word, "ends": term.endswith(word), "starts": term.startswith(word), "has": F.contains(term, F.lit(word))}[kind]
        found = self.terms().filter(hit).select("bucket", "term")
        if kind == "has":
            every = F.sequence(F.lit(0), F.length(term) - len(word))
            insides = F.filter(every, lambda i: F.substring(term, i + 1, F.lit(len(word))) == word)
        else:
            insides = F.array(F.length(term) - len(word) if kind == "ends" else F.lit(0))
        rows = self.postings(pinned(found, insides=insides)).select("term", "insides", F.inline(F.arrays_zip("keys", "places"))).withColumnsRenamed({"keys": "key", "places": "at"})
        return rows.select("key", "at", F.explode("insides").alias("inside"), "term")

    def places(self, query: str) -> DataFrame:
        """(key, at, inside, term): each place where a text has the query, whatever its case; those of its first word."""
        words = query.lower().split(" ")
        if len(words) == 1:
            return self._word(words[0], "has")
        out = self._word(words[0], "ends")
        for k, w in enumerate(words[1:], 1):
            after = self._word(w, "starts" if k + 1 == len(words) else "is").select("key", (F.col("at") - k).alias("at"))
            out = out.join(after, ["key", "at"], "left_semi")
        return out

    def substring(self, query: str) -> DataFrame:
        """(key) of texts that have the query, as search.substring finds them."""
        return self.places(query).select("key").distinct()

    def all_substrings(self, queries: list[str]) -> DataFrame:
        out = self.substring(queries[0])
        for q in queries[1:]:
            out = out.join(self.substring(q), "key", "left_semi")
        return out

    def word_start(self, query: str) -> DataFrame:
        """Texts in which the query comes after a character that is no letter, as search.word_start finds them."""
        before = F.substring("term", F.col("inside"), F.lit(1))
        hit = F.when(F.col("inside") == 0, F.col("at") > 0).otherwise(~before.rlike("[a-z]"))
        return self.places(query).filter(hit).select("key").distinct()

    def ordered(self, queries: list[str]) -> DataFrame:
        """Texts that have all in this order, one after the other, as search.ordered finds them."""
        out = None
        for q in queries:
            here, words = self.places(q), q.split(" ")
            place = F.struct("at", "inside")
            if out is not None:
                here = here.join(out, "key").filter(place >= F.col("end"))
            here = here.groupBy("key").agg(F.min(place).alias("first"))
            inside = F.lit(len(words[-1])) if len(words) > 1 else F.col("first.inside") + len(q)
            out = here.select("key", F.struct((F.col("first.at") + len(words) - 1).alias("at"), inside.alias("inside")).alias("end"))
        return out.select("key")

    def any_phrase(self, phrases: list[str], texts: DataFrame, key: str, text: str | Column) -> DataFrame:
        """Texts with one of the phrases as written: those that have it in any case are looked at."""
        from .search import any_phrase

        out = None
        for p in phrases:
            found = self.substring(p)
            out = found if out is None else out.unionByName(found)
        near = texts.join(out.distinct().withColumnRenamed("key", key), key, "left_semi")
        return near.filter(any_phrase(phrases, text)).select(F.col(key).alias("key"))
