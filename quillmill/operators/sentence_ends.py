"""Sentence ends learned without labels: which words a full stop belongs to.

Every word that ends in a full stop somewhere is counted with and without it, over the whole corpus. A word whose full stop is
no accident (log-likelihood ratio of word and full stop), that is short and often has inner full stops, is an abbreviation;
each occurrence without a full stop speaks against it. Then the rule's sentences are joined again where the last word of one is
an abbreviation, unless the next begins with a word that often begins sentences (log-likelihood ratio of sentence ends and that
word). The counts are reduced before they are shuffled; the tables of abbreviations and beginnings have at most MOST rows.

Defined results: null texts count for nothing and have no sentences. Words are compared lower-cased. A text of one sentence
stays as it is. An empty corpus has no abbreviations.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..shared import settle
from .tables import pinned

MOST = 5000
#: An abbreviation's least score, and the least ratio of a word that begins sentences.
LEAST_SCORE, LEAST_START = 0.3, 30.0
#: The share of words with a full stop, of those whose full stop belongs to them.
SURE = 0.99


def _words(corpus: DataFrame, text: str) -> DataFrame:
    """(word, stop, after_stop): a row for each word of the texts; word without its full stop, lower-cased."""
    w = F.filter(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "), " "), lambda x: x != "")
    rows = pinned(corpus.select(w.alias("_w")), w=F.col("_w"))
    rows = rows.select(F.inline(F.transform("w", lambda x, i: F.struct(x.alias("word"), F.when(i > 0, F.get("w", i - 1).endswith(".")).otherwise(False).alias("before")))))
    stop, before = F.col("word").endswith("."), F.col("before")
    name = F.lower(F.regexp_replace(F.col("word"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return rows.select(name.alias("word"), stop.cast("int").alias("stop"), before.cast("int").alias("after_stop")).filter("word <> ''")


def _xlog(n: Column, p: Column) -> Column:
    """n ln p, where 0 ln 0 is 0."""
    return F.when(n > 0, n * F.log(F.greatest(p, F.lit(1e-12)))).otherwise(0.0)


def counts(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(word, n, with_stop, after_stop) of each word, and the sums over all words: total, stops."""
    by_word = _words(corpus, text).groupBy("word").agg(F.count("*").alias("n"), F.sum("stop").alias("with_stop"), F.sum("after_stop").alias("after_stop"))
    sums = by_word.agg(F.sum("n").alias("total"), F.sum("with_stop").alias("stops"))
    return by_word.withColumn("one", F.lit(1)).join(F.broadcast(sums.withColumn("one", F.lit(1))), "one").drop("one")  # sums: one row


def scored(counted: DataFrame) -> DataFrame:
    """(word, n, with_stop, score) of words that have a full stop somewhere and a letter."""
    k, n, share = F.col("with_stop"), F.col("n"), F.col("stops") / F.col("total")
    ratio = 2 * (_xlog(k, F.lit(SURE)) + _xlog(n - k, F.lit(1 - SURE)) - _xlog(k, share) - _xlog(n - k, 1 - share))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    size = F.length("word") - inner
    score = ratio * F.exp(-size) * (inner + 1) * F.pow(size.cast("double"), -(n - k))
    return counted.filter((k > 0) & F.col("word").rlike(r"\p{L}")).select("word", "n", "with_stop", (F.round(score, 4) + 0.0).alias("score"))  # no minus zero


def abbreviations(counted: DataFrame, least: float = LEAST_SCORE, most: int = MOST) -> DataFrame:
    """(word, score): the best by score, then by name."""
    return scored(counted).filter(F.col("score") >= least).select("word", "score").orderBy(F.col("score").desc(), "word").limit(most)


def beginnings(counted: DataFrame, least: float = LEAST_START, most: int = MOST) -> DataFrame:
    """(word, ratio): words that come after a full stop far more often than others do."""
    k, n, share = F.col("after_stop"), F.col("n"), F.col("stops") / F.col("total")
    own = k / n
    ratio = F.when(own > share, 2 * (_xlog(k, own) + _xlog(n - k, 1 - own) - _xlog(k, share) - _xlog(n - k, 1 - share))).otherwise(0.0)
    return counted.select("word", F.round(ratio, 4).alias("ratio")).filter(F.col("ratio") >= least).orderBy(F.col("ratio").desc(), "word").limit(most)


class SentenceEnds:
    """The two tables, small enough for every task."""

    def __init__(self, shortened: set[str], starts: set[str]):
        self.shortened, self.starts = frozenset(shortened), frozenset(starts)

    @classmethod
    def fit(cls, corpus: DataFrame, text: str = "text", least: float = LEAST_SCORE) -> SentenceEnds:
        counted = settle(counts(corpus, text))
        return cls({r.word for r in abbreviations(counted, least).collect()}, {r.word for r in beginnings(counted).collect()})  # at most MOST each

    def joins(self, last: str, first: str) -> bool:
        """Whether a sentence that ends in the word last goes on with the word first."""
        bare = last.lower().strip("([\"'“‘")
        if not bare.endswith(".") or bare[:-1] not in self.shortened:
            return False
        return first.lower().strip("([\"'“‘.,;:!?)]”’") not in self.starts

    def joined(self, sentences: list[str]) -> list[str]:
        out: list[list[str]] = []
        for s in sentences:
            words = s.split()
            if out and words and (before := out[-1][-1].split()) and self.joins(before[-1], words[0]):
                out[-1].append(s)
            else:
                out.append([s])
        return [" ".join(x) for x in out]


def sentences_by(model: SentenceEnds, text: Column | str) -> Column:
    """The sentences of a text: the rule's, joined where a full stop belongs to its word."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else model.joined(list(v)) for v in values.tolist()], dtype=object)

    return run(X.sentences(text))
