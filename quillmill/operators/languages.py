"""Languages by letter n-grams: a multinomial model that Spark counts from labelled texts.

Texts are lower-cased, everything but letters becomes one space, and runs of one to three letters (with the space at a word's
ends) are counted by language. The MOST most frequent n-grams of each language are kept; an n-gram weighs, for a language,
1000 times the logarithm of its smoothed share there, as a whole number. So sums are exact, and a text's language is that of
the greatest sum; equal sums go to the first language by name. Each task counts its texts' n-grams, so that only counts are shuffled
(and written once); the table that is sent to all tasks has at most MOST times the number of languages n-grams, whatever the corpus.

Defined results: null texts, and texts without a letter, have no language (null, with a null score). Labelled rows whose text
or language is null teach nothing. Without any labelled row no text has a language.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import settle

MOST, LONGEST = 3000, 3
#: Kinds of n-grams that a task holds before it passes their counts on.
HELD = 500_000


def letters_of(text: Column) -> Column:
    """A text as its n-grams see it: lower-cased words with one space around each."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.when(words != "", F.concat(F.lit(" "), words, F.lit(" "))).otherwise("")


def gram_counts(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n): how often each language has each n-gram. No n-gram is a blank alone."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), letters_of(F.col(text)).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, Counter[str]] = defaultdict(Counter)

        def done() -> pa.RecordBatch:
            out = [(x, g, n) for x, own in held.items() for g, n in own.items() if g != " "]
            held.clear()
            return pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])

        for b in batches:
            for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n in range(1, LONGEST + 1):
                    held[x].update(map("".join, zip(*(t[k:] for k in range(n)))) if n > 1 else t)  # noqa: B905
                if sum(map(len, held.values())) > HELD:
                    yield done()
        yield done()

    return rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def weights(counts: DataFrame, most: int = MOST) -> DataFrame:
    """(gram, lang, w): a weight of each kept n-gram for each language."""
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    kept = counts.withColumn("r", rank).filter(F.col("r") <= most).select("gram").distinct()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    langs = totals.agg(F.collect_list(F.struct("lang", "total", "kinds")).alias("langs")).withColumn("one", F.lit(1))  # one row a language
    every = kept.withColumn("one", F.lit(1)).join(F.broadcast(langs), "one").select("gram", F.inline("langs"))
    own = every.join(counts, ["lang", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return own.select("gram", "lang", F.round(1000 * F.log((F.col("n") + 0.5) / (F.col("total") + 0.5 * F.col("kinds")))).cast("long").alias("w"))


class LanguageModel:
    """Weights by n-gram. Called with a list of texts it gives (language, score) for each; score is the language's share of
    belief. It can be pickled."""

    def __init__(self, table: dict[str, list[int]], langs: list[str]):
        self.table, self.langs = table, langs

    @classmethod
    def fit(cls, labelled: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST) -> LanguageModel:
        rows = weights(settle(gram_counts(labelled, text, lang)), most).collect()  # at most `most` n-grams of each language
        langs = sorted({r.lang for r in rows})
        at = {x: k for k, x in enumerate(langs)}
        table: dict[str, list[int]] = {}
        for r in rows:
            table.setdefault(r.gram, [0] * len(langs))[at[r.lang]] = r.w
        return cls(table, langs)

    def sums(self, text: str) -> list[int] | None:
        """Each language's sum, null for a text without letters."""
        words = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        if not words or not self.langs:
            return None
        t = f" {words} "
        grams: Counter[str] = Counter(c for c in t if c != " ")
        for n in range(2, LONGEST + 1):
            grams.update(t[k : k + n] for k in range(len(t) - n + 1))
        out = [0] * len(self.langs)
        for g, n in grams.items():
            if (own := self.table.get(g)) is not None:
                for k, w in enumerate(own):
                    out[k] += n * w
        return out

    def __call__(self, texts: list[str]) -> list[tuple[str | None, float | None]]:
        out: list[tuple[str | None, float | None]] = []
        for text in texts:
            sums = self.sums(text)
            if sums is None:
                out.append((None, None))
                continue
            best = max(range(len(sums)), key=lambda k: (sums[k], -k))
            out.append((self.langs[best], 1 / sum(math.exp(max(-700.0, (s - sums[best]) / 1000)) for s in sums)))
        return out


def language_by(model: LanguageModel, text: Column | str) -> Column:
    """struct(lang, score) of each text."""

    @F.pandas_udf("lang string, score double")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model([v or "" for v in values.tolist()]), columns=["lang", "score"])

    return run(F.col(text) if isinstance(text, str) else text)
