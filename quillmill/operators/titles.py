"""Papers found by an approximate title: a prefix-filtered join of title words, confirmed by edit distance.

Two titles match if their sets of words have a Jaccard similarity of `least` or more and their texts differ by at most
1 - `alike` of the longer one's letters (titles of more than LONG letters: by words alone). Words are put in the order of their rarity over both tables. Two sets that similar
share a word among the first n - ceil(least * n) + 1 of each, so only those words are joined; sizes, the words' places and the
number of first words that a pair shares bound its similarity before anything is compared. Common words are never among the first of a title of several words, so
no frequent word is a hot key; titles that are all of common words are few texts, as equal titles are joined once.

Defined results: null titles and titles without a letter or digit match nothing. Titles are compared lower-cased, by runs of
letters and digits. Of several papers that match one title the most similar wins (six digits), then the nearest by letters, then
the least key. Repeated titles of one table are matched once and get one answer each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import settle

LEAST, ALIKE = 0.7, 0.8
#: Titles with more letters are compared by their words alone.
LONG = 1000


def plain(title: Column) -> Column:
    """A title as it is compared: lower-cased words, one space between."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def _prefix(least: float) -> Column:
    return F.size("words") - F.ceil(F.round(F.size("words") * least, 9)).cast("int") + 1


def _words(titles: DataFrame) -> DataFrame:
    """(id, word): the distinct words of each title."""
    return titles.select("id", F.explode(F.array_distinct(F.split("plain", " "))).alias("word"))


def _ranked(titles: DataFrame, rarity: DataFrame) -> DataFrame:
    """(id, plain, words): the numbers of the distinct words of each title, rarest first. Only numbers meet the words."""
    rows = _words(titles).join(rarity, "word").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "number"))), lambda x: x["number"]).alias("words"))
    return titles.join(rows, "id")


def _first_words(rows: DataFrame, least: float) -> DataFrame:
    """A row for each of a title's first words, with the title's number and sizes in place of its text."""
    first = rows.select("id", F.size("words").alias("n"), F.length("plain").alias("letters"), F.slice("words", F.lit(1), _prefix(least)).alias("first"))
    return first.select("id", "n", "letters", F.posexplode("first").alias("at", "word"))


def _candidates(a: DataFrame, b: DataFrame, least: float, alike: float) -> DataFrame:
    """(l, r): pairs of the titles (id, plain, words) of two tables that may match, by numbers alone."""
    a, b = (_first_words(t, least) for t in (a, b))
    # Titles whose letters differ by the bound at most lie in one class of lengths or in two neighbours'.
    at = F.floor(F.log("letters") / (-math.log(alike) * (1 + 1e-6))).cast("int") if 0 < alike < 1 else F.lit(0)  # a little wider, for rounding
    a = a.select(F.col("id").alias("l"), F.col("n").alias("ln"), F.col("letters").alias("ll"), F.col("at").alias("la"), "word", F.explode(F.array(at - 1, at, at + 1) if 0 < alike < 1 else F.array(at)).alias("class"))
    b = b.select(F.col("id").alias("r"), F.col("n").alias("rn"), F.col("letters").alias("rl"), F.col("at").alias("ra"), "word", at.alias("class"))
    n, m = F.col("ln"), F.col("rn")
    # So many words can be shared up to a common one and after it; so many must be.
    could = F.least("la", "ra") + 1 + F.least(n - F.col("la") - 1, m - F.col("ra") - 1)
    must = F.ceil(F.round(F.lit(least / (1 + least)) * (n + m), 9))
    close = F.round(F.greatest("ll", "rl") * (1 - alike), 9) >= F.abs(F.col("ll") - F.col("rl"))
    seen = a.join(b, ["word", "class"]).filter((could >= must) & close).groupBy("l", "r", "ln", "rn").agg(F.count("*").alias("seen"))
    # A shared word that isn't among both titles' first words stands after those of one of them.
    after = [F.col(c) - (F.col(c) - F.ceil(F.round(F.col(c) * least, 9)).cast("int") + 1) for c in ("ln", "rn")]
    return seen.filter(F.col("seen") + F.greatest(*after) >= must).select("l", "r")


def similar(left: DataFrame, right: DataFrame, least: float = LEAST, alike: float = ALIKE) -> DataFrame:
    """(l, r, jaccard, letters): pairs of distinct plain titles (column plain of each) that match. No pair is left out."""
    left, right = (settle(t.select("plain").filter(F.coalesce("plain", F.lit("")) != "").distinct().withColumn("id", F.monotonically_increasing_id())) for t in (left, right))
    # A word of a title in both tables counts twice, as the order of words may be any.
    rarity = settle(_words(left).unionByName(_words(right)).groupBy("word").agg(F.count("*").alias("df")).withColumn("number", F.monotonically_increasing_id()))
    ranked = [settle(_ranked(t, rarity)) for t in (left, right)]
    pairs = _candidates(*ranked, least, alike)
    # The texts are met by the pairs that are left.
    texts = [t.select(F.col("id").alias(c), F.col("plain").alias(f"{c}_text"), F.col("words").alias(f"{c}w")) for t, c in zip(ranked, "lr", strict=True)]
    pairs = pairs.join(texts[0], "l").join(texts[1], "r").select(F.col("l_text").alias("l"), F.col("r_text").alias("r"), "lw", "rw")
    n, m = F.size("lw"), F.size("rw")
    shared = F.size(F.array_intersect("lw", "rw"))
    scored = pairs.select("l", "r", (shared / (n + m - shared)).alias("jaccard")).filter(F.col("jaccard") >= least)
    longer = F.greatest(F.length("l"), F.length("r"))
    scored = scored.withColumn("letters", F.when(longer > LONG, F.lit(1.0)).otherwise(1 - F.levenshtein("l", "r") / longer))
    return scored.filter(F.col("letters") >= alike).select("l", "r", F.round("jaccard", 6).alias("jaccard"), F.round("letters", 6).alias("letters"))


def link_by_title(papers: DataFrame, catalogue: DataFrame, title: str = "title", key: str = "doi", least: float = LEAST, alike: float = ALIKE) -> DataFrame:
    """papers with the key of the catalogue's paper of the likest title, and how alike they are; nulls where none matches.

    catalogue: (key, title). The new columns are key and similarity (renamed with leading _ if papers has them).
    """
    named = {}
    for c in (key, "similarity", "plain"):
        new = c
        while new in papers.columns:
            new = f"_{new}"
        named[c] = new
    books = settle(catalogue.select(F.col(key).alias("k"), plain(F.col(title)).alias("plain")).filter("k is not null").groupBy("plain").agg(F.min("k").alias("k")))
    mine = papers.withColumn(named["plain"], plain(F.col(title)))
    found = similar(mine.select(F.col(named["plain"]).alias("plain")), books, least, alike).join(books.withColumnRenamed("plain", "r"), "r")
    best = W.partitionBy("l").orderBy(F.col("jaccard").desc(), F.col("letters").desc(), "k")
    found = found.withColumn("at", F.row_number().over(best)).filter("at = 1").select(F.col("l").alias(named["plain"]), F.col("k").alias(named[key]), F.col("jaccard").alias(named["similarity"]))
    return mine.join(found, named["plain"], "left").drop(named["plain"]).select(*papers.columns, named[key], named["similarity"])
