"""Searches over sections, and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import authors as A
from ..functions import rules as R
from ..operators import ranking, search
from ..shared import settle

RELEVANT = 0.05


def matching(sections: DataFrame, query: str, top_n: int | None = 200, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """Candidate sections of a query: all words in order (AND), quoted phrases, or words of its lemmas."""
    text = F.when(F.col("section") == "objectives", F.concat_ws(" ", F.array_join("messages", ". "), "title")).otherwise(F.array_join("messages", ". "))
    kind = R.query_kind(query)
    if kind == "and":
        hit = search.ordered(search.split_and(query), text)
    elif kind == "match":
        hit = search.any_phrase(search.phrases_of(query), text)
    else:
        words = R.lemmas_of(query)
        hit = search.all_substrings(words, F.col("title"), text)
        if len(words) == 1:
            hit = hit & search.word_start(words[0], text)
    return search.candidates(sections, hit & search.years("year", year_from, year_to), top_n)


def find_papers(sections: DataFrame, query: str, top_n: int = 10, year_from: int | None = None, year_to: int | None = None, sort_by: str = "relevance", most: int | None = 200, min_df: float = 0.05) -> DataFrame:
    """One section a paper with score and rank, by relevance (tf-idf over the candidates), citations or date."""
    # Looked up once, as scores need the rows several times.
    found = settle(matching(sections, query, most, year_from, year_to))
    text = F.array_join("messages", " ")
    scores = ranking.tfidf_scores(found, query.replace('"', " "), "fname", text, min_df=min_df)
    df = found.join(scores, "fname", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6))
    order = {"relevance": [F.col("score").desc()], "citations": [F.coalesce("numCitedBy", F.lit(0.5)).desc()], "date": [F.col("year").desc_nulls_last()]}[sort_by]
    first = W.partitionBy("paper_name").orderBy(*order, "fname")
    df = df.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r").orderBy(*order, "fname").limit(top_n)
    return df.withColumn("relevant", F.col("score") >= RELEVANT)


def semantic(vectors: DataFrame, query: DataFrame, sections: DataFrame, key: str = "vec_id", k: int = 60, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """The k sections nearest to a query vector, within years, with messages, one a paper."""
    near = ranking.nearest(vectors, query, k, key)
    df = near.join(sections, key).filter(search.years("year", year_from, year_to) & (F.size("messages") > 0))
    first = W.partitionBy("paper_name").orderBy(F.col("score").desc(), key)
    return df.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def review(found: DataFrame, order: list) -> DataFrame:
    """One row: the reported sentences as lines, and their references. found: the rows of a ranked, bounded result."""
    rows = found.filter(F.coalesce("reported", F.lit("")) != "")
    line = F.struct(F.row_number().over(W.orderBy(*order)).alias("r"), F.concat(F.lit("- "), "reported").alias("line"), F.concat(F.lit("- "), A.reference("allauthors", "year", "title", "journal")).alias("ref"))
    all_ = rows.select(line.alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return all_.select(F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("review"), F.array_join(F.transform("x", lambda v: v["ref"]), "\n").alias("references"))
