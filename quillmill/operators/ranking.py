"""Orders of results, TF-IDF, and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rules import terms
from ..shared import settle
from .phrases import candidates

#: At most so many field vectors are sent to all tasks; a larger table is refused, as fields are few by their nature.
MOST_FIELDS = 4096
#: Terms of more than a FREQUENT-th of all documents are frequent.
FREQUENT = 1000


def by_citations(df: DataFrame, top_n: int, tie: str = "fname") -> DataFrame:
    return df.orderBy(F.coalesce("numCitedBy", F.lit(0.5)).desc(), tie).limit(top_n)


def by_date(df: DataFrame, top_n: int, tie: str = "fname") -> DataFrame:
    return df.orderBy(F.col("year").cast("double").desc_nulls_last(), tie).limit(top_n)


def tfidf_scores(docs: DataFrame, query: str, key: str, text: str | Column, stop: list[str] | None = None, min_df: float = 0.0) -> DataFrame:
    """(key, score): cosine of the query and each document that has one of its terms.

    The query counts as one more document. Weights are tf * (ln((1 + n) / (1 + df)) + 1); terms of less than min_df of all
    documents are left out. Only documents that have a term of the query are weighed. Terms that stand in more than
    1 / FREQUENT of all documents are sent to all tasks (there are at most FREQUENT times a document's mean number of terms
    of them), so that no frequent term is a hot key; the others are shuffled by term.
    """
    spark = docs.sparkSession
    text = F.col(text) if isinstance(text, str) else text
    # Written once: documents are cut into terms once, not for each of the joins below.
    tf = settle(docs.select(key, F.explode(terms(text, stop)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")))
    asked = spark.range(1).select(F.explode(terms(F.lit(query), stop)).alias("term")).groupBy("term").agg(F.count("*").alias("qtf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).join(asked, "term", "full_outer").select("term", (F.coalesce("df", F.lit(0)) + F.when(F.col("qtf").isNotNull(), 1).otherwise(0)).alias("df"), "qtf")
    n = docs.agg((F.count("*") + 1).alias("n"))
    df = df.withColumn("one", F.lit(1)).join(F.broadcast(n.withColumn("one", F.lit(1))), "one").filter(F.col("df") >= F.col("n") * min_df)
    weights = df.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), "qtf", "df", "n")
    norm = weights.filter("qtf is not null").agg(F.sqrt(F.sum(F.pow(F.col("qtf") * F.col("idf"), 2))).alias("qnorm"))
    own = F.col("tf") * F.col("idf")
    hits = tf.join(F.broadcast(asked.select("term")), "term", "left_semi").select(key).distinct()
    own_terms = tf.join(hits, key, "left_semi")
    frequent = weights.filter(F.col("df") * FREQUENT > F.col("n"))
    rest = own_terms.join(F.broadcast(frequent.select("term")), "term", "left_anti").join(weights.filter(F.col("df") * FREQUENT <= F.col("n")), "term")
    weighed = own_terms.join(F.broadcast(frequent), "term").unionByName(rest)
    sums = weighed.groupBy(key).agg(F.sqrt(F.sum(own * own)).alias("norm"), F.sum(own * F.col("qtf") * F.col("idf")).alias("dot"))
    out = sums.filter("dot is not null").withColumn("one", F.lit(1)).join(F.broadcast(norm.withColumn("one", F.lit(1))), "one")
    return out.select(key, (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))


def top_tfidf(docs: DataFrame, query: str, key: str, text: str | Column, top_n: int, stop: list[str] | None = None, min_df: float = 0.0) -> DataFrame:
    """The best by score (six digits), then by key."""
    scores = tfidf_scores(docs, query, key, text, stop, min_df).select(key, F.round("score", 6).alias("score"))
    return scores.orderBy(F.col("score").desc(), key).limit(top_n)


def document_frequencies(docs: DataFrame, text: str | Column, stop: list[str] | None = None) -> DataFrame:
    text = F.col(text) if isinstance(text, str) else text
    return docs.select(F.explode(F.array_distinct(terms(text, stop))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score): the k rows with the greatest inner product with a query of one row (column `vector`)."""
    one = F.broadcast(query.select(F.lit(1).alias("one"), F.col(vector).alias("asked")).limit(1))
    scored = vectors.withColumn("one", F.lit(1)).join(one, "one").select(key, F.round(dot(F.col(vector), F.col("asked")), 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), key).limit(k)


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, vector): the mean of each label's vectors, six digits."""
    parts = vectors.select(label, F.posexplode(vector).alias("at", "x")).groupBy(label, "at").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias(vector))


def dispatch(vectors: DataFrame, fields: DataFrame, top: int = 3, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, label, score, rank): the fields of greatest inner product for each row. fields: a bounded table."""
    if (n := fields.count()) > MOST_FIELDS:
        raise ValueError(f"{n} fields; at most {MOST_FIELDS} are sent to all tasks")
    all_ = fields.agg(F.collect_list(F.struct(F.col(label).alias("label"), F.col(vector).alias("v"))).alias("fields")).withColumn("one", F.lit(1))
    joined = vectors.select(key, vector).withColumn("one", F.lit(1)).join(F.broadcast(all_), "one")
    scored = F.transform("fields", lambda f: F.struct((-F.round(dot(F.col(vector), f["v"]), 6)).alias("minus"), f["label"].alias("label")))
    best = F.slice(F.array_sort(scored), 1, top)
    return joined.select(key, F.posexplode(best).alias("rank", "x")).select(key, F.col("x.label").alias("label"), (-F.col("x.minus")).alias("score"), (F.col("rank") + 1).alias("rank"))


def best_terms(docs: DataFrame, key: str, text: str | Column, n: int = 2, width: tuple[int, int] = (2, 3)) -> DataFrame:
    """(key, phrase, score, rank): the n phrases of each document with the greatest tf-idf, as made queries."""
    found, total = candidates(docs, key, F.col(text) if isinstance(text, str) else text, n, width)
    scored = found.select(F.col("key").alias(key), "phrase", F.round(F.col("tf") * (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col("score").desc(), "phrase"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n).select(key, "phrase", "score", "rank")
