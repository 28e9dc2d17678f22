"""Scores of predicted spans and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched_spans(pred: DataFrame, gold: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc, class, pred_id, gold_id, overlap): every predicted with every true span of equal document and class.

    Both have doc, class, id, words (an array of word ids). overlap is the lesser of the two shares, null without partner.
    """
    p = pred.select("doc", "class", F.col("id").alias("pred_id"), F.col("words").alias("_p"))
    g = gold.select("doc", "class", F.col("id").alias("gold_id"), F.col("words").alias("_g"))
    n = F.size(F.array_intersect("_p", "_g"))
    both = F.col("pred_id").isNotNull() & F.col("gold_id").isNotNull()
    share = F.when(both, F.least(n / F.size("_p"), n / F.size("_g")))
    return p.join(g, ["doc", "class"], "full_outer").select("doc", "class", "pred_id", "gold_id", share.alias("overlap")).withColumn("hit", F.coalesce(F.col("overlap") >= least, F.lit(False)))


def span_scores(matches: DataFrame) -> DataFrame:
    """(class, tp, fp, fn, f1): each true span takes its best partner; other predicted spans are false."""
    best = matches.filter("hit").groupBy("doc", "class", "gold_id").agg(F.max_by("pred_id", F.struct("overlap", (-F.col("pred_id")).alias("m"))).alias("pred_id"))
    hits = best.groupBy("class").agg(F.count("*").alias("tp"), F.count_distinct("doc", "pred_id").alias("used"))
    all_ = matches.groupBy("class").agg(F.count_distinct("doc", "pred_id").alias("n_pred"), F.count_distinct("doc", "gold_id").alias("n_gold"))
    out = all_.join(hits, "class", "left").na.fill(0, ["tp", "used"])
    fp, fn = F.col("n_pred") - F.col("used"), F.col("n_gold") - F.col("tp")
    return out.select("class", "tp", fp.alias("fp"), fn.alias("fn"), F.round(F.col("tp") / (F.col("tp") + (fp + fn) / 2), 6).alias("f1"))


def mean_f1(scores: DataFrame) -> DataFrame:
    return scores.agg(F.round(F.avg("f1"), 6).alias("f1"), F.count("*").alias("classes"))


def token_accuracy(tokens: DataFrame, pred: str = "pred", gold: str = "gold", ignored: int | str = -100) -> DataFrame:
    """Share of tokens predicted right, those with the ignored label left out."""
    kept = tokens.filter(F.col(gold) != F.lit(ignored))
    return kept.agg(F.count("*").alias("n"), F.round(F.avg((F.col(pred) == F.col(gold)).cast("double")), 6).alias("accuracy"))


def classification_report(tokens: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """(label, precision, recall, f1, support)."""
    g = tokens.groupBy(F.col(gold).alias("label")).agg(F.count("*").alias("support"), F.sum((F.col(pred) == F.col(gold)).cast("long")).alias("tp"))
    p = tokens.groupBy(F.col(pred).alias("label")).agg(F.count("*").alias("predicted"))
    out = g.join(p, "label", "full_outer").na.fill(0, ["support", "tp", "predicted"])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.select("label", F.round(share(F.col("tp"), F.col("predicted")), 6).alias("precision"), F.round(share(F.col("tp"), F.col("support")), 6).alias("recall"), F.round(share(2 * F.col("tp"), F.col("predicted") + F.col("support")), 6).alias("f1"), "support")
