"""Runs of numbers, overlaps of spans, and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.spans import overlap


def islands(df: DataFrame, group: str, number: str) -> DataFrame:
    """(group, start, end, n): runs of consecutive numbers in each group."""
    # Rows are sorted once and read in order; repeated ones go, ends of runs stay, and nothing is held in a table.
    w = W.partitionBy(group).orderBy(number)
    before, n = F.lag(number).over(w), F.col(number)
    rows = df.select(group, number, before.alias("_before"), (F.row_number().over(w) == 1).alias("_first")).filter(F.col("_first") | ~n.eqNullSafe(F.col("_before")))
    starts = F.col("_first") | F.col("_before").isNull() | (n != F.col("_before") + 1)
    rows = rows.select(group, number, starts.alias("_starts"), (F.lead(number).over(w) == n + 1).alias("_goes_on"))
    ends = rows.filter(F.col("_starts") | ~F.coalesce("_goes_on", F.lit(False)))
    end = F.when(F.coalesce("_goes_on", F.lit(False)), F.lead(number).over(w)).otherwise(n)
    out = ends.select(group, n.alias("start"), end.alias("end"), "_starts").filter("_starts")
    return out.select(group, "start", "end", F.coalesce((F.col("end") - F.col("start") + 1).cast("long"), F.lit(1).cast("long")).alias("n"))


def label_by_overlap(sentences: DataFrame, spans: DataFrame, doc: str) -> DataFrame:
    """(doc, sent, label): each sentence's label is that of the span it shares most with; of equals the span that starts first.

    sentences: doc, sent, start, end; spans: doc, label, start, end (half open).
    """
    s = spans.select(doc, "label", F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = sentences.join(s, doc, "left").withColumn("_n", overlap(F.col("start"), F.col("end"), F.col("_s"), F.col("_e")))
    best = F.max_by("label", F.when(F.col("_n") > 0, F.struct(F.col("_n"), (-F.col("_s")).alias("first"))))
    return met.groupBy(doc, "sent").agg(best.alias("label"))


def range_labels(rows: DataFrame, code: str, ranges: DataFrame, bucket: int = 100) -> DataFrame:
    """rows joined with the ranges (label, lo, hi) that hold their code.

    Ranges are cut at multiples of `bucket`, so that it is an equi-join whatever their number; each label once a row.
    """
    cut = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))))
    joined = rows.withColumn("_bucket", F.floor(F.col(code) / bucket)).join(cut, "_bucket").filter(F.col(code).between(F.col("lo"), F.col("hi")))
    return joined.drop("_bucket", "lo", "hi").distinct()


def ranges_of(fields: dict[str, list[str]]) -> list[tuple[str, int, int]]:
    """'lo-hi' and single codes, as (label, lo, hi)."""
    return [(name, int(x.split("-")[0]), int(x.split("-")[-1])) for name, codes in fields.items() for x in codes]


def first_range(rows: DataFrame, group: str, number: str, manifest: DataFrame, bucket: int = 1000) -> DataFrame:
    """rows joined with the manifest entry of their group with first <= number < last.

    Entries are cut at multiples of `bucket`, about an entry's length, so a row meets the few entries of its bucket only,
    however many its group has.
    """
    m = manifest.select(F.col(group).alias("_g"), *[c for c in manifest.columns if c != group])
    m = m.filter(F.col("last") > F.col("first")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("first") / bucket), F.floor((F.col("last") - 1) / bucket))))
    at = F.floor(F.col(number) / bucket)
    return rows.join(m, (F.col(group) == F.col("_g")) & (at == F.col("_b")) & (F.col(number) >= F.col("first")) & (F.col(number) < F.col("last"))).drop("_g", "_b")
