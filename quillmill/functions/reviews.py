"""Which papers are reviews, and the wording of older reviews of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .authors import year_in
from .text import _col

#: Headers of structured abstracts, and words of a review's objective.
SECTION_HEADERS = "(?i)objectives?:|results?:|questions?:|purposes?:|findings:|methods:|conclusion:|report:|discussions?:"
REVIEW_WORDS = "(?i)review|summarizes?|document"


def paper_text(title: Column | str, abstract: Column | str) -> Column:
    return F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "), F.coalesce(_col(abstract), F.lit("")))


def has_section_headers(text: Column | str) -> Column:
    return F.coalesce(_col(text), F.lit("")).rlike(SECTION_HEADERS)


def is_review_objective(text: Column | str) -> Column:
    return F.coalesce(_col(text), F.lit("")).rlike(REVIEW_WORDS)


def objectives_found(sentences: Column | str, judged: Column | None = None) -> Column:
    """Sentences that read like an objective, by cue or by a model (judged: an array of sentences), each once, in order."""
    s = _col(sentences)
    by_cue = F.filter(s, R.is_objective)
    by_model = F.filter(judged if judged is not None else by_cue, lambda x: ~x.rlike(f"(?i){R.BOILERPLATE}"))
    return F.array_union(by_cue, by_model)


def is_review(text: Column | str, sentences: Column | str, judged: Column | None = None) -> Column:
    """No section headers, and an objective that speaks of a review."""
    return ~has_section_headers(text) & is_review_objective(F.array_join(objectives_found(sentences, judged), " "))


def formulation(objective: Column | str, url: Column | str | None = None) -> Column:
    """An objective whose authors, up to the year's bracket, are a link; null without a year."""
    o = _col(objective)
    year = F.regexp_extract(o, "(19[0-9]{2}|20[01][0-9]|202[0-2])", 1)
    cut = F.instr(o, year) + 4
    who, rest = F.substring(o, F.lit(1), cut), F.substring(o, cut + 1, F.length(o))
    linked = who if url is None else F.concat(F.lit("<b><a href="), _col(url), F.lit(">"), who, F.lit("</a></b>"))
    return F.when(year != "", F.concat(linked, rest))


def written(found: DataFrame, group: str, order: Column, objective: str = "objective", url: str | None = None) -> DataFrame:
    """(group, text): the formulations of each group's bounded result, each once, by order."""
    made = found.withColumn("_f", formulation(objective, url)).filter("_f is not null")
    lines = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("_f").alias("f"))))
    return made.groupBy(group).agg(lines.alias("x")).select(group, F.array_join(F.array_distinct(F.transform("x", lambda v: v["f"])), " ").alias("text"))


def latest_first(objective: Column | str) -> Column:
    """An order by the year in the text, the latest first, those without a year last."""
    return -F.coalesce(year_in(objective), F.lit(0))
