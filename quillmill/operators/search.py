"""Predicates of searches over (title, messages) rows. Query text is literal, never a pattern."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _col


def _text(c: Column | str) -> Column:
    return F.lower(F.coalesce(_col(c), F.lit("")))


def years(year: Column | str, low: int | None, high: int | None) -> Column:
    """Exclusive at both ends; unknown years never match once an end is given."""
    y, out = _col(year), F.lit(True)
    if low is not None:
        out = out & (y > low)
    if high is not None:
        out = out & (y < high)
    return F.coalesce(out & (y != 999) if low is not None or high is not None else out, F.lit(False))


def substring(query: str, *columns: Column | str) -> Column:
    """In any of the columns, whatever the case."""
    return reduce(lambda a, b: a | b, (F.contains(_text(c), F.lit(query.lower())) for c in columns))


def all_substrings(queries: list[str], *columns: Column | str) -> Column:
    return reduce(lambda a, b: a & b, (substring(q, *columns) for q in queries), F.lit(True))


def word_start(query: str, c: Column | str) -> Column:
    """After a character that is no letter; a hit at the very start doesn't count."""
    return F.coalesce(_col(c), F.lit("")).rlike("(?i)[^a-zA-Z]" + re.sub(r"([^\w\s])", r"\\\1", query))


def ordered(queries: list[str], c: Column | str) -> Column:
    """All in this order, one after the other, whatever the case."""
    text, at = _text(c), F.lit(1)
    out = F.lit(True)
    for q in queries:
        found = _locate(q.lower(), text, at)
        out = out & (found > 0)
        at = found + len(q)
    return out


def _locate(needle: str, text: Column, start: Column) -> Column:
    """The first place from start, 0 if there is none."""
    rest = F.substring(text, start, F.length(text))
    at = F.instr(rest, needle)
    return F.when(at > 0, at + start - 1).otherwise(0)


def any_phrase(phrases: list[str], c: Column | str) -> Column:
    """Any of the phrases as written."""
    return reduce(lambda a, b: a | b, (F.contains(F.coalesce(_col(c), F.lit("")), F.lit(p)) for p in phrases), F.lit(False))


def split_and(query: str) -> list[str]:
    return [q.strip() for q in re.split(r" AND |&|\+", query) if q.strip()]


def split_or(query: str) -> list[str]:
    return [q.strip() for q in re.split(r"\|| OR ", query) if q.strip()]


def phrases_of(query: str) -> list[str]:
    return [p for p in re.findall('"(.*?)"', query) if p]


def candidates(df: DataFrame, condition: Column, top_n: int | None = 200) -> DataFrame:
    """Matching rows, those with most citations first (then by name), at most top_n."""
    out = df.filter(condition)
    return out if top_n is None else out.orderBy(F.coalesce("numCitedBy", F.lit(0.5)).desc(), "fname").limit(top_n)


def first_then_ordered(df: DataFrame, queries: list[str], title: Column | str, text: Column | str, top_n: int | None = 200) -> DataFrame:
    """The most cited rows of the first keyword (see word_start), of which those that have the others after each other too."""
    first, rest = queries[0], queries[1:]
    found = candidates(df, substring(first, title, text) & word_start(first, text), top_n)
    return found.filter(ordered(rest, text)) if rest else found


def each_phrase(df: DataFrame, phrases: list[str], title: Column | str, text: Column | str, key: str = "fname", top_n: int | None = 200) -> DataFrame:
    """The most cited rows of each phrase, whatever its case and at the start of a word, together and each once."""
    found = [candidates(df, substring(p, title, text) & word_start(p, text), top_n) for p in phrases]
    return reduce(DataFrame.unionByName, found).dropDuplicates([key]) if found else df.limit(0)


def one_section(df: DataFrame, rank: Column) -> DataFrame:
    """The first section of each paper, by rank."""
    from .tables import first_wins

    return first_wins(df, "paper_name", rank)


def by_name(df: DataFrame, fname: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """A row by name; for objectives the years are checked, inclusive."""
    out = df.filter(F.col("fname") == fname)
    if fname.endswith("_objectives"):
        out = out.filter((F.lit(low is None) | (F.col("year") >= (low or 0))) & (F.lit(high is None) | (F.col("year") <= (high or 9999))))
    return out


def by_ids(df: DataFrame, ids: DataFrame, key: str, low: int | None = None, high: int | None = None) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi").filter(years("year", low, high))


def siblings(df: DataFrame, names: DataFrame) -> DataFrame:
    """All sections of the papers whose names are given."""
    return df.join(names.select("paper_name").distinct(), "paper_name", "left_semi")
