"""Parts of a paper from the raw text of its PDF, by pattern.

Defined results: what isn't found is empty (or an empty array, or null for the year); a null text has nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, doi_in, starts_capital

#: Terms that open parts, and the pattern of an address.
INTRODUCTION, CONCLUSION, THANKS = "introduction", "conclusions?", "acknow?ledge?ments?"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]*\w"
LAST_YEAR = 2021


def _text(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def _bare(c: Column) -> Column:
    """Without white space at both ends, line breaks too."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def abstract(c: Column | str) -> Column:
    """The longest paragraph between 'abstract' (spaced out or not) and the introduction."""
    between = F.regexp_extract(_text(c), rf"(?is)a\s?b\s?s\s?t\s?r\s?a\s?c\s?t(.*?){INTRODUCTION}", 1)
    parts = F.transform(F.split(between, "\n\n"), lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), _bare(p).alias("p")))
    return F.coalesce(F.get(F.array_sort(parts), F.lit(0))["p"], F.lit(""))


def after_introduction(c: Column | str) -> Column:
    """What follows the introduction's line; the whole text without one."""
    c = _text(c)
    rest = F.regexp_extract(c, rf"(?is){INTRODUCTION}[^\n]*\n(.*)", 1)
    return F.when(rest == "", c).otherwise(rest)


def introduction(c: Column | str, parts: int = 6) -> Column:
    """The first sixth of the words after the introduction's line."""
    w = F.split(after_introduction(c), " ")
    return F.array_join(F.slice(w, 1, F.floor(F.size(w) / parts).cast("int")), " ")


def conclusion(c: Column | str) -> Column:
    """From the last 'conclusion' to the acknowledgements or references, or to the end."""
    return _bare(F.regexp_extract(_text(c), rf"(?is).*{CONCLUSION}(.*?)(?:{THANKS}|references|$)", 1))


def references(c: Column | str) -> Column:
    """The lines after 'references', without numbers; lines that start in small letters continue the one before."""
    lines = F.filter(F.split(F.regexp_extract(_text(c), r"(?is).*references\s*\n(.*)", 1), "\n"), lambda x: F.trim(x) != "")
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*\[?\(?\d+\)?\]?\.?", "")))

    def step(acc: Column, x: Column) -> Column:
        last = F.concat_ws(" ", F.element_at(acc, -1), x)
        return F.when(starts_capital(x) | (F.size(acc) == 0), F.concat(acc, F.array(x))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(last)))

    return F.aggregate(bare, F.array().cast("array<string>"), step)


def emails(c: Column | str) -> Column:
    """Addresses before the introduction, or if there are none all addresses."""
    c = _text(c)
    head = F.regexp_extract(c, rf"(?is)^(.*?){INTRODUCTION}", 1)
    found = F.regexp_extract_all(head, F.lit(EMAIL), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0)))


def keywords(c: Column | str) -> Column:
    """The paragraph after 'key words', lower-cased and on one line."""
    rest = F.regexp_extract(_text(c), r"(?is)key\s?words(.*?)(?:\n\n|$)", 1)
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(rest, "\n", " "), r"^\s*:", "")))


def year(c: Column | str, last: int = LAST_YEAR) -> Column:
    """The greatest publication year up to a pivot year."""
    found = F.transform(F.regexp_extract_all(_text(c), F.lit("19[0-9]{2}|20[0-9]{2}"), F.lit(0)), lambda y: y.cast("int"))
    return F.array_max(F.filter(found, lambda y: y <= last))


def parts(c: Column | str) -> Column:
    """struct of all parts."""
    return F.struct(abstract(c).alias("abstract"), introduction(c).alias("introduction"), conclusion(c).alias("conclusion"), references(c).alias("references"), emails(c).alias("emails"), keywords(c).alias("keywords"), year(c).alias("year"), doi_in(_text(c)).alias("doi"))
