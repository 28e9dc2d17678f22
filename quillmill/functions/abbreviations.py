"""Abbreviations and their definitions, by the published algorithm of Schwartz and Hearst (2003).

Matching characters from right to left inside a text isn't a composition of column functions, so this is an Arrow-batched
pandas UDF.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _col

_INSIDE = re.compile(r"(?<= )\(([^()]*)\)")


def _short_form(text: str) -> bool:
    return 2 <= len(text) <= 10 and len(text.split()) <= 2 and any(c.isalpha() for c in text) and text[0].isalnum()


def _long_form(short: str, before: str) -> str | None:
    """The shortest end of `before` that holds the short form's characters in order, the first at the start of a word."""
    s, p = len(short) - 1, len(before) - 1
    while s >= 0:
        want = short[s].lower()
        if not want.isalnum():
            s -= 1
            continue
        while p >= 0 and (before[p].lower() != want or (s == 0 and p > 0 and before[p - 1].isalnum())):
            p -= 1
        if p < 0:
            return None
        p, s = p - 1, s - 1
    out = before[before.rfind(" ", 0, p + 1) + 1 :].strip()
    n = len(out.split())
    if not out or n > min(len(short) + 5, 2 * len(short)) or len(out) <= len(short) or out.count("(") != out.count(")") or short in out.split():
        return None
    return out


def pairs(text: str | None) -> dict[str, str]:
    """Abbreviation to definition; of several the last counts. Lines with unbalanced brackets are left out."""
    out: dict[str, str] = {}
    for line in (text or "").split("\n"):
        line = line.strip()
        if line.count("(") != line.count(")"):
            continue
        for m in _INSIDE.finditer(line):
            short = re.split(r"[;:]", m[1])[0].strip()
            if _short_form(short) and (found := _long_form(short, line[: m.start()].rstrip())):
                out[short] = found
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def abbreviation_map(text: pd.Series) -> pd.Series:
    return text.map(pairs)


def full_text_map(*sections: Column | str) -> Column:
    """The abbreviations of all sections of a paper; of several definitions the last counts."""
    return abbreviation_map(F.concat_ws("\n", *sections))


def most_frequent(pairs_: DataFrame, short: str = "short", long: str = "long") -> DataFrame:
    """(short, long, n): each abbreviation's most frequent definition, the first by text of equals."""
    n = pairs_.groupBy(short, long).agg(F.count("*").alias("n"))
    return n.groupBy(short).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(long).alias("l"))).alias("x")).select(short, F.col("x.l").alias(long), (-F.col("x.m")).alias("n"))


def expand(text: Column | str, found: Column | str) -> Column:
    """Each ' ABBR' as ' definition (ABBR)', one pass, longer ones first, without a look at word ends."""
    return _expand(_col(text), _col(found))


@F.pandas_udf(T.StringType())
def _expand(text: pd.Series, found: pd.Series) -> pd.Series:
    def one(t, m):
        m = dict(m) if m is not None else {}
        if not t or not m:
            return t
        return re.sub(" (" + "|".join(map(re.escape, m)) + ")", lambda x: f" {m[x[1]]} ({x[1]})", t)

    return pd.Series([one(t, m) for t, m in zip(text, found, strict=True)], dtype=object)
