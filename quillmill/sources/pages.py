"""Parsing of landed web pages. Fetching happens outside the engine; parsing is in parallel here, by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tag_text(html: Column | str, tag: str) -> Column:
    """The first text right inside a tag."""
    return F.trim(F.regexp_extract(_c(html), f"<{tag}(?:\\s[^>]*)?>([^<]*)", 1))


def tag_count(html: Column | str, tag: str) -> Column:
    return F.regexp_count(_c(html), F.lit(f"<{tag}[\\s>]"))


def attribute(html: Column | str, tag: str, name: str) -> Column:
    return F.regexp_extract(_c(html), f'<{tag}[^>]*\\s{name}="([^"]*)"', 1)


def links(html: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_c(html), F.lit('href="([^"]*)"'), F.lit(1)), lambda x: x)


def plain_text(html: Column | str) -> Column:
    c = F.regexp_replace(_c(html), r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))


def host(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), "^https?://([^/]+)", 1)


def page_fields(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", host("url").alias("host"), tag_text("html", "title").alias("title"), attribute("html", "html", "lang").alias("lang"), tag_text("html", "h1").alias("heading"), tag_count("html", "p").cast("long").alias("paragraphs"), F.size(links("html")).cast("long").alias("links"))
