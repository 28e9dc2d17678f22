"""Papers from pages and records that crawlers landed: a parser for each source, made of column expressions.

Fetching, with its delays and retries, happens outside the engine. A parser takes a table with a column `html` (page, XML or
JSON text, one paper or entry a row) and adds the source's columns; its other columns stay. Pages' elements are found by
selectors over their tree, records' and links by pattern. Nothing is shuffled.

Defined results: a null or empty page gives empty strings, null years and empty arrays; parsers that leave out papers
without an abstract leave it out. Where something occurs more than once, the first counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.authors import year_in
from ..functions.text import _col
from .pages import plain_text
from .selectors import selected

RECORD = "doi string, title string, authors array<struct<name:string>>, year int, abstract string, numCitedBy double, numCiting double"


def first(pattern: str, html: Column | str = "html") -> Column:
    """The first match of a pattern's group, across lines, as plain text; empty without one."""
    return plain_text(F.coalesce(F.regexp_extract(_col(html), f"(?is){pattern}", 1), F.lit("")))


def every(pattern: str, html: Column | str = "html") -> Column:
    """All matches of a pattern's group as plain texts that aren't empty."""
    found = F.coalesce(F.regexp_extract_all(_col(html), F.lit(f"(?is){pattern}"), F.lit(1)), F.array().cast("array<string>"))
    return F.filter(F.transform(found, plain_text), lambda x: x != "")


def within(tag: str, name: str, kind: str = "class") -> str:
    """A pattern for what stands in the first element of a tag whose class (or other attribute) has a word."""
    return rf"""<{tag}\b[^>]*\b{kind}\s*=\s*["'](?:[^"']*\s)?{name}(?:\s[^"']*)?["'][^>]*>(.*?)</{tag}>"""


def _doi(pattern: str) -> Column:
    """A DOI in a link, without its resolver."""
    return F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), rf"(?is){pattern}", 1)


def people(surname: str = "surname", given: str = "given-names", person: str = r"<name\b[^>]*>(.*?)</name>") -> Column:
    """'Given Surname' of each person who has one, joined by commas."""
    found = F.coalesce(F.regexp_extract_all("html", F.lit(f"(?is){person}"), F.lit(1)), F.array().cast("array<string>"))
    part = lambda x, tag: plain_text(F.regexp_extract(x, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))
    names = F.transform(found, lambda x: F.trim(F.concat_ws(" ", part(x, given), part(x, surname))))
    return F.array_join(F.filter(names, lambda x: x != ""), ", ")


def hal(df: DataFrame) -> DataFrame:
    """An archive's result pages; papers in press count as of 2022."""
    at = selected("html", every={"authors": "span.author", "keywords": "div.keywords span"}, first={"title": "h3.title", "abstract": "div.abstract-content", "cited": "div.citation-ref", "journal": "div.citation-ref i"})
    cited = F.col("_at.cited")
    return df.withColumn("_at", at).withColumns({
        "doi": _doi(r"""href=["']https?://(?:dx\.)?doi\.org/([^"']+)["']"""), "title": F.col("_at.title"), "authors": F.array_join("_at.authors", ", "), "abstract": F.col("_at.abstract"),
        "year": F.when(F.lower(cited).contains("in press"), F.lit(2022)).otherwise(year_in(cited)), "keywords": F.array_join("_at.keywords", ", "), "journal": F.col("_at.journal"),
    }).drop("_at")


def biorxiv(df: DataFrame) -> DataFrame:
    """Article XML of a preprint server; records without an abstract are left out."""
    out = df.withColumns({
        "doi": first(within("article-id", "doi", "pub-id-type")), "title": first(r"<article-title\b[^>]*>(.*?)</article-title>"), "authors": people(), "year": year_in(first(r"<pub-date\b[^>]*>(.*?)</pub-date>")),
        "field_paper": first(r"<subject\b[^>]*>(.*?)</subject>"), "abstract": first(r"<abstract\b[^>]*>(.*?)</abstract>"),
    })
    return out.filter(F.col("abstract") != "")


def pubmed(df: DataFrame) -> DataFrame:
    """Article XML of a full-text archive. abstract: array<struct<title, paragraphs>>, title 'text' if it has no parts; body: paragraphs."""
    whole = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<abstract\b[^>]*>(.*?)</abstract>", 1)
    paragraphs = lambda x: every(r"<p\b[^>]*>(.*?)</p>", x)
    parts = F.regexp_extract_all(whole, F.lit(r"(?is)<sec\b[^>]*>(.*?)</sec>"), F.lit(1))
    title = lambda x: plain_text(F.regexp_extract(x, r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    told = F.transform(parts, lambda x: F.struct(title(x).alias("title"), paragraphs(x).alias("paragraphs")))
    plain = F.array(F.struct(F.lit("text").alias("title"), paragraphs(whole).alias("paragraphs")))
    return df.withColumns({
        "doi": first(within("article-id", "doi", "pub-id-type")), "title": first(r"<article-title\b[^>]*>(.*?)</article-title>"), "authors": people(), "year": year_in(first(r"<pub-date\b[^>]*>(.*?)</pub-date>")),
        "journal": first(r"<journal-title\b[^>]*>(.*?)</journal-title>"), "abstract": F.when(F.size(parts) > 0, told).otherwise(plain), "body": every(r"<p\b[^>]*>(.*?)</p>", F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<body\b[^>]*>(.*)</body>", 1)),
    })


def without_last(paragraphs: Column | str, last: int = 5) -> Column:
    """A body's paragraphs without the last ones, which are acknowledgements and the like."""
    p = _col(paragraphs)
    return F.slice(p, 1, F.greatest(F.size(p) - last, F.lit(0)))


def ssrn(df: DataFrame) -> DataFrame:
    """Pages of a working-paper network. The abstract's own heading isn't part of it."""
    at = selected("html", every={"authors": "h2 > a"}, first={"title": "h1", "field": "div.group-field", "heading": "div.abstract-text > h3", "text": "div.abstract-text"})
    text, heading = F.col("_at.text"), F.col("_at.heading")
    return df.withColumn("_at", at).withColumns({
        "abstract_id": _doi(r"""name=["']abstract_id["']\s+value=["'](\d+)"""), "title": F.col("_at.title"), "authors": F.array_join("_at.authors", ", "), "year": year_in(first(r"Posted:(.*?)</span>")), "field": F.col("_at.field"),
        "pages": F.regexp_extract(F.coalesce("html", F.lit("")), r"(\d+) Pages", 1).try_cast("long"), "abstract_text": F.when(F.startswith(text, heading), F.trim(F.substring(text, F.length(heading) + 1, F.length(text)))).otherwise(text), "keywords": first(r"Keywords:\s*</strong>(.*?)</p>"),
    }).drop("_at")


def distinct_entries(df: DataFrame, order: Column) -> DataFrame:
    """Listed papers, the first of each id and of each title."""
    from ..operators.tables import first_wins

    return first_wins(first_wins(df, "abstract_id", order), "title", order)


def egu(df: DataFrame) -> DataFrame:
    """Entries of a publisher's lists; the abstract is empty if the list has none."""
    at = selected("html", every={"links": "div.citation a@href"}, first={"title": "a.article-title", "authors": "div.authors", "cited": "div.citation", "abstract": "div.short_summary"})
    link = F.get(F.filter("_at.links", lambda x: x.startswith("https://doi.org/")), F.lit(0))
    return df.withColumn("_at", at).withColumns({
        "doi": F.coalesce(link, F.lit("")), "title": F.col("_at.title"), "authors": F.col("_at.authors"), "year": F.regexp_extract("_at.cited", r"((?:19|20)\d\d)\W*$", 1).try_cast("int"), "abstract": F.col("_at.abstract"),
    }).drop("_at")


def with_page_abstracts(entries: DataFrame, pages: DataFrame, key: str = "doi") -> DataFrame:
    """Entries without an abstract get that of their article's page; pages: (key, html)."""
    found = pages.select(F.col(key).alias("_key"), selected("html", first={"abstract": "div.abstract"})["abstract"].alias("_abstract"))
    return entries.join(found, F.col(key) == F.col("_key"), "left").withColumn("abstract", F.when(F.col("abstract") == "", F.coalesce("_abstract", F.lit(""))).otherwise(F.col("abstract"))).drop("_key", "_abstract")


def iahr(df: DataFrame) -> DataFrame:
    """Library pages whose paragraphs stand in a fixed order: authors, others, keywords, abstract, DOI, year."""
    p = F.transform(F.coalesce(F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), F.array().cast("array<string>")), plain_text)
    at = lambda k: F.trim(F.regexp_replace(F.coalesce(F.get(p, F.lit(k)), F.lit("")), r"^[\w() ]*:\s*", ""))
    return df.withColumns({"title": first(r"<h1\b[^>]*>(.*?)</h1>"), "authors": at(0), "keywords": at(2), "abstract": at(3), "year": year_in(at(5))})


def iwa(df: DataFrame) -> DataFrame:
    """Article pages of a publisher; unknown citation counts are a half."""
    at = selected("html", every={"authors": "a.linked-name"}, first={"title": "h1.wi-article-title", "date": "span.article-date", "abstract": "section.abstract", "cited": "div.article-cited-by"})
    return df.withColumn("_at", at).withColumns({
        "doi": _doi(r"""href=["']https?://doi\.org/([^"']+)["']"""), "title": F.col("_at.title"), "authors": F.array_join("_at.authors", ", "), "year": year_in(F.col("_at.date")), "abstract": F.col("_at.abstract"),
        "cited": F.coalesce(F.regexp_extract("_at.cited", r"(\d+)", 1).try_cast("double"), F.lit(0.5)),
    }).drop("_at")


def scholar(df: DataFrame) -> DataFrame:
    """A profile's rows: the first grey line has the authors, the next the journal."""
    at = selected("html", every={"grey": "div.gs_gray"}, first={"title": "a.gsc_a_at", "year": "td.gsc_a_y"})
    grey = lambda k: F.coalesce(F.get("_at.grey", F.lit(k)), F.lit(""))
    return df.withColumn("_at", at).withColumns({"title": F.col("_at.title"), "authors": grey(0), "journal": grey(1), "year": year_in(F.col("_at.year"))}).drop("_at")


def issn(df: DataFrame) -> DataFrame:
    """JSON answers of citation services for the DOIs of a journal; those without an abstract are left out."""
    r = df.withColumn("_r", F.from_json("html", RECORD))
    names = F.array_join(F.transform("_r.authors", lambda a: a["name"]), ", ")
    out = r.withColumns({"doi": F.col("_r.doi"), "title": F.col("_r.title"), "authors": F.coalesce(names, F.lit("")), "year": F.col("_r.year"), "abstract": F.col("_r.abstract"), "cited": F.coalesce("_r.numCitedBy", F.lit(0.5)), "citing": F.coalesce("_r.numCiting", F.lit(0.0))})
    return out.filter(F.coalesce("abstract", F.lit("")) != "").drop("_r")


def doaj(df: DataFrame) -> DataFrame:
    """Journal cards of a directory: name, ISSN and subjects."""
    at = selected("html", every={"fields": "ul.inlined-list > li > a"}, first={"journal": "h3.search-results__heading"})
    return df.withColumn("_at", at).withColumns({"journal": F.col("_at.journal"), "issn": F.regexp_extract(F.coalesce("html", F.lit("")), r"(\d{4}-\d{3}[\dXx])", 1), "fields": F.col("_at.fields")}).drop("_at")


def articles_of(journals: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles of a directory's journals: journal and subjects repeated for each; articles has a column issn."""
    return articles.join(journals.select("issn", "journal", "fields"), "issn")


def title_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), r"\s+", " "))


def dois_by_title(papers: DataFrame, hits: DataFrame) -> DataFrame:
    """papers with a column doi: the first hit (title, rank, doi) of a landed title search, empty without one."""
    best = hits.groupBy(title_key("title").alias("_key")).agg(F.min_by("doi", "rank").alias("_doi"))
    return papers.withColumn("_key", title_key("title")).join(best, "_key", "left").withColumn("doi", F.coalesce("_doi", F.lit(""))).drop("_key", "_doi")


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"hal": hal, "biorxiv": biorxiv, "pubmed": pubmed, "ssrn": ssrn, "egu": egu, "iahr": iahr, "iwa": iwa, "scholar": scholar, "issn": issn, "doaj": doaj}
