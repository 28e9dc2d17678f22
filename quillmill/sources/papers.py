"""One formatter for all tabular sources; each source is a row of settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.abbreviations import abbreviation_map, expand
from ..functions.rules import is_english
from ..operators.tables import first_wins, unseen
from ..schema import PAPERS
from ..shared import small_batches


@dataclass(frozen=True)
class Source:
    """Where a source's papers have what, and which checks they pass.

    checks: of 'doi' (not empty), 'seen', 'english', 'length'. registers_early: a DOI counts as seen although the paper
    fails a later check.
    """

    name: str
    database: str
    checks: tuple[str, ...]
    doi: Callable[[], Column] = lambda: F.col("doi")
    title: Callable[[], Column] = lambda: F.col("title")
    authors: Callable[[], Column] = lambda: F.col("authors")
    date: Callable[[], Column] = lambda: F.col("date")
    abstract: Callable[[], Column] = lambda: F.col("abstract")
    fields: Callable[[], Column] = lambda: X.literal_list("fields")
    journal: Callable[[], Column] = lambda: F.col("journals")
    keywords: Callable[[], Column] = lambda: F.lit(None).cast("string")
    citations: Callable[[DataFrame], Column] = lambda df: X.citations("numCitedBy") if "numCitedBy" in df.columns else F.lit(0.5)
    abbreviations: bool = True
    registers_early: bool = False
    extra: dict = field(default_factory=dict)


def _bare_doi() -> Column:
    return F.regexp_replace(F.when(F.coalesce(F.col("doi"), F.lit("nan")) == "nan", F.lit("")).otherwise(F.col("doi")), "^https://doi.org/", "")


def _list_authors() -> Column:
    return F.array_join(X.literal_list("authors"), ", ")


#: The journals of sources that name none.
SOURCES = {
    s.name: s
    for s in (
        Source("generic", "", ("seen", "english", "length")),
        Source("biorxiv", "biorxiv", ("english", "seen"), fields=lambda: F.array("field_paper"), journal=lambda: F.lit("BioRxiv")),
        Source("hal", "hal", ("seen", "english", "length"), fields=lambda: F.when(F.col("fields").isNull(), F.array().cast("array<string>")).otherwise(F.split("fields", ","))),
        Source("issn", "issn", ("seen",), fields=lambda: F.array("field_paper", "field_issn"), journal=lambda: F.col("field_issn")),
        Source("egu", "egu", ("doi", "seen", "length"), doi=_bare_doi, fields=lambda: F.array("field"), journal=lambda: F.lit("European Geosciences Union")),
        Source("iahr", "iahr", ("doi", "seen", "length"), doi=lambda: F.col("webpage"), fields=lambda: F.array("field"), journal=lambda: F.lit("IAHR"), citations=lambda _: F.lit(0.5)),
        Source("pmc", "pmc", ("english", "seen"), authors=_list_authors, date=lambda: F.col("year"), fields=lambda: F.array("title", F.trim(F.regexp_replace("journal", "(?i)journal", ""))), journal=lambda: F.col("journal"), abstract=lambda: X.without_keywords(X.despaced(structured_text("abstract"))), keywords=lambda: X.keywords(structured_text("abstract"))),
        Source("pmc_full", "pmc", ("seen", "english"), authors=_list_authors, date=lambda: F.col("year"), fields=lambda: F.array().cast("array<string>"), journal=lambda: F.col("journal"), abstract=lambda: structured_text("abstract"), registers_early=True),
        Source("ssrn", "ssrn", ("seen",), doi=lambda: F.coalesce("doi", F.concat(F.lit("https://papers.ssrn.com/sol3/papers.cfm?abstract_id="), "abstract_id")), fields=lambda: F.array(ssrn_field("field"), F.col("papers_field")), journal=lambda: ssrn_field("field"), abstract=lambda: F.col("abstract_text"), keywords=lambda: F.col("keywords")),
        Source("covid", "covid", (), doi=lambda: F.col("DOI"), title=lambda: F.col("Title of preprint"), authors=lambda: F.array_join(X.literal_list("Authors"), ", "), date=lambda: F.regexp_extract("Date of Upload", "([0-9]{4})", 1), abstract=lambda: F.col("Abstract"), fields=lambda: F.array().cast("array<string>"), journal=lambda: F.col("Uploaded Site")),
    )
}


def structured_text(c: str) -> Column:
    """The text of a literal {header: text} or {header: [paragraphs]}: 'header: text' joined; the header 'text' isn't named."""
    found = F.regexp_extract_all(F.col(c), F.lit(r"""['"]([^'"]*)['"]:\s*(\[[^\]]*\]|"[^"]*"|'[^']*')"""), F.lit(0))
    name = lambda p: F.regexp_extract(p, r"""^['"]([^'"]*)['"]""", 1)
    body = lambda p: F.array_join(X.literal_list(F.regexp_replace(p, r"""^['"][^'"]*['"]:\s*""", "")), " ")
    joined = F.array_join(F.transform(found, lambda p: F.when(name(p) == "text", body(p)).otherwise(F.concat(name(p), F.lit(": "), body(p)))), " ")
    return F.when(F.size(found) > 0, joined).otherwise(F.col(c))


def ssrn_field(c: str) -> Column:
    return F.trim(F.regexp_replace(F.col(c), r"&\s?|eJournal|Educator:?|Courses, Cases & Teaching|Teaching", ""))


def ssrn_rows(raw: DataFrame, hits: DataFrame | None = None, file: Column | None = None) -> DataFrame:
    """Landed rows as the SSRN formatter takes them: those with an abstract, with the field that their file's folder names.

    hits: (title, rank, doi) of a landed title search, which gives the DOI; file: the file's path if not that of the scan.
    """
    from .landed import dois_by_title

    parts = F.split(F.input_file_name() if file is None else file, "/")
    out = raw.withColumn("papers_field", F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))).filter(F.col("abstract_text").isNotNull())
    if hits is None:
        return out.withColumn("doi", F.lit(None).cast("string"))
    found = dois_by_title(out.drop("doi"), hits)
    return found.withColumn("doi", F.nullif("doi", F.lit("")))


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text; types are set by the formatter, never inferred from data."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*columns) if columns else df


def format_papers(raw: DataFrame, source: Source | str, database: str | None = None, seen: DataFrame | None = None, check_database: bool = True, order: Column | None = None) -> DataFrame:
    """Rows of a source in the papers schema: one a DOI, the first if duplicates are checked, else the last."""
    s = SOURCES[source] if isinstance(source, str) else source
    small_batches(raw.sparkSession)
    order = F.monotonically_increasing_id() if order is None else order
    df = raw.select(
        s.doi().alias("doi"), X.commas(s.authors()).alias("Authors"), X.year_of(s.date()).alias("year"), F.lit(s.database if database is None else database).alias("database"), s.fields().alias("fields"),
        X.one_line(s.abstract()).alias("Abstract"), s.keywords().cast("string").alias("Keywords"), X.one_line(s.title()).alias("Title"), s.citations(raw).cast("double").alias("numCitedBy"), s.journal().alias("Journal"), order.alias("_order"),
    )
    check = {"doi": F.coalesce("doi", F.lit("")) != "", "english": is_english("Title", empty=s.name != "pmc_full"), "length": X.word_count("Abstract") > 5}
    late = []
    for c in s.checks:
        if c == "seen":
            if seen is not None and check_database:
                df = unseen(df, seen, "doi")
        elif s.registers_early and "seen" in s.checks[: s.checks.index(c)]:
            late.append(check[c])
        else:
            df = df.filter(check[c])
    df = first_wins(df, "doi", F.col("_order") if check_database else F.col("_order").desc())
    for c in late:
        df = df.filter(c)
    if s.abbreviations:
        found = abbreviation_map("Abstract")
        df = df.withColumn("_found", found).withColumns({"Abstract": expand("Abstract", "_found"), "Title": expand("Title", "_found")})
    return df.select(*[F.col(f.name).cast(f.dataType) for f in PAPERS.fields])


def with_citations(papers: DataFrame, counts: DataFrame) -> DataFrame:
    """Citation counts from a table (doi, n) where a paper has the default only."""
    return papers.join(counts.select("doi", F.col("n").cast("double").alias("_n")), "doi", "left").withColumn("numCitedBy", F.when(F.col("numCitedBy") == 0.5, F.coalesce("_n", "numCitedBy")).otherwise(F.col("numCitedBy"))).drop("_n")
