"""Registered queries over the sources: every formatter, nested records, TEI and web pages.

documents stands in for each source's table: raw_rows gives them the columns that the source has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import tables
from ..sources import landed as L
from ..sources import papers as S
from ..sources import structured as D
from .queries import _n_words, query, table

TITLE = "string_split(coalesce(text, ''), chr(10))[1]"
ABSTRACT = "replace(replace(coalesce(text, ''), '-' || chr(10), ''), chr(10), ' ')"
AUTHORS = "'Ann A' || (doc_id % 11) || ', Bob B' || (doc_id % 13)"


def _is_english(c: str, empty: str = "true") -> str:
    """The rule of functions.rules.is_english."""
    tokens = rf"regexp_extract_all(lower({c}), '\p{{L}}+')"
    hits = {k: f"len(list_filter({tokens}, lambda w: list_contains([{', '.join(map(repr, v))}], w)))" for k, v in R.STOP_WORDS.items()}
    total = " + ".join(hits.values())
    return rf"CASE WHEN NOT regexp_matches({c}, '\p{{L}}') THEN {empty} ELSE {hits['en']} > 0 AND {hits['en']} >= greatest({hits['fr']}, {hits['de']}, {hits['es']}) AND {hits['en']} / ({total}) > 0.7 END"


ENGLISH = _is_english(TITLE)
LONG = f"{_n_words(ABSTRACT)} > 5"


def _sql(doi: str = "'10.1/' || (doc_id // 2)", checks: tuple[str, ...] = (), late: str = "true", authors: str = AUTHORS, fields: str = "lang || '|' || source", abstract: str = ABSTRACT, keywords: str = "NULL", title: str = TITLE, cited: str = "0.5", journal: str = "source", database: str = "") -> str:
    """What a formatter gives: checks, the first row of each DOI, then late checks."""
    return f"""WITH raw AS (SELECT *, {doi} AS doi FROM documents), ok AS (SELECT * FROM raw WHERE {" AND ".join(checks) or "true"}),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY doc_id) AS r FROM ok) WHERE r = 1 AND {late})
SELECT doi, {authors} AS authors, CAST(1990 + doc_id % 33 AS INTEGER) AS year, '{database}' AS database, {fields} AS fields, md5({abstract}) AS abstract_md5, CAST({keywords} AS VARCHAR) AS keywords, {title} AS title, CAST({cited} AS DOUBLE) AS cited, {journal} AS journal FROM firsts"""


def raw_rows(spark, sf_dir) -> DataFrame:
    d = tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    n = F.col("doc_id")
    two = F.floor(n / 2).cast("string")
    names = [F.concat(F.lit("Ann A"), (n % 11).cast("string")), F.concat(F.lit("Bob B"), (n % 13).cast("string"))]
    return d.withColumns({
        "_doi": F.concat(F.lit("10.1/"), two), "title": F.split(F.coalesce("text", F.lit("")), "\n")[0], "abstract": F.col("text"), "authors": F.concat(names[0], F.lit("; "), names[1]),
        "date": F.concat((n % 33 + 1990).cast("string"), F.lit(".0")), "listed": F.concat(F.lit("['"), names[0], F.lit("', '"), names[1], F.lit("']")),
    })


def _formatted(raw: DataFrame, source: str, seen: DataFrame | None = None) -> DataFrame:
    p = S.format_papers(raw, source, seen=seen, order=F.col("doc_id"))
    return p.select("doi", F.col("Authors").alias("authors"), "year", "database", F.array_join("fields", "|").alias("fields"), F.md5("Abstract").alias("abstract_md5"), F.col("Keywords").alias("keywords"), F.col("Title").alias("title"), F.col("numCitedBy").alias("cited"), F.col("Journal").alias("journal"))


@query(_sql(checks=("doi NOT IN (SELECT '10.1/' || doc_id FROM labels)", ENGLISH, LONG), cited="CASE WHEN doc_id % 7 = 0 THEN 0.5 ELSE n_chars % 100 END"))
def format_generic(spark, sf_dir):
    """Tabular papers with list literals, counts and a registry of DOIs seen before."""
    raw = raw_rows(spark, sf_dir).withColumns({"doi": F.col("_doi"), "fields": F.concat(F.lit("['"), "lang", F.lit("', '"), "source", F.lit("']")), "journals": F.col("source"), "numCitedBy": F.when(F.col("doc_id") % 7 != 0, (F.col("n_chars") % 100).cast("double"))})
    seen = table(spark, sf_dir, "labels").select(F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("doi"))
    return _formatted(raw, "generic", seen)


@query(_sql(checks=(ENGLISH,), fields="lang", journal="'BioRxiv'", database="biorxiv"))
def format_biorxiv(spark, sf_dir):
    return _formatted(raw_rows(spark, sf_dir).withColumns({"doi": F.col("_doi"), "field_paper": F.col("lang")}), "biorxiv")


@query(_sql(checks=(ENGLISH, LONG), fields="CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang || '|' || source END", database="hal"))
def format_hal(spark, sf_dir):
    return _formatted(raw_rows(spark, sf_dir).withColumns({"doi": F.col("_doi"), "fields": F.when(F.col("doc_id") % 5 != 0, F.concat("lang", F.lit(","), "source")), "journals": F.col("source")}), "hal")


@query(_sql(fields="lang || '|' || 'Serial ' || source", journal="'Serial ' || source", database="issn"))
def format_issn(spark, sf_dir):
    return _formatted(raw_rows(spark, sf_dir).withColumns({"doi": F.col("_doi"), "field_paper": F.col("lang"), "field_issn": F.concat(F.lit("Serial "), "source")}), "issn")


@query(_sql(doi="CASE WHEN doc_id % 10 = 0 THEN '' ELSE '10.1/' || (doc_id // 2) END", checks=("doi <> ''", LONG), fields="lang", journal="'European Geosciences Union'", database="egu"))
def format_egu(spark, sf_dir):
    raw = raw_rows(spark, sf_dir)
    doi = F.when(F.col("doc_id") % 20 == 0, F.lit(None)).when(F.col("doc_id") % 10 == 0, "nan").otherwise(F.concat(F.lit("https://doi.org/"), "_doi"))
    return _formatted(raw.withColumns({"doi": doi, "field": F.col("lang")}), "egu")


@query(_sql(doi="CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 'https://w.org/' || (doc_id // 2) END", checks=("coalesce(doi, '') <> ''", LONG), fields="lang", journal="'IAHR'", database="iahr"))
def format_iahr(spark, sf_dir):
    raw = raw_rows(spark, sf_dir)
    return _formatted(raw.withColumns({"webpage": F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("https://w.org/"), F.floor(F.col("doc_id") / 2).cast("string"))), "field": F.col("lang"), "numCitedBy": F.lit(9.0)}), "iahr")


STRUCTURED = "'Aims: to see ' || lang || ' Methods: by ' || source || ' and so'"


def _structured(more: str = "") -> Column:
    return F.concat(F.lit("{'Aims': 'to see "), "lang", F.lit("', 'Methods': ['by "), "source", F.lit(f"', 'and so{more}']}}"))


@query(_sql(checks=(ENGLISH,), fields=f"{TITLE} || '|' || 'of ' || source", abstract=STRUCTURED, keywords="'k' || doc_id", journal="'Journal of ' || source", database="pmc"))
def format_pmc(spark, sf_dir):
    """Abstracts with headers, keywords after their mark, list literals of authors."""
    raw = raw_rows(spark, sf_dir)
    abstract = F.regexp_replace(_structured("%"), "%", F.concat(F.lit(" keywords: k"), F.col("doc_id").cast("string")))
    return _formatted(raw.withColumns({"doi": F.col("_doi"), "authors": F.col("listed"), "year": F.col("date"), "journal": F.concat(F.lit("Journal of "), "source"), "abstract": abstract}), "pmc")


@query(_sql(late=_is_english(TITLE, "false"), fields="''", abstract=STRUCTURED, database="pmc"))
def format_pmc_full(spark, sf_dir):
    """Full texts: a DOI counts as seen before its title's language is judged."""
    raw = raw_rows(spark, sf_dir)
    return _formatted(raw.withColumns({"doi": F.col("_doi"), "authors": F.col("listed"), "year": F.col("date"), "journal": F.col("source"), "abstract": _structured()}), "pmc_full")


@query(_sql(doi="CASE WHEN doc_id % 3 = 0 THEN 'https://papers.ssrn.com/sol3/papers.cfm?abstract_id=' || doc_id ELSE '10.1/' || (doc_id // 2) END", fields="'Law ' || lang || '|' || source", keywords="source || ', ' || lang", journal="'Law ' || lang", database="ssrn"))
def format_ssrn(spark, sf_dir):
    raw = raw_rows(spark, sf_dir)
    made = {"doi": F.when(F.col("doc_id") % 3 != 0, F.col("_doi")), "abstract_id": F.col("doc_id").cast("string"), "field": F.concat(F.lit("& Law "), "lang", F.lit(" eJournal")), "papers_field": F.col("source"), "abstract_text": F.col("text"), "keywords": F.concat_ws(", ", "source", "lang")}
    return _formatted(raw.withColumns(made), "ssrn")


@query(_sql(fields="''", database="covid"))
def format_covid(spark, sf_dir):
    raw = raw_rows(spark, sf_dir)
    made = raw.select("doc_id", F.col("_doi").alias("DOI"), F.col("title").alias("Title of preprint"), F.col("listed").alias("Authors"), F.concat(F.lit("2 May "), F.substring("date", 1, 4)).alias("Date of Upload"), F.col("text").alias("Abstract"), F.col("source").alias("Uploaded Site"))
    return _formatted(made, "covid")


@query("""SELECT '10.1/' || (doc_id // 2) AS doi, max(CASE WHEN l.n IS NOT NULL AND c = 0.5 THEN l.n ELSE c END) AS cited FROM
  (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE CAST(doc_id % 5 AS DOUBLE) END AS c FROM documents WHERE doc_id % 2 = 0) d LEFT JOIN (SELECT doc_id // 2 AS k, CAST(max(quality + 2) AS DOUBLE) AS n FROM labels GROUP BY 1) l ON d.doc_id // 2 = l.k GROUP BY 1""")
def citations_from_a_table(spark, sf_dir):
    """Counts of a service, landed as a table, where a paper has the default only."""
    p = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.concat(F.lit("10.1/"), F.floor(F.col("doc_id") / 2).cast("string")).alias("doi"), F.when(F.col("doc_id") % 4 == 0, 0.5).otherwise((F.col("doc_id") % 5).cast("double")).alias("numCitedBy"))
    n = table(spark, sf_dir, "labels").groupBy(F.concat(F.lit("10.1/"), F.floor(F.col("doc_id") / 2).cast("string")).alias("doi")).agg(F.max(F.col("quality") + 2).alias("n"))
    return S.with_citations(p, n).select("doi", F.col("numCitedBy").alias("cited"))


# -- nested records ----------------------------------------------------------------------------------------------------

_ARCHIVES = ("cs.CL", "math.AG cs.CL", "physics.bio-ph", "none.X")


@query(f"""WITH raw AS (SELECT *, (['cs.CL', 'math.AG cs.CL', 'physics.bio-ph', 'none.X'])[doc_id % 4 + 1] AS cat FROM documents WHERE doc_id % 9 <> 0)
SELECT CASE WHEN doc_id % 2 = 0 THEN '10.1/' || doc_id ELSE '20' || (10 + doc_id % 9) || '.' || doc_id END AS doi, 'Ann A' || (doc_id % 11) || ', Bob' AS authors, CAST(1990 + doc_id % 33 AS INTEGER) AS year,
  (['Computer Science', 'Mathematics', 'Physics', 'none'])[doc_id % 4 + 1] || (['|Computation|Language', '|Geometry', '', ''])[doc_id % 4 + 1] AS fields, md5(trim({ABSTRACT})) AS abstract_md5, source AS journal FROM raw""")
def arxiv_records(spark, sf_dir):
    """JSON lines of preprints, with category names joined; withdrawn ones go."""
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    cat = F.get(F.array(*map(F.lit, _ARCHIVES)), (n % 4).cast("int"))
    line = F.to_json(F.struct(
        F.concat(F.lit("20"), (n % 9 + 10).cast("string"), F.lit("."), n.cast("string")).alias("id"), F.array(F.array(F.concat(F.lit("A"), (n % 11).cast("string")), F.lit("Ann")), F.array(F.lit("Bob"), F.lit(""))).alias("authors_parsed"),
        F.lit("T").alias("title"), F.col("text").alias("abstract"), F.when(n % 2 == 0, F.concat(F.lit("10.1/"), n.cast("string"))).alias("doi"), F.col("source").alias("journal-ref"),
        F.array(F.struct(F.concat(F.lit("Mon, 2 Apr "), (n % 33 + 1990).cast("string"), F.lit(" 19:18:42 GMT")).alias("created"))).alias("versions"), cat.alias("categories"), F.when(n % 9 == 0, "This paper was Withdrawn").alias("comments"),
    ))
    raw = d.select(F.from_json(line, D.ARXIV).alias("x")).select("x.*")
    names = spark.createDataFrame([("cs.CL", "Computation-Language"), ("math.AG", "Geometry")], "category string, name string")
    a = D.arxiv_papers(raw, names=names)
    return a.select("doi", F.col("Authors").alias("authors"), "year", F.array_join("fields", "|").alias("fields"), F.md5("Abstract").alias("abstract_md5"), F.col("Journal").alias("journal"))


_CODES = [(name, int(x.split("-")[0]), int(x.split("-")[-1])) for name, codes in D.FIELD_CODES.items() for x in codes]


@query("WITH r(label, lo, hi) AS (VALUES " + ", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in _CODES) + f"""), c AS (SELECT doc_id, unnest([1000 + doc_id % 2700, 1500 + doc_id % 9]) AS code FROM documents),
f AS (SELECT doc_id, string_agg(DISTINCT label, '|' ORDER BY label) AS fields FROM (SELECT doc_id, label FROM c JOIN r ON code BETWEEN lo AND hi UNION SELECT doc_id, 'Subject ' || code FROM c WHERE code % 100 = 2) GROUP BY 1)
SELECT '10.1/' || d.doc_id AS doi, {AUTHORS.replace("doc_id", "d.doc_id")} AS authors, CAST(1990 + d.doc_id % 33 AS INTEGER) AS year, coalesce(fields, '') AS fields, source || ', ' || lang AS keywords, 'One. Two.' AS highlights, md5({ABSTRACT}) AS abstract_md5 FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id""")
def elsevier_records(spark, sf_dir):
    """Nested records whose subject codes give fields by ranges and names."""
    n = F.col("doc_id")
    author = lambda first, last, k: F.struct(F.lit(first).alias("first"), F.concat(F.lit(last), (n % k).cast("string")).alias("last"))
    meta = F.struct(
        F.array((n % 2700 + 1000).cast("string"), (n % 9 + 1500).cast("string")).alias("asjc"), F.concat(F.lit("10.1/"), n.cast("string")).alias("doi"), F.lit("T").alias("title"), F.array(author("Ann", "A", 11), author("Bob", "B", 13)).alias("authors"),
        F.array("source", "lang").alias("keywords"), F.lit("1").alias("issn"), (n % 33 + 1990).cast("string").alias("pub_year"),
    )
    raw = table(spark, sf_dir, "documents").select(F.col("text").alias("abstract"), F.array(F.struct(F.lit("One.").alias("sentence")), F.struct(F.lit("Two.").alias("sentence"))).alias("author_highlights"), meta.alias("metadata"), F.concat(F.lit("f"), n.cast("string")).alias("file"))
    ranges = spark.createDataFrame(_CODES, "label string, lo int, hi int")
    subjects = spark.range(1002, 4000, 100).select(F.col("id").cast("int").alias("code"), F.concat(F.lit("Subject "), F.col("id").cast("string")).alias("subject"))
    e = D.elsevier_papers(raw, ranges, subjects)
    return e.select("doi", F.col("Authors").alias("authors"), "year", F.array_join("fields", "|").alias("fields"), F.col("Keywords").alias("keywords"), "highlights", F.md5("Abstract").alias("abstract_md5"))


@query("WITH r(lo, hi) AS (VALUES " + ", ".join(f"({lo}, {hi})" for n, lo, hi in _CODES if n == "Mathematics") + ") SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM r WHERE 1000 + p_partkey * 37 % 2700 BETWEEN lo AND hi)")
def records_of_a_field(spark, sf_dir):
    """Files that hold papers of one field."""
    from ..operators import intervals

    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 2700 + 1000).cast("int").alias("code"))
    f = intervals.range_labels(p, "code", spark.createDataFrame(_CODES, "label string, lo int, hi int")).groupBy("p_partkey").agg(F.collect_set("label").alias("fields"))
    return D.files_with_field(f, "Mathematics").select("p_partkey")


WORDS = r"list_filter(string_split_regex(trim(regexp_replace(coalesce(text, ''), '[^\p{L} ]', ' ', 'g')), '\s+'), lambda w: w <> '')"


@query(rf"""SELECT '10.1/' || doc_id AS doi, 'Ann A' || (doc_id % 11) || ', Bob B' || (doc_id % 13) AS authors, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE CAST(1990 + doc_id % 33 AS INTEGER) END AS year, md5(array_to_string({WORDS}, ' ')) AS abstract_md5,
  source || ', ' || lang AS keywords, 'On ' || lang AS title, 'J ' || source AS journal FROM documents WHERE len({WORDS}) > 5""")
def tei_records(spark, sf_dir):
    """TEI documents as PDF services give them."""
    n = F.col("doc_id")
    clean = F.array_join(X.words(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L} ]", " ")), " ")
    person = lambda first, last, k: F.concat(F.lit(f"<author><persName><forename type='first'>{first}</forename><surname>{last}"), (n % k).cast("string"), F.lit("</surname></persName></author>"))
    date = F.when(n % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("<date type='published' when='x'>May "), (n % 33 + 1990).cast("string"), F.lit("</date>")))
    xml = F.concat(
        F.lit("<?xml version='1.0'?><TEI xmlns=\"http://www.tei-c.org/ns/1.0\"><teiHeader><fileDesc><titleStmt><title level='a' type='main' xml:lang='en'>On "), F.col("lang"), F.lit("</title></titleStmt><sourceDesc><biblStruct><analytic>"), person("Ann", "A", 11), person("Bob", "B", 13),
        F.lit("<author><persName><surname>Alone</surname></persName></author></analytic><monogr><title level='j'>J "), F.col("source"), F.lit("</title><imprint>"), date, F.lit("</imprint></monogr><idno type='DOI'>10.1/"), n.cast("string"),
        F.lit("</idno></biblStruct></sourceDesc></fileDesc><profileDesc><textClass><keywords>"), F.col("source"), F.lit("\n"), F.col("lang"), F.lit("</keywords></textClass><abstract><p>"), clean, F.lit("</p></abstract></profileDesc></teiHeader></TEI>"),
    )
    t = D.tei_papers(tables.pinned(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), tei=xml))
    return t.select("doi", F.col("Authors").alias("authors"), F.coalesce("year", F.lit(0)).alias("year"), F.md5("Abstract").alias("abstract_md5"), F.col("Keywords").alias("keywords"), F.col("Title").alias("title"), F.col("Journal").alias("journal"))


@query("""WITH o AS (SELECT o_orderkey, (['Abstract', 'Introduction', 'Study area', 'Methods', 'Other', 'Results', 'More', 'Discussion', 'Funding', 'Notes'])[1:3 + o_orderkey % 8] AS h FROM orders)
SELECT o_orderkey, array_to_string(list_transform(range(0, len(h)), lambda i: CASE WHEN i < 1 THEN 'abstract' WHEN i < 3 THEN 'introduction' WHEN i < 5 THEN 'methods' WHEN i < 8 THEN 'results' ELSE 'references' END), ',') AS parts FROM o""")
def header_parts(spark, sf_dir):
    """Which part of a paper each header belongs to."""
    names = F.array(*map(F.lit, ("Abstract", "Introduction", "Study area", "Methods", "Other", "Results", "More", "Discussion", "Funding", "Notes")))
    h = F.slice(names, 1, (F.col("o_orderkey") % 8 + 3).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(D.header_parts(h), ",").alias("parts"))


@query("""SELECT o_orderkey, list_contains(['Aim', 'Methods'], h) AS structured FROM (SELECT o_orderkey, (['Aim', 'Main text', 'Review', 'Methods', 'Question 1', 'Meaning', 'Key Findings'])[o_orderkey % 7 + 1] AS h FROM orders)""")
def structured_headers(spark, sf_dir):
    names = F.array(*map(F.lit, ("Aim", "Main text", "Review", "Methods", "Question 1", "Meaning", "Key Findings")))
    h = F.array(F.lit("Aim"), F.get(names, (F.col("o_orderkey") % 7).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.is_structured(h).alias("structured"))


@query("""WITH p AS (SELECT o_custkey AS file, o_orderkey AS page, o_orderkey % 3 = 0 AS opens FROM orders)
SELECT file, page AS first, coalesce(nxt - 1, last) AS last FROM (SELECT file, page, lead(page) OVER (PARTITION BY file ORDER BY page) AS nxt FROM p WHERE opens) JOIN (SELECT file, max(page) AS last FROM p GROUP BY 1) USING (file)""")
def articles_of_files(spark, sf_dir):
    """Page ranges of the articles in files of many."""
    many = F.lit("a b s t r a c t " + "word " * 25)
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("page"), F.when(F.col("o_orderkey") % 3 == 0, many).when(F.col("o_orderkey") % 3 == 1, "abstract but short").otherwise("text").alias("text"))
    return D.pdf_articles(p)


# -- web pages of sources ----------------------------------------------------------------------------------------------


def _landed(spark, sf_dir, name: str, html: Column) -> DataFrame:
    d = tables.spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    return L.PARSERS[name](tables.pinned(d, html=html))


def _n() -> Column:
    return F.col("c_custkey").cast("string")


def _year() -> Column:
    return (F.col("c_custkey") % 30 + 1990).cast("string")


@query("""SELECT '10.1/' || c_custkey AS doi, 'On ' || c_name AS title, 'Ann X, Bob Y' AS authors, CASE WHEN c_custkey % 5 = 0 THEN 'In press' ELSE 'Text of ' || c_custkey END AS abstract, CASE WHEN c_custkey % 5 = 0 THEN 2022 ELSE CAST(1990 + c_custkey % 30 AS INTEGER) END AS year, 'a, b' AS keywords, 'J1' AS journal FROM customer""")
def hal_pages(spark, sf_dir):
    press = F.col("c_custkey") % 5 == 0
    html = F.concat(F.lit('<html><body><div class="result-text"><h3 class="title"> On '), F.col("c_name"), F.lit('</h3><div class="authors"><span class="author">Ann X</span> <span class="author">Bob Y</span></div><div class="abstract-content"><div>'), F.when(press, "In press").otherwise(F.concat(F.lit("Text</div> <div><div>of</div> </div>"), _n(), F.lit("<div>"))),
                    F.lit('</div></div><div class="keywords"><span>a</span><span>b</span></div><div class="citation-ref"><i>J1</i>, '), F.when(press, "In press").otherwise(_year()), F.lit('</div><a class="doi" href="https://doi.org/10.1/'), _n(), F.lit('">10.1</a></div></body></html>'))
    return _landed(spark, sf_dir, "hal", html).select("doi", "title", "authors", "abstract", "year", "keywords", "journal")


@query("""SELECT '10.1101/' || c_custkey AS doi, 'On ' || c_name AS title, 'Ann B. X, Bob Y' AS authors, CAST(1990 + c_custkey % 30 AS INTEGER) AS year, 'Biology' AS field_paper, 'Text of ' || c_custkey || ' in two parts' AS abstract FROM customer WHERE c_custkey % 4 <> 0""")
def biorxiv_records(spark, sf_dir):
    """Records without an abstract are left out."""
    body = F.when(F.col("c_custkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("<abstract><p>Text of "), _n(), F.lit("</p><p>in <i>two</i> parts</p></abstract>")))
    html = F.concat(F.lit("<article><front><article-meta><article-id pub-id-type='doi'>10.1101/"), _n(), F.lit("</article-id><article-categories><subj-group subj-group-type='hwp-journal-coll'><subject>Biology</subject></subj-group></article-categories><title-group><article-title>On "), F.col("c_name"),
                    F.lit("</article-title></title-group><contrib-group><contrib contrib-type='author'><name><surname>X</surname><given-names>Ann B.</given-names></name></contrib><contrib contrib-type='author'><name><surname>Y</surname><given-names>Bob</given-names></name></contrib><contrib><collab>Group</collab></contrib></contrib-group><pub-date><year>"), _year(), F.lit("</year></pub-date>"), body, F.lit("</article-meta></front></article>"))
    return _landed(spark, sf_dir, "biorxiv", html).select("doi", "title", "authors", "year", "field_paper", "abstract")


@query("""SELECT '10.1/' || c_custkey AS doi, 'On ' || c_name AS title, 'Ann X, Bob Y' AS authors, CAST(1990 + c_custkey % 30 AS INTEGER) AS year, 'J' AS journal, CASE WHEN c_custkey % 2 = 0 THEN 'Aim: One. Two.|Methods: Three.' ELSE 'text: Plain one.' END AS abstract, 'Body 1. Body 2.' AS body FROM customer""")
def pubmed_records(spark, sf_dir):
    """Abstracts with or without parts, and the body's paragraphs."""
    part = F.when(F.col("c_custkey") % 2 == 0, F.lit("<sec><title>Aim</title><p>One.</p><p>Two.</p></sec><sec><title>Methods</title><p>Three.</p></sec>")).otherwise(F.lit("<p>Plain one.</p>"))
    html = F.concat(F.lit("<article><front><journal-meta><journal-title>J</journal-title></journal-meta><article-meta><article-id pub-id-type='pmid'>7</article-id><article-id pub-id-type='doi'>10.1/"), _n(), F.lit("</article-id><title-group><article-title>On "), F.col("c_name"),
                    F.lit("</article-title></title-group><contrib-group><contrib><name><surname>X</surname><given-names>Ann</given-names></name></contrib><contrib><name><surname>Y</surname><given-names>Bob</given-names></name></contrib></contrib-group><pub-date><year>"), _year(), F.lit("</year></pub-date><abstract>"), part, F.lit("</abstract></article-meta></front><body><p>Body 1.</p><p>Body 2.</p></body></article>"))
    p = _landed(spark, sf_dir, "pubmed", html)
    text = F.array_join(F.transform("abstract", lambda x: F.concat_ws(": ", x["title"], F.array_join(x["paragraphs"], " "))), "|")
    return p.select("doi", "title", "authors", "year", "journal", text.alias("abstract"), F.array_join("body", " ").alias("body"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS abstract_id, 'On ' || c_name AS title, 'Ann X, Bob Y' AS authors, CAST(1990 + c_custkey % 30 AS INTEGER) AS year, 'Law' AS field, c_custkey % 40 AS pages, 'Text of ' || c_custkey AS abstract_text, 'a, b' AS keywords FROM customer""")
def ssrn_pages(spark, sf_dir):
    html = F.concat(F.lit("<div class=\"box-abstract-main\"><h1>On "), F.col("c_name"), F.lit("</h1><p class=\"note note-list\"><span>"), (F.col("c_custkey") % 40).cast("string"), F.lit(" Pages</span><span>Posted: 1 Jan "), _year(), F.lit("</span></p><div class=\"authors\"><h2><a href=\"x\">Ann X</a></h2><h2><a href=\"y\">Bob Y</a></h2></div><div class=\"abstract-text\"><h3>Abstract</h3><div><div>Text</div> of</div><p>"), _n(),
                    F.lit("</p></div><p><strong>Keywords: </strong>a, b</p><div class=\"group-field\"><h2>Law</h2></div></div><input name=\"abstract_id\" value=\""), _n(), F.lit("\">"))
    return _landed(spark, sf_dir, "ssrn", html).select("abstract_id", "title", "authors", "year", "field", "pages", "abstract_text", "keywords")


@query("""SELECT 'https://doi.org/10.5/' || c_custkey AS doi, 'On ' || c_name AS title, 'Ann X, and Bob Y' AS authors, CAST(1990 + c_custkey % 30 AS INTEGER) AS year, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Text of ' || c_custkey END AS abstract FROM customer""")
def egu_pages(spark, sf_dir):
    body = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("<div class=\"short_summary\"><div class=\"x\">Text</div> <div>of <div>"), _n(), F.lit("</div></div></div>")))
    html = F.concat(F.lit("<div class=\"paperlist-object\"><a class=\"article-title\" href=\"/x\">On "), F.col("c_name"), F.lit("</a><div class=\"authors\">Ann X, and Bob Y</div><div class=\"citation\">J, 1, 2, <a href=\"https://doi.org/10.5/"), _n(), F.lit("\">https</a>, "), _year(), F.lit("</div>"), body, F.lit("</div>"))
    return _landed(spark, sf_dir, "egu", html).select("doi", "title", "authors", "year", "abstract")


@query("""SELECT 'On ' || c_name AS title, 'Ann X' AS authors, 'a; b' AS keywords, 'Text of ' || c_custkey AS abstract, CAST(1990 + c_custkey % 30 AS INTEGER) AS year FROM customer""")
def iahr_pages(spark, sf_dir):
    """Fields by the place of their paragraph."""
    html = F.concat(F.lit("<h1>On "), F.col("c_name"), F.lit("</h1><p><b>Author(s):</b> Ann X</p><p>Linked Author(s): </p><p>Keywords: a; b</p><p>Abstract: Text of "), _n(), F.lit("</p><p>DOI: </p><p>Year: "), _year(), F.lit("</p>"))
    return _landed(spark, sf_dir, "iahr", html).select("title", "authors", "keywords", "abstract", "year")


@query("""SELECT '10.2166/' || c_custkey AS doi, 'On ' || c_name AS title, 'Ann X, Bob Y' AS authors, CAST(1990 + c_custkey % 30 AS INTEGER) AS year, 'Text of ' || c_custkey AS abstract, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 9 AS DOUBLE) ELSE 0.5 END AS cited FROM customer""")
def iwa_pages(spark, sf_dir):
    """Citation counts default to a half."""
    cited = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("<div class=\"article-cited-by\">Cited by "), (F.col("c_custkey") % 9).cast("string"), F.lit("</div>"))).otherwise("")
    html = F.concat(F.lit("<h1 class=\"wi-article-title\"> On "), F.col("c_name"), F.lit(" </h1><a class=\"linked-name\">Ann X</a><a class=\"linked-name\">Bob Y</a><div class=\"citation-doi\"><a href=\"https://doi.org/10.2166/"), _n(), F.lit("\">d</a></div><span class=\"article-date\">May "), _year(), F.lit("</span><section class=\"abstract\"><p>Text of "), _n(), F.lit("</p></section>"), cited)
    return _landed(spark, sf_dir, "iwa", html).select("doi", "title", "authors", "year", "abstract", "cited")


@query("""SELECT 'On ' || c_name AS title, 'Ann X, Bob Y' AS authors, 'Journal of T' AS journal, CAST(1990 + c_custkey % 30 AS INTEGER) AS year FROM customer""")
def scholar_pages(spark, sf_dir):
    """A profile's rows: the first grey line names authors, the next the journal."""
    html = F.concat(F.lit("<tr class=\"gsc_a_tr\"><td><a class=\"gsc_a_at\" href=\"/c\">On "), F.col("c_name"), F.lit("</a><div class=\"gs_gray\">Ann X, Bob Y</div><div class=\"gs_gray\">Journal of T</div></td><td class=\"gsc_a_y\"><span>"), _year(), F.lit("</span></td></tr>"))
    return _landed(spark, sf_dir, "scholar", html).select("title", "authors", "journal", "year")


@query("""SELECT '10.1/' || c_custkey AS doi, 'On ' || c_name AS title, 'Ann X, Bob Y' AS authors, CAST(1990 + c_custkey % 30 AS INTEGER) AS year, 'Text of ' || c_custkey AS abstract, CAST(c_custkey % 50 AS DOUBLE) AS cited, CAST(c_custkey % 7 AS DOUBLE) AS citing FROM customer WHERE c_custkey % 3 <> 0""")
def issn_records(spark, sf_dir):
    """Answers of citation services, as JSON; those without an abstract are left out."""
    html = F.to_json(F.struct(
        F.concat(F.lit("10.1/"), _n()).alias("doi"), F.concat(F.lit("On "), F.col("c_name")).alias("title"), F.array(F.struct(F.lit("Ann X").alias("name")), F.struct(F.lit("Bob Y").alias("name"))).alias("authors"), F.col("c_custkey").cast("int").alias("x"), (F.col("c_custkey") % 30 + 1990).alias("year"),
        F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("Text of "), _n())).alias("abstract"), (F.col("c_custkey") % 50).alias("numCitedBy"), (F.col("c_custkey") % 7).alias("numCiting"),
    ))
    return _landed(spark, sf_dir, "issn", html).select("doi", "title", "authors", "year", "abstract", "cited", "citing")


@query("""SELECT c_custkey, 'J' || c_custkey AS journal, '1234-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS issn, 'Law|Art' AS fields FROM customer""")
def doaj_cards(spark, sf_dir):
    """Journal cards: name, ISSN and subjects."""
    html = F.concat(F.lit("<li class=\"card search-results__record\"><h3 class=\"search-results__heading\"><a href=\"/toc/1\">J"), _n(), F.lit("</a></h3><li>ISSN: 1234-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("</li><ul class=\"inlined-list\"><li><a href=\"/s\">Law</a></li><li><a href=\"/s\">Art</a></li></ul></li>"))
    return _landed(spark, sf_dir, "doaj", html).select("c_custkey", "journal", "issn", F.array_join("fields", "|").alias("fields"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '10.1/' || (p_partkey % 100) END AS doi FROM part""")
def doi_by_title(spark, sf_dir):
    """The first hit of a landed title search; empty without one."""
    papers = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Title "), F.when(F.col("p_partkey") % 4 == 0, F.lit("none")).otherwise((F.col("p_partkey") % 100).cast("string"))).alias("title"))
    hits = spark.range(100).select(F.concat(F.lit("title  "), F.col("id").cast("string")).alias("title"), F.explode(F.array(F.lit(0), F.lit(1))).alias("rank"), F.concat(F.lit("10.1/"), F.col("id").cast("string")).alias("doi"))
    hits = hits.withColumn("doi", F.when(F.col("rank") == 0, F.col("doi")).otherwise("10.9/other"))
    return L.dois_by_title(papers, hits).select("p_partkey", "doi")


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def page_texts(spark, sf_dir):
    from ..sources import pages as P

    return table(spark, sf_dir, "pages").select("page_id", F.md5(P.plain_text("html")).alias("text_md5"))


@query("""SELECT c_custkey, 'field' || (c_custkey % 3) AS papers_field, CASE WHEN c_custkey % 2 = 0 THEN '10.1/' || (c_custkey % 20) END AS doi FROM customer WHERE c_custkey % 5 <> 0""")
def ssrn_scan(spark, sf_dir):
    """Landed rows: without an abstract they go, folders name their field, a title search gives DOIs."""
    n = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select("c_custkey", F.when(n % 2 == 0, F.concat(F.lit("On "), (n % 20).cast("string"))).otherwise("None").alias("title"), F.when(n % 5 != 0, "text").alias("abstract_text"), F.concat(F.lit("s://x/field"), (n % 3).cast("string"), F.lit("/f.csv")).alias("f"))
    hits = spark.range(20).select(F.concat(F.lit("on "), F.col("id").cast("string")).alias("title"), F.lit(0).alias("rank"), F.concat(F.lit("10.1/"), F.col("id").cast("string")).alias("doi"))
    return S.ssrn_rows(raw, hits, F.col("f")).select("c_custkey", "papers_field", "doi")
