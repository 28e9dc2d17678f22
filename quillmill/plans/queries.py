"""The registered queries, each with the SQL that an independent engine answers it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import authors as A
from ..functions import rules as R
from ..functions import spans as S
from ..functions import text as X
from ..functions.abbreviations import abbreviation_map
from ..operators import evaluation, intervals, ranking, search, tables, zones
from ..sources import pages as P
from ..sources import structured as D
from . import find
from . import produce as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as papers: a view that the SQL below repeats."""
    d = tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    n = F.col("doc_id")
    third = F.when(n % 3 == 0, F.concat(F.lit(", Cyd C"), (n % 5).cast("string"))).otherwise("")
    return d.select(
        n, F.concat(F.lit("10.0000/doc."), n.cast("string")).alias("doi"), F.split("text", "\n")[0].alias("Title"), X.one_line("text").alias("Abstract"), (n % 33 + 1990).cast("int").alias("year"),
        F.when(n % 7 != 0, (F.col("n_chars") % 100).cast("double")).alias("numCitedBy"), F.col("source").alias("Journal"), F.array("lang", "source").alias("fields"), F.col("source").alias("database"),
        F.concat(F.lit("Ann A"), (n % 11).cast("string"), F.lit(", Bob B"), (n % 13).cast("string"), third).alias("Authors"), F.lit("").alias("Keywords"), "lang", "text",
    )


PAPERS = """papers AS (
  SELECT doc_id, '10.0000/doc.' || doc_id AS doi, string_split(text, chr(10))[1] AS title, replace(replace(text, '-' || chr(10), ''), chr(10), ' ') AS abstract,
    CAST(1990 + doc_id % 33 AS INTEGER) AS year, CASE WHEN doc_id % 7 <> 0 THEN CAST(n_chars % 100 AS DOUBLE) END AS cited, source AS journal, lang, text, source,
    'Ann A' || (doc_id % 11) || ', Bob B' || (doc_id % 13) || CASE WHEN doc_id % 3 = 0 THEN ', Cyd C' || (doc_id % 5) ELSE '' END AS authors
  FROM documents)"""


def _n_words(c: str) -> str:
    return rf"len(list_filter(string_split_regex(trim({c}), '\s+'), lambda w: w <> ''))"


SENTENCES = rf"""sents AS (
  SELECT *, list_filter(list_transform(string_split(regexp_replace(abstract, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS every FROM papers),
full_sents AS (SELECT *, list_filter(every, lambda s: {_n_words("s")} > 5 AND NOT contains(lower(s), 'online version')) AS good FROM sents)"""
FORMULA = "(CASE WHEN doc_id % 3 = 0 THEN 'A' || (doc_id % 11) || ' et al.' ELSE 'A' || (doc_id % 11) || ' and B' || (doc_id % 13) END) || ' (' || year || ')'"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by place: sentence i belongs to objectives, methods or results by i modulo 3."""
    p = papers(spark, sf_dir).withColumn("good", X.full_sentences("Abstract"))

    def row(k: int, section: str):
        return F.struct(F.lit(section).alias("section"), F.filter("good", lambda _, i: i % 3 == k).alias("messages"))

    p = p.select("*", F.inline(F.array(*(row(k, s) for k, s in enumerate(("objectives", "methods", "results"))))))
    return p.select(
        "doc_id", F.concat("doi", F.lit("_"), "section").alias("fname"), F.col("doi").alias("paper_name"), "section", "messages", "year", "numCitedBy", F.col("Title").alias("title"), F.col("Journal").alias("journal"), A.author_formula("Authors", "year").alias("authors"), F.col("Authors").alias("allauthors"), "lang",
        F.concat(A.author_formula("Authors", "year"), F.lit(": "), F.coalesce(F.get("messages", F.lit(0)), F.lit(""))).alias("reported"),
    )


SECTIONS = f"""sections AS (
  SELECT doc_id, doi || '_' || section AS fname, doi AS paper_name, section, messages, year, cited, title, journal, {FORMULA} AS formula, authors, lang,
    {FORMULA} || ': ' || coalesce(messages[1], '') AS reported, array_to_string(messages, '. ') AS msg
  FROM (SELECT *, unnest(['objectives', 'methods', 'results']) AS section,
    unnest([list_filter(good, lambda s, i: (i - 1) % 3 = 0), list_filter(good, lambda s, i: (i - 1) % 3 = 1), list_filter(good, lambda s, i: (i - 1) % 3 = 2)]) AS messages FROM full_sents))"""
BASE = f"WITH {PAPERS}, {SENTENCES}, {SECTIONS}"

# -- ingest ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {PAPERS} SELECT doi, title, md5(abstract) AS abstract_md5, authors, year, coalesce(cited, 0.5) AS cited, journal, lang || ', ' || source AS fields
FROM papers WHERE {_n_words("abstract")} > 5""")
def format_papers(spark, sf_dir):
    """Clean-up, defaults and the length filter of the formatter."""
    p = papers(spark, sf_dir).filter(X.word_count("Abstract") > 5)
    return p.select("doi", F.col("Title").alias("title"), F.md5("Abstract").alias("abstract_md5"), X.commas("Authors").alias("authors"), X.year_of("year").alias("year"), X.citations("numCitedBy").alias("cited"), F.col("Journal").alias("journal"), F.array_join("fields", ", ").alias("fields"))


@query("SELECT md5(text) AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedupe_first_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    return tables.first_wins(d, "key", "doc_id").select("key", "doc_id")


@query("SELECT md5(text) AS key, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedupe_last_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    return tables.last_wins(d, "key", "doc_id").select("key", "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_seen(spark, sf_dir):
    return tables.unseen(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


def _hits(lang: str) -> str:
    return f"len(list_filter(t, lambda w: list_contains([{', '.join(repr(w) for w in R.STOP_WORDS[lang])}], w)))"


@query(rf"""SELECT doc_id, best_lang AS lang, round(best / total, 6) AS score FROM (
  SELECT doc_id, greatest(en, fr, de, es) AS best, en + fr + de + es AS total, CASE greatest(en, fr, de, es) WHEN 0 THEN NULL WHEN en THEN 'en' WHEN fr THEN 'fr' WHEN de THEN 'de' ELSE 'es' END AS best_lang
  FROM (SELECT doc_id, {_hits("en")} AS en, {_hits("fr")} AS fr, {_hits("de")} AS de, {_hits("es")} AS es FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{{L}}+') AS t FROM documents))) WHERE best > 0""")
def detect_language(spark, sf_dir):
    d = tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", R.language("text").alias("x"))
    return d.filter("x.lang is not null").select("doc_id", "x.lang", F.round("x.score", 6).alias("score"))


@query(rf"""SELECT doc_id FROM (SELECT doc_id, blank, {_hits("en")} AS en, {_hits("fr")} AS fr, {_hits("de")} AS de, {_hits("es")} AS es
  FROM (SELECT doc_id, NOT regexp_matches(string_split(text, chr(10))[1], '\p{{L}}') AS blank, regexp_extract_all(lower(string_split(text, chr(10))[1]), '\p{{L}}+') AS t FROM documents))
WHERE blank OR (en > 0 AND en >= greatest(fr, de, es) AND en / (en + fr + de + es) > 0.7)""")
def english_only(spark, sf_dir):
    return papers(spark, sf_dir).filter(R.is_english("Title")).select("doc_id")


@query("""WITH old AS (SELECT doc_id, 'old' AS version FROM documents WHERE doc_id % 2 = 0), new AS (SELECT doc_id, 'new' AS version FROM documents WHERE doc_id % 3 = 0)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)""")
def upsert_papers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return tables.upsert(d.filter("doc_id % 2 = 0").withColumn("version", F.lit("old")), d.filter("doc_id % 3 = 0").withColumn("version", F.lit("new")), "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END::INTEGER AS version FROM documents")
def merge_last_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return tables.merged([d.withColumn("version", F.lit(0)), d.filter("doc_id % 3 = 0").withColumn("version", F.lit(1)), d.filter("doc_id % 5 = 0").withColumn("version", F.lit(2))], "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def remove_registered(spark, sf_dir):
    return tables.without(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id")


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) AS r FROM documents)
WHERE r <= 100 // (SELECT count(DISTINCT source) FROM documents) + 1""")
def stratified_sample(spark, sf_dir):
    """A sampling operator: equal quotas of sources."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    return tables.quota_sample(d, "source", F.md5(F.col("doc_id").cast("string")), 100, d.select("source").distinct().count())


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)) LIMIT 20")
def random_papers(spark, sf_dir):
    """A sampling operator: k rows by a seeded hash."""
    return tables.random_rows(table(spark, sf_dir, "documents").select("doc_id"), 20, F.md5(F.col("doc_id").cast("string")))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE r >= 10 AND r < 500")
def slice_papers(spark, sf_dir):
    return tables.row_slice(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 10, 500)


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def papers_per_field(spark, sf_dir):
    return tables.counts(table(spark, sf_dir, "documents"), "lang")


@query("SELECT field, count(*) AS n FROM (SELECT unnest([lang, source]) AS field FROM documents) GROUP BY 1")
def field_distribution(spark, sf_dir):
    return tables.exploded_counts(papers(spark, sf_dir), "fields", "field")


# -- text functions --------------------------------------------------------------------------------------------------


@query(f"WITH {PAPERS}, {SENTENCES} SELECT doc_id, CAST(len(every) AS BIGINT) AS n, CAST(len(good) AS BIGINT) AS n_full, md5(array_to_string(good, '|')) AS sentences_md5 FROM full_sents")
def sentence_segmentation(spark, sf_dir):
    p = papers(spark, sf_dir)
    good = X.full_sentences("Abstract")
    return p.select("doc_id", F.size(X.sentences("Abstract")).cast("long").alias("n"), F.size(good).cast("long").alias("n_full"), F.md5(F.array_join(good, "|")).alias("sentences_md5"))


@query(rf"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(array_to_string(list_filter(list_filter(list_transform(string_split(regexp_replace(c, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> ''),
  lambda s: NOT regexp_matches(s, '\w+\s?=\s?\w+') AND NOT regexp_matches(s, '{X.FIGURE_TERMS}') AND {_n_words("s")} > 3), ' '), '\.\s*\.', '.', 'g'), '\s+', ' ', 'g'))) AS clean_md5
FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ':\s?[^.]*\.', '.', 'g'), 'i\.e\.?,?|e\.g\.?,?', 'meaning', 'g'), 'et\s+al\.\s?', 'et al', 'g'), 'cf\.', 'see', 'g'),
  '\(\s*([^\s()]+\s+){{5,}}[^\s()]+\s*\)', '', 'g'), '(?i)\((figure|table|meaning)[^)]*\)', '', 'g'), '(\(|\[)[0-9][0-9]?(\)|\])\s?', '', 'g') AS c FROM documents)""")
def clean_text(spark, sf_dir):
    return tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.md5(X.clean_text("text")).alias("clean_md5"))


@query(f"WITH {PAPERS} SELECT doc_id, {FORMULA} AS formula FROM papers")
def author_formula(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", A.author_formula("Authors", "year").alias("formula"))


@query("""SELECT s_suppkey, trim(regexp_replace(regexp_replace(s_name, '^nd\\b', ''), '^\\s*ISSN', '')) AS journal,
  'https://doi.org/10.1/' || s_suppkey AS url, replace(replace(replace(s_name || ' (x).pdf', ' ', '%20'), '(', '%28'), ')', '%29') AS file
FROM supplier WHERE regexp_matches(s_name, '[a-zA-Z]')""".replace("\\\\", "\\"))
def journals_and_urls(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").filter(F.col("s_name").rlike("[a-zA-Z]"))
    return s.select("s_suppkey", A.journal_name("s_name").alias("journal"), A.reference_url(F.lit("egu"), F.concat(F.lit("10.1/"), F.col("s_suppkey").cast("string")), "s_name", "").alias("url"), A.escaped(F.concat("s_name", F.lit(" (x).pdf"))).alias("file"))


@query(f"WITH {PAPERS} SELECT doc_id, authors || ', ' || year || ', ' || title || ', ' || journal || '.' AS reference FROM papers")
def reference_strings(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", A.reference("Authors", "year", "Title", "Journal").alias("reference"))


@query(f"{BASE} SELECT fname, regexp_replace(fname, '_(methods|results)$', '_objectives') AS root, regexp_replace(fname, '_(objectives|methods|results)$', '') AS paper FROM sections")
def section_names(spark, sf_dir):
    return sections(spark, sf_dir).select("fname", A.root_name("fname").alias("root"), A.paper_name("fname").alias("paper"))


@query(r"""SELECT conv_id, turn, regexp_extract(text, '(?i)(10\.[0-9]{3,7}(\.\w+)*(/|%2f)[\w\-:;()/.<>]*[\w\-:;()/<>])', 1) AS doi, trim(regexp_extract(text, '(?i)key\s?words:(.*)', 1)) AS keywords,
  coalesce(try_cast(regexp_extract(text, '(19[0-9]{2}|20[01][0-9]|202[0-2])', 1) AS INTEGER), 0) AS year FROM conversations""")
def text_extractions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", X.doi_in("text").alias("doi"), X.keywords("text").alias("keywords"), F.coalesce(A.year_in("text"), F.lit(0)).alias("year"))


@query(f"WITH {PAPERS} SELECT doc_id, trim(lang || ', ' || source || '  ' || title) AS dispatch_text FROM papers")
def dispatch_texts(spark, sf_dir):
    p = papers(spark, sf_dir)
    return M.dispatch_text(p).select("doc_id", "dispatch_text")


@query(f"{BASE} SELECT fname, md5(CASE WHEN section = 'objectives' THEN title || ' ' || array_to_string(messages, ' ') ELSE array_to_string(messages, ' ') END) AS text_md5 FROM sections")
def texts_to_encode(spark, sf_dir):
    return M.text_to_encode(sections(spark, sf_dir)).select("fname", F.md5("text").alias("text_md5"))


@query("SELECT conv_id, CASE WHEN regexp_matches(text, ' AND |&|\\+') THEN 'and' WHEN regexp_matches(text, '\"[^\"]*\"') THEN 'match' ELSE 'single' END AS kind, count(*) AS n FROM conversations GROUP BY 1, 2".replace("\\\\", "\\"))
def query_types(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", R.query_kind_column("text").alias("kind")).groupBy("conv_id", "kind").agg(F.count("*").alias("n"))


# -- searches --------------------------------------------------------------------------------------------------------


@query(f"WITH {PAPERS} SELECT doc_id FROM papers WHERE contains(lower(title), 'thing') OR contains(lower(abstract), 'thing')")
def search_substring(spark, sf_dir):
    return papers(spark, sf_dir).filter(search.substring("Thing", "Title", "Abstract")).select("doc_id")


@query(f"WITH {PAPERS} SELECT doc_id FROM papers WHERE contains(lower(abstract), 'the') AND contains(substr(lower(abstract), instr(lower(abstract), 'the') + 3), 'thing')")
def search_and_ordered(spark, sf_dir):
    return papers(spark, sf_dir).filter(search.ordered(["the", "thing"], "Abstract")).select("doc_id")


@query(f"WITH {PAPERS} SELECT doc_id FROM papers WHERE contains(lower(abstract), 'thing') AND contains(lower(abstract), 'that')")
def search_and_unordered(spark, sf_dir):
    return papers(spark, sf_dir).filter(search.all_substrings(["thing", "that"], "Abstract")).select("doc_id")


@query(f"WITH {PAPERS} SELECT doc_id FROM papers WHERE contains(abstract, 'of the') OR contains(abstract, 'The and')")
def search_exact(spark, sf_dir):
    return papers(spark, sf_dir).filter(search.any_phrase(search.phrases_of('"of the" "The and"'), "Abstract")).select("doc_id")


@query(f"WITH {PAPERS} SELECT doc_id FROM papers WHERE contains(lower(abstract), 'loser') OR contains(lower(abstract), 'schaft')")
def search_or(spark, sf_dir):
    p, found = papers(spark, sf_dir), None
    for q in search.split_or("loser OR schaft"):
        part = p.filter(search.substring(q, "Abstract")).select("doc_id")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


@query(f"WITH {PAPERS} SELECT doc_id FROM papers WHERE regexp_matches(abstract, '(?i)[^a-zA-Z]ing')")
def search_word_start(spark, sf_dir):
    return papers(spark, sf_dir).filter(search.word_start("ing", "Abstract")).select("doc_id")


@query(f"WITH {PAPERS} SELECT doc_id, year FROM papers WHERE year > 2000 AND year < 2010")
def year_window(spark, sf_dir):
    return papers(spark, sf_dir).filter(search.years("year", 2000, 2010)).select("doc_id", "year")


@query(f"{BASE} SELECT fname, CAST(len(messages) AS BIGINT) AS n FROM sections WHERE fname = '10.0000/doc.5_objectives' AND year >= 1990 AND year <= 2020")
def point_lookup(spark, sf_dir):
    return search.by_name(sections(spark, sf_dir), "10.0000/doc.5_objectives", 1990, 2020).select("fname", F.size("messages").cast("long").alias("n"))


@query(f"{BASE} SELECT fname FROM sections WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND year > 1995 AND year < 2015")
def id_set_lookup(spark, sf_dir):
    return search.by_ids(sections(spark, sf_dir), table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", 1995, 2015).select("fname")


@query(f"{BASE} SELECT fname FROM sections WHERE paper_name IN (SELECT '10.0000/doc.' || doc_id FROM labels WHERE quality = 0)")
def section_siblings(spark, sf_dir):
    names = table(spark, sf_dir, "labels").filter("quality = 0").select(F.concat(F.lit("10.0000/doc."), F.col("doc_id").cast("string")).alias("paper_name"))
    return search.siblings(sections(spark, sf_dir), names).select("fname")


@query(f"WITH {PAPERS} SELECT doi, coalesce(cited, 0.5) AS cited FROM papers ORDER BY cited DESC, doi LIMIT 50")
def rank_citations(spark, sf_dir):
    """A top-k report."""
    return ranking.by_citations(papers(spark, sf_dir), 50, "doi").select("doi", X.citations("numCitedBy").alias("cited"))


@query(f"WITH {PAPERS} SELECT doi, year FROM papers ORDER BY year DESC, doi LIMIT 50")
def rank_dates(spark, sf_dir):
    """A top-k report."""
    return ranking.by_date(papers(spark, sf_dir), 50, "doi").select("doi", "year")


STOP = ", ".join(repr(w) for w in R.STOP_WORDS["en"])


def tfidf_sql(query_text: str, source: str, key: str, text: str, min_df: float, top: int | None) -> str:
    """The same scores in SQL; source is a table expression."""
    return rf"""tok AS (SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '{R.TERM}')) AS term FROM {source}),
tf AS (SELECT k, term, count(*) AS tf FROM tok WHERE term NOT IN ({STOP}) GROUP BY 1, 2),
q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest(regexp_extract_all(lower('{query_text}'), '{R.TERM}')) AS term) WHERE term NOT IN ({STOP}) GROUP BY 1),
n AS (SELECT count(*) + 1 AS n FROM {source}),
df AS (SELECT coalesce(a.term, q.term) AS term, coalesce(df, 0) + CASE WHEN q.term IS NULL THEN 0 ELSE 1 END AS df, qtf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1) a FULL JOIN q ON a.term = q.term),
w AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf, qtf FROM df, n WHERE df >= n * {min_df}),
s AS (SELECT k, sqrt(sum(tf * idf * tf * idf)) AS norm, sum(tf * idf * qtf * idf) AS dot FROM tf JOIN w USING (term) GROUP BY k),
scores AS (SELECT k, round(dot / (norm * (SELECT sqrt(sum(qtf * idf * qtf * idf)) FROM w WHERE qtf IS NOT NULL)), 6) AS score FROM s WHERE dot IS NOT NULL)
""" + ("" if top is None else f"SELECT k AS {key}, score FROM scores ORDER BY score DESC, k LIMIT {top}")


@query(f"WITH {PAPERS}, {tfidf_sql('thing ordered heonand schaft nation', 'papers', 'doc_id', 'abstract', 0, 5)}")
def tfidf_top(spark, sf_dir):
    """A top-k report."""
    return ranking.top_tfidf(papers(spark, sf_dir), "thing ordered heonand schaft nation", "doc_id", "Abstract", 5)


@query(f"WITH {PAPERS}, {tfidf_sql('thing onre hation that ander heit les', 'papers', 'doc_id', 'abstract', 0.05, 5)}")
def tfidf_min_df(spark, sf_dir):
    """A top-k report."""
    return ranking.top_tfidf(papers(spark, sf_dir), "thing onre hation that ander heit les", "doc_id", "Abstract", 5, min_df=0.05)


@query(rf"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{R.TERM}')) AS term FROM documents) WHERE term NOT IN ({STOP}) GROUP BY 1")
def document_frequency(spark, sf_dir):
    return ranking.document_frequencies(table(spark, sf_dir, "documents"), "text")


@query(rf"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{R.TERM}'), lambda x: NOT list_contains([{STOP}], x)) AS t FROM documents),
g AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]), list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS phrase FROM t),
tf AS (SELECT doc_id, phrase, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT phrase, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT doc_id, phrase, round(tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1), 6) AS score FROM tf JOIN df USING (phrase))
SELECT doc_id, phrase, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS rank FROM s) WHERE rank <= 2""")
def generated_queries(spark, sf_dir):
    return ranking.best_terms(tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def _found(query_text: str, where: str, order: str, top: int, min_df: float = 0.05) -> str:
    """Search, tf-idf over the candidates, one section a paper, top rows."""
    return f"""{BASE}, t AS (SELECT *, CASE WHEN section = 'objectives' THEN concat_ws(' ', msg, title) ELSE msg END AS txt, array_to_string(messages, ' ') AS body FROM sections),
cand AS (SELECT * FROM t WHERE {where} ORDER BY coalesce(cited, 0.5) DESC, fname LIMIT 200), {tfidf_sql(query_text, "cand", "fname", "body", min_df, None)},
r AS (SELECT cand.*, round(coalesce(score, 0), 6) AS score, coalesce(cited, 0.5) AS c FROM cand LEFT JOIN scores ON fname = k)
SELECT fname, score, year, score >= 0.05 AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY paper_name ORDER BY {order}, fname) AS rn FROM r) WHERE rn = 1 ORDER BY {order}, fname LIMIT {top}"""


@query(_found("thing", r"(contains(lower(title), 'thing') OR contains(lower(txt), 'thing')) AND regexp_matches(txt, '(?i)[^a-zA-Z]thing') AND year > 1992 AND year < 2020", "score DESC", 20))
def find_papers_single(spark, sf_dir):
    """A top-k report."""
    return find.find_papers(sections(spark, sf_dir), "thing", 20, 1992, 2020).select("fname", "score", "year", "relevant")


@query(_found("the AND thing", "contains(lower(txt), 'the') AND contains(substr(lower(txt), instr(lower(txt), 'the') + 3), 'thing')", "c DESC", 20))
def find_papers_and(spark, sf_dir):
    """A top-k report."""
    return find.find_papers(sections(spark, sf_dir), "the AND thing", 20, sort_by="citations").select("fname", "score", "year", "relevant")


@query(_found(" of the ", "contains(txt, 'of the')", "year DESC", 20))
def find_papers_match(spark, sf_dir):
    """A top-k report."""
    return find.find_papers(sections(spark, sf_dir), '"of the"', 20, sort_by="date").select("fname", "score", "year", "relevant")


@query(f"""{BASE}, top AS (SELECT *, row_number() OVER (ORDER BY coalesce(cited, 0.5) DESC, fname) AS r FROM (SELECT * FROM sections WHERE section = 'objectives' ORDER BY coalesce(cited, 0.5) DESC, fname LIMIT 10))
SELECT string_agg('- ' || reported, chr(10) ORDER BY r) AS review, string_agg('- ' || authors || ', ' || year || ', ' || title || ', ' || journal || '.', chr(10) ORDER BY r) AS "references" FROM top""")
def review_text(spark, sf_dir):
    """A top-k report."""
    top = ranking.by_citations(sections(spark, sf_dir).filter("section = 'objectives'"), 10)
    return find.review(top, [F.coalesce("numCitedBy", F.lit(0.5)).desc(), "fname"])


# -- vectors ---------------------------------------------------------------------------------------------------------


@query("""SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 60""")
def knn_top60(spark, sf_dir):
    """A top-k report."""
    e = table(spark, sf_dir, "embeddings")
    return ranking.nearest(e, e.filter("vec_id = 0"), 60)


@query(f"""{BASE}, near AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 60)
SELECT fname, score, year FROM near JOIN sections ON doc_id = vec_id WHERE section = 'objectives' AND year > 1992 AND year < 2020 AND len(messages) > 0""")
def semantic_search(spark, sf_dir):
    """A top-k report."""
    e = table(spark, sf_dir, "embeddings")
    s = sections(spark, sf_dir).filter("section = 'objectives'").withColumnRenamed("doc_id", "vec_id")
    return find.semantic(e, e.filter("vec_id = 1"), s, year_from=1992, year_to=2020).select("fname", "score", "year")


@query("""WITH c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT vec_id, c.label, round(list_dot_product(embedding::DOUBLE[], v), 6) AS score FROM embeddings, c)
SELECT vec_id, label, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank FROM s) WHERE rank <= 3""")
def dispatch_top3(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return ranking.dispatch(e, ranking.centroids(e))


# -- sections --------------------------------------------------------------------------------------------------------


def _cues(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


#: Labels by rule, as the production plan gives them.
LABELLED = rf"""labelled AS (
  SELECT doc_id, i, n, s, o, CASE WHEN greatest(o, m, r, b) = 0 THEN (CASE WHEN i * 3 < n THEN 'objectives' WHEN i * 3 < 2 * n THEN 'methods' ELSE 'results' END) WHEN o = greatest(o, m, r, b) THEN 'objectives' WHEN m = greatest(o, m, r, b) THEN 'methods' WHEN r = greatest(o, m, r, b) THEN 'results' ELSE 'background' END AS label
  FROM (SELECT *, CASE WHEN regexp_matches(s, '{R.OBJECTIVE_CUES}') THEN 2 ELSE 0 END AS o, {_cues("s", R.METHOD_CUES)} AS m, {_cues("s", R.RESULT_CUES)} AS r, {_cues("s", R.BACKGROUND_CUES)} AS b
    FROM (SELECT doc_id, unnest(good) AS s, unnest(range(0, len(good))) AS i, len(good) AS n FROM full_sents)))"""


@query(f"WITH {PAPERS}, {SENTENCES} SELECT doc_id, i::INTEGER AS i, s FROM (SELECT doc_id, unnest(good) AS s, unnest(range(0, len(good))) AS i FROM full_sents) WHERE regexp_matches(s, '{R.OBJECTIVE_CUES}')")
def sentence_objectives(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", F.posexplode(X.full_sentences("Abstract")).alias("i", "s")).filter(R.is_objective("s"))


@query(f"WITH {PAPERS}, {SENTENCES}, {LABELLED} SELECT label, count(*) AS n, count(DISTINCT doc_id) AS docs FROM labelled WHERE label <> 'background' OR o > 0 GROUP BY 1")
def segment_labels(spark, sf_dir):
    p = papers(spark, sf_dir).withColumn("good", X.full_sentences("Abstract")).select("doc_id", F.explode(R.segmented("good")).alias("x"))
    return p.groupBy(F.col("x.label").alias("label")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(f"""WITH {PAPERS}, {SENTENCES}, {LABELLED}, kept AS (SELECT doc_id, label, s, i FROM labelled WHERE label <> 'background'), names AS (SELECT DISTINCT doc_id, unnest(['objectives', 'methods', 'results']) AS section FROM kept)
SELECT '10.0000/doc.' || n.doc_id || '_' || section AS fname, section, count(s) AS n, md5(coalesce(string_agg(s, '|' ORDER BY i), '')) AS messages_md5, any_value(year) AS year
FROM names n JOIN papers p ON p.doc_id = n.doc_id LEFT JOIN kept k ON k.doc_id = n.doc_id AND k.label = section GROUP BY n.doc_id, section""")
def produce_sections(spark, sf_dir):
    """The production plan: papers to labelled section rows."""
    s = M.produce(papers(spark, sf_dir), summarise=False)
    return s.select("fname", "section", F.size("messages").cast("long").alias("n"), F.md5(F.array_join("messages", "|")).alias("messages_md5"), "year")


@query()
def reported_sentences(spark, sf_dir):
    """Reported speech of each paper's chosen sentence; checked by tests, as its rules chain dozens of replacements."""
    return M.produce(papers(spark, sf_dir)).filter("section = 'objectives'").select("paper_name", "reported", "authors", "website")


@query(f"""{BASE}, m AS (SELECT doc_id, unnest(good) AS s, unnest(range(0, len(good))) AS i FROM full_sents), c AS (SELECT doc_id, i, s, {_n_words("s")} AS n FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN n BETWEEN 20 AND 25 THEN 0 ELSE 1 END, CASE WHEN n BETWEEN 20 AND 25 THEN abs(n - 22) ELSE abs(n - 20) END, i) AS k FROM c)
SELECT doc_id, s AS chosen FROM r WHERE k = 1""")
def choose_reported(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", R.chosen(X.full_sentences("Abstract")).alias("chosen")).filter("chosen is not null")


@query(f"{BASE} SELECT fname, section, CAST(len(messages) AS BIGINT) AS n, md5(array_to_string(messages, ' ')) AS messages_md5, year FROM sections")
def sections_rows(spark, sf_dir):
    return sections(spark, sf_dir).select("fname", "section", F.size("messages").cast("long").alias("n"), F.md5(F.array_join("messages", " ")).alias("messages_md5"), "year")


@query(f"{BASE} SELECT paper_name, sum(len(messages)) FILTER (WHERE section = 'objectives')::BIGINT AS objectives, sum(len(messages)) FILTER (WHERE section = 'methods')::BIGINT AS methods, sum(len(messages)) FILTER (WHERE section = 'results')::BIGINT AS results FROM sections GROUP BY 1")
def section_pivot(spark, sf_dir):
    return zones.pivoted(sections(spark, sf_dir))


@query(f"{BASE} SELECT fname FROM sections s WHERE len(messages) > 0 OR (section = 'objectives' AND EXISTS (SELECT 1 FROM sections t WHERE t.paper_name = s.paper_name AND len(t.messages) > 0))")
def clean_empty_sections(spark, sf_dir):
    return zones.drop_empty_sections(sections(spark, sf_dir)).select("fname")


@query(f"{BASE} SELECT fname, coalesce(CASE WHEN s.doc_id % 4 = 0 THEN authors END, l.a) AS allauthors FROM sections s LEFT JOIN (SELECT doc_id, 'Q' || quality AS a FROM labels) l ON s.doc_id = l.doc_id")
def fill_authors(spark, sf_dir):
    s = sections(spark, sf_dir).withColumn("allauthors", F.when(F.col("doc_id") % 4 == 0, F.col("allauthors")))
    other = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("Q"), F.col("quality").cast("string")).alias("allauthors"))
    return tables.fill(s, other, "doc_id", "allauthors").select("fname", "allauthors")


@query(f"{BASE} SELECT fname, coalesce(cited, CAST(l.c AS DOUBLE)) AS cited FROM sections s LEFT JOIN (SELECT doc_id, quality + toxic AS c FROM labels) l ON s.doc_id = l.doc_id")
def fill_citations(spark, sf_dir):
    other = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).cast("double").alias("numCitedBy"))
    return tables.fill(sections(spark, sf_dir), other, "doc_id", "numCitedBy").select("fname", F.col("numCitedBy").alias("cited"))


@query(f"{BASE} SELECT fname, CASE WHEN section = 'objectives' OR doc_id % 2 = 0 THEN year ELSE max(CASE WHEN section = 'objectives' THEN year END) OVER (PARTITION BY paper_name) END AS year FROM sections")
def fill_years(spark, sf_dir):
    s = sections(spark, sf_dir).withColumn("year", F.when((F.col("section") == "objectives") | (F.col("doc_id") % 2 == 0), F.col("year")))
    return tables.fill_within(s, "paper_name", "year", F.col("section") == "objectives").select("fname", "year")


@query(f"{BASE} SELECT fname, CASE WHEN section = 'objectives' THEN regexp_replace(replace(formula, ')', '.0)'), '([0-9])\\.[0-9]', '\\1', 'g') ELSE replace(formula, ')', '.0)') END AS authors FROM sections".replace("\\\\", "\\"))
def correct_years(spark, sf_dir):
    s = sections(spark, sf_dir).withColumn("authors", F.replace("authors", F.lit(")"), F.lit(".0)")))
    return zones.correct_years(s).select("fname", "authors")


@query(f"""WITH {PAPERS}, {SENTENCES}, {LABELLED} SELECT doi AS paper_name FROM papers WHERE doc_id % 3 = 0 OR doc_id IN (SELECT doc_id FROM labelled WHERE label <> 'background' OR o > 0)""")
def reuse_produced(spark, sf_dir):
    """Papers that were produced before are taken over, the others produced."""
    old = sections(spark, sf_dir).filter("doc_id % 3 = 0").select("fname", "paper_name", "section", F.lit(None).cast("string").alias("website"), "year", F.lit(None).cast("string").alias("database"), "messages", "reported", "title", "journal", "authors", "numCitedBy", "allauthors")
    return M.produce_new(papers(spark, sf_dir), old).select("paper_name").distinct()


# -- spans, ranges, evaluation ---------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), r AS (SELECT l_orderkey, l_suppkey, l_suppkey - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS g FROM d)
SELECT l_orderkey, min(l_suppkey) AS start, max(l_suppkey) AS "end", count(*) AS n FROM r GROUP BY l_orderkey, g""")
def islands(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return intervals.islands(li, "l_orderkey", "l_suppkey")


SPAN_SENTS = f"""BASE, pos AS (SELECT doc_id, i - 1 AS sent, CAST(coalesce(list_sum(list_transform(good[:i - 1], lambda s: {_n_words("s")})), 0) AS INTEGER) AS start, {_n_words("good[i]")} AS n FROM (SELECT doc_id, good, unnest(range(1, len(good) + 1)) AS i FROM full_sents))""".replace("BASE", f"WITH {PAPERS}, {SENTENCES}")


def _positions(spark, sf_dir) -> DataFrame:
    p = papers(spark, sf_dir).withColumn("good", X.full_sentences("Abstract"))
    s = p.select("doc_id", F.posexplode("good").alias("sent", "s")).withColumn("n", X.word_count("s"))
    before = F.sum("n").over(W.partitionBy("doc_id").orderBy("sent").rowsBetween(W.unboundedPreceding, -1))
    return s.select("doc_id", "sent", F.coalesce(before, F.lit(0)).cast("int").alias("start"), "n").withColumn("end", (F.col("start") + F.col("n")).cast("int"))


def _spans(spark, sf_dir) -> DataFrame:
    total = _positions(spark, sf_dir).groupBy("doc_id").agg(F.max("end").alias("t"))
    third = F.floor(F.col("t") / 3).cast("int")
    ends = (("objectives", F.lit(0), third), ("methods", third, third * 2), ("results", third * 2, F.col("t")))
    return total.select("doc_id", F.inline(F.array(*(F.struct(F.lit(n).alias("label"), a.cast("int").alias("start"), b.cast("int").alias("end")) for n, a, b in ends))))


@query(f"""{SPAN_SENTS}, t AS (SELECT doc_id, max(start + n) AS t FROM pos GROUP BY 1), sp AS (SELECT doc_id, unnest(['objectives', 'methods', 'results']) AS label, unnest([0, t // 3, 2 * (t // 3)]) AS s, unnest([t // 3, 2 * (t // 3), t]) AS e FROM t),
o AS (SELECT doc_id, sent, label, s, greatest(0, least(start + n, e) - greatest(start, s)) AS n FROM pos JOIN sp USING (doc_id))
SELECT doc_id, CAST(sent AS INTEGER) AS sent, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent ORDER BY n DESC, s) AS k FROM o WHERE n > 0) WHERE k = 1""")
def segment_overlap_label(spark, sf_dir):
    return intervals.label_by_overlap(_positions(spark, sf_dir), _spans(spark, sf_dir), "doc_id").filter("label is not null")


@query("""WITH g AS (SELECT l.doc_id AS doc, c.class, c.k AS id, list_transform(range(0, 10 + l.doc_id % 5), lambda i: c.k * 20 + i) AS words FROM labels l, (VALUES ('background', 0), ('objectives', 1), ('methods', 2), ('results', 3), ('other', 4)) c(class, k)),
p AS (SELECT doc, class, id, list_transform(words, lambda w: w + doc % 11) AS words FROM g WHERE (doc + id) % 7 <> 0),
m AS (SELECT coalesce(p.doc, g.doc) AS doc, coalesce(p.class, g.class) AS class, p.id AS pred_id, g.id AS gold_id, CASE WHEN p.id IS NOT NULL AND g.id IS NOT NULL THEN least(len(list_intersect(p.words, g.words)) / len(p.words), len(list_intersect(p.words, g.words)) / len(g.words)) END AS overlap FROM p FULL JOIN g ON p.doc = g.doc AND p.class = g.class),
s AS (SELECT class, count(*) FILTER (WHERE overlap >= 0.5) AS tp, count(pred_id) AS np, count(gold_id) AS ng FROM m GROUP BY 1)
SELECT class, tp, np - tp AS fp, ng - tp AS fn, round(tp / (tp + (np - tp + ng - tp) / 2), 6) AS f1 FROM s""")
def span_f1(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    classes = F.array(*(F.struct(F.lit(c).alias("class"), F.lit(k).alias("id")) for k, c in enumerate(("background", "objectives", "methods", "results", "other"))))
    gold = labels.select(F.col("doc_id").alias("doc"), F.inline(classes)).withColumn("words", F.transform(F.sequence(F.lit(0), (F.lit(9) + F.col("doc") % 5).cast("int")), lambda i: F.col("id") * 20 + i))
    pred = gold.filter((F.col("doc") + F.col("id")) % 7 != 0).withColumn("words", F.transform("words", lambda w: (w + F.col("doc") % 11).cast("int")))
    return evaluation.span_scores(evaluation.matched_spans(pred, gold))


@query("SELECT count(*) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels WHERE quality <> -100")
def token_accuracy(spark, sf_dir):
    return evaluation.token_accuracy(table(spark, sf_dir, "labels"), "toxic", "quality")


@query("""WITH g AS (SELECT quality AS label, count(*) AS support, sum(CASE WHEN quality = toxic THEN 1 ELSE 0 END) AS tp FROM labels GROUP BY 1), p AS (SELECT toxic AS label, count(*) AS predicted FROM labels GROUP BY 1)
SELECT coalesce(g.label, p.label) AS label, round(CASE WHEN coalesce(predicted, 0) > 0 THEN tp / predicted ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall, round(2 * tp / (coalesce(predicted, 0) + support), 6) AS f1, support FROM g FULL JOIN p ON g.label = p.label""")
def classification_report(spark, sf_dir):
    return evaluation.classification_report(table(spark, sf_dir, "labels"), "toxic", "quality")


@query(rf"""SELECT doc_id, md5(array_to_string(list_concat(list_transform(range(0, {_n_words("a")}), lambda i: CASE WHEN i = 0 THEN 'B-objectives' ELSE 'I-objectives' END), list_transform(range(0, {_n_words("b")}), lambda i: 'O')), ' ')) AS tags_md5,
  CAST({_n_words("a")} + {_n_words("b")} AS BIGINT) AS n FROM (SELECT doc_id, coalesce(text, '') AS a, lang || ' ' || source AS b FROM documents)""")
def bio_tags(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    parts = F.array(F.struct(F.lit("objectives").alias("label"), F.coalesce("text", F.lit("")).alias("text")), F.struct(F.lit("other").alias("label"), F.concat_ws(" ", "lang", "source").alias("text")))
    tags = S.section_tags(parts)
    return d.select("doc_id", F.md5(F.array_join(tags, " ")).alias("tags_md5"), F.size(tags).cast("long").alias("n"))


@query(rf"""SELECT doc_id, x.label, x.start, x."end", x.first, x.last FROM (SELECT doc_id, unnest([{{'label': 'objectives', 'start': 0, 'end': CAST(length(a) AS INTEGER), 'first': 1, 'last': CAST({_n_words("a")} AS INTEGER)}},
  {{'label': 'other', 'start': CAST(length(a) + 1 AS INTEGER), 'end': CAST(length(a) + 1 + length(b) AS INTEGER), 'first': CAST({_n_words("a")} + 1 AS INTEGER), 'last': CAST({_n_words("a")} + {_n_words("b")} AS INTEGER)}}]) AS x FROM (SELECT doc_id, coalesce(text, '') AS a, lang || ' ' || source AS b FROM documents))""")
def text_spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    parts = F.array(F.struct(F.lit("objectives").alias("label"), F.coalesce("text", F.lit("")).alias("text")), F.struct(F.lit("other").alias("label"), F.concat_ws(" ", "lang", "source").alias("text")))
    return d.select("doc_id", F.inline(S.section_spans(parts)))


_RANGES = intervals.ranges_of(D.FIELD_CODES)


@query("WITH r(label, lo, hi) AS (VALUES " + ", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in _RANGES) + ") SELECT DISTINCT p_partkey, label FROM (SELECT p_partkey, 1000 + p_partkey % 2700 AS code FROM part) JOIN r ON code BETWEEN lo AND hi")
def code_range_join(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 2700 + 1000).cast("int").alias("code"))
    return intervals.range_labels(parts, "code", spark.createDataFrame(_RANGES, "label string, lo int, hi int")).select("p_partkey", "label").distinct()


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dimension_join(spark, sf_dir):
    """Codes to names, as category tables are joined."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("""WITH m AS (SELECT o_custkey % 50 AS g, (o_orderkey // 1000) * 1000 AS first FROM orders GROUP BY 1, 2)
SELECT o_orderkey, m.first AS first FROM orders JOIN m ON o_custkey % 50 = m.g AND o_orderkey >= m.first AND o_orderkey < m.first + 1000""")
def manifest_range_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("g"))
    m = o.select("g", (F.floor(F.col("o_orderkey") / 1000) * 1000).alias("first")).distinct().withColumn("last", F.col("first") + 1000)
    return intervals.first_range(o, "g", "o_orderkey", m).select("o_orderkey", "first")


@query("SELECT o_orderkey, CASE WHEN regexp_matches(lower(h), 'introduction|background') THEN 'background' WHEN regexp_matches(lower(h), 'purpose|aim|objective') THEN 'objectives' WHEN regexp_matches(lower(h), 'method|materials|approach') THEN 'methods' WHEN regexp_matches(lower(h), 'result|finding|conclusion') THEN 'results' ELSE 'other' END AS class FROM (SELECT o_orderkey, (['Introduction', 'Aims', 'Materials', 'Main Findings', 'Funding', 'Approach', 'Purpose'])[o_orderkey % 7 + 1] AS h FROM orders)")
def header_classes(spark, sf_dir):
    names = F.array(*map(F.lit, ("Introduction", "Aims", "Materials", "Main Findings", "Funding", "Approach", "Purpose")))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.header_class(F.get(names, (F.col("o_orderkey") % 7).cast("int"))).alias("class"))


@query("""SELECT p_partkey, 'X' || s.k AS short, 'Xa' || (p_partkey % 97) || ' Yb' || p_partkey || ' Zc' AS long FROM part, (VALUES ('YZ'), ('Z')) s(k) WHERE s.k = 'YZ'
UNION ALL SELECT p_partkey, 'Qv' AS short, 'Quiet ventures' AS long FROM part WHERE p_partkey % 2 = 0""")
def abbreviation_pairs(spark, sf_dir):
    """Abbreviations that texts define: one a text, for every second text another, and brackets that define nothing."""
    n = F.col("p_partkey")
    text = F.concat(F.lit("We use Xa"), (n % 97).cast("string"), F.lit(" Yb"), n.cast("string"), F.lit(" Zc (XYZ) here (and here), (2).\n"), F.when(n % 2 == 0, "All Quiet ventures (Qv; so) end.").otherwise("All Quiet ventures (Qv; end."))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(abbreviation_map(text)).alias("short", "long"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, trim(regexp_extract(html, '<title(?:\s[^>]*)?>([^<]*)', 1)) AS title, regexp_extract(html, '<html[^>]*\slang="([^"]*)"', 1) AS lang,
  trim(regexp_extract(html, '<h1(?:\s[^>]*)?>([^<]*)', 1)) AS heading, CAST(len(regexp_extract_all(html, '<p[\s>]')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS BIGINT) AS links FROM pages""")
def html_pages_parse(spark, sf_dir):
    return P.page_fields(table(spark, sf_dir, "pages"))


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript, count(*) AS turns FROM conversations GROUP BY 1""")
def ordered_text_aggregation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("transcript"), F.count("*").alias("turns"))
