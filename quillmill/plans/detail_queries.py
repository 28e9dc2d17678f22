"""Registered queries over details of names, headings, lemmas, summaries and reported sections, from the texts of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import authors as A
from ..functions import clauses as C
from ..functions import rules as R
from ..functions import text as X
from ..operators.tables import pinned, spread
from . import produce as M
from .queries import FORMULA, LABELLED, PAPERS, SENTENCES, SQL, _n_words, papers, query, table

_NAMES = r"""names AS (SELECT c_custkey, substr(c_name, 1, CAST(c_custkey % 12 AS INTEGER)) || chr(10) || c_mktsegment || '.x & ' || c_nationkey AS raw FROM customer),
clean AS (SELECT *, trim(regexp_replace(regexp_replace(replace(replace(replace(raw, chr(10), '; '), '&', ','), '.', '. '), '[^a-zA-Z+.,\-;]', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM names),
parts AS (SELECT *, list_filter(string_split_regex(trim(c), '\s+'), lambda w: w <> '') AS w FROM clean)"""
_CAPITALS = "array_to_string(list_transform(string_split(lower(trim({x})), ' '), lambda p: upper(left(p, 1)) || substr(p, 2)), ' ')"


@query(f"WITH {_NAMES} SELECT c_custkey, c AS clean, len(w) > 1 AND length(w[1]) > 1 AND length(w[2]) > 1 AS plausible FROM parts")
def author_clean_up(spark, sf_dir):
    """Names with line breaks, signs and digits, cleaned, and whether they can be an author's."""
    raw = F.concat(F.substring("c_name", F.lit(1), (F.col("c_custkey") % 12).cast("int")), F.lit("\n"), "c_mktsegment", F.lit(".x & "), F.col("c_nationkey").cast("string"))
    c = table(spark, sf_dir, "customer").select("c_custkey", A.clean_author(raw).alias("clean"))
    return c.select("c_custkey", "clean", F.coalesce(A.plausible_author("clean"), F.lit(False)).alias("plausible"))


@query(f"""WITH o AS (SELECT c_nationkey AS k, list(c_mktsegment ORDER BY c_custkey) AS a FROM customer GROUP BY 1), x AS (SELECT k, unnest(a) AS v, generate_subscripts(a, 1) AS i FROM o),
y AS (SELECT k, {_CAPITALS.format(x="CASE WHEN i % 2 = 0 THEN v ELSE ' ' || lower(v) END")} AS v, i FROM x), z AS (SELECT k, v, min(i) AS i FROM y GROUP BY 1, 2) SELECT k, string_agg(v, ',' ORDER BY i) AS names FROM z GROUP BY 1""")
def distinct_names(spark, sf_dir):
    """Names of each nation, each once whatever its case, in order."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment"))), lambda x: x["c_mktsegment"]).alias("a"))
    mixed = F.transform("a", lambda v, i: F.when(i % 2 == 1, v).otherwise(F.concat(F.lit(" "), F.lower(v))))
    return c.select("k", F.array_join(A.distinct_authors(mixed), ",").alias("names"))


@query(r"""SELECT doc_id, md5(coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda s: len(list_filter(regexp_extract_all(s, '[a-zA-Z]+'), lambda w: length(w) > 2)) > 0), '|'), '')) AS lines_md5 FROM documents""")
def long_word_lines(spark, sf_dir):
    """Lines in which some word is longer than two letters."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.md5(F.coalesce(F.array_join(X.long_word_items(F.split("text", "\n")), "|"), F.lit(""))).alias("lines_md5"))


@query(rf"""WITH {PAPERS}, w AS (SELECT doc_id, list_filter(string_split_regex(trim(lower(coalesce(title, ''))), '\s+'), lambda x: x <> '' AND NOT list_contains([{", ".join(repr(x) for x in R.STOP_WORDS["en"])}], x)) AS w FROM papers)
SELECT doc_id, array_to_string(list_transform(w, lambda x: CASE WHEN length(x) > 5 AND ends_with(x, 'ies') THEN left(x, length(x) - 3) || 'y' WHEN length(x) > 6 AND ends_with(x, 'ing') THEN left(x, length(x) - 3)
  WHEN length(x) > 5 AND ends_with(x, 'ed') THEN left(x, length(x) - 2) WHEN length(x) > 3 AND ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN left(x, length(x) - 1) ELSE x END), ' ') AS lemmas FROM w""")
def title_lemmas(spark, sf_dir):
    """Titles as their lemmas, without stop words."""
    return papers(spark, sf_dir).select("doc_id", F.array_join(R.lemmas("Title"), " ").alias("lemmas"))


_CUED = "CASE (i - 1) % 3 WHEN 0 THEN 'In this study ' || s WHEN 1 THEN s ELSE 'We aim at this section ' || s END"


@query(f"""WITH {PAPERS}, {SENTENCES}, cued AS (SELECT doc_id, list_transform(good, lambda s, i: {_CUED}) AS a FROM full_sents),
summed AS (SELECT *, list_filter(a, lambda s: regexp_matches(s, '{R.OBJECTIVE_CUES}') AND NOT regexp_matches(s, '{R.BOILERPLATE}')) AS o FROM cued)
SELECT doc_id, CAST(len(CASE WHEN len(o) > 3 THEN o ELSE a END) AS INTEGER) AS n, md5(array_to_string(CASE WHEN len(o) > 3 THEN o ELSE a END, '|')) AS kept_md5 FROM summed""")
def objective_summaries(spark, sf_dir):
    """Objective sentences without boilerplate if there are more than three, else all."""
    p = pinned(papers(spark, sf_dir).select("doc_id", "Abstract"), good=X.full_sentences("Abstract"))
    cued = F.transform("good", lambda s, i: F.when(i % 3 == 0, F.concat(F.lit("In this study "), s)).when(i % 3 == 1, s).otherwise(F.concat(F.lit("We aim at this section "), s)))
    p = pinned(p, a=cued)
    return p.select("doc_id", R.objective_summary("a").alias("x")).select("doc_id", F.size("x").alias("n"), F.md5(F.array_join("x", "|")).alias("kept_md5"))


@query(f"""WITH {PAPERS}, {SENTENCES}, {LABELLED}, kept AS (SELECT doc_id, i, CASE WHEN label = 'background' THEN 'objectives' ELSE label END AS label, CASE WHEN label = 'background' THEN 0 ELSE 1 END AS o FROM labelled WHERE label <> 'background' OR o > 0)
SELECT doc_id, string_agg(label, ',' ORDER BY o, i) AS labels FROM kept GROUP BY 1""")
def segmented_papers(spark, sf_dir):
    """The labels of each paper's sentences in the order of its sections, as the segmenter gives them."""
    made = M.segment(papers(spark, sf_dir).select("doc_id", "Abstract"), summarise=False).filter(F.size("segments") > 0)
    return made.select("doc_id", F.array_join(F.transform("segments", lambda s: s["label"]), ",").alias("labels"))


_PICK = "coalesce(list_sort(list_transform(list_filter({a}, lambda x: x.n >= 20 AND x.n <= 25), lambda x: {{'d': abs(x.n - 22), 'i': x.i, 's': x.s}}))[1].s, list_sort(list_transform({a}, lambda x: {{'d': abs(x.n - 20), 'i': x.i, 's': x.s}}))[1].s)"


@query(rf"""WITH {PAPERS}, {SENTENCES}, {LABELLED}, k AS (SELECT doc_id, label, list({{'n': len(list_filter(string_split_regex(trim(s), '\s+'), lambda w: w <> '')), 'i': i, 's': s}} ORDER BY i) AS a FROM labelled WHERE label <> 'background' GROUP BY 1, 2),
c AS (SELECT doc_id, label, {_PICK.format(a="a")} AS s FROM k)
SELECT doc_id, coalesce(max(s) FILTER (WHERE label = 'objectives'), max(s) FILTER (WHERE label = 'methods'), max(s) FILTER (WHERE label = 'results')) AS s FROM c GROUP BY 1""")
def reported_sections(spark, sf_dir):
    """The sentence that is reported of each paper: of its objectives, else its methods, else its results."""
    made = M.segment(papers(spark, sf_dir).select("doc_id", "Abstract"), summarise=False).filter(F.size("segments") > 0)
    of = lambda name: F.transform(F.filter("segments", lambda s: s["label"] == name), lambda s: s["message"])
    made = pinned(made, **{c: of(c) for c in ("objectives", "methods", "results")})
    return made.select("doc_id", F.coalesce(*(R.chosen(c) for c in ("objectives", "methods", "results"))).alias("s"))


# -- clauses and reported speech -------------------------------------------------------------------------------------------

_FIRST = f"WITH {PAPERS}, {SENTENCES}, s AS (SELECT doc_id, good[1] AS s FROM full_sents WHERE len(good) > 0)"


def _first_sentences(spark, sf_dir):
    p = pinned(papers(spark, sf_dir).select("doc_id", "Abstract"), good=X.full_sentences("Abstract"))
    return p.filter(F.size("good") > 0).select("doc_id", F.col("good")[0].alias("s"))


@query(rf"""{_FIRST}, m AS (SELECT doc_id, list_prepend('', string_split(regexp_replace(s, '(?i)\s+({"|".join(C.SEPARATORS)})\s+|\s*(,)\s*', chr(1) || '\1\2' || chr(1), 'g'), chr(1))) AS p FROM s),
c AS (SELECT doc_id, list_filter(list_transform(range(0, len(p) // 2), lambda i: {{'a': p[2 * i + 1], 't': trim(p[2 * i + 2])}}), lambda x: x.t <> '' OR x.a = '') AS c FROM m)
SELECT doc_id, CAST(len(c) AS INTEGER) AS n, md5(array_to_string(list_transform(c, lambda x: x.a || ':' || x.t), '|')) AS clauses_md5 FROM c""")
def sentence_clauses(spark, sf_dir):
    """The clauses of each paper's first full sentence."""
    s = pinned(_first_sentences(spark, sf_dir), c=C.clauses("s"))
    return s.select("doc_id", F.size("c").alias("n"), F.md5(F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["separator"], x["text"])), "|")).alias("clauses_md5"))


@query(rf"""{_FIRST}, w AS (SELECT doc_id, string_split(regexp_replace(s, '[^\x00-\x7F]', 'x', 'g'), ' ') AS w FROM s), p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'The ' || w[1] || ' was measured by ' || array_to_string(w[2:4], ' ') || '.' WHEN 1 THEN w[1] || ' of ' || coalesce(w[2], '') || ' have been shown by ' || coalesce(w[3], '') ELSE array_to_string(w, ' ') END AS s FROM w),
x AS (SELECT doc_id, s, regexp_extract(s, '{C.PASSIVE}', 1) AS what, regexp_extract(s, '{C.PASSIVE}', 2) AS verb, regexp_extract(s, '{C.PASSIVE}', 3) AS who, regexp_extract(s, '{C.PASSIVE}', 4) AS stop FROM p)
SELECT doc_id, md5(CASE WHEN what <> '' THEN upper(who[1]) || substr(who, 2) || ' ' || verb || ' ' || lower(what[1]) || substr(what, 2) || stop ELSE s END) AS active_md5, what <> '' AS passive FROM x""")
def active_sentences(spark, sf_dir):
    """Passive sentences about the words of the papers, made active; a third of them stay as they are."""
    # Engines differ in the capitals of some letters, so only plain ones are kept here.
    w = pinned(_first_sentences(spark, sf_dir), w=F.split(F.regexp_replace("s", r"[^\x00-\x7F]", "x"), " "))
    at, n = (lambda k: F.coalesce(F.get("w", F.lit(k)), F.lit(""))), F.col("doc_id") % 3
    made = F.when(n == 0, F.concat(F.lit("The "), at(0), F.lit(" was measured by "), F.array_join(F.slice("w", 2, 3), " "), F.lit("."))).when(n == 1, F.concat(at(0), F.lit(" of "), at(1), F.lit(" have been shown by "), at(2))).otherwise(F.array_join("w", " "))
    p = pinned(w.select("doc_id", made.alias("_s")), s=F.col("_s"))
    return p.select("doc_id", F.md5(C.active("s")).alias("active_md5"), (F.regexp_extract("s", C.PASSIVE, 1) != "").alias("passive"))


def _corrected(x: str) -> str:
    for old, new in R.CORRECTIONS.items():
        x = f"replace({x}, '{old.replace(chr(39), chr(39) * 2)}', '{new.replace(chr(39), chr(39) * 2)}')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _simplified(x: str) -> str:
    x = rf"regexp_replace({x}, '(?i)^(however|therefore|moreover|furthermore|here|hence|thus|to this end),?\s+', '')"
    x = rf"regexp_replace({x}, '(?i)\bas well as\b|\balong with\b', 'and', 'g')"
    for _ in range(6):  # what follows a clause is part of the match here, so neighbours need another pass
        x = rf"regexp_replace({x}, ',\s*(?:which|through)\b[^,.]*([,.])', '\1', 'g')"
    return rf"trim(regexp_replace({x}, '\s*\((i|ii|iii|iv|[0-9])\)', '', 'g'))"


_PAST = f"CASE {' '.join(f'''WHEN verb = '{k}' THEN '{v}' ''' for k, v in R.IRREGULAR.items())} WHEN ends_with(verb, 'e') THEN verb || 'd' WHEN regexp_matches(verb, '[^aeiou]y$') THEN regexp_replace(verb, 'y$', '') || 'ied' ELSE verb || 'ed' END"


@query(f"""{_FIRST}, f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'We propose ' || s WHEN 1 THEN 'However, this study aims to show ' || s WHEN 2 THEN 'In this paper, we study ' || s || ', which is so, as well as (i) more.' ELSE s END AS s, 'A' || doc_id || ' (2020)' AS who FROM s),
m AS (SELECT doc_id, who, {_simplified("s")} AS s FROM f), v AS (SELECT *, lower(regexp_extract(s, '{R.REPORT}', 1)) AS verb, regexp_extract(s, '{R.REPORT}', 2) AS rest FROM m)
SELECT doc_id, {_corrected(f"CASE WHEN verb <> '' THEN who || ' ' || {_PAST} || ' ' || rest ELSE who || ': ' || s END")} AS reported FROM v""")
def reported_speech(spark, sf_dir):
    """Statements made of the papers' sentences, as reported speech: fillers and clauses dropped, verbs in the past, corrected."""
    s, n = F.col("s"), F.col("doc_id") % 4
    made = F.when(n == 0, F.concat(F.lit("We propose "), s)).when(n == 1, F.concat(F.lit("However, this study aims to show "), s)).when(n == 2, F.concat(F.lit("In this paper, we study "), s, F.lit(", which is so, as well as (i) more."))).otherwise(s)
    p = pinned(_first_sentences(spark, sf_dir).select("doc_id", made.alias("_s")), s=F.col("_s"))
    return p.select("doc_id", R.reported("s", F.concat(F.lit("A"), F.col("doc_id").cast("string"), F.lit(" (2020)"))).alias("reported"))


#: reported_sentences, registered with the production plan: summary, labels, choice and reported speech of every paper.
SQL["reported_sentences"] = rf"""WITH {PAPERS}, {SENTENCES}, kept_sents AS (SELECT * REPLACE (CASE WHEN len(o) > 3 THEN o ELSE good END AS good) FROM (SELECT *, list_filter(good, lambda s: regexp_matches(s, '{R.OBJECTIVE_CUES}') AND NOT regexp_matches(s, '{R.BOILERPLATE}')) AS o FROM full_sents)),
{LABELLED.replace("FROM full_sents", "FROM kept_sents")},
r AS (SELECT doc_id, s, CASE WHEN label = 'background' THEN 'objectives' ELSE label END AS label, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN label = 'background' THEN 0 ELSE 1 END, i) AS i FROM labelled WHERE label <> 'background' OR o > 0),
k AS (SELECT doc_id, label, list({{'n': {_n_words("s")}, 'i': i, 's': s}} ORDER BY i) AS a FROM r GROUP BY 1, 2), c AS (SELECT doc_id, label, {_PICK.format(a="a")} AS s FROM k),
b AS (SELECT doc_id, coalesce(max(s) FILTER (WHERE label = 'objectives'), max(s) FILTER (WHERE label = 'methods'), max(s) FILTER (WHERE label = 'results')) AS s FROM c GROUP BY 1),
m AS (SELECT doc_id, doi, {FORMULA} AS who, {_simplified("b.s")} AS s FROM b JOIN papers USING (doc_id)), v AS (SELECT *, lower(regexp_extract(s, '{R.REPORT}', 1)) AS verb, regexp_extract(s, '{R.REPORT}', 2) AS rest FROM m)
SELECT doi AS paper_name, {_corrected(f"CASE WHEN verb <> '' THEN who || ' ' || {_PAST} || ' ' || rest ELSE who || ': ' || s END")} AS reported, who AS authors, '{A.DOI_URL}' || doi AS website FROM v"""
