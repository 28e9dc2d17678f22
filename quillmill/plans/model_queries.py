"""Registered queries over what is learned or indexed: vector index, tagger, encoder, languages, sentence ends, titles.

What training gives can't be said in SQL where it is a model's weights; such queries return figures that a test of the model can
be judged by, on rows held out, and SQL gives what they have to be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registry
from ..functions import rules as R
from ..functions import text as X
from ..operators import encoder, languages, sentence_ends, tagger, text_index, titles, training, vector_index
from ..operators.tables import pinned, spread
from ..shared import settle, shared_dir
from .produce import training_pairs
from .queries import BASE, PAPERS, SENTENCES, SQL, _n_words, papers, query, sections, table

# -- vector index ------------------------------------------------------------------------------------------------------


def _index(spark, e: DataFrame) -> vector_index.VectorIndex:
    """An index whose vectors were written in three parts."""
    n = e.count()
    index = vector_index.VectorIndex(spark, shared_dir(spark)).fit(e, max(1, min(vector_index.MOST_CELLS, round(n**0.5))))
    for k in range(3):
        index.append(e.filter(F.col("vec_id") % 3 == k))
    return index


def _asked(e: DataFrame) -> DataFrame:
    return e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


_EXACT = """SELECT query_id, key, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS key, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= {k}"""


@query(_EXACT.format(k=10))
def vector_index_search(spark, sf_dir):
    """All cells of a stored index, scored exactly: the ten nearest rows of each query."""
    e = table(spark, sf_dir, "embeddings")
    index = _index(spark, e)
    return index.search(_asked(e), 10, probes=vector_index.MOST_CELLS, exact=True)


@query("SELECT count(*) AS n_queries, 60 AS k, true AS recall_of_95, true AS reads_less_than_all FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark, sf_dir):
    """The sixty nearest rows by as many cells as other queries have shown to be enough, against the exact answer."""
    e = table(spark, sf_dir, "embeddings")
    index, asked = _index(spark, e), _asked(e)
    others = e.filter("vec_id % 100 <> 0 and vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    probes = index.probes_for(others, 60, 0.97)
    exact = index.search(asked, 60, probes=vector_index.MOST_CELLS, exact=True)
    got = vector_index.recall(index.search(asked, 60, probes=probes), exact)
    share = index.read_share(asked, probes)
    figures = got.agg(F.count("*").alias("n_queries"), (F.sum("n_found") / F.sum("n_exact") >= 0.95).alias("recall_of_95"))
    return figures.select("n_queries", F.lit(60).alias("k"), "recall_of_95", F.lit(share < 1).alias("reads_less_than_all"))


# -- tagger ------------------------------------------------------------------------------------------------------------


def abstracts(spark, sf_dir) -> DataFrame:
    """Structured abstracts: the quarters of a paper's sentences, for papers of four or more."""
    p = pinned(papers(spark, sf_dir).select("doi", "Abstract"), good=X.full_sentences("Abstract")).filter(F.size("good") >= 4)
    quarter = lambda k: F.filter("good", lambda _, i: F.floor(i * 4 / F.size("good")) == k)
    heads = ("Background", "Objectives", "Methods", "Results")
    return p.select("doi", F.array(*(F.struct(F.lit(h).alias("header"), quarter(k).alias("paragraphs")) for k, h in enumerate(heads))).alias("parts"), F.array().cast("array<string>").alias("others"))


def by_rules(rows: DataFrame) -> DataFrame:
    """rows (text) with ruled: the class of each word, by the cue words of its sentence."""
    out = pinned(rows, s=X.sentences("text"))
    out = pinned(out, scored=F.transform("s", lambda x, i: R.scores(x, i, F.size("s"))))
    each = F.transform("scored", lambda r: F.array_repeat(R.section_label(r), X.word_count(r["s"])))
    return out.withColumn("ruled", F.flatten(each)).drop("s", "scored")


@query(f"WITH {PAPERS}, {SENTENCES} SELECT count(*) AS n_papers, true AS all_measured, true AS better_than_rules, true AS better_than_chance FROM full_sents WHERE len(good) >= 4")
def tagger_accuracy(spark, sf_dir):
    """A tagger trained on four fifths of the papers, against the cue words, on the words of the others (classes alone)."""
    made = abstracts(spark, sf_dir)
    rows = settle(training.tag_rows(training.structured_only(made)))
    model, found = tagger.train(rows, rounds=4)
    _, held = training.split(rows, "doi")
    from ..functions.models import tagger as slot

    tagged = by_rules(held).withColumn("tagged", slot("bomr", lambda: model)("text"))
    same = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x))
    of = lambda c: F.transform(c, lambda t: F.when(t == "O", "other").otherwise(F.substring(t, 3, 20)))
    n = tagged.agg(F.sum(F.size("entities")).alias("words"), F.sum(same(of("entities"), of("tagged"))).alias("ours"), F.sum(same(of("entities"), F.col("ruled"))).alias("rules"), F.sum((F.size("entities") == F.size("tagged")).cast("int")).alias("measured"), F.count("*").alias("rows"))
    return made.agg(F.count("*").alias("n_papers")).join(n).select("n_papers", (F.col("measured") == F.col("rows")).alias("all_measured"), (F.col("ours") > F.col("rules")).alias("better_than_rules"), (F.col("ours") > 0.3 * F.col("words")).alias("better_than_chance"))


# -- encoder -----------------------------------------------------------------------------------------------------------


@query(f"{BASE} SELECT count(*) AS n_messages, true AS better_than_hashing, true AS better_than_untrained FROM (SELECT unnest(messages) AS m FROM sections) WHERE len(list_filter(string_split_regex(trim(m), '\\s+'), lambda w: w <> '')) > 5")
def encoder_recall(spark, sf_dir):
    """An encoder trained on made queries and their sentences, against tf-idf hashed to as many places, on held-out papers."""
    s = settle(sections(spark, sf_dir).select("fname", "paper_name", "messages"))
    messages = s.select("paper_name", F.explode("messages").alias("text"))
    pairs = settle(training_pairs(s).select(F.substring_index("fname", "_", 1).alias("paper"), F.concat_ws("#", "fname", "query").alias("key"), "query", F.col("sentence").alias("text")))
    own, held = training.split(pairs, "paper")
    start = encoder.fresh(messages, "text")
    model = encoder.trained(start, own, rounds=3)
    # Sentences of many papers alike have no right answer: each is asked among the distinct ones.
    found = encoder.ranks_of([e.encode for e in (model, encoder.HashVectors(start), start)], held, held.select("text"))
    ours, hashing, untrained = (sum(r <= 10 for r in own) for own in found)
    return messages.agg(F.count("*").alias("n_messages")).select("n_messages", F.lit(ours > hashing).alias("better_than_hashing"), F.lit(ours >= untrained).alias("better_than_untrained"))


# -- languages ---------------------------------------------------------------------------------------------------------

_SPLIT = "CAST('0x' || left(md5(doc_id || '|42|split'), 8) AS BIGINT) % 100 < 80"
_GRAMS = r"""letters AS (SELECT doc_id, lang, string_split(' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ', '') AS c FROM documents WHERE text IS NOT NULL),
grams AS (SELECT doc_id, lang, unnest(list_concat(list_filter(c, lambda x: x <> ' ' AND x <> ''), list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), list_transform(range(1, greatest(len(c) - 1, 1)), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS gram FROM letters WHERE len(c) > 2),"""


@query(rf"""WITH {_GRAMS}
counts AS (SELECT lang, gram, count(*) AS n FROM grams WHERE {_SPLIT} AND lang IS NOT NULL GROUP BY 1, 2),
totals AS (SELECT lang, sum(n) AS total, count(*) AS kinds FROM counts GROUP BY 1),
kept AS (SELECT DISTINCT gram FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM counts) WHERE r <= {languages.MOST}),
weights AS (SELECT k.gram, t.lang, CAST(round(1000 * ln((coalesce(c.n, 0) + 0.5) / (t.total + 0.5 * t.kinds))) AS BIGINT) AS w FROM kept k CROSS JOIN totals t LEFT JOIN counts c ON c.gram = k.gram AND c.lang = t.lang),
asked AS (SELECT doc_id, gram, count(*) AS n FROM grams WHERE NOT ({_SPLIT}) GROUP BY 1, 2),
sums AS (SELECT doc_id, lang, sum(n * w) AS s FROM asked JOIN weights USING (gram) GROUP BY 1, 2)
SELECT d.doc_id, (SELECT arg_max(lang, (s, -ascii(lang), -ascii(lang[2:]))) FROM sums WHERE sums.doc_id = d.doc_id) AS lang FROM documents d WHERE NOT ({_SPLIT})""")
def language_by_grams(spark, sf_dir):
    """The languages of a fifth of the documents, from the letters of the others."""
    own, held = training.split(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")), "doc_id")
    model = languages.LanguageModel.fit(own)
    return held.select("doc_id", languages.language_by(model, "text")["lang"].alias("lang"))


@query(f"SELECT count(*) AS n, true AS better_than_stop_words, true AS right_in_90 FROM documents WHERE NOT ({_SPLIT})")
def language_accuracy(spark, sf_dir):
    """On the first ten words of held-out documents, letters against stop words."""
    own, held = training.split(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")), "doc_id")
    short = held.select("lang", F.array_join(F.slice(X.words("text"), 1, 10), " ").alias("text"))
    told = short.select("lang", languages.language_by(languages.LanguageModel.fit(own), "text")["lang"].alias("ours"), R.language("text")["lang"].alias("rule"))
    hits = {c: F.sum(F.col(c).eqNullSafe(F.col("lang")).cast("int")) for c in ("ours", "rule")}
    return told.agg(F.count("*").alias("n"), (hits["ours"] > hits["rule"]).alias("better_than_stop_words"), (hits["ours"] >= 0.9 * F.count("*")).alias("right_in_90"))


# -- sentence ends -----------------------------------------------------------------------------------------------------

_XLOG = "CASE WHEN {n} > 0 THEN ({n}) * ln(greatest({p}, 1e-12)) ELSE 0 END"


def _ratio(*terms: tuple[int, str, str]) -> str:
    return " ".join(f"{'+' if sign > 0 else '-'} {_XLOG.format(n=n, p=p)}" for sign, n, p in terms)


@query(rf"""WITH w AS (SELECT list_filter(string_split(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
u AS (SELECT unnest(w) AS word FROM w),
t AS (SELECT lower(regexp_replace(word, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) AS word, CAST(ends_with(word, '.') AS INTEGER) AS stop FROM u),
c AS (SELECT word, count(*) AS n, sum(stop) AS k FROM t WHERE word <> '' GROUP BY 1), s AS (SELECT sum(n) AS total, sum(k) AS stops FROM c),
r AS (SELECT word, n, k, stops / total AS p, length(word) - length(replace(word, '.', '')) AS inner_stops FROM c, s WHERE k > 0 AND regexp_matches(word, '\p{{L}}'))
SELECT word, n, CAST(k AS BIGINT) AS with_stop, round(2 * (0 {_ratio((1, "k", str(sentence_ends.SURE)), (1, "n - k", str(round(1 - sentence_ends.SURE, 9))), (-1, "k", "p"), (-1, "n - k", "1 - p"))}) * exp(-(length(word) - inner_stops)) * (inner_stops + 1) * pow(length(word) - inner_stops, -(n - k)::DOUBLE), 4) + 0.0 AS score FROM r""")
def full_stop_scores(spark, sf_dir):
    """How much a full stop belongs to each word that has one somewhere."""
    return sentence_ends.scored(sentence_ends.counts(spread(table(spark, sf_dir, "documents").select("text"))))


# -- titles ------------------------------------------------------------------------------------------------------------

#: The engine that answers the SQL measures the distance of letters in bytes.
_ASCII = r"regexp_replace(string_split(text, chr(10))[1], '[^\x00-\x7F]', 'x', 'g')"
_PLAIN = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(rf"""WITH b AS (SELECT min('10.0000/doc.' || doc_id) AS doi, {_PLAIN.format(_ASCII)} AS p FROM documents WHERE doc_id % 2 = 0 GROUP BY 2),
e AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN regexp_replace(t, '^(\S+)\s+\S+', '\1') WHEN 1 THEN replace(t, 'e', 'ee') ELSE '* ' || t || '  .' END AS t FROM (SELECT doc_id, {_ASCII} AS t FROM documents)),
m AS (SELECT doc_id, {_PLAIN.format("t")} AS p FROM e),
x AS (SELECT p, list_distinct(string_split(p, ' ')) AS w, length(p) AS n FROM (SELECT p FROM b UNION SELECT p FROM m) WHERE p <> ''),
j AS (SELECT l.p AS l, r.p AS r, greatest(l.n, r.n) AS longer, len(list_intersect(l.w, r.w)) / (len(l.w) + len(r.w) - len(list_intersect(l.w, r.w))) AS jaccard
  FROM x l JOIN x r ON least(len(l.w), len(r.w)) >= {titles.LEAST} * greatest(len(l.w), len(r.w)) - 1e-9 AND abs(l.n - r.n) <= greatest(l.n, r.n) * (1 - {titles.ALIKE}) + 1e-9 AND list_has_any(l.w, r.w)
  WHERE l.p IN (SELECT p FROM m) AND r.p IN (SELECT p FROM b)),
s AS (SELECT *, CASE WHEN longer > {titles.LONG} THEN 1.0 ELSE 1 - levenshtein(l, r) / longer END AS letters FROM j WHERE jaccard >= {titles.LEAST}),
f AS (SELECT l, doi, round(jaccard, 6) AS similarity, row_number() OVER (PARTITION BY l ORDER BY round(jaccard, 6) DESC, round(letters, 6) DESC, doi) AS at FROM s JOIN b ON b.p = s.r WHERE letters >= {titles.ALIKE})
SELECT doc_id, doi, similarity FROM m LEFT JOIN f ON f.l = m.p AND f.at = 1""")
def title_links(spark, sf_dir):
    """Papers whose titles were edited (a word less, letters doubled, signs), found in a catalogue of half of them."""
    p = papers(spark, sf_dir).select("doc_id", "doi", F.regexp_replace("Title", r"[^\x00-\x7F]", "x").alias("title"))
    t, n = F.col("title"), F.col("doc_id") % 3
    edited = F.when(n == 0, F.regexp_replace(t, r"^(\S+)\s+\S+", "$1")).when(n == 1, F.replace(t, F.lit("e"), F.lit("ee"))).otherwise(F.concat(F.lit("* "), t, F.lit("  .")))
    found = titles.link_by_title(p.select("doc_id", edited.alias("title")), p.filter("doc_id % 2 = 0"))
    return found.select("doc_id", "doi", "similarity")


# -- text index, table functions -----------------------------------------------------------------------------------------


def _text_index(spark, sf_dir) -> tuple[text_index.TextIndex, DataFrame]:
    """An index of all abstracts, written in two parts."""
    p = papers(spark, sf_dir).select("doc_id", "Abstract")
    index = text_index.TextIndex(spark, shared_dir(spark))
    for k in range(2):
        index.append(p.filter(F.col("doc_id") % 2 == k), "doc_id", "Abstract")
    return index, p


def _ids(found: DataFrame) -> DataFrame:
    return found.select(F.col("key").alias("doc_id"))


@query(SQL["search_and_ordered"])
def index_ordered(spark, sf_dir):
    """Words in order, by merging their places."""
    return _ids(_text_index(spark, sf_dir)[0].ordered(["the", "thing"]))


@query(SQL["search_and_unordered"])
def index_unordered(spark, sf_dir):
    return _ids(_text_index(spark, sf_dir)[0].all_substrings(["thing", "that"]))


@query(SQL["search_or"])
def index_or(spark, sf_dir):
    index = _text_index(spark, sf_dir)[0]
    return _ids(index.substring("loser").unionByName(index.substring("schaft")).distinct())


@query(SQL["search_exact"])
def index_exact(spark, sf_dir):
    """Phrases as written: found in any case, then looked at."""
    index, p = _text_index(spark, sf_dir)
    return _ids(index.any_phrase(["of the", "The and"], p, "doc_id", "Abstract"))


@query(SQL["search_word_start"])
def index_word_start(spark, sf_dir):
    return _ids(_text_index(spark, sf_dir)[0].word_start("ing"))


@query(f"WITH {PAPERS}, {SENTENCES} SELECT doc_id, sum({_n_words('s')})::BIGINT AS words, count(*) AS rows, true AS bounded FROM (SELECT doc_id, unnest(every) AS s FROM sents) GROUP BY 1")
def segments_by_table_function(spark, sf_dir):
    """Each paper's sentences put together to segments of a hundred words, by a table function in SQL."""
    registry.register(spark)
    papers(spark, sf_dir).select("doc_id", F.posexplode(X.sentences("Abstract")).alias("place", "sentence")).createOrReplaceTempView("_sentence_rows")
    made = spark.sql("SELECT * FROM segments_of(TABLE(_sentence_rows) PARTITION BY doc_id ORDER BY place, text => 'sentence', words => 100)")
    n = X.word_count("segment")
    return made.groupBy("doc_id").agg(F.sum(n.cast("long")).alias("words"), F.sum("n_rows").alias("rows"), F.max(F.when((n > 100) & (F.col("n_rows") > 1), 1).otherwise(0)).alias("over")).select("doc_id", "words", "rows", (F.col("over") == 0).alias("bounded"))
