from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import abbreviations, spans
from quillmill.functions import authors as A
from quillmill.functions import rules as R
from quillmill.functions import text as X


def value(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_author_formula(spark):
    cases = {
        ("Samuel I. Haruna, N. Nkongolo", 2020): "Haruna and Nkongolo (2020)", ("A B, C D, E F", 1999): "B et al. (1999)", ("Jane Roe", 2001): "Roe (2001)", ("Jane Roe John Doe", 2001): "Roe and Doe (2001)",
        ("", 2001): "authors (2001)", ("One", 2001): "Some authors  (2001)", ("Jane Roe", 999): "Roe ()",
    }
    for (authors, year), want in cases.items():
        assert value(spark, A.author_formula("a", "y"), a=authors, y=year) == want


def test_years_and_citations(spark):
    for given, want in (("2022.0", 2022), ("2020", 2020), ("x", None), (None, None)):
        assert value(spark, X.year_of(F.lit(given).cast("string"))) == want
    assert value(spark, X.citations(F.lit(float("nan")))) == 0.5
    assert value(spark, A.arxiv_year(F.lit("9901.123"))) == 1999
    assert value(spark, A.arxiv_year(F.lit("2101.123"))) == 2021


def test_text(spark):
    assert value(spark, X.one_line(F.lit("ab-\ncd\nef"))) == "abcd ef"
    assert value(spark, X.one_line(F.lit(None).cast("string"))) == ""
    assert value(spark, X.literal_list(F.lit("""['a', "b's"]"""))) == ["a", "b's"]
    assert value(spark, X.despaced(F.lit("a b s t r a c t"))) == "abstract"
    assert value(spark, X.doi_in(F.lit("see doi: 10.1234/ab.c-d, and"))) == "10.1234/ab.c-d"
    assert value(spark, X.keywords(F.lit("Text. Key words: soil, water"))) == "soil, water"
    assert value(spark, X.without_long_brackets(F.lit("a (b c) d (one two three four five six) e"))) == "a (b c) d  e"
    assert value(spark, X.objective_clean(F.lit("12We use [3] this (4); yes"))) == "We use Someone this , yes"
    assert value(spark, X.repeated_capitalised(F.lit("Ab cd Ab cd Ef gh "), 1)) == ["Ab cd "]
    assert value(spark, X.comma_pair(F.lit("a, b, c"), F.lit("a b c"))) == "a, b, c"


def test_sentences(spark):
    text = "One two three four five six seven. Short one. The online version of this has more words here! Nine ten eleven twelve thirteen fourteen?"
    assert len(value(spark, X.sentences(F.lit(text)))) == 4
    assert len(value(spark, X.full_sentences(F.lit(text)))) == 2


def test_language(spark):
    assert value(spark, R.language(F.lit("the cat of the house and it is on the mat")))["lang"] == "en"
    assert value(spark, R.language(F.lit("der Hund und die Katze mit dem Haus ist nicht")))["lang"] == "de"
    assert value(spark, R.is_english(F.lit(""))) is True
    assert value(spark, R.is_english(F.lit(""), empty=False)) is False


def test_segment_and_report(spark):
    text = "However previous literature is known and recent in many ways. In this paper we propose a new model for water flow in soils. We used data and methods from an experiment with samples. Results showed a significant finding that increased yields."
    got = value(spark, R.segmented(X.full_sentences(F.lit(text))))
    assert [x["label"] for x in got] == ["objectives", "methods", "results"]
    assert value(spark, R.reported(F.lit("In this paper, we propose a model of flow."), F.lit("Roe (2020)"))) == "Roe (2020) proposed a model of flow."
    assert value(spark, R.reported(F.lit("This study aims to find paths."), F.lit("Roe (2020)"))) == "Roe (2020) found paths."
    assert value(spark, R.reported(F.lit("Water is wet."), F.lit("Roe (2020)"))) == "Roe (2020): Water is wet."


def test_chosen(spark):
    mk = lambda n: " ".join(["w"] * n)
    assert value(spark, F.size(X.words(R.chosen(F.array(*(F.lit(mk(n)) for n in (10, 24, 21, 40))))))) == 21
    assert value(spark, F.size(X.words(R.chosen(F.array(*(F.lit(mk(n)) for n in (10, 17, 40))))))) == 17
    assert value(spark, R.chosen(F.array().cast("array<string>"))) is None


def test_query_kinds():
    assert [R.query_kind(q) for q in ("a AND b", "a & b", '"a b"', '"a" AND b', "a b")] == ["and", "and", "match", "and", "single"]
    assert R.lemmas_of("the studies of running crops") == ["study", "runn", "crop"]


def test_abbreviations(spark):
    text = "The no tillage (NT) system and soil organic carbon (SOC) content. Bad (unbalanced here.\nSee heat shock protein (HSP; new)."
    assert abbreviations.pairs(text) == {"HSP": "heat shock protein"} | abbreviations.pairs(text.split("\n")[0])
    assert abbreviations.pairs("The no tillage (NT) system") == {"NT": "no tillage"}
    assert abbreviations.pairs("x (12) and (a b c) y") == {}
    assert value(spark, abbreviations.expand(F.lit("use NT now"), F.create_map(F.lit("NT"), F.lit("no tillage")))) == "use no tillage (NT) now"


def test_spans(spark):
    assert [tuple(x) for x in value(spark, spans.runs(F.array(*map(F.lit, (1, 2, 5, 8, 9)))))] == [(1, 2), (5, 5), (8, 9)]
    parts = F.array(F.struct(F.lit("objectives").alias("label"), F.lit("ab cd").alias("text")), F.struct(F.lit("other").alias("label"), F.lit("ef").alias("text")))
    assert value(spark, spans.section_tags(parts)) == ["B-objectives", "I-objectives", "O"]
    assert [tuple(x) for x in value(spark, spans.section_spans(parts))] == [("objectives", 0, 5, 1, 2), ("other", 6, 8, 3, 3)]
    assert tuple(value(spark, spans.char_span(F.lit("a b c d e f g"), F.lit("b c d e f g")))) == (2, 13)
    assert value(spark, spans.repaired_tags(F.array(*map(F.lit, ("B-a", "I-a", "B-b"))))) == ["B-a", "I-a"]
