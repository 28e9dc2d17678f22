from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillmill.operators import evaluation, intervals, ranking, tables, zones
from quillmill.operators.zones import Zone
from quillmill.plans import find, produce
from quillmill.sources import papers as P
from quillmill.sources import structured as D

ROWS = [
    ("The effects of cover crops on the soil", "Samuel I. Haruna; N. Nkongolo", "2020.0", "['soil', 'crops']", "In this study we propose a cover crop model for the soil of the farm. Results showed a significant increase of the water in the soil.", "10.1/a", None, "nd Soil"),
    ("The effects of cover crops on the soil", "X Y", "2021", "['soil']", "Another abstract of the same paper with the same number and more words.", "10.1/a", "3", "Soil"),
    ("Die Wirkung der Pflanzen auf den Boden und das Wasser", "A B", "2019", "['soil']", "Ein deutscher Text mit mehr als fünf Wörtern in der Zeile.", "10.1/b", "1", "Boden"),
    ("The water", "C D", "bad", "[]", "Too short.", "10.1/c", "1", "Water"),
]
COLUMNS = "title string, authors string, date string, fields string, abstract string, doi string, numCitedBy string, journals string"


def test_format_generic(spark):
    raw = spark.createDataFrame(ROWS, COLUMNS)
    got = P.format_papers(raw, "generic", "doaj").collect()
    assert [r.doi for r in got] == ["10.1/a"]
    r = got[0]
    assert (r.Authors, r.year, r.numCitedBy, r.database, r.fields) == ("Samuel I. Haruna, N. Nkongolo", 2020, 0.5, "doaj", ["soil", "crops"])
    last = P.format_papers(raw, "generic", check_database=False).collect()
    assert [x.numCitedBy for x in last] == [3.0]
    seen = spark.createDataFrame([("10.1/a",)], "doi string")
    assert P.format_papers(raw, "generic", seen=seen).count() == 0


def test_format_sources(spark):
    egu = spark.createDataFrame([("T of the", "A B", "2022.0", "x y z w v u t", "https://doi.org/10.5194/acp-1", "f"), ("U", "A B", "2022", "x y z w v u t", "nan", "f")], "title string, authors string, date string, abstract string, doi string, field string")
    assert [r.doi for r in P.format_papers(egu, "egu").collect()] == ["10.5194/acp-1"]
    iahr = spark.createDataFrame([("T", "a b c d e f g", "A", "2001", "f", "k", "http://x/1")], "title string, abstract string, authors string, date string, field string, keywords string, webpage string")
    assert P.format_papers(iahr, "iahr").first().doi == "http://x/1"
    issn = spark.createDataFrame([("Ein Titel und das", "A", "2001", "p", "kurz", "10/1", "7", "q")], "title string, authors string, date string, field_paper string, abstract string, doi string, numCitedBy string, field_issn string")
    r = P.format_papers(issn, "issn").first()
    assert (r.numCitedBy, r.Journal, r.fields) == (7.0, "q", ["p", "q"])
    pmc = spark.createDataFrame([("The effect of the drug", "['A B', 'C D']", "2001", "{'text': ['ab cd', 'ef']}", "10/2", "Journal of Drugs")], "title string, authors string, year string, abstract string, doi string, journal string")
    r = P.format_papers(pmc, "pmc").first()
    assert (r.Authors, r.Abstract, r.fields[1]) == ("A B, C D", "ab cd ef", "of Drugs")


def test_arxiv_and_elsevier(spark, tmp_path):
    rec = {"id": "0704.1", "authors_parsed": [["Roe", "Jane", ""], ["Doe", "J.", ""]], "title": "A\n title", "abstract": " Abs\ntract ", "doi": None, "journal-ref": "J", "versions": [{"created": "Mon, 2 Apr 2007"}], "categories": "cs.AI", "comments": None}
    (tmp_path / "a.json").write_text(json.dumps(rec) + "\n" + json.dumps(rec | {"id": "2", "comments": "This paper has been withdrawn"}))
    r = D.arxiv_papers(D.read_arxiv(spark, str(tmp_path / "a.json")), names=spark.createDataFrame([("cs.AI", "Artificial-Intelligence")], "category string, name string")).collect()
    assert len(r) == 1 and (r[0].doi, r[0].Authors, r[0].year, r[0].fields) == ("0704.1", "Jane Roe, J. Doe", 2007, ["Computer Science", "Artificial", "Intelligence"])
    e = {"abstract": "x", "author_highlights": [{"sentence": "h"}], "metadata": {"asjc": ["1703", "1702"], "doi": "10/1", "title": "t", "authors": [{"first": "A", "last": "B"}], "keywords": ["k"], "issn": "1", "pub_year": "2010"}}
    (tmp_path / "e").mkdir()
    (tmp_path / "e/1.json").write_text(json.dumps(e))
    ranges = spark.createDataFrame(intervals.ranges_of(D.FIELD_CODES), "label string, lo int, hi int")
    r = D.elsevier_papers(D.read_elsevier(spark, str(tmp_path / "e")), ranges).first()
    assert r.fields == ["Artificial Intelligence", "Computer Science", "Mathematics"] and r.Authors == "A B"


def test_tei_and_headers(spark):
    tei = '<?xml version="1.0"?><TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title type="main">Main</title><analytic><author><persName><forename>Jane</forename><surname>Roe</surname></persName></author></analytic><title level="j">Jour</title><date type="published" when="2010">May 2010</date><idno type="DOI">10/1</idno><keywords>a\nb</keywords><abstract>One two three four five six.</abstract></teiHeader></TEI>'
    r = D.tei_papers(spark.createDataFrame([(tei,)], "tei string")).first()
    assert (r.doi, r.Authors, r.year, r.Title, r.Journal, r.Keywords) == ("10/1", "Jane Roe", 2010, "Main", "Jour", "a, b")
    heads = ["Keywords", "Introduction", "Related", "Methods", "Data", "Results", "Discussion", "References"]
    got = spark.createDataFrame([(heads,)], "h array<string>").select(D.header_parts("h").alias("x")).first().x
    assert got == ["abstract", "introduction", "introduction", "methods", "methods", "results", "results", "references"]


def test_grobid_client_failures_are_null(spark):
    class Client:
        def process(self, content):
            if content == b"bad":
                raise ValueError
            return "<TEI/>"

    pdfs = spark.createDataFrame([("a", b"ok"), ("b", b"bad")], "path string, content binary")
    got = {r.path: r for r in D.grobid(pdfs, Client).collect()}
    assert {k: r.tei for k, r in got.items()} == {"a": "<TEI/>", "b": None} and got["a"].status == 200 and got["b"].status == 0 and got["b"].error


def test_zone(spark, tmp_path):
    z = Zone(spark, f"file://{tmp_path}", "formatted")
    z.write(spark.createDataFrame([("1", 1, "x"), ("2", 1, "y")], "doi string, v int, database string"))
    z.upsert(spark.createDataFrame([("1", 2, "x"), ("3", 2, "x")], "doi string, v int, database string"), "doi")
    assert {r.doi: r.v for r in z.read().collect()} == {"1": 2, "3": 2, "2": 1}
    assert {r.database: r.n for r in z.elements().collect()} == {"x": 2, "y": 1}
    z.compact()
    assert z.read(database="x").count() == 2
    assert z.sample(2, "doi").count() == 3
    z.remove(database="x")
    assert z.read().count() == 1


def test_produce_search_review(spark):
    raw = spark.createDataFrame(ROWS[:1], COLUMNS)
    s = produce.produce(P.format_papers(raw, "generic", "doaj"))
    got = {r.section: r for r in s.collect()}
    assert set(got) == {"objectives", "methods", "results"} and got["objectives"].authors == "Haruna and Nkongolo (2020)"
    assert got["methods"].title is None and got["objectives"].journal == "Soil"
    found = find.find_papers(s.withColumn("title", F.coalesce("title", F.lit(""))), "cover crops", top_n=5, year_from=2000)
    assert [r.paper_name for r in found.collect()] == ["10.1/a"]
    assert find.find_papers(s, "cover crops", year_from=2020).count() == 0  # exclusive
    r = find.review(s.filter("section = 'objectives'"), ["fname"]).first()
    assert r.review.startswith("- Haruna and Nkongolo (2020)") and r.references == "- Samuel I. Haruna, N. Nkongolo, 2020, The effects of cover crops on the soil, Soil."


def test_tables(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, g long")
    assert sorted(r.id for r in tables.row_slice(df, "id", 5, 9).collect()) == [5, 6, 7, 8]
    assert sorted(r.id for r in tables.row_slice(df, "id", 28, None).collect()) == [28, 29]
    assert tables.quota_sample(df, "g", F.col("id"), 6, 3).count() == 9
    assert tables.register(df.select("id"), df.select((F.col("id") + 1).alias("id")), "id").count() == 31


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ranking.nearest(empty, empty, 5).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ranking.top_tfidf(docs, "a query", "doc_id", "text", 5).count() == 0
    assert intervals.islands(docs.select(F.col("doc_id").alias("g"), F.col("doc_id").alias("n")), "g", "n").count() == 0


def test_span_scores(spark):
    gold = spark.createDataFrame([(1, "a", 0, [1, 2, 3]), (1, "a", 1, [7, 8])], "doc long, class string, id int, words array<int>")
    pred = spark.createDataFrame([(1, "a", 0, [1, 2]), (1, "a", 1, [20])], "doc long, class string, id int, words array<int>")
    r = evaluation.span_scores(evaluation.matched_spans(pred, gold)).first()
    assert (r.tp, r.fp, r.fn, r.f1) == (1, 1, 1, 0.5)
    assert evaluation.mean_f1(evaluation.span_scores(evaluation.matched_spans(pred, gold))).first().f1 == 0.5


def test_clean_zone(spark):
    rows = [("p_objectives", "p", "objectives", "R (2020.0)", 2020, ["The aim of the work is to see it"], "T", None, None), ("p_methods", "p", "methods", None, None, ["The method of the paper and the data"], None, None, None), ("q_methods", "q", "methods", None, 2001, [], None, None, None)]
    s = spark.createDataFrame(rows, "fname string, paper_name string, section string, authors string, year int, messages array<string>, title string, numCitedBy double, allauthors string").withColumn("reported", F.col("authors"))
    other = spark.createDataFrame([("p", 4.0, "Jane Roe")], "paper_name string, numCitedBy double, allauthors string")
    got = {r.fname: r for r in zones.clean(s, other).collect()}
    assert set(got) == {"p_objectives", "p_methods"} and got["p_methods"].year == 2020
    assert got["p_objectives"].authors == "R (2020)" and got["p_methods"].numCitedBy == 4.0 and got["p_objectives"].allauthors == "Jane Roe"


def test_streaming_ingest(spark, tmp_path):
    from quillmill.streaming import ingest

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"doi": d, "at": "2024-01-01T00:00:00Z", "database": "x"}) for d in ("a", "a", "b")))
    df = ingest.landed(spark, str(src), "doi string, at timestamp, database string")
    q = ingest.to_zone(ingest.first_within(df, "at"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(r.doi for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
