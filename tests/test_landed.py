"""Parsers of landed pages, services, model slots and slices at size."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quillmill.functions import labels, models, pdf_text
from quillmill.operators import intervals, tables, training
from quillmill.plans import stand_ins
from quillmill.shared import settle, shared_dir
from quillmill.sources import landed, services


@pytest.mark.parametrize("name", sorted(landed.PARSERS))
def test_null_and_empty_pages_give_empty_fields(spark, name):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>nothing of it</p>")], "k int, html string")
    got = landed.PARSERS[name](pages).collect()
    assert len(got) in (0, 3)
    for r in got:
        for c, v in r.asDict().items():
            assert c in ("k", "html") or v in (None, "", [], 0.5, 0.0, "nothing of it") or c in ("abstract", "body")


def test_first_of_several_counts_and_markup_goes(spark):
    pages = spark.createDataFrame([('<div class="x title"><b>A</b> &c</div><h1 class="wi-article-title">One <i>two</i></h1><h1 class="wi-article-title">Other</h1>',)], "html string")
    assert landed.iwa(pages).first().title == "One two"


def test_abstracts_of_article_pages(spark):
    entries = spark.createDataFrame([("a", ""), ("b", "own"), ("c", "")], "doi string, abstract string")
    pages = spark.createDataFrame([("a", '<div class="abstract">Of <b>page</b></div>'), ("b", '<div class="abstract">no</div>')], "doi string, html string")
    assert {(r.doi, r.abstract) for r in landed.with_page_abstracts(entries, pages).collect()} == {("a", "Of page"), ("b", "own"), ("c", "")}


def test_listed_papers_once_by_id_and_title(spark):
    rows = spark.createDataFrame([("1", "A", 1), ("1", "B", 2), ("2", "A", 3), ("3", "C", 4)], "abstract_id string, title string, at int")
    assert {(r.abstract_id, r.title) for r in landed.distinct_entries(rows, F.col("at")).collect()} == {("1", "A"), ("3", "C")}


def test_journals_are_repeated_for_each_article(spark):
    journals = spark.createDataFrame([("1", "J", ["a"])], "issn string, journal string, fields array<string>")
    articles = spark.createDataFrame([("1", "x"), ("1", "y"), ("2", "z")], "issn string, doi string")
    assert {(r.doi, r.journal) for r in landed.articles_of(journals, articles).collect()} == {("x", "J"), ("y", "J")}


def test_last_paragraphs_of_a_body_go(spark):
    df = spark.createDataFrame([(list("abcdefg"),), (list("ab"),), ([],)], "p array<string>")
    assert [r[0] for r in df.select(landed.without_last("p")).collect()] == [["a", "b"], [], []]


def test_service_waits_while_busy_and_tells_timeouts():
    seen = []

    def send(url, body, headers, timeout):
        seen.append(url)
        if body and b"slow" in body:
            raise TimeoutError
        if body and b"bad" in body:
            return 500, "x"
        return (503, "") if len(seen) < 3 else (200, "<TEI/>")

    s = services.PdfService("http://h/", pause=0, send=send)
    assert s.ask(b"pdf") == (200, "<TEI/>") and len(seen) == 3 and seen[0] == "http://h/api/processFulltextDocument"
    assert s.ask(b"slow") == (408, None) and s.ask(b"bad") == (500, None) and s.process(b"bad") is None and s.alive()
    assert services.PdfService("http://h", pause=0, tries=2, send=lambda *a: (503, "")).ask(b"x") == (503, None)


def test_files_and_exports(spark, tmp_path):
    docs = spark.createDataFrame([("a", "<TEI>\n1</TEI>"), ("b", None), ("c", "<TEI/>")], "name string, tei string")
    services.export_tei(docs, f"file://{tmp_path}/tei")
    assert {d for d in os.listdir(tmp_path / "tei") if d.startswith("name=")} == {"name=a", "name=c"}
    files = services.files_by_time(spark, f"file://{tmp_path}/tei/*", "*.txt").collect()
    assert len(files) == 2 and files == sorted(files, key=lambda r: (r.modified, r.path))
    docs.coalesce(1).write.parquet(f"file://{tmp_path}/p")
    assert [r.n for r in services.rows_by_file(spark.read.parquet(f"file://{tmp_path}/p")).collect()] == [3]


def test_hook_runs_after_a_load_only():
    done = []

    @services.then(done.append)
    def load(x):
        if x < 0:
            raise ValueError
        return x + 1

    assert load(1) == 2 and done == [2]
    with pytest.raises(ValueError):
        load(-1)
    assert done == [2]


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    a, b = shared_dir(spark), shared_dir(spark)
    assert a != b and "://" in a
    df = spark.createDataFrame([(1, "x"), (2, "y"), (2, None)], "k int, v string")
    assert sorted(map(tuple, settle(df, "k").filter("k = 2").select("k", "v").collect()), key=repr) == sorted([(2, "y"), (2, None)], key=repr)


def test_models_in_slots_take_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("ab",), (None,), ("",)], "t string")
    assert [r.n for r in df.select(models.slot("length", stand_ins.lengths, "long")("t").alias("n")).collect()] == [2, 0, 0]
    assert df.filter("false").select(models.encoder("shape", stand_ins.shape)("t")).count() == 0


def test_labels_of_empty_and_null_arrays(spark):
    df = spark.createDataFrame([([], [], None)], "a array<int>, t array<string>, n array<int>")
    r = df.select(labels.first_tokens("a", "a").alias("f"), labels.word_lists("t").alias("w"), labels.tag_counts("t").alias("c"), labels.aligned("a", "n").alias("n")).first()
    assert r.f == [] and r.w == [] and r.c == [] and r.n is None


def test_pdf_text_without_parts(spark):
    df = spark.createDataFrame([(None,), ("",), ("plain words only",)], "t string")
    for r in df.select(pdf_text.parts("t").alias("p")).collect():
        assert r.p.abstract == "" and r.p.references == [] and r.p.emails == [] and r.p.year is None and r.p.doi == ""


def test_training_data_of_odd_papers(spark):
    kind = "doi string, parts array<struct<header:string,paragraphs:array<string>>>, others array<string>"
    df = spark.createDataFrame([("a", None, None), ("b", [], []), ("c", [("Methods", ["one two three four five six seven eight nine"])], ["Too short."]), (None, [("Results", ["few"])], None)], kind)
    assert [(r.doi, r["class"], r.predictionstring) for r in training.span_rows(df).collect()] == [("c", "methods", "1 2 3 4 5 6 7 8 9")]
    assert training.structured_only(df).select("doi").collect()[0].doi == "c"


@pytest.mark.parametrize("parts", [4, 200])
def test_slices_of_a_million_rows(spark, parts):
    n = 1_000_000
    df = spark.range(0, n, 1, 4).select(((F.col("id") * 7919) % n).alias("k"), (F.col("id") % 3).alias("v"))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for a, b in ((0, 5), (400_000, 400_010), (699_999, 700_003), (999_995, None), (n, None)):
            assert sorted(r.k for r in tables.row_slice(df, "k", a, b).collect()) == list(range(a, min(n, b or n)))
        got = tables.row_slice(df, "k", 300_000, None).agg(F.count("*").alias("n"), F.min("k").alias("a"), F.sum("k").alias("s")).first()
        assert tuple(got) == (700_000, 300_000, sum(range(300_000, n)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_slices_with_ties_nulls_and_texts(spark):
    rows = [(None, k) for k in range(5)] + [("b", k) for k in range(50)] + [("a", 1), ("é", 2)]
    df = spark.createDataFrame(rows, "t string, k int")
    whole = [tables.row_slice(df, "t", k, k + 1).collect() for k in range(len(rows))]
    assert all(len(x) == 1 for x in whole) and sorted(map(repr, (tuple(x[0]) for x in whole))) == sorted(map(repr, rows))
    assert [x[0].t for x in whole] == [None] * 5 + ["a"] + ["b"] * 50 + ["é"]
    assert tables.row_slice(df.filter("false"), "t", 0, 3).count() == 0 and tables.row_slice(df, "t", 3, 3).count() == 0


def test_ranges_longer_and_shorter_than_a_bucket(spark):
    rows = spark.createDataFrame([(1, k) for k in range(0, 5000, 7)] + [(2, 5)], "g int, n int")
    manifest = spark.createDataFrame([(1, 0, 2500, "x"), (1, 2500, 2501, "none"), (1, 2501, 5000, "y"), (2, 6, 6, "empty")], "g int, first int, last int, name string")
    for bucket in (10, 1000, 100_000):
        got = intervals.first_range(rows, "g", "n", manifest, bucket).collect()
        assert sorted((r.g, r.n, r.name) for r in got) == sorted((1, k, "x" if k < 2500 else "none" if k < 2501 else "y") for k in range(0, 5000, 7))
