"""What the findings of round 3 asked for: work that grows with its input only, and exact answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillmill.operators import encoder


def test_f1_an_encoder_step_takes_numbered_features_and_shards_grow(spark, monkeypatch):
    start = encoder.Encoder(np.random.default_rng(3).normal(0, 1, (256, 8)), np.ones(256))
    own = encoder.Encoder(start.table.copy(), start.idf)
    encoder._learn(own, [(start.numbers(q), start.numbers(t)) for q, t in (("a flow", "the flow of it"), ("b heat", "some heat"))], 0.1, np.zeros(256))
    assert (own.table != start.table).any()
    monkeypatch.setattr(encoder, "PAIRS", 10)
    seen = []
    sums = encoder._numbered
    monkeypatch.setattr(encoder, "_numbered", lambda rows, e: seen.append(rows.agg(F.countDistinct("shard")).first()[0]) or sums(rows, e))
    df = spark.range(200).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("q"), "id").alias("query"), F.concat(F.lit("text q"), "id").alias("text"))
    encoder.trained(start, df, rounds=1)
    assert seen[0] > encoder.SHARDS


def test_f2_a_shard_is_read_once_and_its_words_are_tagged_as_one_by_one():
    from quillmill.operators import tagger

    model = tagger.Perceptron(np.random.default_rng(0).integers(-99, 99, (1 << 12, len(tagger.TAGS))))
    words = "The aim is a flow. It was é! so b.c d".split() * 150
    numbers = model.numbers(words)
    assert numbers.tolist() == [[tagger.hashed(f, 12) for f in fs] for fs in tagger.word_features(words)]
    before, want = -1, []
    for fs in numbers:
        before = int(model.weights[[*fs, *model.after(np.array([before]), fs[None, :])[0]]].sum(0).argmax())
        want.append(before)
    assert model.tag(words) == want and model.tag([]) == []


def test_f6_phrases_are_counted_where_a_key_lies(spark):
    from quillmill.operators import ranking

    df = spark.createDataFrame([(1, "flow of heat flow of heat water"), (2, "flow of heat"), (2, "cold water flow"), (3, None)], "id int, text string")
    got = ranking.best_terms(df, "id", "text", n=50)
    assert {r.phrase for r in got.filter("id = 2").collect()} == {"flow heat", "cold water", "cold water flow", "water flow"}
    assert got.filter("id = 1").orderBy("rank").first().phrase == "flow heat" and got.filter("id = 1").count() == 6



def test_f5_the_sql_of_pdf_parts_takes_years_from_numbers_too():
    import duckdb

    from quillmill.plans import catalog

    con = duckdb.connect()
    con.sql("CREATE TABLE documents AS SELECT unnest([7, 12020, 2021]) AS doc_id, 'en' AS lang, 'src1' AS source")
    got = con.sql(f"SELECT doc_id, year FROM ({catalog.SQL['pdf_parts']}) ORDER BY 1").fetchall()
    assert got == [(7, 2019), (2021, 2021), (12020, 2020)]


def test_f4_f15_an_exact_search_is_exact_among_copies_and_holds_k_rows_a_query(spark):
    from quillmill.operators import vector_index
    from quillmill.shared import shared_dir

    rng = np.random.default_rng(5)
    # 400 rows that differ by far less than a code's step, and copies of one.
    x = (rng.normal(0, 1, 8)[None, :] + rng.normal(0, 3e-5, (400, 8))).astype(np.float32)
    x[300:] = x[17]
    e = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate([x, rng.normal(0, 1, (20, 8)).astype(np.float32)]))], "vec_id long, embedding array<float>")
    index = vector_index.VectorIndex(spark, shared_dir(spark)).fit(e, 3).append(e)
    asked = e.filter("vec_id in (1, 17, 410)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in e.collect()}
    want = {(q, k) for q in (1, 17, 410) for k, _ in sorted(((k, round(float(rows[q] @ v), 6)) for k, v in rows.items()), key=lambda p: (-p[1], p[0]))[:10]}
    assert {(r.query_id, r.key) for r in index.search(asked, 10, probes=vector_index.MOST_CELLS, exact=True).collect()} == want
    assert index.search(asked, 10, probes=1, exact=True).count() == 30


def test_f24_verbs_are_stemmed_by_one_look_up(spark):
    from quillmill.functions import clauses

    df = spark.createDataFrame([("It was found, then shown",), ("We studied flows",), ("no such thing",), (None,)], "s string").select(clauses.root_verb("s").alias("v"), clauses.stem(F.lit("Analysed.")).alias("w"), clauses.stem(F.lit("Flow!")).alias("x"))
    assert [tuple(r) for r in df.collect()] == [("find", "analyse", "flow"), ("study", "analyse", "flow"), (None, "analyse", "flow"), (None, "analyse", "flow")]
    assert str(clauses.stem(F.lit("x"))).count("WHEN") <= 1


def test_f23_runs_of_repeated_and_missing_numbers(spark):
    from quillmill.operators import intervals

    df = spark.createDataFrame([("a", x) for x in (3, 1, 2, 2, 7, 9, 8, None, None, 12)] + [(None, 5), ("b", None), ("c", -1), ("c", 0)], "g string, x long")
    made = intervals.islands(df, "g", "x")
    want = {("a", None, None, 1), ("a", 1, 3, 3), ("a", 7, 9, 3), ("a", 12, 12, 1), (None, 5, 5, 1), ("b", None, None, 1), ("c", -1, 0, 2)}
    assert {(r.g, r.start, r.end, r.n) for r in made.collect()} == want and made.count() == len(want)
    assert "HashAggregate" not in made._jdf.queryExecution().executedPlan().toString()


def test_f9_f11_grams_are_counted_in_their_task(spark, monkeypatch):
    from quillmill.operators import languages

    monkeypatch.setattr(languages, "HELD", 3)
    df = spark.createDataFrame([("en", "Ab, b"), ("en", "ab"), ("fr", "éa"), (None, "x"), ("fr", None), ("fr", "12")], "lang string, text string")
    made = languages.gram_counts(df, "text", "lang")
    got = {(r.lang, r.gram): r.n for r in made.collect()}
    assert got["en", "ab"] == 2 and got["en", "b "] == 3 and got["en", " ab"] == 2 and got["fr", "éa"] == 1 and ("en", " ") not in got and ("fr", "x") not in got
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()


def test_f16_to_f20_postings_are_put_together_in_their_task(spark, monkeypatch):
    from quillmill.operators import text_index
    from quillmill.shared import shared_dir

    monkeypatch.setattr(text_index, "BLOCK", 4)
    df = spark.createDataFrame([(1, "a b a c"), (2, "B a"), (3, None), (4, "a a  a")], "key int, text string").coalesce(1)
    index = text_index.TextIndex(spark, shared_dir(spark), buckets=3).append(df, "key", "text")
    assert {(r.term, r.n) for r in index.terms().collect()} == {("a", 3), ("b", 2), ("c", 1), ("", 2)}
    assert [r.key for r in index.substring("b a").orderBy("key").collect()] == [1, 2]
    stored = spark.read.parquet(f"{index.root}/postings")
    assert stored.filter("term = 'a'").count() == 2 or stored.filter("size(keys) > 1").count() > 0
    assert {(r.key, r["at"]) for r in index._word("a", "is").collect()} == {(1, 0), (1, 2), (2, 1), (4, 0), (4, 1), (4, 3)}


def test_f7_f10_f12_f13_formatters_bound_their_batches(spark):
    from quillmill.plans import source_queries
    from quillmill.shared import small_batches

    from .conftest import SMALL

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, "10000")
    source_queries.format_covid(spark, SMALL)
    assert int(spark.conf.get(key)) == 1000
    small_batches(spark, int(held))


def test_f8_f14_f21_f22_f25_pages_are_dealt_to_all_cores(spark):
    from quillmill.plans import source_queries

    from .conftest import SMALL

    for name in ("ssrn_pages", "hal_pages", "egu_pages", "doaj_cards", "iwa_pages"):
        assert getattr(source_queries, name)(spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_f3_titles_at_the_bounds_of_lengths_are_found_and_texts_are_not_multiplied(spark):
    from quillmill.operators import titles

    mine = [f"{'a' * n} flow of some heat" for n in range(1, 40)]
    books = [f"{'a' * n} flow of some heat" for n in range(1, 60)]
    table = lambda rows: spark.createDataFrame([(x,) for x in rows], "plain string")
    got = {(r.l, r.r) for r in titles.similar(table(mine), table(books), least=0.6).collect()}
    assert got == {(x, y) for x in mine for y in books if abs(len(x) - len(y)) <= round(0.2 * max(len(x), len(y)), 9)}
    few = titles._first_words(spark.createDataFrame([(1, "a b", ["a", "b"])], "id long, plain string, words array<string>"), 0.7)
    assert "plain" not in few.columns and "words" not in few.columns
