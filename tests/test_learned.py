"""What is learned or indexed, against brute force; archives, selectors, requests and zones."""

from __future__ import annotations

import collections
import http.server
import io
import random
import threading
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.functions import models
from quillmill.operators import encoder, languages, search, sentence_ends, tagger, text_index, titles, vector_index, zones
from quillmill.shared import shared_dir
from quillmill.sources import archives, fetching, landed, selectors

# -- vector index ------------------------------------------------------------------------------------------------------


def _vectors(n: int = 600, size: int = 12) -> list[tuple]:
    r = np.random.default_rng(4)
    middle = r.normal(size=(7, size))
    rows = [(int(k), (middle[k % 7] + 0.4 * r.normal(size=size)).astype(np.float32).tolist()) for k in range(n)]
    return [*rows, (n, rows[3][1]), (n + 1, None), (n + 2, [1.0, 2.0]), (None, rows[5][1])]


def _truth(rows: list[tuple], q: list, k: int) -> list[tuple]:
    size = len(q)
    every = [(-round(float(np.dot(np.array(v, float), np.array(q, float))), 6), key is not None, key or 0, key) for key, v in rows if v is not None and len(v) == size]
    return [(key, -s) for s, _, _, key in sorted(every)[:k]]


@pytest.fixture(scope="module")
def built(spark):
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("x"))
    index = vector_index.VectorIndex(spark, shared_dir(spark)).fit(df, 9)
    for k in range(3):
        index.append(df.filter(F.pmod(F.xxhash64("vec_id"), F.lit(3)) == k))
    return rows, df, index


def test_all_cells_give_the_exact_answer(spark, built):
    rows, _, index = built
    asked = [(k, rows[k][1]) for k in (0, 50, 333)] + [(9, None)]
    got = index.search(spark.createDataFrame(asked, "query_id long, vector array<float>"), 15, probes=99, rerank=1000).collect()
    for k, q in asked[:3]:
        own = sorted((r.rank, r.key, r.score) for r in got if r.query_id == k)
        assert [(key, s) for _, key, s in own] == [(key, pytest.approx(s, abs=2e-6)) for key, s in _truth(rows, q, 15)]
    assert {r.query_id for r in got} == {0, 50, 333}


def test_appended_is_rebuilt_and_skips_what_is_no_vector(spark, built):
    rows, df, index = built
    again = vector_index.VectorIndex(spark, shared_dir(spark)).fit(df.repartition(5), 9).append(df)
    assert np.array_equal(index.cells()[0], again.cells()[0])
    held = [sorted((r.cell, r.key or -1, bytes(r.code)) for r in x.lists().collect()) for x in (index, again)]
    assert held[0] == held[1] and len(held[0]) == len(rows) - 2


def test_few_cells_find_most(spark, built):
    rows, _, index = built
    asked = spark.createDataFrame([(k, rows[k][1]) for k in range(0, 600, 20)], "query_id long, vector array<float>")
    exact, some = index.search(asked, 30, 99, 1000), index.search(asked, 30, 3)
    r = vector_index.recall(some, exact).agg(F.avg("recall")).first()[0]
    assert r >= 0.9 and index.read_share(asked, 3) < 0.6


def test_an_index_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    index = vector_index.VectorIndex(spark, shared_dir(spark)).fit(none, 4).append(none)
    assert index.search(spark.createDataFrame([(1, [0.5])], "query_id long, vector array<float>"), 3, 2).count() == 0
    with pytest.raises(ValueError, match="cells"):
        vector_index.fit_cells(none, 10_000)


# -- tagger ------------------------------------------------------------------------------------------------------------


def _tagged(n: int = 60) -> list[tuple]:
    r = random.Random(1)
    words = {"background": "known things often are as before".split(), "methods": "we used some data models here".split(), "results": "found greater values than others did".split()}
    out = []
    for k in range(n):
        text, tags = [], []
        for c, own in words.items():
            m = r.randint(4, 9)
            text += [r.choice(own) for _ in range(m - 1)] + ["end."]
            tags += [f"B-{c}", *[f"I-{c}"] * (m - 1)]
        out.append((f"p{k}", " ".join(text), tags))
    return [*out, ("null", None, ["O"]), ("uneven", "one two", ["O"]), ("empty", "", []), ("odd", "a b", ["X", "O"])]


def test_a_tagger_learns_alike_from_any_partitions(spark):
    df = spark.createDataFrame(_tagged(), "doi string, text string, entities array<string>")
    a, found = tagger.train(df.repartition(1), rounds=3, bits=12)
    b, again = tagger.train(df.repartition(7, "text"), rounds=3, bits=12)
    assert np.array_equal(a.weights, b.weights) and found == again and max(found) > 0.85
    made = df.filter("doi = 'p1' or text is null").select("entities", models.tagger("t1", lambda: a)("text").alias("got")).collect()
    assert sum(x == y for x, y in zip(*made[0], strict=True)) > 0.8 * len(made[0].got) and made[1].got == []


def test_a_tagger_of_nothing_says_o(spark):
    model, found = tagger.train(spark.createDataFrame([], "doi string, text string, entities array<string>"), rounds=2, bits=8)
    assert model(["a b", ""]) == [["O", "O"], []] and found[0] == 0.0


# -- encoder -----------------------------------------------------------------------------------------------------------


def _pairs() -> list[tuple]:
    """Queries name a thing by another word than their texts do, always the same."""
    r = random.Random(3)
    names = [("".join(r.choice("abcdefgh") for _ in range(6)), "".join(r.choice("qrstuvwx") for _ in range(6))) for _ in range(40)]
    out = []
    for k in range(400):
        a, b = r.choice(names), r.choice(names)
        out.append((f"k{k}", f"{a[0]} {b[0]}", f"of {a[1]} and {b[1]} then"))
    return out


def test_an_encoder_learns_what_hashing_cannot(spark):
    df = spark.createDataFrame([*_pairs(), (None, "x", "y"), ("n", None, "y")], "key string, query string, text string")
    own, held = df.filter("key is null or key not like '%7'"), df.filter("key like '%7'")
    start = encoder.fresh(df, "text", bits=12, size=32)
    model, again = (encoder.trained(start, own.repartition(n), rounds=6, shards=2) for n in (1, 5))
    assert np.array_equal(model.table, again.table)
    within = {n: sum(x <= 5 for x in encoder.ranks(e.encode, held, df)) for n, e in (("trained", model), ("hash", encoder.HashVectors(start)), ("start", start))}
    assert within["trained"] > 2 * max(within["hash"], within["start"]) and within["trained"] > 20
    got = df.limit(2).select(models.encoder("e1", lambda: model)("text").alias("v")).collect()
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-3 for r in got) and not any(model([""])[0])


# -- languages ---------------------------------------------------------------------------------------------------------


def test_languages_by_letters(spark):
    rows = [("aa ab ba", "x")] * 5 + [("öö öü üö", "y")] * 5 + [(None, "y"), ("zz", None)]
    model = languages.LanguageModel.fit(spark.createDataFrame(rows, "text string, lang string"))
    asked = spark.createDataFrame([("ab a",), ("ÖÜ!",), ("12 ",), (None,), ("",), ("qq",)], "text string")
    got = [(r.text, r.x.lang) for r in asked.select("text", languages.language_by(model, "text").alias("x")).collect()]
    assert got[:5] == [("ab a", "x"), ("ÖÜ!", "y"), ("12 ", None), (None, None), ("", None)] and got[5][1] == "x"
    none = languages.LanguageModel.fit(spark.createDataFrame([], "text string, lang string"))
    assert none(["a"]) == [(None, None)]


# -- sentence ends -----------------------------------------------------------------------------------------------------


def test_abbreviations_are_learned(spark):
    r = random.Random(2)
    words = [f"w{k}x" for k in range(300)]
    texts = []
    for _ in range(300):
        s = [r.choice(words) for _ in range(9)]
        s[4] = r.choice(["approx.", "e.g.", "vol."])
        texts.append("The " + " ".join(s) + ". The " + " ".join(r.choice(words) for _ in range(6)) + ".")
    corpus = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string")
    model = sentence_ends.SentenceEnds.fit(corpus)
    assert {"e.g", "vol"} <= model.shortened and not model.shortened & set(words) and "the" in model.starts
    df = spark.createDataFrame([("See vol. 3 of it. The end e.g. this one. The vol. The next.",), (None,), ("One only",)], "text string")
    got = [r.s for r in df.select(sentence_ends.sentences_by(model, "text").alias("s")).collect()]
    assert got == [["See vol. 3 of it.", "The end e.g. this one.", "The vol.", "The next."], [], ["One only"]]


# -- titles ------------------------------------------------------------------------------------------------------------


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_titles_match_as_brute_force_says(spark):
    r = random.Random(6)
    words = "of the on in deep sea ice flow soil wave model study rain long term data".split()
    books = [" ".join(r.choice(words) for _ in range(r.randint(1, 9))) for _ in range(150)]
    mine = []
    for b in books:
        w = b.split()
        if len(w) > 1:
            w.pop(r.randrange(len(w)))
        if r.random() < 0.5:
            w.insert(r.randrange(len(w) + 1), r.choice(words))
        mine.append(" ".join(w).upper() + r.choice(["", "!", " ."]))
    mine += [None, "", "?!", *mine[:5]]
    catalogue = [(f"10.1/{k:03}", b) for k, b in enumerate(books)] + [(None, "deep sea"), ("10.2/x", None)]
    got = titles.link_by_title(spark.createDataFrame([(k, m, "own") for k, m in enumerate(mine)], "id int, title string, doi string"), spark.createDataFrame(catalogue, "doi string, title string")).collect()
    want = {}
    for k, m in enumerate(mine):
        p = " ".join("".join(c if c.isalnum() else " " for c in (m or "").lower()).split())
        best = []
        for doi, b in catalogue:
            if p and b and doi:
                x, y = set(p.split()), set(b.split())
                j, d = len(x & y) / len(x | y), 1 - _distance(p, b) / max(len(p), len(b))
                if j >= titles.LEAST and d >= titles.ALIKE:
                    best.append((-round(j, 6), -round(d, 6), doi))
        want[k] = min(best, default=None)
    assert {r.id: (r._doi, r.similarity) for r in got} == {k: (w[2], -w[0]) if w else (None, None) for k, w in want.items()}
    assert sum(w is not None for w in want.values()) > 40 and all(r.doi == "own" for r in got)


# -- text index --------------------------------------------------------------------------------------------------------


def test_an_index_answers_as_the_scans_do(spark):
    r = random.Random(9)
    words = ["the", "thing", "THE", "ing", "of", "offthe", "bring", "a-the", "then", "é", "x", "", "of the"]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for k in range(120)] + [(500, None), (501, ""), (502, "the")]
    df = spark.createDataFrame(rows, "key int, text string")
    index = text_index.TextIndex(spark, shared_dir(spark), buckets=7).append(df.filter("key % 2 = 0"), "key", "text").append(df.filter("key % 2 = 1"), "key", "text")
    ids = lambda x: sorted(r.key for r in x.collect())
    for q in ("the", "ing", "of the", "e th", "x  of", "é", "nothing"):
        assert ids(index.substring(q)) == ids(df.filter(search.substring(q, "text"))), q
        if " " not in q:
            assert ids(index.word_start(q)) == ids(df.filter(search.word_start(q, "text"))), q
    for qs in (["the", "thing"], ["ing", "the", "the"], ["of the", "bring"], ["th", "the"], ["thing", "of the"]):
        assert ids(index.ordered(qs)) == ids(df.filter(search.ordered(qs, "text"))), qs
        assert ids(index.all_substrings(qs)) == ids(df.filter(search.all_substrings(qs, "text"))), qs
    assert ids(index.any_phrase(["of the", "THE"], df, "key", "text")) == ids(df.filter(search.any_phrase(["of the", "THE"], "text")))


# -- selectors ---------------------------------------------------------------------------------------------------------

PAGE = """<div class="a b"><div>one <div class="c">two</div> three</div> four</div><ul class=k><li>x<li><b>y</b></ul>
<a class="doi" href="h&amp;1">L</a><span class="c">five<br>six</span><script>var a = "<div class='c'>no</div>";</script><p>p1<p>p2"""


@pytest.mark.parametrize(("path", "want"), [
    ("div.a", ["one two three four"]), ("div.a.b > div", ["one two three"]), ("div .c", ["two"]), (".c", ["two", "five six"]), ("ul.k > li", ["x", "y"]), ("ul b", ["y"]), ("a.doi@href", ["h&1"]), ("a[class=doi]", ["L"]), ("p", ["p1", "p2"]), ("div > .c", ["two"]), ("div.a > .c", []), ("* > div > div", ["two"]), ("[href]", ["L"]),
])
def test_selectors(path, want):
    assert selectors.select(PAGE, [selectors.Selector(path)], [None])[0] == want


@pytest.mark.parametrize("path", ["", "div >", "a@b c", "!", "div..x"])
def test_what_is_no_selector(path):
    with pytest.raises(ValueError, match="selector"):
        selectors.Selector(path)


def test_selectors_of_broken_pages(spark):
    r = random.Random(1)
    cuts = ["<![a[x]]>", "<![", "<!", "</", "<div", "<div class='c", "&#", "\x00", "<svg/>", "</div></div>"]
    pages = [PAGE[: r.randrange(len(PAGE))] + r.choice(cuts) + PAGE[r.randrange(len(PAGE)) :] for _ in range(200)] + [None, "", "<div>" * 20_000 + "x"]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    got = df.select(selectors.selected("html", every={"c": ".c", "d": "div div"}, first={"a": "div.a"}).alias("x")).collect()
    assert len(got) == 203 and got[200].x.asDict() == {"c": [], "d": [], "a": ""}


def test_nested_elements_of_landed_pages(spark):
    html = '<h3 class="title">T</h3><div class="abstract-content"><div>A <div>b</div></div> c</div><div class="keywords"><div><span>k <span>m</span></span></div></div><div class="citation-ref"><div>x</div><i>J</i> 2001</div>'
    r = landed.hal(spark.createDataFrame([(html,)], "html string")).first()
    assert (r.title, r.abstract, r.journal, r.year) == ("T", "A b c", "J", 2001)


# -- requests ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def server():
    seen: collections.Counter = collections.Counter()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            seen[self.path] += 1
            if self.path.startswith("/busy") and seen[self.path] < 3:
                self.send_response(503)
            elif self.path == "/never":
                self.send_response(503)
            elif self.path == "/gone":
                self.send_response(404)
            elif self.path == "/reset":
                self.connection.close()
                return
            elif self.path == "/slow":
                threading.Event().wait(1.5)
                self.send_response(200)
            else:
                self.send_response(200)
            self.end_headers()
            try:
                self.wfile.write(f"{self.command} {self.path}".encode())
            except OSError:
                pass

        do_POST = do_PUT = do_DELETE = do_GET  # noqa: N815

        def log_message(self, *args):
            pass

    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}", seen
    own.shutdown()


def test_requests_wait_and_a_restart_asks_the_rest(spark, server):
    base, seen = server
    paths = ["ok1", "ok2", "busy1", "busy2", "gone", "reset", "slow", "never"]
    df = spark.createDataFrame([(p, f"{base}/{p}") for p in paths] + [("ok1", f"{base}/zz"), (None, f"{base}/null"), ("bad", "no address")], "key string, url string")
    ledger, manners = shared_dir(spark), fetching.Manners(at_once=4, pause=0.0, tries=3, wait=0.05, timeout=0.5)
    got = {r.key: r for r in fetching.fetch(df, ledger, manners).collect()}
    assert {k: r.status for k, r in got.items()} == {"ok1": 200, "ok2": 200, "busy1": 200, "busy2": 200, "gone": 404, "reset": 0, "slow": 408, "never": 503, "bad": 0}
    assert got["busy1"].tries == 3 and got["busy1"].answer == "GET /busy1" and not got["never"].final and got["gone"].final and got["bad"].final
    assert not seen["/null"] and not seen["/zz"] and seen["/ok1"] == 1 and seen["/never"] == 3
    again = {r.key: r for r in fetching.fetch(df, ledger, manners).collect()}
    assert seen["/ok1"] == 1 and seen["/busy1"] == 3 and seen["/gone"] == 1 and seen["/never"] == 6
    assert again["ok2"].status == 200 and len(again) == 9


def test_a_hosts_rate_holds(server):
    base, _ = server
    answers = list(fetching.Manners(at_once=4, pause=0.1).ask([(str(k), f"{base}/rate{k}", None) for k in range(6)]))
    assert len(answers) == 6 and max(a[8] for a in answers) - min(a[8] for a in answers) >= 0.35


def test_the_four_verbs(server):
    rest = fetching.Rest(server[0])
    assert [rest.get("v")[1], rest.post("v", b"x")[1], rest.put("/v", b"x")[1], rest.delete("v")[1]] == [b"GET /v", b"POST /v", b"PUT /v", b"DELETE /v"]
    assert rest.get("gone")[0] == 404


# -- archives ----------------------------------------------------------------------------------------------------------


def test_records_of_archives(spark, tmp_path):
    xml = "<article><article-id pub-id-type='doi'>10.1/{0}</article-id><article-title>On {0}</article-title><abstract><p>Text {0}</p></abstract></article>"
    for a in range(2):
        with zipfile.ZipFile(tmp_path / f"a{a}.zip", "w", zipfile.ZIP_DEFLATED if a else zipfile.ZIP_STORED) as z:
            z.writestr("content/", "")
            for k in range(7):
                z.writestr(f"content/{a}{k}.xml", xml.format(f"{a}{k}") if k else "")
            z.writestr("mimetype", "x")
    (tmp_path / "other.txt").write_text("no archive")
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    every = archives.zip_entries(spark, str(tmp_path), per_partition=3)
    assert every.count() == 16 and {r.size for r in every.filter("name like '%0.xml'").collect()} == {0}
    got = archives.biorxiv_archive(spark, str(tmp_path)).collect()
    assert {(r.doi, r.title, r.abstract) for r in got} == {(f"10.1/{a}{k}", f"On {a}{k}", f"Text {a}{k}") for a in range(2) for k in range(1, 7)}
    assert {r.name for r in archives.zip_entries(spark, str(tmp_path / "a1.zip"), ".xml").filter("name = 'content/13.xml'").collect()} == {"content/13.xml"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = archives.zip_entries(spark, str(tmp_path)).filter("name = 'content/13.xml'")
        assert [bytes(r.content)[:9] for r in pushed.collect()] == [b"<article>"] and pushed.filter("size > 5").count() == 1
        assert archives.zip_entries(spark, str(tmp_path)).filter("startswith(name, 'content/1')").count() == 7
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    (tmp_path / "bad.zip").write_bytes(io.BytesIO(b"PK nothing").getvalue())
    with pytest.raises(Exception, match="no archive"):
        archives.zip_entries(spark, str(tmp_path)).count()


# -- zones -------------------------------------------------------------------------------------------------------------


def test_a_key_that_moves_leaves_its_old_partition(spark):
    zone = zones.Zone(spark, shared_dir(spark), "z", ("database",))
    make = lambda *rows: spark.createDataFrame(rows, "id int, database string, v int")
    zone.write(make((1, "de", 1), (2, "en", 1), (3, "fr", 1), (4, None, 1), (5, "en", 1)))
    zone.upsert(make((1, "en", 2), (4, "fr", 2), (6, "es", 2)), "id")
    held = lambda: sorted((r.id, r.database, r.v) for r in zone.read().collect())
    assert held() == [(1, "en", 2), (2, "en", 1), (3, "fr", 1), (4, "fr", 2), (5, "en", 1), (6, "es", 2)]
    assert {r.database for r in zone.elements().collect()} == {"en", "fr", "es"} and zone.read(database="de").count() == 0


def test_removing_a_partition_touches_no_other(spark):
    zone = zones.Zone(spark, shared_dir(spark), "z", ("database",))
    zone.write(spark.createDataFrame([(1, "a b/c", 1), (2, "en", 1), (3, "fr", 1)], "id int, database string, v int"))
    files = lambda d: {r[0] for r in zone.read(database=d).select("_metadata.file_path").collect()}
    before = files("en") | files("fr")
    zone.remove(database="a b/c")
    assert files("en") | files("fr") == before and sorted(r.id for r in zone.read().collect()) == [2, 3]
    zone.compact()
    assert sorted(r.id for r in zone.read().collect()) == [2, 3]
    zone.remove(database="en")
    zone.upsert(spark.createDataFrame([(9, "en", 5)], "id int, database string, v int"), "id")
    assert sorted((r.id, r.v) for r in zone.read().collect()) == [(3, 1), (9, 5)]
