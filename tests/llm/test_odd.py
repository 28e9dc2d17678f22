"""Values under repeated rows, null ids, nulls, clashing columns and very long texts, against plain versions."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import decontam, fingerprint, fm_dedup, html_extract, line_dedup, near_dedup, packing, suffix_dedup, toxicity, warc

from .test_operators import BENCH, TEXTS

ROWS = [(5, TEXTS[9]), (5, TEXTS[9]), (5, TEXTS[40]), (None, TEXTS[9]), (None, None), (7, TEXTS[9]), (8, TEXTS[41]), (8, TEXTS[41]), (9, ""), (-3, TEXTS[18])]
#: Names that the operators' own columns have.
CLASH = ("bucket", "row_key", "spans", "start", "length", "h1", "h2", "bands", "node", "label", "grp", "set", "size", "n_lines", "_lost", "_id", "batch", "score", "half", "y", "id", "unit", "copies", "copy", "word", "n")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("doc_id", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)], "text", F.lit("x").alias("TEXTS"))


def _removed(units, window: int, join) -> list[tuple]:
    first: dict = {}
    for d, t in ROWS:
        if d is not None:
            u = units((t or "").encode())
            for i in range(len(u) - window + 1):
                k = u[i : i + window] if isinstance(u, bytes) else tuple(u[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in ROWS:
        u = units((t or "").encode())
        gone = np.zeros(len(u), bool)
        if d is not None:
            for i in range(len(u) - window + 1):
                if first[u[i : i + window] if isinstance(u, bytes) else tuple(u[i : i + window])] < d:
                    gone[i : i + window] = True
        out.append((d, len(u), int(gone.sum()), join([x for x, g in zip(u, gone, strict=True) if not g])))
    return out


def _same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_suffix_dedup(docs):
    got = [(r.doc_id, r.n_units, r.n_removed, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs).collect()]
    _same(got, _removed(lambda b: b, 50, bytes))
    assert sum(x[2] for x in got) > 500


def test_substring_dedup(docs):
    got = [(r.doc_id, r.n_units, r.n_removed, bytes(r.kept)) for r in fm_dedup.substring_dedup(docs).collect()]
    _same(got, _removed(lambda b: b.split(), 13, b" ".join))


def test_near_dedup(docs):
    words = [((t or "").lower().split()) for _, t in ROWS]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in words]
    root = list(range(len(ROWS)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(ROWS)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    named: dict = {}
    for k, (d, _) in enumerate(ROWS):
        if d is not None:
            named[find(k)] = min(named.get(find(k), d), d)
    # One id may stand in several components; each row has that of its own text.
    want = [(d, len(s), named.get(find(k), d)) for k, ((d, _), s) in enumerate(zip(ROWS, sets, strict=True))]
    _same([(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()], want)
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    _same([(r.doc_id, r.text) for r in kept.collect()], [r for r, w in zip(ROWS, want, strict=True) if w[0] == w[2]])


def test_packing(docs):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(str(public.path(packing.TOKENIZER)))
    want = []
    for d, t in ROWS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes()), len(ids)) for s in range(0, len(ids), 64)]
    got = packing.pack(docs, size=64).collect()
    _same([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got], want)
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for x in held.values():
        x.sort()
        assert [o for o, _ in x] == [0, *np.cumsum([n for _, n in x])[:-1].tolist()] and sum(n for _, n in x) <= 64


def test_many_equal_rows_are_dealt_to_many_groups(spark):
    df = spark.createDataFrame([(1, "a b c")] * 4000, "doc_id long, text string")
    got = packing.pack(df, size=16, group_docs=100).withColumn("g", F.shiftright("sequence_id", 32))
    n = [r["count"] for r in got.groupBy("g").count().collect()]
    assert sum(n) == 4000 and len(n) > 30 and max(n) < 250


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(k % 12 - 3, int(k % 2), 7, "z") for k in range(40)] + [(None, 1, 7, "z"), (5, None, 7, "z")], "doc_id long, toxic int, id int, half string")
    got = toxicity.scored(docs, toxicity.fit(docs, labels), score_col="own_score").collect()
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r.text or ""].add(r.own_score)
    assert len(got) == len(ROWS) and all(len(v) == 1 and 0 <= min(v) <= 1 for v in by_text.values())
    assert toxicity.clean_only(docs, labels).columns == docs.columns


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(i, t, "q", 3) for i, t in BENCH], "item_id long, text string, word string, n int")

    def numbers(a, b):
        seen: dict = {}
        return tuple([seen.setdefault(w, len(seen)) for w in decontam.words(x)] for x in (a, b))

    def best(a: list, b: list) -> int:
        row, top = [0] * (len(b) + 1), 0
        for x in a:
            new = [0] * (len(b) + 1)
            for j, y in enumerate(b):
                new[j + 1] = max(0, row[j] + (decontam.MATCH if x == y else decontam.MISMATCH), row[j + 1] + decontam.GAP, new[j] + decontam.GAP)
                top = max(top, new[j + 1])
            row = new
        return top

    want = [(d, i) for d, t in ROWS for i, b in BENCH if b and best(*numbers(b, t)) >= decontam.MIN_SCORE * decontam.MATCH * len(decontam.words(b))]
    own = [*ROWS, (30, TEXTS[30])]
    want += [(30, i) for i, b in BENCH if b and best(*numbers(b, TEXTS[30])) >= decontam.MIN_SCORE * decontam.MATCH * len(decontam.words(b))]
    df = docs.unionByName(spark.createDataFrame(own[-1:], "doc_id long, text string").select("doc_id", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)], "text", F.lit("x").alias("TEXTS")))
    _same([(r.doc_id, r.item_id) for r in decontam.contaminated(df, items).collect()], want)
    assert (30, 4) in want and decontam.uncontaminated(df, items).columns == df.columns


PAGES = [(1, "u", "a"), (1, "u", "a"), (2, None, "a"), (None, "u", "a"), (3, "u", None), (None, None, None), (4, "v", "b"), (4, "v", "cc")]


def _pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").select("page_id", *[F.lit(k).alias(c) for k, c in enumerate(("sha", "last", "revisit", "payload", "_page", "_sha", "text", "n_chars"))], "url", "html")


def test_archives(spark, tmp_path):
    got = warc.read_archives(warc.write_archives(_pages(spark), f"file://{tmp_path}")).collect()
    last = {"a": 2, "": 3, "b": 4, "cc": 4}
    want = []
    for p, u, h in PAGES:
        raw = (h or "").encode()
        again = p != last[h or ""]
        want.append((p, u, "revisit" if again else "response", None if again else raw, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), last[h or ""] if again else None))
    _same([(r.page_id, r.url, r.record_type, None if r.payload is None else bytes(r.payload), r.payload_bytes, r.payload_digest, r.refers_to) for r in got], want)


def test_main_text_of_odd_pages(spark):
    got = html_extract.extract(_pages(spark)).collect()
    assert sorted(((r.page_id or 0, r.url or "") for r in got)) == sorted((p or 0, u or "") for p, u, _ in PAGES)
    assert all(r.n_chars == len(r.text) for r in got) and all(r.text == "" for r in got if r.page_id == 3)


def test_deep_pages_and_long_classes():
    crf = html_extract.model()
    deep = "<div>" * 3000 + "<article><p>It is the text of this page, as it stands here.</p></article>" + "</div>" * 3000
    assert html_extract.main_text(f"<html><body>{deep}</body></html>", crf)
    many = " ".join(f"a{k}" for k in range(30)) + " advertisement"
    blocks = html_extract.blocks_of(f'<div class="{many}">x</div>')
    assert any(f == "has=advertisement" for f in html_extract.features(blocks)[0])


@pytest.mark.parametrize("page", ["<div>x" * 50_000, "".join(f'<div class="k{k} content">x' for k in range(20_000)), "<p class='" + "a b " * 50_000 + "'>" + "<i>y</i><p>" * 3000])
def test_depth_costs_no_more_than_length(page):
    crf, began = html_extract.model(), time.process_time()
    html_extract.main_text(page, crf)
    assert time.process_time() - began < 20


BROKEN = ["<![foo[y]]>", "<![ 1 >", "<![", "<!", "<!-", "<!--", "<![CDATA[x", "</", "<?", "<a <b", "<![if x]>t<![endif]>", "&#x", "&", "]]>", "\x00", "<svg><path>", "<noscript>", "<b a='"]


def test_broken_markup_ends_no_job(spark):
    r = random.Random(2)
    pages = [html_extract._page(r) for _ in range(20)]
    rows = [(k, "u", b) for k, b in enumerate(BROKEN)]
    for k in range(300):
        p = r.choice(pages)
        a, b = r.randrange(len(p)), r.randrange(len(p))
        rows.append((100 + k, "u", p[:a] + r.choice(BROKEN) + p[b:]))
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(x.text is not None for x in got)


@pytest.mark.parametrize("left_open", ["<svg><path d='1'>", "<noscript>off", "<object>none", "<![endif]>"])
def test_an_element_left_open_swallows_no_article(left_open):
    page = f"<body><nav><a href=/>Home</a></nav>{left_open}<article><h1>The title of it</h1><p>It is the text of this page, as it stands here, with words.</p></article></body>"
    assert html_extract.main_text(page, html_extract.model()).endswith("The title of it\n\nIt is the text of this page, as it stands here, with words.")


def test_very_long_texts(spark):
    words = [f"w{k * 7919 % 100_003}x" for k in range(200_000)]
    long = " ".join(words)  # over a million characters
    blank = " " * 1_200_000
    rows = [(1, long), (2, long), (3, blank), (4, "\n".join([" ".join(words[:30])] * 5000)), (5, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(df).collect()}
    assert got[2].n_removed == len(long) and got[1].n_removed == 0 and got[3].n_units == 1_200_000
    got = {r.doc_id: r for r in fm_dedup.substring_dedup(df).collect()}
    assert got[2].n_removed == 200_000 and got[1].n_removed == 0 and got[3].n_units == 0 and got[4].n_removed > 100_000
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df).collect()}
    assert got[2].component_id == 1 and got[3].n_shingles == 0 and got[4].component_id == 4
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[4].n_lines == 5000 and all(r.n_dropped == 0 for r in got.values())
    pieces = packing.pack(df).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert all(r.n == r.t for r in pieces) and len(pieces) == 5
    assert fingerprint.digest(long.encode()) == fingerprint.digest(long.encode())
