"""The corpus queries over small tables with nulls, empty and long texts, ties, repeats and clashing columns, against plain versions."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm import decontam, fingerprint, html_extract, line_dedup, near_dedup, packing, queries, suffix_dedup, suffix_sort, toxicity, warc
from quillmill.llm.common import settle
from quillmill.llm.components import components

BAD = ["idiot", "scum", "moron", "trash"]


def _texts(n: int = 260) -> list:
    r = random.Random(8)
    vocab = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiouéü") for _ in range(r.randint(1, 3))) for _ in range(300)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    base, passage, line = say(150), say(60), say(12)
    out: list = [None, "", " \n\t ", "a", "one two", "x" * 49, "x" * 50, "y" * 200, say(9000), base, base, base]
    for k in range(n - len(out)):
        t = say(r.choice([5, 30, 80, 150]))
        if k % 9 == 0:
            t = " ".join(w if r.random() > 0.02 else r.choice(vocab) for w in base.split())
        if k % 7 == 0:
            t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        if k % 5 == 0:
            t = f"{say(8)}\n {line.upper() if k % 2 else line}\t\n{t}\n{line}"
        if k % 4 == 1:
            own = t.split(" ")
            for _ in range(4):
                own.insert(r.randint(0, len(own)), r.choice(BAD))
            t = " ".join(own)
        out.append(t)
    return out


TEXTS = _texts()
BENCH = [(1, " ".join(TEXTS[8].split()[100:140])), (2, None), (3, ""), (4, " ".join(TEXTS[30].split()[:25])), (4, " ".join(TEXTS[30].split()[:25])), (None, "ba de fo gu ki lo mu")]
HTML = [None, "", "<p>", *(f"<html><body><nav><a href=/>{k}</a></nav><article><p>Text {k % 4} of the page, with more words in it.</p></article></body></html>" for k in range(20))]


def _write(path, docs: list[tuple], pages=True):
    cols = {"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs], pa.string()), "lang": pa.array(["en"] * len(docs)), "source": pa.array([None] * len(docs), pa.string()), "n_chars": pa.array([len(d[1] or "") for d in docs], pa.int64())}
    cols |= {k: pa.array([1] * len(docs), pa.int64()) for k in ("n_lines", "score", "bucket", "spans", "row_key", "component_id", "h1", "_lost", "word", "run", "node")}
    pq.write_table(pa.table(cols), path / "documents.parquet", row_group_size=50)
    toxic = [int(any(b in (d[1] or "") for b in BAD)) for d in docs]
    pq.write_table(pa.table({"doc_id": cols["doc_id"], "quality": pa.array([1] * len(docs), pa.int32()), "toxic": pa.array([None if k % 50 == 3 else t for k, t in enumerate(toxic)], pa.int32())}), path / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([b[0] for b in BENCH], pa.int64()), "text": pa.array([b[1] for b in BENCH], pa.string())}), path / "benchmark.parquet")
    html = HTML if pages else []
    pq.write_table(pa.table({"page_id": pa.array(range(len(html)), pa.int64()), "url": pa.array([None if k == 1 else f"http://a.org/{k}" for k in range(len(html))], pa.string()), "html": pa.array(html, pa.string())}), path / "pages.parquet")
    r = random.Random(len(docs))
    talks = [(c, None if t == 9 else t, r.choice(["user", None, "bot"]), r.choice(["x", "yy", "", None, "zé"])) for c in (*range(40), 100, 101, 150, 230, -7) for t in r.sample(range(10), r.choice([1, 3, 6]))] if docs else []
    clash = {k: pa.array([1] * len(talks), pa.int64()) for k in ("keys", "block", "at", "turns", "l", "v")}
    pq.write_table(pa.table({"conv_id": pa.array([t[0] for t in talks], pa.int64()), "turn": pa.array([t[1] for t in talks], pa.int64()), **{c: pa.array([t[k] for t in talks], pa.string()) for k, c in ((2, "role"), (3, "text"))}, **clash}), path / "conversations.parquet")
    sold = [(s, i) for s in (None, *range(90)) for i in r.sample([None, *range(8)], r.randint(0, 6)) for _ in range(r.choice([1, 1, 2]))] if docs else []
    clash = {k: pa.array([1] * len(sold), pa.int64()) for k in ("basket", "item", "s", "part", "tail", "support")}
    pq.write_table(pa.table({"sale_id": pa.array([x[0] for x in sold], pa.int64()), "item_id": pa.array([x[1] for x in sold], pa.int64()), "flag": pa.array([None] * len(sold), pa.string()), **clash}), path / "sale_lines.parquet")
    return str(path)


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    return _write(tmp_path_factory.mktemp("sf"), list(enumerate(TEXTS)))


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Repeated rows, null ids, equal ids with different texts."""
    docs = [(5, TEXTS[9]), (5, TEXTS[9]), (5, TEXTS[40]), (None, TEXTS[9]), (None, None), (7, TEXTS[9]), (8, TEXTS[41]), (8, TEXTS[41])]
    return _write(tmp_path_factory.mktemp("odd"), docs)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return _write(tmp_path_factory.mktemp("empty"), [], pages=False)


def run(spark, name: str, sf_dir: str):
    return queries.queries()[name](spark, sf_dir).toPandas()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty, name):
    assert len(run(spark, name, empty)) == 0


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"op8_decontamination", "op6_packing", "op9_html_extract", "op10_warc", "op12_prefix_trie", "op13_itemsets"}))
def test_repeated_rows_and_null_ids(spark, odd, name):
    got = run(spark, name, odd)
    assert len(got) == 8 and got.doc_id.isna().sum() == 2


def test_op1(spark, sf):
    got = run(spark, "op1_fingerprint", sf).set_index("doc_id")
    texts = [t or "" for t in TEXTS]
    for k, t in enumerate(texts):
        new = fingerprint.edited(t, texts[(k + 1) % len(texts)])
        r = got.loc[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == fingerprint.digest(t.encode()).hex() and r.edited_fingerprint == fingerprint.digest(new.encode()).hex()
        assert r.near_next == fingerprint.likeness(fingerprint.digest(t.encode()), fingerprint.digest(texts[(k + 1) % len(texts)].encode()))


def test_op2(spark, sf):
    got = run(spark, "op2_toxicity", sf).set_index("doc_id")
    assert got.score.between(0, 1).all() and len(got) == len(TEXTS)
    for k in got.index:
        assert got.held_out[k] == (zlib.crc32(str(k).encode()) % 3 == 1) and got.predicted[k] == int(got.score[k] >= 0.7)


@pytest.mark.parametrize(("size", "recall", "least_auc"), [("sf0.01", 0.6, 0.93), ("sf0.1", 0.9, 0.98)])
def test_op2_learns_on_the_given_tables(spark, size, recall, least_auc):
    d = f"/root/testdata/{size}"
    got = run(spark, "op2_toxicity", d).merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    a, b = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    auc = np.mean((a[:, None] > b[None, :]) + 0.5 * (a[:, None] == b[None, :]))
    assert auc > least_auc and (a >= 0.7).mean() >= recall and not (b >= 0.7).any()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_answer_as_their_sql_does(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "sale_lines"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = run(spark, name, sf), con.sql(queries.oracle_sql()[name]).df()
    plain = lambda v: None if v is None or v != v else v
    key = lambda d: sorted(([plain(v) for v in r] for r in d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).itertuples(index=False, name=None)), key=repr)
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)
    assert name != "op3_line_dedup" or got.n_dropped.sum() > 20


def test_line_runs_are_compacted_and_tell_new_lines(spark):
    make = lambda *rows: spark.createDataFrame(rows, "h1 long, h2 long, doc_id long")
    for fanout in (2, 3):
        runs = line_dedup.LineRuns(spark, 4, fanout)
        assert {tuple(r) for r in runs.add(make((1, 1, 20), (1, 1, 21), (2, 2, 20))).collect()} == {(1, 1, 2, 21), (2, 2, 1, 20)}
        assert {tuple(r) for r in runs.add(make((2, 2, 10), (3, 3, 10))).collect()} == {(2, 2, 1, None), (3, 3, 1, 10)}  # known lines name no holder
        runs.add(make())
        runs.add(make((1, 1, 5), (3, 3, 6), (4, 4, 6)))
        assert [len(level) for level in runs.levels] == ([0, 0, 1] if fanout == 2 else [1, 1])
        assert {tuple(r) for r in runs.totals().collect()} == {(1, 1, 3, 21), (2, 2, 2, 20), (3, 3, 2, 10), (4, 4, 1, 6)}


def test_old_runs_are_neither_shuffled_nor_sorted_again(spark):
    rows = [(k * 2654435761 % 2**40, k, k % 50) for k in range(2000)]
    make = lambda part: spark.createDataFrame(part, "h1 long, h2 long, doc_id long")
    runs = line_dedup.LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs.add(make(rows[:1200]))
    batch = make(rows[800:]).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    held = {k: spark.conf.get(k) for k in (line_dedup.ORDERED, "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set(line_dedup.ORDERED, "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = runs.fresh(batch)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1  # the new batch's


def test_hot_lines_and_few_take_the_same_way(spark, sf, monkeypatch):
    want = run(spark, "op3_line_dedup", sf)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 1)  # nothing is hot
    assert run(spark, "op3_line_dedup", sf).sort_values("doc_id").values.tolist() == want.sort_values("doc_id").values.tolist()


def test_lines_of_repeated_rows_and_null_ids(spark):
    line = "a line that is long enough to be looked at by the rule, surely"
    docs = [(k, line + "\nown %d" % k) for k in range(3)] + [(2, line + "\nagain")] * 4 + [(None, line)] * 9 + [(9, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(df).collect())  # three documents, however many rows
    got = line_dedup.dedup_lines(df, min_docs=3).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped) for r in got) == sorted([("0", 2, 1), ("1", 2, 1)] + [("2", 2, 0)] * 5 + [("None", 1, 0)] * 9 + [("9", 1, 0)])


def _removed(units, window: int, join):
    first, out = {}, {}
    for d, t in enumerate(TEXTS):
        u = units((t or "").encode())
        gone = np.zeros(len(u), bool)
        keys = [u[i : i + window] if isinstance(u, bytes) else tuple(u[i : i + window]) for i in range(len(u) - window + 1)]
        for i, k in enumerate(keys):
            if first.get(k, d) < d:
                gone[i : i + window] = True
        for k in keys:
            first.setdefault(k, d)
        runs = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out[d] = (len(u), int(gone.sum()), runs, hashlib.sha256(join([x for x, g in zip(u, gone, strict=True) if not g])).hexdigest())
    return out


def test_op4(spark, sf):
    got, want = run(spark, "op4_suffix_dedup", sf), _removed(lambda b: b, 50, bytes)
    assert {r[0]: r[1:] for r in got[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)} == want
    assert got.n_removed.sum() > 5000


def test_op7(spark, sf):
    got, want = run(spark, "op7_substring_dedup", sf), _removed(lambda b: b.split(), 13, b" ".join)
    assert {r[0]: r[1:] for r in got[["doc_id", "n_words", "n_removed", "kept_sha256"]].itertuples(index=False, name=None)} == {d: (a, b, e) for d, (a, b, _, e) in want.items()}
    assert got.n_removed.sum() > 500


def test_hot_anchors_are_taken_window_by_window(spark, sf, monkeypatch):
    from quillmill.llm import anchors

    monkeypatch.setattr(anchors, "HOT_SEGMENTS", 1)
    got = suffix_dedup.op4_suffix_dedup(spark, sf).toPandas().set_index("doc_id")
    want = _removed(lambda b: b, 50, bytes)
    assert {d: (got.n_removed[d], got.kept_sha256[d]) for d in got.index} == {d: (b, e) for d, (_, b, _, e) in want.items()}


def _components(width: int, percent: int) -> dict:
    sets = []
    for t in TEXTS:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def test_op5(spark, sf):
    got = run(spark, "op5_near_dedup", sf)
    want = _components(3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want
    assert (got.kept == (got.doc_id == got.component_id)).all() and (~got.kept).sum() > 10


def test_different_texts_under_one_id_are_each_compared(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    docs = spark.createDataFrame([(1, a), (1, b), (2, b + " x"), (3, a + " x"), (4, "c d e f"), (None, a), (5, None), (5, None)], "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, width=3, percent=85).collect()
    assert sorted(((r.doc_id or 0, r.component_id, r.kept) for r in got), key=repr) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (0, 1, False), (5, 5, True), (5, 5, True)], key=repr)


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(400, 400 + k) for k in range(1, 90)] + [(k, k + 1) for k in range(600, 640)] + [(7, 7), (None, 3), (3, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in links:
        if None not in (x, y) and x != y:
            a, b = sorted((find(x), find(y)))
            root[b] = a
    df = spark.createDataFrame(links * 2, "a long, b long").withColumn("label", F.lit(1))
    assert {n: x for n, x in components(df).collect()} == {n: find(n) for n in root}
    assert components(df.filter("a < 0")).count() == 0


def test_near_dedup_in_blocks(spark, sf):
    """Groups larger than a block give the same components."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = near_dedup.near_duplicates(docs, width=3, percent=85, block=6).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == _components(3, 85)


def test_near_dedup_at_five_words(spark, sf):
    """The stage's rule, against all pairs."""
    got = near_dedup.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == _components(5, 80)


def test_op6(spark, sf):
    public_tokenizers, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    got = run(spark, "op6_packing", sf)
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    for doc, own in got.groupby("doc_id"):
        ids = np.array([*library.encode(TEXTS[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        own = own.sort_values("start")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()] and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))
    assert set(got.doc_id) == set(range(len(TEXTS)))
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *np.cumsum(seq.length)[:-1].tolist()] and seq.length.sum() <= 2048
    assert got.length.sum() / (2048 * got.sequence_id.nunique()) > 0.95


def test_op8(spark, sf):
    got = run(spark, "op8_decontamination", sf)
    pairs = {(r.doc_id, r.item_id) for r in got.itertuples()}
    assert {(8, 1), (30, 4)} <= pairs and not {2, 3} & {i for _, i in pairs}
    truth = {(d, i) for d, t in enumerate(TEXTS) for i, b in BENCH if i and b and decontam.align(*_numbers(b, t))[0] >= len(decontam.words(b))}
    assert pairs == truth
    assert len(got) == sum(1 + (i == 4) for _, i in truth)  # the item that stands twice


def _numbers(a: str, b: str | None):
    seen: dict = {}
    return tuple(np.array([seen.setdefault(w, len(seen)) for w in decontam.words(x)], np.int64) for x in (a, b))


def test_decontamination_in_blocks_of_items(spark, sf, monkeypatch):
    want = run(spark, "op8_decontamination", sf)
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 2)
    got = run(spark, "op8_decontamination", sf)
    key = ["doc_id", "item_id", "start_word", "end_word"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, want[key].values.tolist()))


def test_op9(spark, sf):
    got = run(spark, "op9_html_extract", sf).set_index("page_id")
    crf = html_extract.model()
    for k, h in enumerate(HTML):
        assert got.text[k] == html_extract.main_text(h, crf) and got.n_chars[k] == len(got.text[k])
    assert got.text[10] == "Text 3 of the page, with more words in it."


@pytest.mark.parametrize("least", [0, 10])
def test_op10(spark, sf, least, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    a = warc.write_archives(pages, f"file://{tmp_path}", min_bytes=least, archive_bytes=2000)
    got = {r.page_id: r for r in warc.read_archives(a).collect()}
    last = {}
    for k, h in enumerate(HTML):
        last[h or ""] = k
    for k, h in enumerate(HTML):
        p, r = (h or "").encode(), got[k]
        again = len(p) >= least and last[h or ""] != k
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", last[h or ""] if again else None)
        assert r.payload is None if again else bytes(r.payload) == p


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    kept = settle(corpus_pipeline.drop_toxic(spark, docs, sf))
    assert kept.columns == docs.columns
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, s in scores.items() if s < 0.7}

    lines = settle(corpus_pipeline.drop_lines(spark, kept, sf))
    assert lines.columns == docs.columns
    count, last = collections.Counter(), {}
    rows = {r.doc_id: r.text or "" for r in kept.collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    for d, t in sorted(rows.items()):
        for k in {key(x) for x in t.split("\n")}:
            count[k] += 1
            last[k] = d
    want = {d: "\n".join(x for x in t.split("\n") if len(key(x)) < 40 or count[key(x)] < 5 or last[key(x)] == d) for d, t in rows.items()}
    assert {r.doc_id: r.text for r in lines.collect()} == want and all(r.n_chars == len(r.text) for r in lines.collect())

    near = settle(corpus_pipeline.drop_near_copies(spark, lines, sf))
    assert near.columns == docs.columns
    found = near_dedup.near_duplicates(lines).collect()
    assert {r.doc_id for r in near.collect()} == {r.doc_id for r in found if r.component_id == r.doc_id}

    clean = settle(corpus_pipeline.drop_leaks(spark, near, sf))
    hits = {r.doc_id for r in decontam.contaminated(near, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect()} - hits and hits

    packed = corpus_pipeline.pack(spark, clean, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.collect()}


def test_pipeline_run(spark, sf, empty):
    got = corpus_pipeline.run(spark, sf)
    assert got.agg(F.count("*")).first()[0] > 0 and "sequence_id" in got.columns
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_is_registered():
    import __spark_entry__ as e

    assert "pipeline" in e.queries() and set(queries.queries()) <= set(e.queries())


def test_all_suffixes_in_one_distributed_order(spark):
    r = random.Random(5)
    docs = [(k // 2 if k < 4 else k, "".join(r.choice("ab") for _ in range(r.randint(0, 40)))) for k in range(30)] + [(40, None), (None, "abab" * 5), (41, "é" * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    raw = [(d, t.encode()) for d, t in docs if d is not None and t]
    rows = spark.createDataFrame(list(enumerate(t.decode() for _, t in raw)), "g long, text string")
    for depth in (2, 7, 50):
        rank = {(x.g, x.i): x.rank for x in suffix_sort.suffix_ranks(suffix_sort.units(rows), depth).collect()}
        order = sorted(rank, key=rank.get)
        cut = [raw[g][1][i : i + depth] for g, i in order]
        assert cut == sorted(cut) and len(rank) == sum(len(t) for _, t in raw)
    first: dict = {}
    for d, t in raw:
        for i in range(len(t) - 5):
            first[t[i : i + 6]] = min(first.get(t[i : i + 6], d), d)
    want = sorted((d, i) for d, t in raw for i in range(len(t) - 5) if first[t[i : i + 6]] < d)
    assert sorted((x.doc_id, x.i) for x in suffix_sort.shared_prefixes(df, 6).collect()) == want and len(want) > 400
    assert suffix_sort.shared_prefixes(df.filter("doc_id is null"), 6).count() == 0
