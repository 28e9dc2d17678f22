"""Parts of the corpus operators against plain versions."""

from __future__ import annotations

import io
import random
import zipfile
import zlib

import numpy as np
import pytest

from quillmill.llm import anchors, decontam, fingerprint, fm_dedup, html_extract, near_dedup, packing, suffix_dedup, toxicity, warc


def test_suffix_array():
    r = random.Random(3)
    for _ in range(400):
        s = np.array([r.randint(1, 3) for _ in range(r.randint(0, 40))], np.int64)
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_suffix_array_to_a_depth():
    r = random.Random(7)
    for _ in range(400):
        s = np.array([r.randint(1, 2) for _ in range(r.randint(0, 60))] * r.randint(1, 3), np.int64)
        for depth in (1, 2, 3, 4, 9, 10, 20):
            order = suffix_dedup.suffix_array(s, depth).tolist()
            assert sorted(order) == list(range(len(s)))
            cut = [s[i : i + depth].tolist() for i in order]
            assert cut == sorted(cut)


def test_order_by_many_and_wide_keys():
    r = np.random.default_rng(5)
    for most in (1, 3, 1 << 20, 1 << 40, 1 << 62):
        keys = [r.integers(0, most, 500) for _ in range(3)] + [r.integers(0, 3, 500)]
        order, new = suffix_dedup.order_by(*keys)
        rows = [tuple(int(k[i]) for k in keys) for i in order]
        assert rows == sorted(rows) and new.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(500)]
    assert len(suffix_dedup.order_by(np.zeros(0, np.int64))[0]) == 0


def test_shared_windows():
    r = random.Random(4)
    for _ in range(150):
        segs = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 8))]
        ids = np.array([r.randint(0, 5) for _ in segs])
        w = 4
        want = [any(segs[j][o : o + w] == g[p : p + w] for j in range(len(segs)) if ids[j] < ids[i] for o in range(len(segs[j]) - w + 1)) and p + w <= len(g) for i, g in enumerate(segs) for p in range(len(g))]
        assert suffix_dedup.shared_windows(segs, ids, w).tolist() == want
        assert fm_dedup.shared_windows([b" ".join(bytes([c]) for c in x) for x in segs], ids, w).tolist() == want


def test_fm_index_counts_and_statistics():
    r = np.random.default_rng(1)
    s = np.append(r.integers(1, 6, 500), 0)
    index = fm_dedup.FMIndex(s)
    ends = np.arange(1, 501)
    length, lo, hi = fm_dedup.statistics(index, s, ends, 4)
    text = s.tolist()
    for e, n, a, b in zip(ends.tolist(), length.tolist(), lo.tolist(), hi.tolist(), strict=True):
        assert n == min(4, e)
        assert b - a == sum(text[i : i + n] == text[e - n : e] for i in range(len(text) - n + 1))


def test_every_window_has_one_segment_with_its_content():
    r = random.Random(5)
    texts = [bytes(r.choice(b"abc ") for _ in range(r.choice([0, 5, 49, 50, 51, 300]))) for _ in range(30)]
    at = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    _, _, start, length = anchors.segments(data, at, 50, 20)
    held = sorted(p for s, n in zip(start.tolist(), length.tolist(), strict=True) for p in range(s, s + n - 49))
    assert held == [a + i for a, t in zip(at[:-1].tolist(), texts, strict=True) for i in range(len(t) - 49)]


def test_word_bounds_and_hashes():
    texts = [b"", b" a  bc\t", b"bc", b"x\x0by\xc2\xa0z", b"  "]
    at = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    s, e, before = anchors.word_bounds(data, at)
    assert [data[a:b].tobytes() for a, b in zip(s, e, strict=True)] == [w for t in texts for w in t.split()]
    assert np.diff(before).tolist() == [len(t.split()) for t in texts]
    u, _ = anchors.word_units(data, at)
    assert u[1] == u[2] and len(set(u.tolist())) == len(u) - 1


def test_digest():
    a = b"The quick brown fox jumps over the lazy dog. " * 30
    assert fingerprint.likeness(fingerprint.digest(a), fingerprint.digest(a)) == 1.0
    r = random.Random(1)
    b = bytes(r.choice(b"abcdefgh ") for _ in range(1300))
    assert 0 <= fingerprint.likeness(fingerprint.digest(a), fingerprint.digest(b)) < 0.9
    assert fingerprint.counts(b"ab").sum() == 0 and set(fingerprint.digest(b"")) == {0}
    assert fingerprint.edited("abcde", "xyz") == "abcxy" and fingerprint.edited("abcd", "x") == "abx" and fingerprint.edited("", "x") == ""


def test_first_fit_decreasing():
    r = random.Random(2)
    sizes = np.array(sorted((r.randint(1, 100) for _ in range(300)), reverse=True))
    at, offset = packing.first_fit_decreasing(sizes, 100)
    room: list[int] = []
    for n, a, o in zip(sizes.tolist(), at.tolist(), offset.tolist(), strict=True):
        first = next((i for i, x in enumerate(room) if x >= n), len(room))
        if first == len(room):
            room.append(100)
        assert (a, o) == (first, 100 - room[first])
        room[first] -= n


def test_encoder_gives_the_ids_of_the_tokenizers_library():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(packing.TOKENIZER))
    encode = packing.encoder()
    texts = ["", "a", "Hello  world\n\n it's 123  ", "ñandú 東京 🙂🙂  x", "<|endoftext|> b", "  lead", "tab\t\tx", "a" * 5000, "Éan de aiê la\r\n\r\nb", "\x00\x01", "é ½ ②"]
    texts += [" " * 1_200_000, " " * 1_200_000 + "a", "ab cd " * 800_000, "\u00a0\u2003x \u3000y\x1c\x1f z\u200b'S 'll"]
    r = random.Random(4)
    texts += ["".join(r.choice(" \n\t'sreléñ東½٣_-.,!<|🙂\x00\u00a0ABz9") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    for x in texts:
        assert np.frombuffer(encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    assert encode.by_word and len(encode.known) <= packing.KNOWN_WORDS


def test_shingles_and_intersections():
    texts = [b"A b C", b"a B c", b"a b", b"", b"a b c d a b c", b"a"]
    at = np.cumsum([0, *map(len, texts)])
    row, h = near_dedup.shingles(np.frombuffer(b"".join(texts), np.uint8), at, 3)
    sets = [set(h[row == k].tolist()) for k in range(len(texts))]
    assert sets[0] == sets[1] and len(sets[2]) == 1 and not sets[3] and len(sets[4]) == 4 and sets[0] < sets[4] and sets[2] != sets[5]
    r = np.random.default_rng(3)
    many = [np.unique(r.integers(0, 300, r.integers(1, 120))).astype(np.uint64) for _ in range(60)]
    got = near_dedup.intersections(many)
    assert all(got[i, j] == len(np.intersect1d(many[i], many[j])) for i in range(60) for j in range(60))


def test_bands_keep_the_miss_rate():
    for p in (1, 10, 20, 40, 60, 80, 85, 90, 100):
        rows, bands = near_dedup.layout(p)
        assert (1 - (p / 100) ** rows) ** bands <= near_dedup.MISS and (bands <= 400 or rows == 1)
    with pytest.raises(ValueError):
        near_dedup.layout(0)


def test_capitals_are_counted_in_words_of_any_case():
    at = 14  # the share of capital letters
    x = toxicity.Tokens({}).features(["You Are An Idiot Here", "You ARE An (Idiot) Here", "no, none", "ÉA b", None, ""])
    assert [round(v, 4) for v in x[:, at]] == [round(5 / 21, 4), round(7 / 23, 4), 0.0, 0.5, 0.0, 0.0]


def test_alignment():
    item = np.arange(1, 21)
    doc = np.concatenate([np.full(30, 99), item[:8], [77], item[9:], np.full(30, 98)])
    score, a, b = decontam.align(item, doc)
    assert (score, a, b) == (2 * 19 - 1, 30, 50)
    assert decontam.align(item, np.array([50, 51])) == (0, 0, 0)


def test_seeds_find_edited_copies():
    r = random.Random(6)
    words = ["".join(r.choice("bcdfg") + r.choice("aeiou") for _ in range(3)) for _ in range(400)]
    items = [(k, " ".join(r.choice(words) for _ in range(40))) for k in range(20)]
    seeds = decontam.Seeds(items, {w: 1 / 400 for w in words}, 1e6)

    def find(text: str) -> list:
        return [seeds.items[k][0] for k, *_ in seeds.matches(np.array([seeds.vocab.get(w, -1) for w in decontam.words(text)]), 0.5)]

    for k, text in items:
        own = text.split()
        for i in range(3, 40, 8):
            own[i] = "changed"
        del own[20]
        assert find(" ".join(r.choice(words) for _ in range(100)) + " " + " ".join(own).upper()) == [k]
    assert find(" ".join(r.choice(words) for _ in range(3000))) == []
    assert find("") == []


def test_boosting_and_isotonic():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    b = toxicity.Boosted(x, y, trees=30)
    assert ((b.raw(x) > 0) == (y > 0)).mean() > 0.97
    at, value = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all() and value[0] == 0 and value[-1] == 1


def test_obfuscated_words_meet_the_lexicon():
    assert "idiot" in toxicity.units_of("1d10t!") and "trash" in toxicity.units_of("(TR@SH).") and toxicity.units_of("...") == ()


def _archive(records: int) -> bytes:
    w = warc.ArchiveWriter()
    for k in range(records):
        p = f"<p>{k}é</p>".encode()
        w.add(k, f"http://www.x.org/{k}", p, warc.payload_digest(p), None, False)
    w.add(records, None, b"", warc.payload_digest(b""), 3, True)
    return w.close()


def _reader(data: bytes):
    reads = []

    def read(at, n):
        reads.append((at, n))
        return data[at : at + n]

    return warc.ArchiveReader(read, len(data)), reads


def test_archive_round_trip_and_ranges():
    data = _archive(50)
    reader, reads = _reader(data)
    got = list(reader.records())
    assert [r["page_id"] for r in got] == list(range(51)) and got[7]["payload"] == "<p>7é</p>".encode()
    assert got[50]["record_type"] == "revisit" and got[50]["refers_to"] == 3 and got[50]["payload"] is None
    assert [r["page_id"] for r in reader.records(lambda e: e["id"] == 9)] == [9]
    assert max(n for _, n in reads[-1:]) < 1000
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None


def test_zip64_directories(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = _archive(40)
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    assert len(list(_reader(data)[0].records())) == 41


def test_bad_archives():
    with pytest.raises(ValueError, match="end record"):
        _reader(b"nothing")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.DATA, b"x" * 100)
        z.writestr(warc.INDEX, b"")
    with pytest.raises(ValueError, match="compressed"):
        _reader(out.getvalue())[0].span(warc.DATA)
    bad = warc.record(1, "u", b"abc", warc.payload_digest(b"abd"), None, False)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(bad)
    assert zlib.crc32(b"") == 0


PAGES = {
    "article": ("<html><body><nav><a href=/>Home</a></nav><article><h1>Title here</h1><p>First &amp; main para with several words, and more.<br>next</p><p>Second paragraph of text is here.</p></article><footer>&copy; 2020 site</footer></body></html>", "Title here\n\nFirst & main para with several words, and more. next\n\nSecond paragraph of text is here."),
    "none": ("", ""),
    "null": (None, ""),
    "broken": ("<article><p>A first para that isn't closed and goes on for long<p>Another one with &lt;tags&gt; and words in it", "A first para that isn't closed and goes on for long\n\nAnother one with <tags> and words in it"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    html, want = PAGES[name]
    assert html_extract.main_text(html, html_extract.model()) == want


def test_boilerplate_goes():
    html = """<body><header><h1>Site name</h1><ul class="menu"><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></header><div class="cookie-notice"><p>This site uses cookies, and you must accept them to read on.</p></div>
    <main><article><p>The body of the article has a sentence of some length, which is kept.</p><div class="ad"><p>Buy this now for a low price today only.</p></div><p>And here is one more paragraph of the same article.</p></article>
    <section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this article a lot and read it twice, thanks.</p></div></section></main>
    <aside class="sidebar"><h3>Related</h3><p>Some other story that you may like to read next.</p></aside><form><label>Mail</label><input><button>Go</button></form><footer><p>All rights reserved.</p></footer><script>var x = "<p>no</p>";</script></body>"""
    assert html_extract.main_text(html, html_extract.model()) == "The body of the article has a sentence of some length, which is kept.\n\nAnd here is one more paragraph of the same article."


def test_viterbi_is_the_best_path():
    import itertools

    crf = html_extract.Crf({"a": 1.0, "b": -0.7, "c": 0.2}, np.array([[0.3, -0.4], [-0.2, 0.5]]))
    r = random.Random(1)
    for _ in range(30):
        page = [[r.choice("abcd")] for _ in range(r.randint(1, 7))]

        def total(ys, page=page):
            e = sum(crf.weights.get(f[0], 0) * y for f, y in zip(page, ys, strict=True))
            return e + sum(crf.moves[a][b] for a, b in itertools.pairwise(ys))

        assert total(crf.decode(page)) == pytest.approx(max(map(total, itertools.product((0, 1), repeat=len(page)))))


def test_crf_on_unseen_pages():
    crf, right, n = html_extract.model(), 0, 0
    for blocks, y in html_extract.labelled_pages(200, 99):
        z = crf.decode(html_extract.features(blocks))
        right += sum(a == b for a, b in zip(y, z, strict=True))
        n += len(y)
    assert right / n > 0.97
