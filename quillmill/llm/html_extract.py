"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is parsed into leaf blocks, the texts between block-level tags. Each block has features of its ancestors' tags,
classes and ids, of its text (words, share in links, punctuation, cues) and of its neighbours. A chain of two labels (main
text or not) is trained by maximum likelihood on labelled pages and decoded by Viterbi. The labelled pages are made here:
layouts that pages commonly have, filled with made-up words, so that structure and not vocabulary is learned.

Defined results: a null or empty page, or one without main text, gives an empty text. Scripts, styles, templates and the
head are markup. Character references are decoded, white space inside a block (line breaks of <br> too) is one space.
Repeated rows give repeated results. Other columns aren't read.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune

#: Elements that break a line of text, that hold no text, that have no end tag, and that others end.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul video audio canvas".split())
SILENT = frozenset("script style template head title noscript svg object".split())
SECTIONS = frozenset("article main body header footer nav section aside h1".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of notices, forms and page furniture.
CUES = frozenset("cookie cookies privacy copyright subscribe newsletter login register share tweet advertisement sponsored comment comments reply menu terms rights reserved".split())
_PART = re.compile(r"[a-z]+|\d+")


class Element:
    """An open element and what there is of the elements around it. What an element adds nothing to is shared, not copied, so
    a page's depth costs no more than its length. words: those of class, id and role that the model knows."""

    __slots__ = ("tag", "own", "tags", "words", "near", "last", "under", "holders", "main")

    def __init__(self, tag: str, words: tuple[str, ...], known: frozenset[str] | None, above: Element | None):
        self.tag = tag
        own = frozenset(w for w in words if not w.isdigit() and (known is None or w in known))
        held = above.words if above else frozenset()
        self.words = held if own <= held else held | own
        self.near = own if words else above.near if above else frozenset()
        self.tags, self.last, self.under, self.holders, self.main = (above.tags, above.last, above.under, above.holders, above.main) if above else (frozenset(), "none", "none", 0, -1)
        if tag in BLOCK_TAGS:
            if tag not in self.tags and tag not in ("html", "body"):
                self.tags |= {tag}
            self.last, self.under = tag, self.last
            if tag in ("article", "main"):
                self.main = self.holders
            self.holders += 1


_NOWHERE = Element("", (), None, None)


class Block:
    __slots__ = ("at", "text", "linked")

    def __init__(self, at, text, linked):
        self.at, self.text, self.linked = at, text, linked


class _Parser(HTMLParser):
    """Leaf blocks in page order, each with the innermost element around it."""

    def __init__(self, known: frozenset[str] | None = None):
        super().__init__(convert_charrefs=True)
        self.known = known
        self.open: list[Element] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.silent = self.links = 0
        self.there: Counter[str] = Counter()  # open elements by tag

    def parse_marked_section(self, i, report=1):
        """Sections of any name (<![if x]>, <![x[y]]>) are no markup of pages: comments up to the next >."""
        return self.parse_bogus_comment(i)

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.blocks.append(Block(self.open[-1] if self.open else _NOWHERE, text, min(1.0, self.linked / len(text))))
            self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCK_TAGS:
            self.flush()
            if self.silent:
                self._leave(tag)
            self._close("p")
            if tag in ENDS and self.open:
                while self.open and self.open[-1].tag in ENDS[tag]:
                    self._pop()
        if tag in VOID:
            return
        words = tuple(w for k, v in attrs if v and k in ("class", "id", "role", "itemprop") for w in _PART.findall(v.lower()))
        self.open.append(Element(tag, words, self.known, self.open[-1] if self.open else None))
        self.there[tag] += 1
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK_TAGS:
            self.handle_endtag(tag)

    def _pop(self) -> str:
        tag = self.open.pop().tag
        self.there[tag] -= 1
        self.silent -= tag in SILENT
        self.links -= tag == "a"
        return tag

    def _close(self, tag) -> None:
        if self.there[tag] > 0:
            while self._pop() != tag:
                pass

    def _leave(self, tag) -> None:
        """Parts of a page can't stand in drawings or notices for other browsers: those weren't ended."""
        if not self.there["foreignobject"]:
            self._close("svg")
        if tag in SECTIONS:
            self._close("noscript")
            self._close("object")

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        self._close(tag)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks_of(html: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """known: words of class, id and role to look at, all by default."""
    parser = _Parser(known)
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def _level(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that each block has."""
    own = []
    for b in blocks:
        words = b.text.split()
        n = len(words)
        at = b.at
        f = {"1", f"tag={at.last}", f"words={_level(n, (2, 4, 8, 15, 30, 60))}", f"linked={_level(b.linked, (0.05, 0.35, 0.7, 0.95))}", f"end={b.text[-1] in '.!?:;…»”’' + chr(34)}", f"commas={_level(b.text.count(','), (1, 3))}", f"under={at.under}", f"deep={min(4, at.holders - 1 - at.main)}"}
        f |= {f"in={t}" for t in at.tags} | {f"has={w}" for w in at.words} | {f"near={w}" for w in at.near}
        if any(w.strip(".,:;!?()").lower() in CUES for w in words):
            f.add("cue")
        if "©" in b.text or "|" in b.text or "·" in b.text or "»" in b.text:
            f.add("sign")
        own.append(f)
    out = []
    for k, f in enumerate(own):
        near = {f"before:{x}" for x in own[k - 1] if x.startswith(("tag=", "words=", "linked="))} if k else {"first"}
        near |= {f"after:{x}" for x in own[k + 1] if x.startswith(("tag=", "words=", "linked="))} if k + 1 < len(own) else {"last"}
        out.append(sorted(f | near))
    return out


class Crf:
    """Two labels. A feature's weight speaks for label 1; moves holds the weights of neighbouring labels."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray):
        self.weights, self.moves = weights, moves.tolist()
        self.known = frozenset(x.split("=", 1)[1] for x in weights if x.startswith(("has=", "near=")))

    def decode(self, pages: list[list[str]]) -> list[int]:
        """The likeliest labels of a page's blocks, by Viterbi."""
        get, m = self.weights.get, self.moves
        back, a, b = [], 0.0, 0.0
        for k, f in enumerate(pages):
            e = sum(get(x, 0.0) for x in f)
            if k == 0:
                a, b = 0.0, e
                continue
            from_a, from_b = (a + m[0][0] >= b + m[1][0]), (a + m[0][1] >= b + m[1][1])
            a, b = max(a + m[0][0], b + m[1][0]), max(a + m[0][1], b + m[1][1]) + e
            back.append((from_a, from_b))
        if not pages:
            return []
        out = [int(b > a)]
        for pair in reversed(back):
            out.append(0 if pair[out[-1]] else 1)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 300, ridge: float = 1e-5) -> Crf:
    """Maximum likelihood with a quadratic penalty, by Adam over all pages at once."""
    pages = [p for p in pages if p[0]]
    seen: dict[str, int] = {}
    for fs, _ in pages:
        for f in fs:
            for x in f:
                seen[x] = seen.get(x, 0) + 1
    names = sorted(x for x, n in seen.items() if n >= 3)
    number = {x: k for k, x in enumerate(names)}
    most = max(len(f) for f, _ in pages)
    rows, index = [], []
    gold, there = np.zeros((most, len(pages)), int), np.zeros((most, len(pages)), bool)
    for p, (fs, ys) in enumerate(pages):
        for t, (f, y) in enumerate(zip(fs, ys, strict=True)):
            own = [number[x] for x in f if x in number]
            index += own
            rows += [t * len(pages) + p] * len(own)
            gold[t, p], there[t, p] = y, True
    rows, index = np.array(rows), np.array(index)
    w, move = np.zeros(len(names)), np.zeros((2, 2))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, move)]
    true_moves = np.zeros((2, 2))
    both = there[1:] & there[:-1]
    np.add.at(true_moves, (gold[:-1][both], gold[1:][both]), 1)
    n = there.sum()
    for step in range(1, rounds + 1):
        e = np.zeros((most, len(pages), 2))
        e[..., 1] = np.bincount(rows, w[index], most * len(pages)).reshape(most, len(pages))
        fore, rear = np.zeros_like(e), np.zeros_like(e)
        fore[0] = e[0]
        for t in range(1, most):
            fore[t] = np.where(there[t, :, None], np.logaddexp(fore[t - 1][:, :1] + move[0], fore[t - 1][:, 1:] + move[1]) + e[t], fore[t - 1])
        for t in range(most - 2, -1, -1):
            x = rear[t + 1] + e[t + 1]
            rear[t] = np.where(there[t + 1, :, None], np.logaddexp(x[:, :1] + move[:, 0], x[:, 1:] + move[:, 1]), 0.0)
        z = np.logaddexp(fore[-1][:, 0], fore[-1][:, 1])
        one = np.exp(fore[..., 1] + rear[..., 1] - z) * there
        grad_w = np.bincount(index, (one - gold * there).ravel()[rows], len(names)) / n + ridge * w
        grad_m = np.zeros((2, 2))
        for i in range(2):
            for j in range(2):
                grad_m[i, j] = (np.exp(fore[:-1, :, i] + move[i, j] + e[1:, :, j] + rear[1:, :, j] - z) * both).sum()
        grad_m = (grad_m - true_moves) / n + ridge * move
        for x, g, m in ((w, grad_w, moments[0]), (move, grad_m, moments[1])):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x -= 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return Crf(dict(zip(names, w.tolist(), strict=True)), move)


MARK = "⁣"  # in the labelled pages, stands before the text of a main block


def _page(r: random.Random) -> str:
    """A made-up page; texts that are main start with MARK."""
    syllables = ["ba", "den", "ti", "ro", "lu", "ske", "mon", "va", "ri", "sto", "né", "for", "gü", "pla"]

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def say(lo: int, hi: int, stop: bool = True) -> str:
        ws = [word() + ("," if r.random() < 0.08 else "") for _ in range(r.randint(lo, hi))]
        return " ".join(ws).capitalize().rstrip(",") + ("." if stop else "")

    def pick(*names: str) -> str:
        n = r.choice(names)
        return r.choice([f' class="{n}"', f' id="{n}"', f' class="{word()} {n}"', f' class="{n}-{r.choice(["box", "wrap", "area", "list", "top"])}"'])

    def link(lo: int = 1, hi: int = 3) -> str:
        return f'<a href="/{word()}">{say(lo, hi, False)}</a>'

    def links(k: int, item: str = "li") -> str:
        return "".join(f"<{item}>{link()}</{item}>" for _ in range(k))

    def inline(text: str) -> str:
        ws = text.split(" ")
        for _ in range(r.choice([0, 0, 1, 2])):
            k = r.randrange(len(ws))
            ws[k] = r.choice([f"<b>{ws[k]}</b>", f"<em>{ws[k]}</em>", f'<a href="/x">{ws[k]}</a>', f"<span>{ws[k]}</span>", f"{ws[k]}<br>"])
        return " ".join(ws)

    def main_block() -> str:
        x = r.random()
        if x < 0.66:
            lead = r.choice(["", "", "", "<b>", "<i>"])
            return f"<p>{lead}{MARK}{inline(say(*r.choice([(1, 5), (6, 30), (20, 90)]), r.random() < 0.9))}" + r.choice(["</p>", "</p>", "</p>", "<br>", ""])
        if x < 0.74:
            h = r.choice(["h2", "h3"])
            return f"<{h}>{MARK}{say(1, 7, r.random() < 0.2)}</{h}>"
        if x < 0.82:
            return "<ul>" + "".join(f"<li>{MARK}{inline(say(2, 20, r.random() < 0.5))}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if x < 0.87:
            return f"<blockquote>{MARK}{say(8, 40)}</blockquote>"
        if x < 0.91:
            return f"<pre>{MARK}{say(3, 20, False)}</pre>"
        if x < 0.95:
            return "<table>" + "".join(f"<tr><td>{MARK}{say(1, 3, False)}</td><td>{MARK}{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<figure><img src=x><figcaption>{MARK}{say(4, 15)}</figcaption></figure>"

    def advert() -> str:
        t = r.choice(["div", "div", "section", "p", "aside"])
        return f"<{t}{pick('ad', 'ads', 'advert', 'advertisement', 'banner', 'promo', 'sponsored', 'sponsor')}>{r.choice([say(3, 40), '<p>' + say(3, 30) + '</p>', link(2, 6)])}</{t}>"

    def comments() -> str:
        t = r.choice(["section", "div", "ol", "ul", "aside"])
        inner = "li" if t in ("ol", "ul") else r.choice(["div", "article", "p"])
        inside = [f"<{inner}{pick('comment', 'comment', 'reply', 'comment-body')}>{r.choice(['<p>' + say(3, 60) + '</p>', say(2, 40), '<b>' + word() + '</b>: ' + say(3, 30)])}</{inner}>" for _ in range(r.randint(1, 6))]
        head = r.choice(["", f"<h3>{r.choice(['Comments', say(1, 3, False)])}</h3>", f"<h2>{r.randint(1, 40)} comments</h2>"])
        return f"<{t}{pick('comments', 'comments', 'comment-list', 'discussion', 'responses', 'disqus')}>{head}{''.join(inside)}</{t}>"

    def form() -> str:
        return f"<form{r.choice(['', pick('search', 'newsletter', 'signup', 'login', 'subscribe', 'contact')])}>{r.choice(['<label>' + say(1, 4, False) + '</label>', '<p>' + say(3, 20) + '</p>', say(2, 12)])}<input name=q><button>{say(1, 2, False)}</button>{r.choice(['', '<select><option>' + word() + '</option><option>' + word() + '</option></select>', '<textarea>' + word() + '</textarea>'])}</form>"

    def notice() -> str:
        t = r.choice(["div", "section", "aside", "p", "dialog"])
        return f"<{t}{pick('cookie', 'cookies', 'notice', 'consent', 'gdpr', 'alert', 'popup', 'modal', 'cookie-notice', 'paywall', 'warning')}>{r.choice(['', 'Cookies: '])}{r.choice([say(5, 30), '<p>' + say(5, 40) + '</p>'])}{r.choice(['', '<button>OK</button>'])}</{t}>"

    def sidebar() -> str:
        t = r.choice(["aside", "aside", "div"])
        inside = r.choice([f"<h3>{say(1, 3, False)}</h3><ul>{links(r.randint(2, 7))}</ul>", f"<p>{say(4, 30)}</p>", f"<h4>{say(1, 3, False)}</h4><p>{say(4, 40)}</p><p>{link()}</p>"])
        return f"<{t}{r.choice(['', pick('sidebar', 'widget', 'related', 'side')]) if t == 'aside' else pick('sidebar', 'side', 'widget', 'related', 'rail', 'trending', 'recommended')}>{inside}</{t}>"

    def share() -> str:
        return f"<div{pick('share', 'social', 'tags', 'byline', 'meta', 'breadcrumb', 'breadcrumbs', 'pagination', 'author', 'sharing')}>{r.choice([''.join(link() for _ in range(3)), say(1, 5, False)])}</div>"

    def menu() -> str:
        t = r.choice(["nav", "nav", "div", "ul"])
        inside = links(r.randint(3, 9)) if t == "ul" else r.choice([f"<ul>{links(r.randint(3, 9))}</ul>", " | ".join(link() for _ in range(4)), links(4, "div")])
        return f"<{t}{r.choice(['', pick('nav', 'menu')]) if t == 'nav' else pick('nav', 'menu', 'navigation', 'navbar')}>{inside}</{t}>"

    def header() -> str:
        t = r.choice(["header", "header", "div"])
        return f"<{t}{r.choice(['', pick('header')]) if t == 'header' else pick('header', 'masthead', 'topbar', 'logo')}>{r.choice([f'<h1>{say(1, 4, False)}</h1>', f'<p>{say(2, 14)}</p>', link(), f'<h2>{say(1, 3, False)}</h2><p>{say(3, 10)}</p>', say(1, 6, False)])}{r.choice(['', menu()])}</{t}>"

    def footer() -> str:
        t = r.choice(["footer", "footer", "footer", "div"])
        return f"<{t}{r.choice(['', pick('footer')]) if t == 'footer' else pick('footer', 'bottom', 'copyright', 'legal')}>{r.choice(['&copy; ' + word() + ' &middot; ' + say(2, 30), '<p>&copy; ' + say(2, 12) + '</p>', '<p>' + say(4, 40) + '</p>', '<ul>' + links(4) + '</ul>', say(3, 12)])}" + r.choice([f"</{t}>", f"</{t}>", ""])

    noise = [advert, comments, form, notice, sidebar, share]
    body = [main_block() for _ in range(r.choice([1, 2, 3, 5, 8, 14]))]
    for _ in range(r.choice([0, 0, 1, 2, 3])):
        body.insert(r.randint(0, len(body)), r.choice([advert, share, form, notice, sidebar, comments])())
    title = f"<h1>{MARK}{say(2, 12, r.random() < 0.2)}</h1>" if r.random() < 0.7 else ""
    t = r.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
    kind = r.choice(["", "", pick("article", "post", "content", "entry", "story")]) if t in ("article", "main") else pick("content", "article", "post", "entry", "story", "main", "text", "body")
    article = f"<{t}{kind}>{title}{''.join(body)}</{t}>"
    if t == "td":
        article = f"<table><tr><td{pick('nav', 'menu', 'sidebar')}>{links(3, 'div')}</td>{article}</tr></table>"
    if r.random() < 0.4:
        article = f"<{r.choice(['main', 'div'])}{r.choice(['', pick('content', 'wrapper', 'page', 'container')])}>{article}{r.choice(['', sidebar(), comments()])}</main></div>"
    before = [f() for f in r.choice([[menu], [menu, advert], [header], [header, menu], [notice, header], [header, menu, advert], [advert], [form, menu], [], [], []])]
    after = [r.choice(noise)() for _ in range(r.choice([0, 0, 0, 1, 2, 3]))]
    end = [footer()] if r.random() < 0.7 else []
    return f"<!DOCTYPE html><html><head><title>{say(2, 8, False)}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head><body>{''.join(before)}{article}{''.join(after)}{''.join(end)}</body></html>"


def labelled_pages(n: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """Made-up pages and which of their blocks are main text."""
    r, out = random.Random(seed), []
    for _ in range(n):
        blocks = blocks_of(_page(r))
        labels = [int(MARK in b.text) for b in blocks]
        for b in blocks:
            b.text = " ".join(b.text.replace(MARK, "").split()) or "-"
        out.append((blocks, labels))
    return out


@lru_cache(1)
def model() -> Crf:
    return train([(features(b), y) for b, y in labelled_pages(1000, 11)])


def main_text(html: str | None, crf: Crf) -> str:
    blocks = blocks_of(html, crf.known)
    return "\n\n".join(b.text for b, y in zip(blocks, crf.decode(features(blocks)), strict=True) if y)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages."""
    tune(pages.sparkSession)
    crf = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, crf) for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: The main text of pages that are laid out as those of the given tables: an article of headings and paragraphs.
ORACLE_OP9 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(x, '</?(h1|p)>'), lambda p: regexp_replace(regexp_replace(p, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda p: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(p, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&nbsp;', ' '), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM (SELECT page_id, url, array_to_string(list_filter(parts, lambda p: p <> ''), chr(10) || chr(10)) AS text FROM c)
"""
