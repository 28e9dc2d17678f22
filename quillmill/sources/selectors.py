"""Selectors over the tree of a landed page: what stands in elements, nested ones included.

A selector is a path: "div.abstract", "div.keywords > span", "table td.year", "article-id[pub-id-type=doi]", "a.doi@href". A
step is a tag or * with classes and attributes; a blank between steps is any depth, > is the next level; @name at the end asks
for an attribute instead of the text. A page is read once, event by event, with a stack of its open elements, for all selectors
together; texts are collected while their element is open. One Arrow batch of pages is a task's unit; nothing is shuffled.

Defined results: null and empty pages match nothing. An element that is left open ends with the element around it, or with the
page; p and li end before the next of their kind. Texts have one space where a tag or white space stood; scripts and styles have
no text. Texts that are empty aren't matches. Matches are in the order their elements begin. Declarations of any kind and other
broken markup are skipped, never an error.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without an end tag, elements whose text isn't shown, and elements that end before their like.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style".split())
ALONE = frozenset("p li dt dd tr td th option".split())
_STEP = re.compile(r"(>)?\s*([\w:*-]+)?((?:\.[\w-]+|\[[\w:-]+(?:=[^\]]*)?\])*)(?:@([\w:-]+))?\s*")
_PART = re.compile(r"\.([\w-]+)|\[([\w:-]+)(?:=([^\]]*))?\]")


class Selector:
    """A parsed path: steps of (direct, tag, classes, attributes), and the attribute that is asked for."""

    def __init__(self, path: str):
        self.steps: list[tuple[bool, str, frozenset[str], tuple[tuple[str, str | None], ...]]] = []
        self.wanted: str | None = None
        at = 0
        while at < len(path):
            m = _STEP.match(path, at)
            if not m or m.end() == at or not (m[2] or m[3]) or self.wanted:
                raise ValueError(f"not a selector: {path!r}")
            parts = list(_PART.finditer(m[3]))
            self.steps.append((bool(m[1]), (m[2] or "*").lower(), frozenset(p[1] for p in parts if p[1]), tuple((p[2].lower(), p[3].strip("'\"") if p[3] is not None else None) for p in parts if p[2])))
            self.wanted, at = m[4], m.end()
        if not self.steps:
            raise ValueError("an empty selector")

    def fits(self, k: int, tag: str, attributes: dict[str, str]) -> bool:
        _, name, classes, asked = self.steps[k]
        if name not in ("*", tag):
            return False
        if classes and not classes <= set((attributes.get("class") or "").split()):
            return False
        return all(n in attributes and (v is None or attributes[n] == v) for n, v in asked)

    def after(self, above: tuple[frozenset[int], frozenset[int]], tag: str, attributes: dict[str, str]) -> tuple[frozenset[int], frozenset[int]]:
        """How many steps fit up to this element: ending here, and ending here or above. above: those of the element around it."""
        here, held = above
        new = {k + 1 for k in range(len(self.steps)) if (k == 0 or k in (here if self.steps[k][0] else held)) and self.fits(k, tag, attributes)}
        new = frozenset(new)
        return new, held if new <= held else held | new


class _Reader(HTMLParser):
    def __init__(self, selectors: list[Selector], most: list[int | None]):
        super().__init__(convert_charrefs=True)
        self.selectors, self.most = selectors, most
        self.open: list[tuple[str, list, list[list[str]]]] = []  # tag, state of each selector, texts that it collects
        self.found: list[list[list[str]]] = [[] for _ in selectors]
        self.collecting: list[list[str]] = []
        self.hidden = 0
        self.there: Counter[str] = Counter()  # open elements by tag

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def _space(self) -> None:
        for c in self.collecting:
            c.append(" ")

    def handle_starttag(self, tag, attrs):
        self._space()
        if tag in ALONE and self.open and self.open[-1][0] == tag:
            self._pop()
        attributes = {k: v or "" for k, v in reversed(attrs)}
        none = (frozenset(), frozenset())
        states, own = [], []
        for k, s in enumerate(self.selectors):
            state = s.after(self.open[-1][1][k] if self.open else none, tag, attributes)
            states.append(state)
            if len(s.steps) in state[0] and (self.most[k] is None or len(self.found[k]) < self.most[k]):
                if s.wanted is not None:
                    if s.wanted in attributes:
                        self.found[k].append([attributes[s.wanted]])
                else:
                    text: list[str] = []
                    self.found[k].append(text)
                    own.append(text)
        if tag not in VOID:
            self.open.append((tag, states, own))
            self.there[tag] += 1
            self.collecting += own
            self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._pop()

    def _pop(self) -> str:
        tag, _, own = self.open.pop()
        self.there[tag] -= 1
        if own:
            del self.collecting[-len(own) :]
        self.hidden -= tag in HIDDEN
        return tag

    def handle_endtag(self, tag):
        self._space()
        if self.there[tag]:
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            for c in self.collecting:
                c.append(data)


def select(html: str | None, selectors: list[Selector], most: list[int | None]) -> list[list[str]]:
    """The texts that each selector finds, no more than its number if it has one."""
    reader = _Reader(selectors, most)
    reader.feed(html or "")
    reader.close()
    return [[t for parts in found if (t := " ".join("".join(parts).split()))] for found in reader.found]


def selected(html: Column | str, every: dict[str, str] | None = None, first: dict[str, str] | None = None) -> Column:
    """struct of the named selectors' texts in a page: an array for each of every, the first or an empty text for each of first."""
    every, first = every or {}, first or {}
    names = [*every, *first]
    parsed = [Selector(p) for p in (*every.values(), *first.values())]
    # Elements without text aren't matches, so a first match may come after them: only attributes can stop at one.
    most = [None] * len(every) + [1 if s.wanted is not None else None for s in parsed[len(every) :]]

    @F.pandas_udf(", ".join(f"{n} array<string>" for n in every) + (", " if every and first else "") + ", ".join(f"{n} string" for n in first))
    def run(pages: pd.Series) -> pd.DataFrame:
        rows = [select(p, parsed, most) for p in pages.tolist()]
        return pd.DataFrame({n: [r[k] if k < len(every) else (r[k] or [""])[0] for r in rows] for k, n in enumerate(names)}, columns=names)

    return run(F.col(html) if isinstance(html, str) else html)
