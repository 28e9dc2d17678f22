"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features are rates of a document: densities of lexicon hits and their weights, hits near second-person words, capitals,
punctuation, and obfuscated words. The lexicon is learned: words, and their first five and six letters, that are far more
frequent in toxic rows. Words are read lower-cased, with digits and signs that stand for letters put back. Labelled rows
are split by a hash in halves: the trees see each half with the lexicon of the other, and the calibration sees each half's
scores from trees of the other, so neither learns from its own labels. The model in use has the lexicon and the trees of
both halves.

The fit uses at most SAMPLE_ROWS labelled rows (those with the least hash of doc_id, one row of each); their ids are sent to
all tasks, a few hundred kB. The lexicon has every unit of the sample that passes its thresholds. Scoring reads every whole
text and shuffles nothing.

Defined results: null and empty texts have all-zero features and get the model's score for them. Labels that are null are
left out; of several labels of a doc_id the greatest counts, of several texts of one the least is learned from. Without labelled rows of both classes every score is the
share of toxic ones (0 without rows). A null doc_id is scored and not held out. Repeated rows are scored alike. Extra
columns of any name pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches as cut_batches, fresh_name, settle, table, tune

SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
#: Lexicon units need so many toxic rows of the sample and so high a log-odds weight.
MIN_ROWS, MIN_WEIGHT = 3, 2.5
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32
#: Least sum of hessians of a leaf and the penalty of its value: small, as a few hundred labelled rows have few toxic ones.
LEAF, RIDGE = 0.3, 2.0
NEAR_WORDS = 5
KNOWN_TOKENS = 200_000
#: Second-person words of the languages at hand, and signs that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie tú ti usted ustedes vosotros su".split())
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "-": "", "_": "", ".": ""})
_EDGE = re.compile(r"^[^\w@$*]+|[^\w@$*]+$")
_SIGNED = re.compile(r"[^\W\d_][\d@$!*_.\-]+[^\W\d_]|^[@$*\d]+[^\W\d_]")
FEATURES = 20


def units_of(token: str) -> tuple[str, ...]:
    """What a token can match in the lexicon: its word as meant, and the word's beginnings."""
    word = _EDGE.sub("", token).lower()
    if _SIGNED.search(word):
        word = word.translate(SIGNS)
    if len(word) < 3:
        return (word,) if word else ()
    return (word, *(f"{word[:n]}-" for n in (5, 6) if len(word) >= n))


@dataclass
class Tokens:
    """What is known of each token, looked up once for each distinct one."""

    lexicon: dict[str, float]
    number: dict[str, int] = field(default_factory=dict)
    facts: np.ndarray = field(default_factory=lambda: np.zeros((1024, 7), np.float32))

    def add(self, token: str) -> int:
        k = self.number[token] = len(self.number)
        if k == len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        get, word = self.lexicon.get, token.strip(".,;:!?()")
        if word.isalpha():  # most tokens: no sign to look at
            low = word.lower()
            whole = get(low, 0.0)
            weight = max(whole, get(f"{low[:5]}-", 0.0) if len(low) >= 5 else 0.0, get(f"{low[:6]}-", 0.0) if len(low) >= 6 else 0.0)
            self.facts[k] = (weight, whole > 0, 0, 0, len(word) >= 2 and word.isupper(), low in SECOND_PERSON, sum(map(str.isupper, word)))
            return k
        word, units = _EDGE.sub("", token), units_of(token)
        weight = max((get(u, 0.0) for u in units), default=0.0)
        letters = sum(c.isalpha() for c in token)
        signed = bool(_SIGNED.search(word.lower()))
        self.facts[k] = (weight, bool(units) and units[0] in self.lexicon, signed, signed and weight > 0, letters >= 2 and word.isupper(), word.lower() in SECOND_PERSON, sum(map(str.isupper, token)))
        return k

    def features(self, texts: list[str | None]) -> np.ndarray:
        if len(self.number) > KNOWN_TOKENS:
            self.number = {}
        get, add = self.number.get, self.add
        ids = [[x if (x := get(t)) is not None else add(t) for t in (text or "").split()] for text in texts]
        facts = self.facts
        out = np.zeros((len(texts), FEATURES), np.float64)
        for row, own, text in zip(out, ids, texts, strict=True):
            if not text:
                continue
            n = max(1, len(own))
            f = facts[own] if own else np.zeros((0, 7), np.float32)
            hit, you = f[:, 0] > 0, f[:, 5] > 0
            chars = len(text)
            if hit.any() and you.any():
                at = np.flatnonzero(you)
                places = np.flatnonzero(hit)
                k = np.searchsorted(at, places)
                gap = np.minimum(np.abs(at[np.minimum(k, len(at) - 1)] - places), np.abs(at[np.maximum(k - 1, 0)] - places))
                near = int((gap <= NEAR_WORDS).sum())
            else:
                near = 0
            hits, strong = int(hit.sum()), int((f[:, 0] >= 4).sum())
            upper = float(f[:, 6].sum())
            row[:] = (
                math.log1p(n), hits / n, strong / n, math.log1p(hits), math.log1p(strong), f[:, 0].max(initial=0), f[:, 0].sum() / n, len({own[i] for i in np.flatnonzero(hit)}), f[:, 1].sum() / n, math.log1p(f[:, 1].sum()),
                near / n, math.log1p(near), you.sum() / n, f[:, 4].sum() / n, upper / chars, text.count("!") / chars, text.count("?") / chars, (text.count("!!") + text.count("??") + text.count("...")) / n, f[:, 2].sum() / n, f[:, 3].sum() / n,
            )
        return out


class Boosted:
    """Trees of fixed depth for the logistic loss, grown level by level from histograms of quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, least: float = LEAF, ridge: float = RIDGE):
        n, m = x.shape
        self.depth = depth
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
        bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        self.base = math.log(share / (1 - share))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.full(n, self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
            for level in range(depth):
                first, count = (1 << level) - 1, 1 << level
                best = np.full(count, 1e-6)
                local = node - first
                for j in range(m):
                    at = local * BINS + bins[:, j]
                    gs = np.cumsum(np.bincount(at, g, count * BINS).reshape(count, BINS), 1)
                    hs = np.cumsum(np.bincount(at, h, count * BINS).reshape(count, BINS), 1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                    gain[(hs < least) | (ht - hs < least)] = 0
                    gain = gain[:, : len(self.cuts[j])]
                    if gain.shape[1]:
                        k = gain.argmax(1)
                        for c in np.flatnonzero(gain[np.arange(count), k] > best):
                            best[c], feature[first + c], cut[first + c] = gain[c, k[c]], j, self.cuts[j][k[c]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            leaf = node - ((1 << depth) - 1)
            value = -rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
            self.trees.append((feature, cut, value))
            score += value[leaf]

    def raw(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += value[node - ((1 << self.depth) - 1)]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean scores of the blocks, and their means of y, both rising."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Boosted | None
    at: np.ndarray
    value: np.ndarray
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, between 0 and 1; a thousandth of the trees' own probability keeps order within calibrated steps."""
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.raw(x)
        return 0.999 * np.interp(raw, self.at, self.value) + 0.001 / (1 + np.exp(-raw))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from labelled rows of docs that aren't held out."""
    tune(docs.sparkSession)
    sample = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    sample = sample.filter(~held_out("id")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    half = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))  # one row an id, so at most sample_rows
    rows = settle(rows.select("text", F.col("y").cast("int").alias("y"), half.cast("int").alias("half")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [Counter() for _ in range(4)]
        for b in batches:
            for text, y, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = {u for t in set((text or "").split()) for u in units_of(t)}
                n[2 * h + (y > 0)].update(own)
                n[2 * h + (y > 0)][""] += 1
        units = sorted(set().union(*n))
        yield pa.record_batch([pa.array(units, pa.string()), *(pa.array([c[u] for u in units], pa.int64()) for c in n)], names=["unit", *names])

    names = ["clean0", "toxic0", "clean1", "toxic1"]
    counted = rows.mapInArrow(count, "unit string, clean0 long, toxic0 long, clean1 long, toxic1 long").groupBy("unit").agg(*(F.sum(c).alias(c) for c in names))
    counted = settle(counted)
    total = counted.filter("unit = ''").first()

    def likely(halves: tuple[int, ...]) -> F.Column:
        toxic, clean = (sum((F.col(f"{kind}{h}") for h in halves), F.lit(0)) for kind in ("toxic", "clean"))
        m, n = (sum(total[f"{kind}{h}"] for h in halves) if total else 0 for kind in ("toxic", "clean"))
        return F.log((toxic + 0.5) / (m + 1)) - F.log((clean + 0.5) / (n + 1)) >= MIN_WEIGHT - 1e-9

    # What some lexicon holds: units of a bounded sample, of MIN_ROWS of its toxic rows or more each.
    some = (F.col("toxic0") + F.col("toxic1") >= MIN_ROWS) & (likely((0,)) | likely((1,)) | likely((0, 1)))
    found = sorted(counted.filter((F.col("unit") == "") | some).collect(), key=lambda r: r.unit)

    def learn(halves: tuple[int, ...], least: int) -> dict[str, float]:
        clean, toxic = ({r.unit: sum(r[f"{kind}{h}"] for h in halves) for r in found} for kind in ("clean", "toxic"))
        n, m = clean.get("", 0), toxic.get("", 0)
        weight = {u: math.log((t + 0.5) / (m + 1)) - math.log((clean[u] + 0.5) / (n + 1)) for u, t in toxic.items() if u and t >= least}
        return {u: w for u, w in weight.items() if w >= MIN_WEIGHT}

    lexicons = [learn((1,), MIN_ROWS - 1), learn((0,), MIN_ROWS - 1)]  # that of the other half
    lexicon = learn((0, 1), MIN_ROWS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [Tokens(x) for x in lexicons]
        for b in batches:
            for h in range(2):
                own = b.filter(pa.array([x == h for x in b.column(2).to_pylist()], pa.bool_()))
                if own.num_rows:
                    yield pa.record_batch([own.column(1), own.column(2), pa.array(list(tokens[h].features(own.column(0).to_pylist())), pa.list_(pa.float64()))], names=["y", "half", "x"])

    got = rows.mapInArrow(measure, "y int, half int, x array<double>").collect()  # at most sample_rows rows of FEATURES numbers
    got.sort(key=lambda r: (r.half, r.y, r.x))
    y = np.array([float(r.y > 0) for r in got])
    second = np.array([r.half == 1 for r in got], bool)
    none = np.zeros(0)
    if not len(y) or any(len(set(part)) < 2 for part in (y[second].tolist(), y[~second].tolist())):
        return Model(lexicon, None, none, none, float(y.mean()) if len(y) else 0.0)
    x = np.array([r.x for r in got])
    raw = np.empty(len(y))
    for part in (second, ~second):
        raw[part] = Boosted(x[~part], y[~part]).raw(x[part])
    at, value = isotonic(raw, y)
    return Model(lexicon, Boosted(x, y), at, value, float(y.mean()))


def held_out(column: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with one more column, a score between 0 and 1."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(model.lexicon)
        for b in cut_batches(batches, column=text_col):
            yield pa.record_batch([*b.columns, pa.array(model.scores(tokens.features(b.column(at).to_pylist())))], names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    names = schema.names
    return docs.mapInArrow(run, schema)


def clean_only(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below threshold."""
    name = fresh_name(docs, "score")
    return scored(docs, fit(docs, labels), score_col=name).filter(F.col(name) < threshold).drop(name)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
