"""Word labels: from a model's tokens to words, classes, word lists and ranges, and back to training labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _col, words

#: Fixed value: the label of tokens that don't count in training.
IGNORED = -100


def first_tokens(predicted: Column | str, word_ids: Column | str) -> Column:
    """The prediction of each word's first token; 0 for words that the predictions don't reach. Null word ids mark no word."""
    p, ids = _col(predicted), _col(word_ids)
    own = F.array_distinct(F.filter(ids, lambda w: w.isNotNull()))
    return F.transform(own, lambda w: F.coalesce(F.get(p, (F.array_position(ids, w) - 1).cast("int")), F.lit(0)))


def aligned(labels: Column | str, word_ids: Column | str) -> Column:
    """Labels of tokens: a word's label for its first token, IGNORED for its others and for tokens of no word."""
    own, ids = _col(labels), _col(word_ids)
    return F.transform(ids, lambda w, i: F.when(w.isNull() | (F.array_position(ids, w) != i + 1), F.lit(IGNORED)).otherwise(F.get(own, w)))


def clean(labels: Column | str) -> Column:
    """Classes of tags: without B- and I-; O is other."""
    return F.transform(_col(labels), lambda x: F.when(x == "O", "other").otherwise(F.regexp_replace(x, "^[BI]-", "")))


def word_lists(classes: Column | str) -> Column:
    """array<struct<class, words>>: the places (from 1) of each class's words, classes in the order in which they occur."""
    c = _col(classes)
    places = F.transform(c, lambda x, i: F.struct(x.alias("class"), (i + 1).alias("at")))
    own = lambda k: F.transform(F.filter(places, lambda p: p["class"] == k), lambda p: p["at"])
    return F.transform(F.array_distinct(c), lambda k: F.struct(k.alias("class"), own(k).alias("words")))


def tag_counts(tags: Column | str) -> Column:
    """array<struct<tag, n>>, tags in the order in which they occur."""
    t = _col(tags)
    return F.transform(F.array_distinct(t), lambda x: F.struct(x.alias("tag"), F.size(F.filter(t, lambda y: y == x)).alias("n")))


def class_ranges(spans: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, class, ranges): each class's (start, end), sorted."""
    return spans.groupBy(doc, "class").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))


def token_places(text: Column | str, token: Column | str, least: Column | int = 0) -> Column:
    """Places (from 0) of the words that equal a token, from place `least`."""
    token, least = _col(token), least if isinstance(least, Column) else F.lit(least)
    found = F.transform(words(text), lambda w, i: F.when((w == token) & (i >= least), i))
    return F.filter(found, lambda x: x.isNotNull())


def sentence_range(sentence: Column | str, text: Column | str, least: Column | int = 0) -> Column:
    """struct(start, end) of a sentence's words in a text, from its first word's first place; the end leaves out the last word."""
    w = words(sentence)
    start = F.get(token_places(text, F.get(w, F.lit(0)), least), F.lit(0))
    return F.struct(start.alias("start"), (start + F.size(w) - 1).alias("end"))


def marked(text: Column | str, spans: Column | str) -> Column:
    """struct(text, ents): what viewers of entities take; spans: array<struct<label, start, end>>."""
    ents = F.transform(F.array_sort(F.transform(_col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))), lambda s: s)
    return F.struct(_col(text).alias("text"), ents.alias("ents"))


def texts_of(text: Column | str, spans: Column | str) -> Column:
    """array<struct<label, text>>: the parts of a text that (half-open) spans of characters name."""
    text = _col(text)
    return F.transform(_col(spans), lambda s: F.struct(s["label"].alias("label"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text")))


def by_class(parts: Column | str) -> Column:
    """map<label, text>: a text's parts by class, the texts of one class joined by a space, in order."""
    p = _col(parts)
    names = F.array_distinct(F.transform(p, lambda x: x["label"]))
    own = lambda k: F.array_join(F.transform(F.filter(p, lambda x: x["label"] == k), lambda x: x["text"]), " ")
    return F.map_from_arrays(names, F.transform(names, own))
