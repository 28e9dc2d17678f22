"""Spans of words: runs, overlaps, tags, offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, words


def tags(class_name: Column | str, tokens: Column) -> Column:
    """B-class for the first word, I-class for the others."""
    return F.transform(tokens, lambda _, i: F.concat(F.when(i == 0, "B-").otherwise("I-"), _col(class_name)))


def section_tags(sections: Column | str) -> Column:
    """Tags of array<struct<label, text>>, one after the other; label 'other' is O."""
    return F.flatten(F.transform(_col(sections), lambda x: F.transform(words(x["text"]), lambda _, i: F.when(x["label"] == "other", "O").otherwise(F.concat(F.when(i == 0, "B-").otherwise("I-"), x["label"])))))


def section_spans(sections: Column | str) -> Column:
    """array<struct<label, start, end, first, last>> of the texts joined by a space: characters (half open) and words from 1."""
    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("word"), F.array().cast("array<struct<label:string,start:int,end:int,first:int,last:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        n, w = F.length(x["text"]), F.size(words(x["text"]))
        span = F.struct(x["label"].alias("label"), acc["at"].alias("start"), (acc["at"] + n).alias("end"), acc["word"].alias("first"), (acc["word"] + w - 1).alias("last"))
        return F.struct((acc["at"] + n + 1).alias("at"), (acc["word"] + w).alias("word"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(_col(sections), start, step, lambda acc: acc["out"])


def runs(ids: Column | str) -> Column:
    """array<struct<start, end>> of runs of consecutive numbers in a sorted array; runs of one are kept."""
    ids = _col(ids)
    heads = F.filter(ids, lambda x: ~F.array_contains(ids, x - 1))
    tails = F.filter(ids, lambda x: ~F.array_contains(ids, x + 1))
    return F.transform(heads, lambda h, i: F.struct(h.alias("start"), F.get(tails, i).alias("end")))


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Length that two half-open ranges share."""
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def prediction_string(ids: Column | str) -> Column:
    return F.concat_ws(" ", F.transform(_col(ids), lambda x: x.cast("string")))


def ids_of(prediction: Column | str) -> Column:
    return F.transform(words(_col(prediction)), lambda x: x.cast("int"))


def char_span(text: Column | str, span: Column | str) -> Column:
    """struct(start, end): from the first place of the span's first five words to the first end of its last five."""
    text, w = _col(text), words(_col(span))
    first = F.array_join(F.slice(w, 1, 5), " ")
    last = F.array_join(F.slice(w, F.greatest(F.size(w) - 4, F.lit(1)), 5), " ")
    return F.struct((F.instr(text, first) - 1).alias("start"), (F.instr(text, last) - 1 + F.length(last)).alias("end"))


def repaired_tags(tags_: Column | str) -> Column:
    """Tags without those of a class that occurs once only."""
    t = _col(tags_)
    kind = lambda x: F.regexp_replace(x, "^[BI]-", "")
    return F.filter(t, lambda x: F.size(F.filter(t, lambda y: kind(y) == kind(x))) > 1)
