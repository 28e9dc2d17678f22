"""Training data for the sentence classifier, from papers with structured abstracts.

A paper has parts, array<struct<header, paragraphs>>, and others, the texts of body sections of no class. All choices are by
hash of the paper's key and a seed, so they are the same wherever a row lies. Nothing is shuffled.

Defined results: null parts or others are empty; papers all of whose classes are empty give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import spans as S
from ..functions import text as X
from ..functions.text import _col
from ..sources.structured import header_class, is_structured
from .tables import pinned

CLASSES = ("background", "objectives", "methods", "results")
#: Orders of the classes, and their weights in per cent; numbers of the classes.
ORDERS = {"BOMR": ("background", "objectives", "methods", "results"), "OBMR": ("objectives", "background", "methods", "results"), "MOBR": ("methods", "objectives", "background", "results")}
WEIGHTS = {"BOMR": 60, "OBMR": 20, "MOBR": 20}
NUMBERS = {"background": 0, "objectives": 1, "methods": 2, "results": 3, "other": 4}
LEAST_WORDS = 8
#: The tags of a tagger, in the order of their numbers.
TAGS = ("O", "B-background", "I-background", "B-objectives", "I-objectives", "B-methods", "I-methods", "B-results", "I-results")


def structured_only(papers: DataFrame, parts: str = "parts") -> DataFrame:
    """Papers whose abstract has headers that are used."""
    return papers.filter((F.size(parts) > 0) & is_structured(F.transform(parts, lambda p: p["header"])))


def is_long(c: Column | str) -> Column:
    return X.word_count(c) > LEAST_WORDS


def class_text(parts: Column | str, name: str) -> Column:
    """A class's paragraphs, one header after the other; empty if they are few words."""
    own = F.filter(_col(parts), lambda p: header_class(p["header"]) == name)
    text = F.trim(F.array_join(F.transform(own, lambda p: F.array_join(p["paragraphs"], " ")), ""))
    return F.when(is_long(text), F.trim(F.replace(text, F.lit(" "), F.lit("")))).otherwise("")


def told(text: Column | str) -> Column:
    """A text's sentences, and whether each reads like an objective."""
    return F.transform(X.sentences(text), lambda x: F.struct(x.alias("text"), R.is_objective(x).alias("is_objective")))


def moved(background: Column, objectives: Column, sentences: Column | None = None) -> tuple[Column, Column]:
    """Sentences of the background that read like an objective go to the objectives. sentences: those of the background, told."""
    s = told(background) if sentences is None else sentences
    some = F.array_join(F.filter(s, lambda x: x["is_objective"])["text"], " ")
    rest = F.array_join(F.filter(s, lambda x: ~x["is_objective"])["text"], " ")
    return F.when(some == "", background).otherwise(rest), F.trim(F.concat_ws(" ", objectives, some))


def other_sentence(text: Column, key: Column, seed: int) -> Column:
    """One sentence of a section of no class: letters only, long, no objective, picked by hash; null if there is none."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z\s.,]", ""), r"\s+", " "))
    some = F.filter(F.split(plain, r"\."), lambda x: is_long(x) & ~R.is_objective(x))
    at = F.pmod(chance(key, seed, "other", 1 << 30), F.greatest(F.size(some), F.lit(1)))
    return F.get(some, at.cast("int"))


def other_text(others: Column | str, key: Column | str, seed: int = 0) -> Column:
    picked = F.transform(F.coalesce(_col(others), F.array().cast("array<string>")), lambda t: F.trim(other_sentence(t, _col(key), seed)))
    return F.array_join(F.array_distinct(F.filter(picked, lambda x: x.isNotNull())), ". ")


def chance(key: Column | str, seed: int, what: str, of: int) -> Column:
    """A number below `of`, by a hash of the key, the seed and what it is for."""
    text = F.concat_ws("|", _col(key).cast("string"), F.lit(f"{seed}|{what}"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(of))


def order_of(key: Column | str, seed: int = 0) -> Column:
    """struct(name, first): one of ORDERS by its weight, and whether the other text comes first."""
    at, bound, name = chance(key, seed, "order", 100), 0, None
    for k, weight in WEIGHTS.items():
        bound += weight
        name = F.when(at < bound, k) if name is None else name.when(at < bound, k)
    return F.struct(name.alias("name"), (chance(key, seed, "first", 2) == 0).alias("first"))


def labelled(papers: DataFrame, key: str = "doi", parts: str = "parts", others: str = "others", seed: int = 0) -> DataFrame:
    """papers with order_name and sections, array<struct<label, text>> of their classes that aren't empty, in their order."""
    texts = pinned(papers, **{f"_{c}": class_text(F.coalesce(parts, F.array().cast(dict(papers.dtypes)[parts])), c) for c in CLASSES})
    texts = pinned(texts, _told=told("_background"))  # judged once, and not wherever they are used
    background, objectives = moved(F.col("_background"), F.col("_objectives"), F.col("_told"))
    texts = pinned(texts.drop("_b", "_o"), _b=background, _o=objectives, _x=other_text(others, key, seed), _order=order_of(key, seed))
    of = {"background": F.col("_b"), "objectives": F.col("_o"), "methods": F.col("_methods"), "results": F.col("_results"), "other": F.col("_x")}
    part = lambda c: F.struct(F.lit(c).alias("label"), of[c].alias("text"))
    made = None
    for name, classes in ORDERS.items():
        own = F.array(*map(part, classes))
        made = F.when(F.col("_order.name") == name, own) if made is None else made.when(F.col("_order.name") == name, own)
    other = F.array(part("other"))
    whole = F.when(F.col("_order.first"), F.concat(other, made)).otherwise(F.concat(made, other))
    out = pinned(texts, order_name=F.col("_order.name"), sections=F.filter(whole, lambda s: F.trim(s["text"]) != ""))
    return out.drop(*(f"_{c}" for c in CLASSES), "_told", "_b", "_o", "_x", "_order").filter(F.size("sections") > 0)


def span_rows(papers: DataFrame, key: str = "doi", **columns) -> DataFrame:
    """(key, class, class_num, text, start, end, predictionstring): a row a section; words count from 1."""
    made = labelled(papers, key, **columns)
    rows = made.select(key, F.inline(F.arrays_zip(F.col("sections"), S.section_spans("sections").alias("span")))).select(key, "sections.*", "span.start", "span.end", "span.first", "span.last")
    number = F.create_map(*(F.lit(x) for p in NUMBERS.items() for x in p))[F.col("label")]
    return rows.select(key, F.col("label").alias("class"), number.alias("class_num"), "text", "start", "end", S.prediction_string(F.sequence("first", "last")).alias("predictionstring"))


def tag_rows(papers: DataFrame, key: str = "doi", **columns) -> DataFrame:
    """(key, text, entities, order_name): the text in its order and a tag of each word."""
    made = labelled(papers, key, **columns)
    return made.select(key, F.array_join(F.transform("sections", lambda s: s["text"]), " ").alias("text"), S.section_tags("sections").alias("entities"), "order_name")


def tag_numbers(tags: Column | str) -> Column:
    """The numbers of tags; unknown tags are null."""
    known = F.create_map(*(F.lit(x) for k, t in enumerate(TAGS) for x in (t, k)))
    return F.transform(_col(tags), lambda t: F.try_element_at(known, t))


def tagger_rows(landed: DataFrame, text: str = "text", entities: str = "entities") -> DataFrame:
    """Landed training rows (entities: a list literal of tags) with words, tags and tag_ids; rows without text or tags go.

    Tags of classes that occur once only are left out, with O if it does.
    """
    out = landed.filter(F.col(text).isNotNull() & F.col(entities).isNotNull())
    out = pinned(out, tags=S.repaired_tags(X.literal_list(entities)), words=X.words(text))
    return out.withColumn("tag_ids", tag_numbers("tags"))


def split(df: DataFrame, key: str, percent: int = 80, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows to train on and rows to test on, by hash of the key."""
    at = chance(key, seed, "split", 100) < percent
    return df.filter(at), df.filter(~at)
