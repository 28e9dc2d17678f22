"""Clauses of a sentence by rule: separators, the root verb, and passive sentences made active.

The rules stand where a parser's would; a parser goes into a model slot (functions.models) with the same results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import IRREGULAR
from .text import MARK, _col, words

#: Words that part clauses, and action verbs of objectives.
SEPARATORS = ("which", "and", "but", "because", "while", "then", "also", "that")
VERBS = ("aim", "analyse", "analyze", "apply", "assess", "build", "choose", "compare", "describe", "develop", "discuss", "estimate", "evaluate", "examine", "explore", "find", "give", "introduce", "investigate", "make", "measure", "model", "present", "propose", "review", "seek", "show", "study", "take", "use", "write")
PASSIVE = r"(?i)^(.+?) (?:is|are|was|were|has been|have been) (\w+(?:ed|en|own|ought|ade|ept|uilt|ound)) by (.+?)([.]?)$"


def clauses(sentence: Column | str) -> Column:
    """array<struct<separator, text>>: a sentence cut before each separating word and after commas; the first has none."""
    marked = F.regexp_replace(_col(sentence), r"(?i)\s+(" + "|".join(SEPARATORS) + r")\s+|\s*(,)\s*", f"{MARK}$1$2{MARK}")
    parts = F.concat(F.array(F.lit("")), F.split(marked, MARK))
    n = F.floor(F.size(parts) / 2).cast("int")
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(parts, 2 * i).alias("separator"), F.trim(F.get(parts, 2 * i + 1)).alias("text")))
    return F.filter(at, lambda c: (c["text"] != "") | (c["separator"] == ""))


def _forms() -> dict[str, str]:
    """The plain form of each form of the known verbs: of several the last verb's, else that of an irregular one."""
    known = {f: plain for plain in VERBS for f in (plain, f"{plain}s", f"{plain}es", f"{plain}ed", f"{plain}d", f"{plain}ing", f"{plain[:-1]}ing", f"{plain[:-1]}ies", f"{plain[:-1]}ied")}
    return {**{form: plain for plain, form in IRREGULAR.items()}, **known}


FORMS = _forms()


def _letters(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}]", ""))


def stem(word: Column) -> Column:
    """A verb's plain form, for the verbs known here; other words as they are, in small letters."""
    w = _letters(word)
    return F.coalesce(F.create_map(*(F.lit(x) for p in FORMS.items() for x in p))[w], w)


def root_verb(sentence: Column | str) -> Column:
    """The first of the known verbs in a sentence, in its plain form; null without one."""
    # Words are looked up in a set; the first that is found is stemmed.
    found = F.filter(F.transform(words(sentence), _letters), lambda w: w.isin(*(f for f, plain in FORMS.items() if plain in VERBS)))
    return stem(F.get(found, F.lit(0)))


def root_clause(sentence: Column | str) -> Column:
    """The first clause with a known verb, else the first."""
    c = clauses(sentence)
    some = F.filter(c, lambda x: root_verb(x["text"]).isNotNull())
    return F.coalesce(F.get(some, F.lit(0)), F.get(c, F.lit(0)))["text"]


def active(sentence: Column | str) -> Column:
    """'X was shown by Y.' is 'Y shown X.' with the verb's form kept; other sentences stay."""
    s = _col(sentence)
    what, verb, who, end = (F.regexp_extract(s, PASSIVE, k) for k in range(1, 5))
    lower = F.concat(F.lower(F.substring(what, 1, 1)), F.substring(what, F.lit(2), F.length(what)))
    upper = F.concat(F.upper(F.substring(who, 1, 1)), F.substring(who, F.lit(2), F.length(who)))
    return F.when(what != "", F.concat(upper, F.lit(" "), verb, F.lit(" "), lower, end)).otherwise(s)
