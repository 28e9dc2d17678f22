"""Rules that stand where models would: objective sentences, section labels, language, lemmas, reported speech.

Each is a column expression with the shape that a model's function would have, so a pandas_udf can take its place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, word_count, words

#: What a sentence of purpose has: a noun of purpose, the work itself, a statement of what the authors do, or a question that is put.
PURPOSE_NOUNS = ("aim", "goal", "objective", "purpose", "target", "motivation")
PURPOSE_VERBS = ("aim", "ask", "assess", "attempt", "compare", "examine", "introduce", "investigate", "present", "propose", "report", "seek", "study", "test")
OBJECTIVE_CUES = rf"(?i)\b({'|'.join(PURPOSE_NOUNS)})s?\b|\b(we|the authors) (here |now |therefore )?({'|'.join(PURPOSE_VERBS)})(e?d)?\b|\bthis (article|paper|study|thesis|work)\b|\bto (determine|find out|learn|see) (how|if|what|whether|why)\b"
#: Boilerplate, and cues of the other sections.
BOILERPLATE = "this section|Corresponding| PhD "
METHOD_CUES = r"(?i)\b(method|methods|model|dataset|data|using|used|approach|algorithm|simulation|experiment|experiments|measured|sampled)\b"
RESULT_CUES = r"(?i)\b(result|results|found|finding|findings|conclude|conclusion|significant|increased|decreased|indicate|showed|demonstrated)\b"
BACKGROUND_CUES = r"(?i)\b(background|introduction|however|previous|literature|known|recent|although)\b"
#: Frequent words that tell languages apart.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "was", "that", "for", "with", "by", "from", "this", "are", "it", "as", "on", "be"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "qui", "dans", "pour", "est", "sur", "par", "au"],
    "de": ["der", "die", "das", "und", "in", "von", "mit", "für", "ist", "ein", "eine", "zu", "nicht", "sich", "den", "im", "auf", "des"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "para", "es", "se", "del", "no", "su"],
}
#: Past forms that no suffix rule gives.
IRREGULAR = {"show": "showed", "find": "found", "build": "built", "give": "gave", "make": "made", "take": "took", "seek": "sought", "write": "wrote", "begin": "began", "see": "saw", "draw": "drew", "choose": "chose", "lead": "led", "set": "set", "put": "put", "hold": "held", "keep": "kept", "run": "ran", "undertake": "undertook", "bring": "brought"}
#: Corrections of reported sentences.
CORRECTIONS = {" - ": "-", " – ": "–", " , ": ", ", "( ": "(", " )": ")", " ' ": "'", " / ": "/", " these ": " the ", " our ": " their ", "the present ": " their ", "and and": "and", "nonuniform": "non-uniform", "also": "", "In this ": "in their ", " this ": " their ", "in addition": "", ".we ": ".They ", ",we ": ",they ", " we ": " they ", " us ": " them ", "Fig.": "", "Figure": "", "(i": "(", "(e": "(", " above": "", " cited ": " "}
TERM = r"[\p{L}\p{N}_]{2,}"


def is_objective(c: Column | str) -> Column:
    return _col(c).rlike(OBJECTIVE_CUES)


def cue_count(c: Column | str, cues: str) -> Column:
    return F.regexp_count(_col(c), F.lit(cues))


def section_label(scored: Column) -> Column:
    """The class with most cues, the first of equals; without cues the third of the abstract decides. scored: see scores."""
    best = F.greatest(*(scored[k] for k in ("objectives", "methods", "results", "background")))
    by_place = F.when(scored["i"] * 3 < scored["n"], "objectives").when(scored["i"] * 3 < 2 * scored["n"], "methods").otherwise("results")
    out = F.when(best == 0, by_place)
    for name in ("objectives", "methods", "results", "background"):
        out = out.when(scored[name] == best, name)
    return out


def scores(sentence: Column, index: Column, count: Column) -> Column:
    """struct: the sentence, its place, and how many cues of each class it has (2 for an objective cue)."""
    return F.struct(
        sentence.alias("s"), index.alias("i"), count.alias("n"), F.when(is_objective(sentence), 2).otherwise(0).alias("objectives"),
        cue_count(sentence, METHOD_CUES).alias("methods"), cue_count(sentence, RESULT_CUES).alias("results"), cue_count(sentence, BACKGROUND_CUES).alias("background"),
    )


def language(c: Column | str) -> Column:
    """struct(lang, score): the language with most stop words, and its share of all stop-word hits; nulls without hits."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))

    def count(known: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(*known)))

    hits = {k: count(v) for k, v in STOP_WORDS.items()}
    best, total = F.greatest(*hits.values()), sum(hits.values(), F.lit(0))
    name = F.when(best == 0, F.lit(None).cast("string"))
    for k, n in hits.items():
        name = name.when(n == best, k)
    return F.struct(name.alias("lang"), F.when(best > 0, best / total).alias("score"))


def is_english(c: Column | str, least: float = 0.7, empty: bool = True) -> Column:
    """English by more than `least` of the stop words; texts without letters count as `empty` says."""
    found = language(c)
    blank = ~F.coalesce(_col(c), F.lit("")).rlike(r"\p{L}")
    return F.when(blank, F.lit(empty)).otherwise(F.coalesce((found["lang"] == "en") & (found["score"] > least), F.lit(False)))


def lemma(word: Column) -> Column:
    w = F.lower(word)
    n = F.length(w)
    return F.when((n > 5) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y"))).when((n > 6) & w.endswith("ing"), F.substring(w, F.lit(1), n - 3)).when((n > 5) & w.endswith("ed"), F.substring(w, F.lit(1), n - 2)).when((n > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), n - 1)).otherwise(w)


def lemmas(c: Column | str, stop: list[str] | None = None) -> Column:
    """Lower-cased words without stop words and common endings."""
    stop = stop or STOP_WORDS["en"]
    return F.transform(F.filter(words(F.lower(_col(c))), lambda w: ~w.isin(*stop)), lemma)


def lemmas_of(query: str, stop: list[str] | None = None) -> list[str]:
    """The same for a query text, on the driver."""
    out = []
    for w in query.lower().split():
        if w in (stop or STOP_WORDS["en"]):
            continue
        for end, least, put in (("ies", 5, "y"), ("ing", 6, ""), ("ed", 5, ""), ("s", 3, "")):
            if w.endswith(end) and len(w) > least and not (end == "s" and w.endswith("ss")):
                w = w[: -len(end)] + put
                break
        out.append(w)
    return out


def terms(c: Column | str, stop: list[str] | None = None) -> Column:
    """Lower-cased terms of two characters or more, without stop words."""
    stop = stop or STOP_WORDS["en"]
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(TERM), F.lit(0)), lambda t: ~t.isin(*stop))


def past_tense(verb: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    regular = F.when(verb.endswith("e"), F.concat(verb, F.lit("d"))).when(verb.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(verb, "y$", ""), F.lit("ied"))).otherwise(F.concat(verb, F.lit("ed")))
    return F.coalesce(known[verb], regular)


def corrected(c: Column) -> Column:
    for old, new in CORRECTIONS.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def simplified(c: Column | str) -> Column:
    """Leading fillers, clauses with which or through, and enumerations go; 'as well as' is 'and'."""
    c = F.regexp_replace(_col(c), r"(?i)^(however|therefore|moreover|furthermore|here|hence|thus|to this end),?\s+", "")
    c = F.regexp_replace(c, r"(?i)\bas well as\b|\balong with\b", "and")
    c = F.regexp_replace(c, r",\s*(which|through)\b[^,.]*(?=[,.])", "")
    return F.trim(F.regexp_replace(c, r"\s*\((i|ii|iii|iv|[0-9])\)", ""))


REPORT = r"(?i)^(?:in this (?:paper|study|work|article),?\s+)?(?:we|this (?:paper|study|work|article)|the (?:aim|purpose|goal|objective) of this (?:paper|study|work|article) (?:is|was) to|the present (?:paper|study|work))\s*(?:aims?\s+to|aimed\s+to)?\s+([a-z]+?)(?:e?s)?\s+(.*)$"


def reported(sentence: Column | str, formula: Column | str) -> Column:
    """'We propose X.' by Smith in 2020 is 'Smith (2020) proposed X.'; other sentences follow the formula after a colon."""
    s = simplified(sentence)
    who = _col(formula)
    verb, rest = F.lower(F.regexp_extract(s, REPORT, 1)), F.regexp_extract(s, REPORT, 2)
    return corrected(F.when(verb != "", F.concat_ws(" ", who, past_tense(verb), rest)).otherwise(F.concat(who, F.lit(": "), s)))


def chosen(messages: Column | str) -> Column:
    """Of several sentences that of 20 to 25 words nearest to 22, else that nearest to 20; the first of equals. Null if none."""
    m = F.transform(_col(messages), lambda s, i: F.struct(word_count(s).alias("n"), i.alias("i"), s.alias("s")))
    window = F.filter(m, lambda x: (x["n"] >= 20) & (x["n"] <= 25))
    nearest = lambda a, to: F.get(F.array_sort(F.transform(a, lambda x: F.struct(F.abs(x["n"] - to).alias("d"), x["i"].alias("i"), x["s"].alias("s")))), F.lit(0))["s"]
    return F.when(F.size(window) > 0, nearest(window, 22)).otherwise(nearest(m, 20))


def objective_summary(sentences: Column | str) -> Column:
    """The objective sentences without boilerplate if there are more than three, else all sentences."""
    all_ = _col(sentences)
    some = F.filter(all_, lambda s: is_objective(s) & ~s.rlike(BOILERPLATE))
    return F.when(F.size(some) > 3, some).otherwise(all_)


def segmented(sentences: Column | str) -> Column:
    """array<struct<label, message>>: background sentences come first as objectives if they read like one, else they go.

    Each sentence gets its place and the count of all beside it first: what a lambda captures is computed anew for every
    element once the optimizer has put expressions in place of columns.
    """
    s = _col(sentences)
    places = F.transform(F.array_repeat(F.size(s), F.size(s)), lambda n, i: F.struct(i.alias("i"), n.alias("n")))
    scored = F.zip_with(s, places, lambda x, p: scores(x, p["i"], p["n"]))
    told = F.transform(scored, lambda r: F.struct(section_label(r).alias("label"), r["i"].alias("i"), r["s"].alias("message"), (r["objectives"] > 0).alias("objective")))
    first = lambda x: (x["label"] == "background") & x["objective"]
    kept = F.filter(told, lambda x: (x["label"] != "background") | x["objective"])
    order = F.array_sort(F.transform(kept, lambda x: F.struct(F.when(first(x), 0).otherwise(1).alias("o"), x["i"].alias("i"), F.when(first(x), "objectives").otherwise(x["label"]).alias("label"), x["message"].alias("message"))))
    return F.transform(order, lambda x: F.struct(x["label"].alias("label"), x["message"].alias("message")))


def query_kind(query: str) -> str:
    """and, match or single, in that order of precedence."""
    if re.search(r" AND |&|\+", query):
        return "and"
    return "match" if re.search('"(.*?)"', query) else "single"


def query_kind_column(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.rlike(r" AND |&|\+"), "and").when(c.rlike('"[^"]*"'), "match").otherwise("single")
