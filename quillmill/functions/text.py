"""Text clean-up, words and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"
#: Terms of figures, tables and equations whose sentences are dropped.
FIGURE_TERMS = r"(?i)(\(|\[)?(figure|fig\.|table|equation|eqs?\.)(\)|\])?"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_line(c: Column | str) -> Column:
    """Words broken by a hyphen at a line's end joined, lines joined by a space; null is empty."""
    return F.replace(F.replace(F.coalesce(_col(c), F.lit("")), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))


def words(c: Column | str) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(_col(c), F.lit(""))), r"\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def sentences(c: Column | str) -> Column:
    """Trimmed sentences, cut after . ! or ? and white space. A mark stands in for look-around, so SQL engines agree."""
    cut = F.split(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"([.!?])\s+", f"$1{MARK}"), MARK)
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda s: s != "")


def full_sentences(c: Column | str, least: int = 5) -> Column:
    """Sentences of more than `least` words that aren't a notice of an online version."""
    return F.filter(sentences(c), lambda s: (word_count(s) > least) & ~F.contains(F.lower(s), F.lit("online version")))


def thin_spaces(c: Column | str) -> Column:
    return F.translate(_col(c), "   ", "")


def commas(c: Column | str) -> Column:
    return F.translate(_col(c), ";", ",")


def year_of(c: Column | str) -> Column:
    """2022, '2022' and '2022.0' are 2022; anything else is null."""
    return _col(c).cast("string").try_cast("double").cast("int")


def citations(c: Column | str) -> Column:
    """Unknown counts are 0.5, so that they rank below papers cited once."""
    return F.coalesce(F.nanvl(_col(c).cast("double"), F.lit(0.5)), F.lit(0.5))


def literal_list(c: Column | str) -> Column:
    """The strings of a list literal such as ['a', "b's"]; text without quotes is split at commas."""
    c = _col(c)
    quoted = F.regexp_extract_all(c, F.lit(r"""'([^']*)'|"([^"]*)\""""), F.lit(0))
    plain = F.filter(F.transform(F.split(F.regexp_replace(c, r"[\[\]]", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(quoted) > 0, F.transform(quoted, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(plain)


def keywords(c: Column | str) -> Column:
    """What follows 'keywords:'; empty if nothing does."""
    return F.trim(F.regexp_extract(_col(c), r"(?i)key\s?words:(.*)", 1))


def without_keywords(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"(?i)key\s?words:(.*)", ""))


def despaced(c: Column | str) -> Column:
    """'a b s t r a c t' is 'abstract' if no two letters stand together anywhere."""
    c = _col(c)
    once = F.regexp_replace(c, "(.) (.)", "$1$2")
    return F.when(c.rlike(r"\w\w"), c).otherwise(F.regexp_replace(once, "(.) (.)", "$1$2"))


#: Fixed value: the pattern of a DOI.
DOI = r"(?i)(10\.[0-9]{3,7}(\.\w+)*(/|%2f)[\w\-:;()/.<>]*[\w\-:;()/<>])"


def doi_in(c: Column | str) -> Column:
    """The first DOI in a text; empty if there is none."""
    return F.regexp_extract(_col(c), DOI, 1)


def without_long_brackets(c: Column | str, most: int = 5) -> Column:
    """Round brackets of more than `most` words go."""
    return F.regexp_replace(_col(c), rf"\(\s*([^\s()]+\s+){{{most},}}[^\s()]+\s*\)", "")


def clean_text(c: Column | str) -> Column:
    """Explanations after colons, abbreviations, brackets, and sentences about figures or equations go."""
    c = F.regexp_replace(_col(c), r":\s?[^.]*\.", ".")
    c = F.regexp_replace(c, r"i\.e\.?,?|e\.g\.?,?", "meaning")
    c = F.regexp_replace(F.regexp_replace(c, r"et\s+al\.\s?", "et al"), r"cf\.", "see")
    c = F.regexp_replace(without_long_brackets(c), r"(?i)\((figure|table|meaning)[^)]*\)", "")
    c = F.regexp_replace(c, r"(\(|\[)[0-9][0-9]?(\)|\])\s?", "")
    kept = F.filter(sentences(c), lambda s: ~s.rlike(r"\w+\s?=\s?\w+") & ~s.rlike(FIGURE_TERMS) & (word_count(s) > 3))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(kept, " "), r"\.\s*\.", "."), r"\s+", " "))


def objective_clean(c: Column | str) -> Column:
    """A sentence without numbered marks: '(3)' goes, '[3]' is Someone, leading digits and '- ' go."""
    c = F.regexp_replace(F.replace(_col(c), F.lit(";"), F.lit(",")), r"\([0-9]+\)", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\[[0-9]+\]", "Someone"), r"^[0-9]+", "")
    return F.trim(F.regexp_replace(F.replace(c, F.lit("- "), F.lit("")), r"\s+", " "))


def between(c: Column | str, first: str, last: str) -> Column:
    """The shortest text between two patterns, across lines."""
    return F.regexp_extract(_col(c), f"(?s){first}(.*?){last}", 1)


def find_slice(c: Column | str, needle: str, length: int) -> Column:
    """From where needle is found, whatever its case, `length` characters as written; empty if it isn't."""
    c = _col(c)
    at = F.locate(needle.lower(), F.lower(c))
    return F.when(at > 0, F.substring(c, at, F.lit(length))).otherwise("")


def comma_pair(with_commas: Column | str, without: Column | str) -> Column:
    """If the first has two commas and the second none, the part between them gets its commas back in the second."""
    a, b = _col(with_commas), _col(without)
    parts = F.split(a, ",")
    return F.when((F.size(parts) == 3) & ~F.contains(b, F.lit(",")), F.replace(b, parts[1], F.concat(F.lit(","), parts[1], F.lit(",")))).otherwise(b)


def capitalised(c: Column | str) -> Column:
    """Every word with a capital first letter, the others small."""
    return F.initcap(_col(c))


def starts_capital(c: Column | str) -> Column:
    return _col(c).rlike(r"^\s*[A-Z]")


def has_digit(c: Column | str) -> Column:
    return _col(c).rlike("[0-9]")


def _tail(array: Column, skip: int) -> Column:
    """An array without its first elements."""
    return F.slice(array, skip + 1, F.greatest(F.size(array) - skip, F.lit(0)))


def repeated_capitalised(c: Column | str, threshold: int) -> Column:
    """Parts that start at capitals, of more than one word, that occur more often than threshold."""
    parts = F.filter(_tail(F.split(F.concat(F.lit(" "), _col(c)), r"\b(?=[A-Z])"), 1), lambda p: word_count(p) > 1)
    # Sorted, so that a part's repeats are a run: the one `threshold` places on is equal.
    ordered = F.array_sort(parts)
    later = _tail(ordered, threshold)
    return F.array_distinct(F.filter(F.zip_with(ordered, later, lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))


def heading_pattern(c: Column | str) -> Column:
    """Which pattern the numbered headings follow, judged from the introduction's: '1.', '1', or null."""
    head = F.regexp_extract(_col(c), r"(?im)^([\n\s0-9]+\w*introduction.*)", 1)
    return F.when((head == "") | ~has_digit(head), F.lit(None)).when(F.contains(head, F.lit(".")), r"^\d\.[\n\s]+[a-zA-Z]+.*").otherwise(r"^\d[\n\s]+[a-zA-Z]+.*")


def long_word_items(c: Column | str, least: int = 2) -> Column:
    """The strings of an array in which some word is longer than `least`."""
    return F.filter(_col(c), lambda s: F.exists(F.regexp_extract_all(s, F.lit("[a-zA-Z]+"), F.lit(0)), lambda w: F.length(w) > least))
