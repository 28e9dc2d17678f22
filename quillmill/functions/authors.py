"""Author formulae, journals, years and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, words

#: Where papers of each database are found.
ARXIV_PDF, DOI_URL = "https://arxiv.org/pdf/", "https://doi.org/"
PIVOT_YEAR = 2021


def _last_word(c: Column) -> Column:
    return F.element_at(words(c), -1)


def _from_parts(parts: Column) -> Column:
    """'X et al.' or 'X and Y' from an array of names."""
    first = F.coalesce(F.try_element_at(words(F.get(parts, F.lit(0))), F.lit(-1)), F.lit(""))
    second = F.get(parts, F.lit(1))
    many = (F.size(parts) > 2) | (F.size(words(second)) > 2)
    return F.when(many, F.concat(first, F.lit(" et al."))).otherwise(F.concat(first, F.lit(" and "), F.coalesce(F.try_element_at(words(second), F.lit(-1)), F.lit(""))))


def with_commas(c: Column | str) -> Column:
    return _from_parts(F.split(_col(c), ","))


def full_names(c: Column | str) -> Column:
    """For names without commas, an even count of words taken in pairs."""
    w = words(c)
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0)), F.lit(2)), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))
    return _from_parts(pairs)


def initials(c: Column | str) -> Column:
    """Names with initials, 'A. Smith B. Jones': the first surname, and the others by the comma rule."""
    c = _col(c)
    only = F.trim(F.element_at(F.split(c, r"\."), -1))
    surnames = F.filter(F.transform(F.split(c, r"(?:[A-Z]\.\s*)+"), lambda x: F.trim(F.regexp_replace(x, "[,&]", ""))), lambda x: x != "")
    return F.when(F.size(F.split(c, r"\.")) == 2, only).otherwise(_from_parts(surnames))


def author_formula(authors: Column | str, year: Column | str) -> Column:
    """'Smith (2020)', 'Smith and Jones (2020)', 'Smith et al. (2020)'; unknown years give '()'."""
    a = F.coalesce(F.nullif(F.trim(F.coalesce(_col(authors), F.lit(""))), F.lit("")), F.lit("Some authors"))
    y = _col(year)
    when = F.when(y.isNull() | (y == 999), F.lit("()")).otherwise(F.concat(F.lit("("), y.cast("string"), F.lit(")")))
    n = F.size(words(a))
    name = F.when(n == 2, _last_word(a)).when(F.contains(a, F.lit(",")), with_commas(a)).when(n % 2 == 0, full_names(a)).otherwise(F.lit("Some authors "))
    return F.concat(name, F.lit(" "), when)


def journal_name(c: Column | str) -> Column:
    """Without a letter it is empty; a leading 'nd' or 'ISSN' goes."""
    c = _col(c)
    return F.when(c.rlike("[a-zA-Z]"), F.trim(F.regexp_replace(F.regexp_replace(c, r"^nd\b", ""), r"^\s*ISSN", ""))).otherwise(F.lit(""))


def escaped(c: Column | str) -> Column:
    return F.replace(F.replace(F.replace(_col(c), F.lit(" "), F.lit("%20")), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))


def reference_url(database: Column | str, doi: Column | str, title: Column | str, own_root: str) -> Column:
    """Where a paper is found; own files (database 'mine') lie under own_root by their titles."""
    d, doi, title = _col(database), _col(doi), _col(title)
    own = F.concat(F.lit(own_root), F.when(F.coalesce(title, F.lit("")) == "", F.lit("")).otherwise(escaped(F.concat(title, F.lit(".pdf")))))
    return F.when(d == "mine", own).when(d == "arxiv", F.concat(F.lit(ARXIV_PDF), doi)).when(d == "iahr", doi).otherwise(F.concat(F.lit(DOI_URL), doi))


def reference(authors: Column | str, year: Column | str, title: Column | str, journal: Column | str) -> Column:
    text = lambda c: F.coalesce(_col(c).cast("string"), F.lit(""))
    return F.concat(text(authors), F.lit(", "), text(year), F.lit(", "), text(title), F.lit(", "), text(journal), F.lit("."))


def root_name(c: Column | str) -> Column:
    """A section's row name as that of its paper's objectives."""
    return F.regexp_replace(_col(c), "_(methods|results)$", "_objectives")


def paper_name(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "_(objectives|methods|results)$", "")


def arxiv_year(c: Column | str) -> Column:
    """From 'yymm.number': 20yy up to the pivot year, else 19yy."""
    yy = F.substring(F.split(_col(c), r"\.")[0], 1, 2).try_cast("int")
    return F.when(yy + 2000 > PIVOT_YEAR, yy + 1900).otherwise(yy + 2000)


def year_in(c: Column | str) -> Column:
    """The first publication year from 1900 to 2022 in a text."""
    return F.regexp_extract(_col(c), "(19[0-9]{2}|20[01][0-9]|202[0-2])", 1).try_cast("int")


def without_point_zero(c: Column | str) -> Column:
    """'(2020.0)' is '(2020)'."""
    return F.regexp_replace(_col(c), r"([0-9])\.[0-9]", "$1")


def clean_author(c: Column | str) -> Column:
    c = F.replace(F.replace(F.replace(_col(c), F.lit("\n"), F.lit("; ")), F.lit("&"), F.lit(",")), F.lit("."), F.lit(". "))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z+.,\-;]", " "), r"\s+", " "))


def plausible_author(c: Column | str) -> Column:
    w = words(c)
    return (F.size(w) > 1) & (F.length(F.get(w, F.lit(0))) > 1) & (F.length(F.get(w, F.lit(1))) > 1)


def distinct_authors(c: Column | str) -> Column:
    """An array of names, capitalised, each once whatever its case, in order."""
    return F.array_distinct(F.transform(_col(c), lambda x: F.initcap(F.trim(x))))
