"""Papers to sections: every paper gives three rows, objectives, methods and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import authors as A
from ..functions import rules as R
from ..functions import text as X
from ..operators.tables import pinned
from ..schema import SECTIONS


def segment(papers: DataFrame, text: str = "Abstract", summarise: bool = True) -> DataFrame:
    """papers with a column segments, array<struct<label, message>>."""
    made = pinned(papers, _sentences=X.full_sentences(X.thin_spaces(text)))
    if summarise:
        made = pinned(made.withColumnRenamed("_sentences", "_all"), _sentences=R.objective_summary("_all")).drop("_all")
    return pinned(made, segments=R.segmented("_sentences")).drop("_sentences")


def produce(papers: DataFrame, key: str = "doi", summarise: bool = True, own_root: str = "") -> DataFrame:
    """Sections of all papers with an abstract of which some section has a sentence. Narrow: nothing is shuffled.

    own_root: the folder of own papers' files; without one their links are relative.
    """
    df = segment(papers.filter(F.length(F.trim(F.coalesce("Abstract", F.lit("")))) > 0), summarise=summarise)

    def of(name: str):
        return F.transform(F.filter("segments", lambda s: s["label"] == name), lambda s: s["message"])

    df = pinned(df, **{f"_{s}": of(s) for s in ("objectives", "methods", "results")})
    df = df.filter(F.size("_objectives") + F.size("_methods") + F.size("_results") > 0)
    best = F.coalesce(R.chosen("_objectives"), R.chosen("_methods"), R.chosen("_results"))
    df = pinned(df, _best=best, _formula=A.author_formula("Authors", "year"))
    df = df.withColumn("_reported", R.reported("_best", "_formula"))
    none, name = F.lit(None).cast("string"), F.col(key).cast("string")
    full = {"website": A.reference_url("database", "doi", "Title", own_root), "database": F.col("database"), "reported": F.col("_reported"), "title": F.col("Title"), "journal": A.journal_name(F.coalesce("Journal", F.lit(""))), "authors": F.col("_formula"), "allauthors": F.col("Authors")}

    def row(section: str):
        given = {k: (v if section == "objectives" else none).cast("string") for k, v in full.items()}
        given |= {"fname": F.concat(name, F.lit(f"_{section}")), "paper_name": name, "section": F.lit(section), "year": F.col("year").cast("int"), "messages": F.col(f"_{section}"), "numCitedBy": F.col("numCitedBy").cast("double")}
        return F.struct(*(given[f.name].alias(f.name) for f in SECTIONS.fields))

    return df.select(F.inline(F.array(*map(row, ("objectives", "methods", "results")))))


def produce_new(papers: DataFrame, produced: DataFrame, key: str = "doi") -> DataFrame:
    """Sections produced elsewhere already are taken over; only other papers are produced."""
    names = papers.select(F.col(key).cast("string").alias("paper_name")).distinct()
    old = produced.join(names, "paper_name", "left_semi")
    done = produced.select(F.col("paper_name").alias(key)).distinct()
    return old.unionByName(produce(papers.join(done, key, "left_anti"), key))


def text_to_encode(sections: DataFrame) -> DataFrame:
    joined = F.array_join("messages", " ")
    return sections.select("fname", F.when(F.col("section") == "objectives", F.concat_ws(" ", "title", joined)).otherwise(joined).alias("text"))


def dispatch_text(papers: DataFrame) -> DataFrame:
    """What a paper's fields are judged by: its fields if more than two, else fields, keywords and title."""
    return papers.withColumn("dispatch_text", F.when(F.size("fields") > 2, F.array_join("fields", ", ")).otherwise(F.trim(F.concat_ws(" ", F.array_join("fields", ", "), F.coalesce("Keywords", F.lit("")), F.coalesce("Title", F.lit(""))))))


def training_pairs(sections: DataFrame) -> DataFrame:
    """(fname, query, sentence): made queries with the sentences they came from, for a search model's fine-tuning."""
    from ..operators.ranking import best_terms

    s = sections.select("fname", F.posexplode("messages").alias("i", "sentence")).filter(X.word_count("sentence") > 5).withColumn("id", F.concat_ws("#", "fname", "i"))
    return s.join(best_terms(s, "id", "sentence"), "id").select("fname", F.col("phrase").alias("query"), "sentence")
