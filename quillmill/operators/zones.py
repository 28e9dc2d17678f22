"""Storage zones: formatted, dispatched and produced tables under one root, partitioned by field and database."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.authors import reference_url, without_point_zero
from ..functions.rules import is_english
from ..shared import settle
from .tables import fill, fill_within, last_wins, quota_sample, upsert


class Zone:
    """A table of one zone. Paths are read and written by Spark alone, so any store it knows will do."""

    def __init__(self, spark: SparkSession, root: str, name: str, partitions: tuple[str, ...] = ("database",)):
        self.spark, self.path, self.partitions = spark, f"{root.rstrip('/')}/{name}", partitions

    def exists(self) -> bool:
        try:
            self.spark.read.parquet(self.path)
        except AnalysisException:  # no such path, or nothing there yet
            return False
        return True

    def read(self, **where: str) -> DataFrame:
        """The rows of some partitions, or all; Spark reads only those partitions' files."""
        df = self.spark.read.parquet(self.path)
        for k, v in where.items():
            df = df.filter(F.col(k) == v)
        return df

    def elements(self) -> DataFrame:
        """The partitions there are, with their counts."""
        return self.read().groupBy(*self.partitions).agg(F.count("*").alias("n"))

    def write(self, df: DataFrame) -> None:
        """Replace the partitions that df has rows of; others stay."""
        df.repartition(*self.partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.partitions).parquet(self.path)

    def upsert(self, df: DataFrame, key: str) -> None:
        """New rows replace old ones of equal key, whichever partition those are in.

        Only partitions that new rows go to, or that lose a row to another one, are rewritten. The result is staged first, in a
        folder of this write's own, as it reads what it replaces. Partitions that have lost all their rows are emptied last.
        """
        if not self.exists():
            return self.write(df)
        new = settle(df)
        keys = new.select(key).distinct()
        touched = settle(new.select(*self.partitions).unionByName(self.read().join(keys, key, "left_semi").select(*self.partitions)).distinct())
        same = lambda other: [touched[c].eqNullSafe(other[c]) for c in self.partitions]
        held = self.read()
        staged = settle(upsert(held.join(touched, same(held), "left_semi"), new, key))
        self.write(staged)
        empty = touched.join(staged, same(staged), "left_anti")
        for row in empty.collect():  # partitions, not rows
            self.remove(**row.asDict())
        return None

    def compact(self) -> None:
        """Rewrite every partition in few files."""
        self.write(settle(self.read()))

    def remove(self, **where: str | None) -> None:
        """Drop the rows of some partitions. Only their folders are written, each with an empty file that keeps the columns."""
        rows = self.read()
        for k, v in where.items():
            rows = rows.filter(F.col(k).eqNullSafe(F.lit(v)))
        # The column is an address, with signs of a partition's value written as %..; a path has them as they are.
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        folders = rows.select(F.regexp_replace(path, "/[^/]*$", "").alias("at")).distinct().collect()  # partitions, not rows
        schema = self.read().drop(*self.partitions).schema
        for folder in folders:
            self.spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(folder["at"])

    def reset(self) -> None:
        """Drop all rows; the table and its columns stay."""
        self.read().limit(0).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self.path)

    def merge(self, key: str, order: str) -> DataFrame:
        """All partitions as one, later rows replacing earlier ones."""
        return last_wins(self.read(), key, order)

    def sample(self, size: int, key: str, group: str = "database") -> DataFrame:
        df = self.read()
        return quota_sample(df, group, F.md5(F.col(key).cast("string")), size, df.select(group).distinct().count())


def drop_empty_sections(sections: DataFrame) -> DataFrame:
    """Sections without messages go, but objectives stay if a sibling has some."""
    from pyspark.sql import Window as W

    some = F.max(F.size("messages")).over(W.partitionBy("paper_name"))
    return sections.withColumn("_most", some).filter((F.size("messages") > 0) | ((F.col("section") == "objectives") & (F.col("_most") > 0))).drop("_most")


def english_sections(sections: DataFrame) -> DataFrame:
    return sections.filter(is_english(F.coalesce(F.get("messages", F.lit(0)), "title")))


def correct_years(sections: DataFrame) -> DataFrame:
    fix = {c: F.when(F.col("section") == "objectives", without_point_zero(c)).otherwise(F.col(c)) for c in ("authors", "reported")}
    return sections.withColumns(fix | {"year": F.col("year").cast("int")})


def clean(sections: DataFrame, dispatched: DataFrame) -> DataFrame:
    """Empty and foreign sections go; years, citations and authors are mended and filled from dispatched papers."""
    out = correct_years(english_sections(drop_empty_sections(sections)))
    out = fill_within(out, "paper_name", "year", F.col("section") == "objectives")
    out = fill(out, dispatched, "paper_name", "numCitedBy")
    return fill(out, dispatched, "paper_name", "allauthors")


def repair_websites(sections: DataFrame, database: str = "pmc", own_root: str = "") -> DataFrame:
    """The links of one database's papers, made anew from their keys; only objectives have one."""
    link = reference_url(F.lit(database), F.col("paper_name"), F.col("title"), own_root)
    return sections.withColumn("website", F.when((F.col("database") == database) & (F.col("section") == "objectives"), link).otherwise(F.col("website")))


def pivoted(sections: DataFrame) -> DataFrame:
    """One row a paper: how many messages each section has."""
    return sections.groupBy("paper_name").pivot("section", ["objectives", "methods", "results"]).agg(F.sum(F.size("messages")))


def query_table(sections: DataFrame) -> DataFrame:
    """As searches read it: citations default to 0.5, most cited first in every file."""
    return sections.withColumn("numCitedBy", F.coalesce("numCitedBy", F.lit(0.5))).sortWithinPartitions(F.col("numCitedBy").desc(), "fname")
