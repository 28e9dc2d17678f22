"""Schemas of the tables that plans exchange."""

from __future__ import annotations

from pyspark.sql import types as T

PAPERS = T.StructType(
    [
        T.StructField("doi", T.StringType()),
        T.StructField("Authors", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("database", T.StringType()),
        T.StructField("fields", T.ArrayType(T.StringType())),
        T.StructField("Abstract", T.StringType()),
        T.StructField("Keywords", T.StringType()),
        T.StructField("Title", T.StringType()),
        T.StructField("numCitedBy", T.DoubleType()),
        T.StructField("Journal", T.StringType()),
    ]
)
SECTIONS = T.StructType(
    [
        T.StructField("fname", T.StringType()),
        T.StructField("paper_name", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("website", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("database", T.StringType()),
        T.StructField("messages", T.ArrayType(T.StringType())),
        T.StructField("reported", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("journal", T.StringType()),
        T.StructField("authors", T.StringType()),
        T.StructField("numCitedBy", T.DoubleType()),
        T.StructField("allauthors", T.StringType()),
    ]
)
DEFAULT_CITATIONS = 0.5
UNKNOWN_YEAR = 999
SECTION_NAMES = ("objectives", "methods", "results")
