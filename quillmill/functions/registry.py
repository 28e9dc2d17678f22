"""Functions that SQL texts can use: the library's Python functions under their names, and table functions.

sentences_of(text) gives a row a sentence. segments_of takes a table, and its result has that table's columns: in

    SELECT * FROM segments_of(TABLE(sentences) PARTITION BY doi ORDER BY place, text => 'sentence', words => 100)

the texts of each partition's rows are put together, in order, to segments of at most so many words (one row's text alone may
be longer). A segment has the other columns of its first row, how many rows it has, and their texts. A partition is streamed:
only the rows of one segment are held. Null texts are empty, and rows without a word are in the segment that they fall in.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .abbreviations import abbreviation_map


class _Sentences:
    """One row a sentence: its place and text."""

    def eval(self, text: str):
        import re

        place = 0
        for s in re.split(r"(?<=[.!?])\s+", text or ""):
            if s := s.strip(" "):
                yield place, s
                place += 1


class _Segments:
    """Rows of a partition put together to segments of some words."""

    def __init__(self):
        self.first, self.texts, self.n, self.rows = None, [], 0, 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, words: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(rows.dataType, T.StructType):
            raise ValueError("segments_of takes a table first")
        if text.value not in rows.dataType.names or not isinstance(rows.dataType[text.value].dataType, T.StringType):
            raise ValueError(f"no text column {text.value!r}; there are {', '.join(rows.dataType.names)}")
        if not isinstance(words.value, int) or words.value < 1:
            raise ValueError("words is a number above zero")
        schema = T.StructType([f for f in rows.dataType.fields if f.name != text.value])
        return AnalyzeResult(schema.add("n_rows", T.IntegerType()).add("segment", T.StringType()))

    def _made(self):
        out = (*self.first, self.rows, " ".join(t for t in self.texts if t))
        self.first, self.texts, self.n, self.rows = None, [], 0, 0
        return out

    def eval(self, rows, text, words):
        own = (rows[text] or "").strip()
        n = len(own.split())
        if self.first is not None and n and self.n + n > words:
            yield self._made()
        if self.first is None:
            self.first = tuple(rows[c] for c in rows.__fields__ if c != text)
        self.texts.append(own)
        self.n += n
        self.rows += 1

    def terminate(self):
        if self.first is not None:
            yield self._made()


def register(spark: SparkSession) -> list[str]:
    """Register abbreviations(text) and the table functions; more by spark.udf.register and model slots."""
    spark.udf.register("abbreviations", abbreviation_map)
    spark.udtf.register("sentences_of", F.udtf(_Sentences, returnType="place int, sentence string"))
    spark.udtf.register("segments_of", F.udtf(_Segments))
    return ["abbreviations", "sentences_of", "segments_of"]
