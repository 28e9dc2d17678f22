"""All suffixes of a table of strings in one order, by the distributed difference-cover algorithm.

A unit is a row (string, place, symbol). Suffixes at places 1 and 2 modulo 3 are named by their triples: the triples are
sorted over the cluster by ranges, equal ones get one name. The names of each string's places of one kind are strings of a
third of the length, whose suffixes are ranked the same way, until names cover as many units as are asked for (`depth`). The
remaining suffixes are ranked by a symbol and the rank that follows, and merged in: a suffix's rank is the number of suffixes
below it, counted against the sampled ones of both kinds. Suffixes that agree in their first `depth` units may have any
order among themselves; otherwise the order is right, so equal windows stand together.

Every step is a sort by ranges, a join by place or a count; tasks hold a batch of rows. It moves some hundred times the
text, see README, so the corpus query deals texts to shards first (see suffix_dedup). This is for corpora, or parts of
them, for which there is room.

Defined results: empty tables and strings give no rows. Strings are told apart by their number, equal strings rank alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, id_text, parts, settle, utf8

AT = ["g", "i"]


def units(docs: DataFrame) -> DataFrame:
    """(g, i, c) of (g, text): the bytes of each text, from 1."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, 1 << 20):
            data, at = utf8(b.column(1))
            own = np.repeat(np.arange(b.num_rows), np.diff(at))
            yield pa.record_batch([b.column(0).take(pa.array(own)), pa.array(np.arange(len(data)) - at[own]), pa.array(data.astype(np.int64) + 1)], names=["g", "i", "c"])

    return docs.mapInArrow(run, "g long, i long, c long")


def ranked(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with less (rows whose keys are below) and name (from 1, equal keys alike): a sort by ranges, written once."""
    fields = df.schema.names

    def number(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, names, start, last = TaskContext.get().partitionId(), 0, 0, 0, None
        for b in rows:
            k = np.stack([b.column(fields.index(c)).to_numpy(zero_copy_only=False) for c in keys], 1)
            if not len(k):
                continue
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]).any(axis=1)
            new[0] = last is None or bool((k[0] != last).any())
            head = np.where(new, np.arange(len(k)) + n, -1)
            head[0] = head[0] if new[0] else start
            less = np.maximum.accumulate(head)
            name = names + np.cumsum(new)
            yield pa.record_batch([*b.columns, pa.array(np.full(len(k), part, np.int32)), pa.array(less), pa.array(name)], names=[*fields, "_p", "less", "name"])
            n, names, start, last = n + len(k), int(name[-1]), int(less[-1]), k[-1]

    # Equal keys have one range, so no range's first row has the keys of the range before.
    made = df.repartitionByRange(parts(df), *keys).sortWithinPartitions(*keys)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    made = settle(made.mapInArrow(number, f"{kind}, _p int, less long, name long"))
    sizes = sorted((r._p, r.n, r.names) for r in made.groupBy("_p").agg(F.count("*").alias("n"), F.max("name").alias("names")).collect())
    rows, seen, base = 0, 0, {}
    for p, n, names in sizes:
        base[p] = (rows, seen)
        rows, seen = rows + n, seen + names
    shift = lambda at: F.create_map(*(F.lit(x) for p, b in base.items() for x in (p, b[at])))[F.col("_p")] if base else F.lit(0)
    return made.select(*fields, (F.col("less") + shift(0)).alias("less"), (F.col("name") + shift(1)).alias("name"))


def ahead(s: DataFrame, columns: dict[str, tuple[DataFrame, str, int]]) -> DataFrame:
    """s with more columns: the value that a table (g, i, value) has some places on, 0 past a string's end."""
    given = [s.select(*AT, F.struct(*[c for c in s.columns if c not in AT]).alias("own"), *[F.lit(None).cast("long").alias(k) for k in columns])]
    for name, (table, value, on) in columns.items():
        own = F.lit(None).cast(given[0].schema["own"].dataType)
        given.append(table.select("g", (F.col("i") - on).alias("i"), own.alias("own"), *[F.col(value).alias(k) if k == name else F.lit(None).cast("long").alias(k) for k in columns]))
    both = reduce(DataFrame.unionByName, given).groupBy(*AT).agg(F.first("own", True).alias("own"), *[F.max(k).alias(k) for k in columns])
    return both.filter("own is not null").select(*AT, "own.*", *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in columns])


def suffix_ranks(s: DataFrame, depth: int, covers: int = 1) -> DataFrame:
    """(g, i, rank): rank rises with the order of the suffixes' first `depth` units. s: (g, i, c); a symbol covers so many units."""
    s = settle(s)
    kind = F.col("i") % 3
    triples = ahead(s.filter(kind != 0), {"c1": (s, "c", 1), "c2": (s, "c", 2)})
    named = ranked(triples, ["c", "c1", "c2"])
    if 3 * covers < depth and named.agg((F.max("name") < F.count("*")).alias("again")).first().again:
        deeper = named.select((2 * F.col("g") + kind - 1).alias("g"), F.floor(F.col("i") / 3).alias("i"), F.col("name").alias("c"))
        found = suffix_ranks(deeper, depth, 3 * covers)
        sample = found.select(F.floor(F.col("g") / 2).alias("g"), (3 * F.col("i") + F.pmod("g", F.lit(2)) + 1).alias("i"), F.col("rank").alias("r"))
    else:
        sample = named.select(*AT, F.col("name").alias("r"))
    sample = settle(sample)
    at = settle(ahead(s, {"c1": (s, "c", 1), "r0": (sample, "r", 0), "r1": (sample, "r", 1), "r2": (sample, "r", 2)}))
    zero, one, two = (at.filter(kind == k) for k in range(3))

    def below(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """For each row of left, how many of right are below it, and the other way round."""
        both = ranked(left.select(*AT, *keys, F.lit(0).cast("long").alias("side")).unionByName(right.select(*AT, *keys, F.lit(1).cast("long").alias("side"))), keys)
        own = [ranked(x.select(*AT, *keys), keys) for x in (left, right)]
        return tuple(both.filter(F.col("side") == k).select(*AT, "less").unionByName(own[k].select(*AT, (-F.col("less")).alias("less"))).groupBy(*AT).agg(F.sum("less").alias("less")) for k in range(2))

    own_zero = ranked(zero.select(*AT, "c", "r1"), ["c", "r1"]).select(*AT, "less")
    own_sample = ranked(at.filter(kind != 0).select(*AT, "r0"), ["r0"]).select(*AT, "less")
    zero_one, one_zero = below(zero, one, ["c", "r1"])
    zero_two, two_zero = below(zero, two, ["c", "c1", "r2"])
    counts = reduce(DataFrame.unionByName, (own_zero, own_sample, zero_one, one_zero, zero_two, two_zero))
    return settle(counts.groupBy(*AT).agg((F.sum("less") + 1).alias("rank")))


def shared_prefixes(docs: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, g, i): the windows that also start in a document with a smaller doc_id. g: the row's number.

    Neighbours in the order of all suffixes whose first units are equal are one string's occurrences.
    """
    rows = settle(id_text(docs, id_col, text_col).filter("doc_id is not null").withColumn("g", F.monotonically_increasing_id()))
    ranks = suffix_ranks(units(rows.select("g", "text")), window)
    sizes = rows.select("g", "doc_id", F.octet_length("text").alias("n"), F.col("text").cast("binary").alias("bytes"))
    fits = ranks.join(sizes, "g").filter(F.col("i") + window <= F.col("n"))
    rank_order = fits.select("g", "i", "doc_id", "rank", F.substring("bytes", F.col("i").cast("int") + 1, F.lit(window)).alias("prefix"))

    def groups(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, last = TaskContext.get().partitionId(), 0, None
        for b in found:
            prefixes, own = b.column(4).to_pylist(), []
            for p in prefixes:
                n += p != last
                last = p
                own.append(n)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), b.column(4), pa.array([part << 40 | x for x in own], pa.int64())], names=["g", "i", "doc_id", "prefix", "grp"])

    made = settle(rank_order.repartitionByRange(parts(docs), "rank").sortWithinPartitions("rank").mapInArrow(groups, "g long, i long, doc_id long, prefix binary, grp long"))
    # Ties in depth may put a string's occurrences on both sides of a range's bound: groups at bounds with equal prefixes are one.
    ends = made.groupBy(F.shiftright("grp", 40).alias("p")).agg(F.min(F.struct("grp", "prefix")).alias("a"), F.max(F.struct("grp", "prefix")).alias("b")).orderBy("p").collect()  # a row a range
    same: dict[int, int] = {}
    for x, y in zip(ends, ends[1:], strict=False):
        if x.b.prefix == y.a.prefix:
            same[y.a.grp] = same.get(x.b.grp, x.b.grp)
    name: Column = F.col("grp")
    if same:
        name = F.coalesce(F.create_map(*(F.lit(v) for p in same.items() for v in p))[F.col("grp")], F.col("grp"))
    made = made.select("g", "i", "doc_id", name.alias("grp"))
    least = settle(made.groupBy("grp").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most"))
    return made.join(least, "grp").filter(F.col("doc_id") > F.col("least")).select("doc_id", "g", "i")
