"""Dedupe, set operations, upserts, fills and samples of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: later filters and projections can't put the expressions in their place."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def spread(df: DataFrame) -> DataFrame:
    """A small input that lies in fewer parts than there are cores is dealt to all of them; a large one stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def first_wins(df: DataFrame, key: str | list[str], order: str | Column) -> DataFrame:
    """One row a key, the first by order."""
    return _ranked(df, key, F.col(order) if isinstance(order, str) else order)


def last_wins(df: DataFrame, key: str | list[str], order: str | Column) -> DataFrame:
    """One row a key, the last by order: later writes replace earlier ones."""
    return _ranked(df, key, (F.col(order) if isinstance(order, str) else order).desc())


def _ranked(df: DataFrame, key, order: Column) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("_rank = 1").drop("_rank")


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the registry of seen keys."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def register(seen: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return seen.select(key).unionByName(df.select(key)).distinct()


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All of new, and the rows of old whose key isn't in new."""
    return without(old, new, key).unionByName(new, allowMissingColumns=True)


def merged(tables: list[DataFrame], key: str) -> DataFrame:
    """Union in which later tables replace earlier ones' rows of equal key."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("_seq", F.lit(k))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return last_wins(out, key, "_seq").drop("_seq")


def fill(df: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """Missing values of a column from another table's row of equal key."""
    found = first_wins(other.select(key, F.col(column).alias("_new")).filter("_new is not null"), key, "_new")
    return df.join(found, key, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")


def fill_within(df: DataFrame, group: str, column: str, source: Column) -> DataFrame:
    """Missing values of a column from the group's row for which source holds."""
    w = W.partitionBy(group)
    return df.withColumn(column, F.coalesce(column, F.max(F.when(source, F.col(column))).over(w)))


def quota_sample(df: DataFrame, group: str, key: Column, size: int, groups: int) -> DataFrame:
    """size / groups + 1 rows of each group, those with the least hash key: the same rows wherever they lie."""
    quota = size // max(1, groups) + 1
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(group).orderBy(key))).filter(F.col("_rank") <= quota).drop("_rank")


def random_rows(df: DataFrame, k: int, key: Column) -> DataFrame:
    return df.orderBy(key).limit(k)


def row_slice(df: DataFrame, order: str, start: int, stop: int | None) -> DataFrame:
    """Rows start to stop (exclusive) by order, nulls first, equal ones by the hash of the row.

    The rows are cut into ranges at fixed bounds, which are written into the plan: counting and ranking cut alike, whatever
    tasks run again. Only the ranges that the slice touches are ranked, each in a task of its own. The bounds come from a
    sample by hash of some twenty values a range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    names = [f.name for f in df.schema.fields if "map" not in f.dataType.simpleString()]
    keyed = pinned(df, _h=F.xxhash64(*names))
    wide = 1 << 20
    share = min(1.0, 20 * n / max(1, df.count()))
    sample = keyed.filter(F.pmod(F.xxhash64("_h", F.lit(7)), F.lit(wide)) < max(1, int(share * wide))).filter(F.col(order).isNotNull())
    sample = sample.select(order, "_h").orderBy(order, "_h").collect()  # about 20 n values
    bounds = [sample[len(sample) * k // n] for k in range(1, n)] if sample else []
    below = lambda b: (F.col(order) < F.lit(b[0])) | ((F.col(order) == F.lit(b[0])) & (F.col("_h") < F.lit(b[1])))

    def part(lo: int, hi: int) -> Column:
        """How many bounds aren't above the row, of those from lo to hi, by halving."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(below(bounds[mid]), part(lo, mid)).otherwise(part(mid + 1, hi))

    cut = pinned(keyed, _part=F.when(F.col(order).isNull(), -1).otherwise(part(0, len(bounds))))
    sizes = {r._part: r.n for r in cut.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row a range
    base, total = {}, 0
    for p in sorted(sizes):
        base[p], total = total, total + sizes[p]
    touched = [p for p, b in base.items() if b + sizes[p] > start and (stop is None or b < stop)]
    if not touched:
        return df.limit(0)
    whole = [p for p in touched if base[p] >= start and (stop is None or base[p] + sizes[p] <= stop)]
    edge = [p for p in touched if p not in whole]  # two ranges at most
    out = cut.filter(F.col("_part").isin(whole)).select(*df.columns)
    if edge:
        shift = F.create_map(*(F.lit(x) for p in edge for x in (p, base[p])))
        at = F.row_number().over(W.partitionBy("_part").orderBy(F.col(order).asc_nulls_first(), "_h")) + shift[F.col("_part")] - 1
        ranked = cut.filter(F.col("_part").isin(edge)).withColumn("_at", at).filter(F.col("_at") >= start)
        ranked = ranked if stop is None else ranked.filter(F.col("_at") < stop)
        out = out.unionByName(ranked.select(*df.columns))
    return out


def counts(df: DataFrame, by: str, name: str = "n") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias(name))


def exploded_counts(df: DataFrame, array: str, name: str) -> DataFrame:
    return df.select(F.explode(array).alias(name)).groupBy(name).agg(F.count("*").alias("n"))
