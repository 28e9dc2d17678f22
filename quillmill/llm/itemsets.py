"""Closed frequent itemsets of baskets, with the figures of their rules: cumulative intersection in item-conditional shards.

Items are ordered by (support, id), the rarest first. The shard of an item has, of each basket that holds it, the items that
follow it. So an item that a third of all baskets hold comes last or nearly so, and its shard has few different rows: the
k-th of the frequent items has 2 ** (k - 1) of them at most. Equal rows are counted before they are shuffled. A basket is
sent once to each part that holds some of its items, never once for each pair of them: a basket of very many items costs its
length times the number of parts.

In a shard, items that the rest of the item's baskets don't hold often enough go first. Each basket is then intersected with
all sets found so far; the intersections are kept in a prefix tree with the weight of the baskets that hold them. Items are
taken out of a set when the baskets that are left can't bring it to the least support with them. A shard's sets are owned by
its item, their least one, and are closed among the items that follow it. A set isn't closed at all if an item before its
owner is in all its baskets; then the closure, owned by an earlier item, ends in just this set and has its support, so the
shards are merged by one anti-join with the ends of all sets. Supports of a set less one item, returned or not, are asked
from the shard that owns the rest: that of its smallest closure.

Memory: a task holds the different rows of one part (of about ROWS baskets, more parts for more baskets), and the sets of
one shard. Only the number of baskets and the number of pairs come to the driver.

Defined results: rows without basket or item id are left out, whatever their other columns hold; repeated pairs count once.
An empty table has no sets. Extra columns of any name are never read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, settle, table, tune

#: Least support of a set: so many baskets, and one in so many.
LEAST, SHARE = 5, 20_000
#: Pairs of basket and item that a part should have at most.
ROWS = 2_000_000


class Repository:
    """A prefix tree of item sets, each path ascending. A node has the greatest weight of the sets that go through it."""

    def __init__(self) -> None:
        self.root: list = [0, {}]
        self.size = 0

    def _path(self, root: list, items: tuple) -> list[list]:
        nodes = [root]
        for i in items:
            if i not in nodes[-1][1]:
                nodes[-1][1][i] = [0, {}]
            nodes.append(nodes[-1][1][i])
        return nodes

    def add(self, basket: tuple, weight: int) -> None:
        """Intersect a basket with all sets; each intersection weighs as much as the heaviest of its sets, and weight more."""
        held, last = frozenset(basket), basket[-1]
        found: list = [0, {}]
        stack = [(self.root, found)]
        while stack:
            node, into = stack.pop()
            for item, child in node[1].items():
                if item > last:
                    continue
                at = into
                if item in held:
                    at = into[1].get(item)
                    if at is None:
                        at = into[1][item] = [0, {}]
                if child[0] > at[0]:
                    at[0] = child[0]
                if child[1]:
                    stack.append((child, at))
        whole = self._path(found, basket)[-1]
        merged, todo = [], [(found, self.root)]
        while todo:
            new, old = todo.pop()
            for item, child in new[1].items():
                own = old[1].get(item)
                if own is None:
                    own = old[1][item] = [0, {}]
                    self.size += 1
                merged.append((child, own, old))
                todo.append((child, own))
        for new, own, above in reversed(merged):  # children before their parents
            if new[0] or new is whole:
                own[0] = max(own[0], new[0] + weight)
            above[0] = max(above[0], own[0])

    def sets(self) -> Iterator[tuple[tuple, int]]:
        """Sets that weigh more than all that continue them."""
        stack = [((), self.root)]
        while stack:
            path, node = stack.pop()
            if path and node[0] > max((c[0] for c in node[1].values()), default=0):
                yield path, node[0]
            stack += [((*path, i), c) for i, c in node[1].items()]

    def prune(self, left: dict[int, int], least: int) -> None:
        """Take items out of sets that can't reach the least weight with them; left: the weight of baskets to come, by item."""
        held = list(self.sets())
        self.root, self.size = [0, {}], 0
        for items, weight in held:
            rest = tuple(i for i in items if weight + left[i] >= least)
            for node in self._path(self.root, rest)[1:]:
                self.size += 1
                node[0] = max(node[0], weight)

    def closed(self, least: int) -> list[tuple[tuple, int]]:
        """Sets of the least weight at least that no other set of their weight or more contains."""
        held = sorted((x for x in self.sets() if x[1] >= least), key=lambda x: (-x[1], -len(x[0])))
        masks = _masks(held)
        return [x for k, x in enumerate(held) if not _holders(masks, x[0]) & ((1 << k) - 1)]


def _masks(held: list[tuple[tuple, int]]) -> dict[int, int]:
    """For each item a number whose k-th bit tells whether the k-th set has it."""
    bits: dict[int, bytearray] = {}
    n = len(held) // 8 + 1
    for k, (items, _) in enumerate(held):
        for i in items:
            if i not in bits:
                bits[i] = bytearray(n)
            bits[i][k >> 3] |= 1 << (k & 7)
    return {i: int.from_bytes(b, "little") for i, b in bits.items()}


def _holders(masks: dict[int, int], items: tuple) -> int:
    """The sets that contain all items, as a mask."""
    out = -1
    for i in items:
        out &= masks.get(i, 0)
    return out


def mined(baskets: Counter, least: int, prune_from: int = 1000) -> list[tuple[tuple, int]]:
    """Closed sets of weighted baskets (ascending tuples), with their weights. A tree of prune_from nodes is pruned, and again
    whenever it has doubled."""
    left: Counter = Counter()
    for basket, weight in baskets.items():
        for i in basket:
            left[i] += weight
    repository, limit = Repository(), prune_from
    for basket, weight in sorted(baskets.items(), key=lambda x: (len(x[0]), x[0])):
        repository.add(basket, weight)
        for i in basket:
            left[i] -= weight
        if repository.size > limit:
            repository.prune(left, least)
            limit = max(prune_from, 2 * repository.size)
    return repository.closed(least)


def shard_sets(flat: np.ndarray, starts: np.ndarray, weights: np.ndarray, owners: np.ndarray, least: int) -> Iterator[tuple[tuple, int]]:
    """The sets that the given items own. flat, starts: ascending baskets of item numbers, one after the other."""
    lengths = np.diff(starts)
    row = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(flat, kind="stable")
    by_item = flat[order]
    for x in owners.tolist():
        at = order[np.searchsorted(by_item, x) : np.searchsorted(by_item, x, "right")]
        w, begin = weights[row[at]], at + 1
        support, n = int(w.sum()), starts[row[at] + 1] - begin
        if not (total := int(n.sum())):
            yield (x,), support
            continue
        items = flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(total)]
        _, which = np.unique(items, return_inverse=True)
        counts = np.zeros(int(which.max()) + 1, np.int64)
        np.add.at(counts, which, np.repeat(w, n))
        if counts.max() < support:
            yield (x,), support
        often = counts[which] >= least
        if not often.any():
            continue
        of, kept = np.repeat(np.arange(len(at)), n)[often], items[often]
        cuts = np.flatnonzero(np.diff(of)) + 1
        baskets: Counter = Counter()
        for k, basket in zip(of[np.concatenate(([0], cuts))].tolist(), np.split(kept, cuts), strict=True):
            baskets[tuple(basket.tolist())] += int(w[k])
        for found, weight in mined(baskets, least):
            yield (x, *found), weight


def _by_key(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Batches whose first column is sorted, as one table for each of its values."""
    key, held = None, []
    for b in rows:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[a] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = keys[a]
            held.append(b.slice(a, z - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _part(item: int, n: int) -> int:
    return zlib.crc32(str(item).encode()) % n


def owned_sets(pairs: DataFrame, least: int) -> DataFrame:
    """(items, supports, support): the sets of all shards, items in their order, supports of the items alone.

    pairs: distinct (basket, item). All frequent sets that are closed are among them.
    """
    n_parts = max(parts(pairs), pairs.count() // ROWS + 1)
    common = settle(pairs.groupBy("item").agg(F.count("*").alias("s")).filter(F.col("s") >= least))
    baskets = pairs.join(common, "item").groupBy("basket").agg(F.sort_array(F.collect_list(F.struct("s", "item"))).alias("tail"))
    part = lambda x: (F.crc32(x["item"].cast("string").cast("binary")) % n_parts).cast("int")
    sent = baskets.select("tail", F.transform("tail", part).alias("at")).select("tail", "at", F.explode(F.array_distinct("at")).alias("part"))
    rows = sent.select("part", F.slice("tail", F.array_position("at", F.col("part")).cast("int"), F.size("tail")).alias("tail")).groupBy("part", "tail").agg(F.count("*").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, held in _by_key(batches):
            tails = held.column("tail").combine_chunks()
            if isinstance(tails, pa.ChunkedArray):
                tails = pa.concat_arrays(tails.chunks)
            both = tails.flatten()
            s, item = (np.asarray(both.field(c)) for c in (0, 1))
            names, flat = np.unique(np.stack([s, item], 1), axis=0, return_inverse=True)  # by support, then id
            starts = np.concatenate(([0], np.cumsum(tails.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            own = np.array([x for x, i in enumerate(names[:, 1].tolist()) if _part(i, n_parts) == k], np.int64)
            out = list(shard_sets(flat.ravel().astype(np.int64), starts, held.column("w").to_numpy(), own, least))
            for a in range(0, len(out), 10_000):
                some = out[a : a + 10_000]
                ids, sup = ([names[list(x), c].tolist() for x, _ in some] for c in (1, 0))
                yield pa.record_batch([pa.array(ids, pa.list_(pa.int64())), pa.array(sup, pa.list_(pa.int64())), pa.array([w for _, w in some], pa.int64())], names=["items", "supports", "support"])

    return rows.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(run, "items array<long>, supports array<long>, support long")


def closed_sets(owned: DataFrame) -> DataFrame:
    """Owned sets that aren't the end of an earlier item's set with the same support."""
    ends = owned.filter(F.size("items") > 1).select("support", F.explode(F.sequence(F.lit(2), F.size("items"))).alias("k"), F.col("items").alias("whole"))
    ends = ends.select(F.slice("whole", F.col("k"), F.size("whole")).alias("items"), "support").distinct()
    return owned.join(ends, ["items", "support"], "left_anti")


def supports_of(asked: DataFrame, owned: DataFrame) -> DataFrame:
    """(items, support) of asked sets (items in their order), none of which is rarer than the sets owned are."""
    known = owned.select(F.col("items")[0].alias("owner"), F.lit(0).alias("q"), "items", "support")
    asks = asked.select("items").distinct().select(F.col("items")[0].alias("owner"), F.lit(1).alias("q"), "items", F.lit(0).cast("long").alias("support"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _by_key(batches):
            rows = list(zip(t.column("q").to_pylist(), t.column("items").to_pylist(), t.column("support").to_pylist(), strict=True))
            questions = [x[1] for x in rows if x[0]]
            if not questions:
                continue
            held = sorted(((tuple(x[1]), x[2]) for x in rows if not x[0]), key=lambda x: -x[1])
            masks = _masks(held)
            heaviest = [held[((m := _holders(masks, q)) & -m).bit_length() - 1][1] for q in questions]
            yield pa.record_batch([pa.array(questions, pa.list_(pa.int64())), pa.array(heaviest, pa.int64())], names=["items", "support"])

    return known.unionByName(asks).repartition(parts(owned), "owner").sortWithinPartitions("owner", "q").mapInArrow(run, "items array<long>, support long")


def with_rules(closed: DataFrame, owned: DataFrame, n_baskets: int) -> DataFrame:
    """closed with rules: array of (c, a, s), ascending by c, null for none. c follows from the others of its set: at least
    60 of 100 baskets that hold them (a) hold c too, and more than by chance (s: support of c alone)."""
    each = closed.filter(F.size("items") > 1).select("items", "supports", "support", F.posexplode("items").alias("k", "c"))
    each = each.select("items", "support", "c", F.col("supports")[F.col("k")].alias("s"), *(F.concat(F.slice(x, F.lit(1), F.col("k")), F.slice(x, F.col("k") + 2, F.size(x))).alias(y) for x, y in (("items", "rest"), ("supports", "rest_supports"))))
    single = F.size("rest") == 1
    several = settle(each.filter(~single).drop("rest_supports"))
    found = supports_of(several.select(F.col("rest").alias("items")), owned).select(F.col("items").alias("rest"), F.col("support").alias("a"))
    columns = ["items", "support", "c", "a", "s"]
    each = each.filter(single).withColumn("a", F.col("rest_supports")[0]).select(*columns).unionByName(several.join(found, "rest").select(*columns))
    wide = {x: F.col(x).cast("decimal(19,0)") for x in ("support", "a", "s")}  # products can't overflow
    rules = each.filter((100 * wide["support"] >= 60 * wide["a"]) & (wide["support"] * F.lit(n_baskets).cast("decimal(19,0)") > wide["a"] * wide["s"]))
    return closed.join(rules.groupBy("items").agg(F.array_sort(F.collect_list(F.struct("c", "a", "s"))).alias("rules")), "items", "left")


def itemsets(lines: DataFrame, basket_col: str = "sale_id", item_col: str = "item_id", least: int = LEAST, share: int = SHARE) -> DataFrame:
    """(items, supports, support, rules): closed sets that least baskets and one in share of all hold."""
    tune(lines.sparkSession)
    pairs = settle(lines.select(F.col(basket_col).cast("long").alias("basket"), F.col(item_col).cast("long").alias("item")).dropna().distinct())
    n_baskets = pairs.select("basket").distinct().count()
    owned = settle(owned_sets(pairs, max(1, least, -(-n_baskets // share))))
    return with_rules(settle(closed_sets(owned)), owned, n_baskets)


def op13_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = itemsets(table(spark, sf_dir, "sale_lines").select("sale_id", "item_id"))
    text = lambda x: x.cast("string")
    rule = lambda r: F.concat_ws(":", text(r["c"]), text(r["a"]), text(r["s"]))
    rules: Column = F.coalesce("rules", F.array().cast("array<struct<c:bigint,a:bigint,s:bigint>>"))
    return found.select(
        F.array_join(F.transform(F.array_sort("items"), text), ",").alias("items"), F.size("items").cast("long").alias("n_items"), "support", F.size(rules).cast("long").alias("n_rules"),
        F.array_min(F.transform(rules, lambda r: F.struct(r["a"].alias("a"), r["c"].alias("c"))))["c"].alias("best_item"), F.sha2(F.array_join(F.transform(rules, rule), ";").cast("binary"), 256).alias("rules_sha256"),
    )


ORACLE_OP13 = r"""
WITH RECURSIVE pairs AS (SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL),
n AS (SELECT count(DISTINCT sale_id) AS b, greatest(5, ceil(count(DISTINCT sale_id) / 20000.0)) AS least FROM pairs),
sets AS (
  SELECT [item_id] AS items, item_id AS last, list(sale_id) AS held FROM pairs GROUP BY item_id HAVING count(*) >= (SELECT least FROM n)
  UNION ALL
  SELECT list_append(s.items, p.item_id), p.item_id, list(p.sale_id)
  FROM (SELECT items, last, unnest(held) AS sale_id FROM sets) s JOIN pairs p ON p.sale_id = s.sale_id AND p.item_id > s.last
  GROUP BY s.items, p.item_id HAVING count(*) >= (SELECT least FROM n)),
sized AS (SELECT items, len(held) AS support FROM sets),
less AS (
  SELECT items AS whole, support, c, list_filter(items, lambda x: x <> c) AS rest
  FROM (SELECT items, support, unnest(items) AS c FROM sized WHERE len(items) > 1)),
closed AS (SELECT * FROM sized z WHERE NOT EXISTS (SELECT 1 FROM less l WHERE l.rest = z.items AND l.support = z.support)),
rules AS (
  SELECT l.whole, l.c, a.support AS a, s.support AS s
  FROM less l JOIN sized a ON a.items = l.rest JOIN sized s ON s.items = [l.c]
  WHERE 100 * l.support >= 60 * a.support AND l.support * (SELECT b FROM n) > a.support * s.support)
SELECT array_to_string(z.items, ',') AS items, len(z.items) AS n_items, z.support AS support, count(r.c) AS n_rules,
  arg_min(r.c, (r.a, r.c)) AS best_item,
  sha256(coalesce(string_agg(r.c || ':' || r.a || ':' || r.s, ';' ORDER BY r.c), '')) AS rules_sha256
FROM closed z LEFT JOIN rules r ON r.whole = z.items
GROUP BY z.items, z.support
"""
