"""Exact dedup, the prefix trie and itemsets against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillmill.llm import exact_dedup, itemsets, prefix_trie

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()

COPIES = [*enumerate(["a b", "a  b", "a\tb", "b a", "", None, " ", "  ", "x", "y", "y", "x", "a b", "w " * 300_000])]
COPIES += [(3, "b a")] * 3 + [(None, "q"), (None, "q"), (None, "y"), (-4, "b a"), (99, "w\n" * 300_000)]


def _kept(rows):
    norm = [(d, re.sub(r"[\x20\x09-\x0d]+", " ", t or "")) for d, t in rows]
    out, seen = [], set()
    for d, t in norm:
        ids = [x for x, u in norm if u == t]
        keep = min((x for x in ids if x is not None), default=None)
        first = d == keep and t not in seen
        if first:
            seen.add(t)
        out.append((d, keep, len(ids), first, SHA(t)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("hash128", [exact_dedup.content_hash, lambda t: F.lit(b"x"), lambda t: F.length(t)])
def test_exact_groups_under_any_hash(spark, hash128):
    df = spark.createDataFrame(COPIES, "doc_id long, text string").select(F.lit(1).alias("h"), F.lit("n").alias("norm"), F.lit(2).alias("keep_id"), "*")
    got = exact_dedup.exact_groups(df, hash128=hash128).collect()
    assert sorted(repr(tuple(r)) for r in got) == _kept(COPIES)


def test_many_repeated_rows_are_counted_out(spark):
    df = spark.range(150_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    got = exact_dedup.exact_groups(df).groupBy("kept", "keep_id", "group_size").count().collect()
    assert sorted(tuple(r) for r in got) == [(False, 1, 150_000, 149_999), (True, 1, 150_000, 1)]


def test_without_copies(spark):
    df = spark.createDataFrame(COPIES[:12], "doc_id long, text string").withColumn("h", F.lit(1))
    got = exact_dedup.without_copies(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [0, 3, 4, 6, 8, 9]


def test_exact_dedup_runs_no_python(spark):
    plan = exact_dedup.exact_groups(spark.createDataFrame(COPIES[:4], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def _trie(rows):
    talks = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            talks[c].append((t is not None, t or 0, r or "", x or ""))
    talks = {c: [x[2:] for x in sorted(v)] for c, v in talks.items()}
    made = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(talks.get(c - int(math.fmod(c, 100)), [])[:h]) + tuple(own[h:])
    nodes = collections.defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            nodes[t[:d]].append(c)
    kids = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += kids[k] == 0
    return sorted(repr((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], SHA(",".join(str(c) for c in sorted(m) if len(made[c]) == len(k))))) for k, m in nodes.items())


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize(("n_parts", "n", "piece", "say"), [(1, 1, 10, "xy"), (1, 60, 1, "x"), (3, 120, 2, "xy"), (8, 200, 1, "x"), (8, 200, 9, "xyz"), (24, 90, 3, "xxxy")])
def test_trie_equals_that_of_all_prefixes(spark, n_parts, n, piece, say):
    r = random.Random(n_parts * n)
    rows = []
    for c in r.sample(range(-400, 1500), n):
        for t in r.sample(range(14), r.choice([1, 2, 3, 4, 9, 14])):
            rows.append((c, t if t else None, r.choice(["u", None]), r.choice(say)))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n_parts))
    try:
        df = spark.createDataFrame([*rows, (None, 1, "u", "x")], "conv_id long, turn long, role string, text string").withColumn("keys", F.lit(1))
        got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_lists(df)), piece).select(NODE).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert sorted(repr(tuple(x)) for x in got) == _trie(rows)


def test_trie_of_equal_and_of_long_conversations(spark):
    rows = [(c, t, "u", "same") for c in range(0, 90_000, 100) for t in range(2)]  # one conversation, 900 times
    rows += [(7, t, "u", f"{t}") for t in range(6000)] + [(8, t, "u", f"{t}") for t in range(5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lists = prefix_trie.turn_lists(df).select("conv_id", F.transform("turns", lambda t: t["h"]).alias("keys"), F.transform("turns", lambda t: t["n"]).alias("sizes"))
    got = {(r.conv_id, r.depth): r for r in prefix_trie.trie(lists).collect()}
    same = got[0, 2]
    assert (same.n_convs, same.n_children, same.n_leaves, same.saved_tokens, same.parent_conv_id) == (900, 0, 1, 899 * 4, 0)
    assert same.ends_sha256 == SHA(",".join(str(c) for c in range(0, 90_000, 100)))
    assert got[0, 0].n_convs == 902 and got[0, 0].n_children == 2 and got[0, 0].n_leaves == 2 and len(got) == 1 + 2 + 6000
    shared = sum(len(str(t)) for t in range(5000))
    assert got[7, 1].saved_tokens == shared and got[7, 5000].ends_sha256 == SHA("8") and got[7, 6000].ends_sha256 == SHA("7")
    assert got[0, 0].saved_tokens == shared + 2 * 899 * 4


def test_repeated_turns_have_a_defined_order(spark):
    rows = [(1, 2, "u", "b"), (1, 2, "u", "a"), (1, 2, "u", "a"), (1, None, None, None)]
    lists = [prefix_trie.turn_lists(spark.createDataFrame(x, "conv_id long, turn long, role string, text string")).first().turns for x in (rows, rows[::-1])]
    assert lists[0] == lists[1] and [t.n for t in lists[0]] == [0, 1, 1, 1] and len(lists[0]) == 4


def _supports(baskets, least):
    items, held, level = sorted(set(itertools.chain(*baskets))), {}, [()]
    while level:
        level = [(*z, i) for z in level for i in items if not z or i > z[-1]]
        level = [z for z in level if (n := sum(b >= set(z) for b in baskets)) >= least and not held.__setitem__(z, n)]
    return held


def _closed(held):
    return {z: n for z, n in held.items() if not any(n == m and set(z) < set(y) for y, m in held.items())}


@pytest.mark.parametrize("prune_from", [1, 5, 1000])
def test_sets_of_one_shard(prune_from):
    r = random.Random(prune_from)
    for _ in range(80):
        baskets = collections.Counter(tuple(sorted(r.sample(range(7), r.randint(1, 6)))) for _ in range(40))
        every = [set(b) for b, w in baskets.items() for _ in range(w)]
        assert dict(itemsets.mined(baskets, 4, prune_from)) == _closed(_supports(every, 4))


@pytest.mark.parametrize(("n", "least", "share"), [(0, 5, 20_000), (60, 5, 20_000), (150, 3, 20_000), (200, 1, 20)])
def test_itemsets_and_rules(spark, n, least, share):
    r = random.Random(n)
    baskets = [set(r.sample(range(9), r.randint(0, 6))) | ({100} if r.random() < 0.5 else set()) for _ in range(n)]
    if n == 150:
        baskets[0] = set(range(300))  # a basket of nearly all items
    rows = [(k, i) for k, b in enumerate(baskets) for i in b for _ in range(r.choice([1, 2]))] + [(None, 1), (3, None)]
    df = spark.createDataFrame(rows, "sale_id long, item_id long").select(F.lit(1).alias("basket"), F.lit(1).alias("support"), "*")
    got = itemsets.itemsets(df, least=least, share=share).collect()
    baskets = [b for b in baskets if b]
    held = _supports(baskets, max(least, -(-len(baskets) // share)))
    assert {tuple(sorted(x["items"])): x.support for x in got} == _closed(held)
    for x in got:
        z = tuple(sorted(x["items"]))
        want = [(c, held[tuple(i for i in z if i != c)], held[c,]) for c in z if len(z) > 1]
        assert [tuple(q) for q in x.rules or []] == [(c, a, s) for c, a, s in want if 100 * x.support >= 60 * a and x.support * len(baskets) > a * s]


def test_a_large_basket_is_sent_once_a_part(spark):
    rows = [(0, i) for i in range(3000)] + [(1 + i // 4, i % 3000) for i in range(24_000)]
    df = spark.createDataFrame(rows, "sale_id long, item_id long")
    got = itemsets.itemsets(df).collect()
    assert len(got) == 750 and all(x.support == 9 and len(x["items"]) == 4 and len(x.rules) == 4 for x in got)
