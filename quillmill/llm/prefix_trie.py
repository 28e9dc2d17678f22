"""The prefix trie of conversations, as the Cartesian tree of the longest common prefixes of sorted conversations.

Conversations are lists of 128-bit turn digests, sorted over the cluster into blocks. LCP[i] is the length of the prefix that
row i shares with the row before. The rows with one prefix of d turns are those between two values less than d, so every
value's nearest smaller values on both sides are the bounds of a node of the trie. In a block one pass with a stack finds
them; equal values are merged there. A value whose bound lies in another block is open: the least value of each block (one
row a block, in the driver) says which block holds its bound, and the records of that block, its values that are less than
all before or all after them, say where. Open values of one node in many blocks are then merged by its bounds.

A node of the Cartesian tree stands for a chain of trie nodes, from the depth after its parent's value to its own: they have
the same members. Rows longer than both values beside them end in a chain of their own. Per chain there are: the number of
rows, the least id and the number of leaves between its bounds, and the sum of characters that rows share with those before
them; what a node of depth d saves is that sum less (rows - 1) times the characters before depth d. Ids that end at a node
are neighbours in the order. Those of a node in one block are one text; those in several are pieces, put in order and hashed
piece by piece.

Memory: a task holds the digests of one conversation (20 bytes a turn) and a stack as deep as its values; a turn's text is
only hashed. SHA-256 has to read a node's ids in order, so one task streams them, in pieces of PIECE ids.

Defined results: turns are ordered by turn, nulls first; turns of equal number by their digest. Null roles and texts are
empty. Rows without conv_id are left out. Repeated rows are turns like others. An empty table has no nodes, not even a root.
Extra columns of any name are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, settle, table, tune

#: Conversations that share a base, and the remainder that says how many of its turns they take over.
BASE, HEADS = 100, 6
#: Ids of one node that are held at a time.
PIECE = 8192
#: A row's place is its block times this, and its number there.
SHIFT = 40
NO_ID = 1 << 62

CHAIN = "l bigint, v int, p int, n bigint, conv bigint, shared bigint, leaves bigint, kids bigint, before array<bigint>, ends string, n_ends bigint, lp bigint, ref_block int, ref_v int"
PIECES = "l bigint, ref_block int, v int, place bigint, ids string, n bigint"
FIRSTS = "array<struct<v:int,at:bigint,conv:bigint,shared:bigint,leaves:bigint,m:bigint>>"
EDGE = f"block int, n bigint, least int, conv bigint, shared bigint, leaves bigint, firsts {FIRSTS}, lasts {FIRSTS}, before_first array<bigint>, before_last array<bigint>"
GROUP = "block int, v int, m bigint, before array<bigint>, lt int, rt int, l bigint, lv int, l_conv bigint, l_shared bigint, l_leaves bigint, lp bigint, ref_block int, ref_v int, rv int, r_at bigint, r_conv bigint, r_shared bigint, r_leaves bigint"


def turn_lists(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (turn, digest of role and text, code points of text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    own = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), digest.alias("h"), F.length(text).alias("n")).alias("t")).filter("conv_id is not null")
    return own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """(conv_id, keys, sizes): the first turns of each conversation's base, then its own after as many."""
    base = F.col("conv_id") - F.col("conv_id") % BASE
    heads = lists.filter(F.col("conv_id") % BASE == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    none: Column = F.slice("turns", 1, 0)
    joined = lists.withColumn("base", base).join(heads, "base", "left").withColumn("taken", taken)
    joined = joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("taken")), F.slice("turns", F.col("taken") + 1, F.size("turns"))).alias("turns"))
    return joined.select("conv_id", F.transform("turns", lambda t: t["h"]).alias("keys"), F.transform("turns", lambda t: t["n"]).alias("sizes"))


def in_blocks(convs: DataFrame) -> DataFrame:
    """(block, at, conv_id, keys, sizes): all rows in order, each block between the last row of the block before (at -1) and
    the first of the next (at after all), whose conv_id is null."""
    n = parts(convs)
    rows = convs.repartitionByRange(n, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    rows = settle(rows.select(F.spark_partition_id().alias("block"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"), "conv_id", "keys", "sizes"))
    edges = settle(rows.groupBy("block").agg(F.min_by("keys", "at").alias("first"), F.max_by("keys", "at").alias("last")))
    order = sorted(r.block for r in edges.select("block").collect())  # one number a block
    beside = rows.sparkSession.createDataFrame([(b, order[k + 1] if k + 1 < len(order) else None, order[k - 1] if k else None) for k, b in enumerate(order)], "block int, next int, prev int")
    edges = edges.join(F.broadcast(beside), "block")
    no = [F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("array<int>").alias("sizes")]
    before = edges.filter("next is not null").select(F.col("next").alias("block"), F.lit(-1).cast("long").alias("at"), no[0], F.col("last").alias("keys"), no[1])
    after = edges.filter("prev is not null").select(F.col("prev").alias("block"), F.lit(1 << 34).cast("long").alias("at"), no[0], F.col("first").alias("keys"), no[1])
    return rows.unionByName(before).unionByName(after).repartitionById(max(order, default=0) + 1, "block").sortWithinPartitions("block", "at")


def common_prefix(a: list, b: list) -> int:
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


class _Value:
    """An LCP value on the stack: all its places since the last smaller one."""

    __slots__ = ("v", "open", "left", "left_shared", "left_leaves", "m", "head", "tail", "at", "shared", "leaves", "length", "conv", "ends", "flushed", "n_ends", "ends_at")

    def __init__(self, v: int, below: _Value | None, place: int):
        self.v, self.open, self.m, self.head, self.tail = v, below is None, 0, NO_ID, NO_ID
        self.ends, self.flushed, self.n_ends, self.ends_at = [], False, 0, place
        if below is not None:
            self.left, self.left_shared, self.left_leaves = below.at, below.shared, below.leaves


class Block:
    """One pass over a block's rows in order. chains, pieces: what is known of nodes already; edge(): what other blocks ask."""

    def __init__(self, block: int, above: list | None, piece: int = PIECE):
        self.block, self.above, self.piece = block, above, piece
        self.stack: list[_Value] = []
        self.chains: list[tuple] = []
        self.pieces: list[tuple] = []
        self.firsts: list[dict] = []
        self.n = self.shared = self.leaves = 0
        self.least, self.conv = 1 << 30, NO_ID
        self.row: tuple | None = None  # the row before: keys, A, conv_id
        self.before_first: list[int] = []

    def place(self, at: int) -> int:
        return self.block << SHIFT | at

    def _end(self, g: _Value, conv: int, place: int) -> None:
        if not g.ends:
            g.ends_at = place
        g.ends.append(conv)
        g.n_ends += 1
        if len(g.ends) >= self.piece:
            self._flush(g)

    def _flush(self, g: _Value) -> None:
        """What is held of the node's ids, as a piece; it names its node, or the open value."""
        if g.ends:
            self.pieces.append((None if g.open else self.place(g.left), self.block if g.open else None, g.v, g.ends_at, ",".join(map(str, g.ends)), len(g.ends)))
            g.ends, g.flushed = [], True

    def _chain(self, left: int, v: int, p: int, n: int, conv: int, shared: int, leaves: int, kids: int, before: list, ends: str | None, n_ends: int, parent: _Value | None, own_left: int) -> None:
        """parent: the value that holds the parent's bounds, or None if own_left is the parent's left bound."""
        lp, ref = None, None
        if p >= 0:
            lp = self.place(own_left) if parent is None else None if parent.open else self.place(parent.left)
            ref = self.block if lp is None else None
        self.chains.append((self.place(left), v, p, n, conv, shared, leaves, kids, before[p + 1 : v + 1], ends, n_ends, lp, ref, None if ref is None else p))

    def _finish_row(self, c: int) -> None:
        """The row before is followed by one that shares c turns: it may end in a chain of its own."""
        keys, before, conv = self.row
        top, size, at = self.stack[-1], len(keys), self.n - 1
        if c < size:
            self.leaves += 1
        if size > max(top.v, c):
            self._chain(at, size, max(top.v, c), 1, conv, 0, 1, 0, before, str(conv), 1, top if top.v >= c else None, at)

    def _pop(self, c: int) -> None:
        g = self.stack.pop()
        if g.open:  # its left bound is in another block; the next first value tells its right one
            self._flush(g)
            self.firsts[-1]["m"] = g.m
            return
        below = self.stack[-1]
        below.tail = min(below.tail, g.head, g.tail)
        ends = None
        if g.flushed:
            self._flush(g)
        else:
            ends = ",".join(map(str, g.ends))
        self._chain(g.left, g.v, max(below.v, c), self.n - g.left, below.tail, self.shared - g.left_shared, self.leaves - g.left_leaves, g.m + 1 - g.n_ends, self.row[1], ends, g.n_ends, below if below.v >= c else None, g.left)

    def add(self, keys: list, sizes: list, conv: int) -> None:
        c = common_prefix(self.row[0] if self.row else self.above, keys) if self.row or self.above is not None else -1
        if self.row:
            self._finish_row(c)
        at = self.n
        while self.stack and self.stack[-1].v > c:
            self._pop(c)
        whole = [0, *accumulate(sizes, initial=0)]  # by depth d, the characters before turn d; one more at the end
        if not self.stack or self.stack[-1].v < c:
            below = self.stack[-1] if self.stack else None
            g = _Value(c, below, self.place(at))
            if below is None:
                self.firsts.append({"v": c, "at": at, "conv": self.conv, "shared": self.shared, "leaves": self.leaves, "m": 0})
            elif below.length == c:
                self._end(g, below.conv, self.place(below.at))
            self.stack.append(g)
        g = self.stack[-1]
        self.shared += whole[c + 1] if c > 0 else 0
        g.head, g.tail = min(g.head, g.tail), conv
        g.m, g.at, g.shared, g.leaves, g.length, g.conv = g.m + 1, at, self.shared, self.leaves, len(keys), conv
        if len(keys) == c:
            self._end(g, conv, self.place(at))
        if not self.row:
            self.before_first = whole[: max(0, c) + 1]
        self.least, self.conv = min(self.least, c), min(self.conv, conv)
        self.row = (keys, whole, conv)
        self.n += 1

    def edge(self, below: list | None) -> dict:
        """below: the keys of the next block's first row."""
        c = common_prefix(self.row[0], below) if below is not None else -1
        top, size = self.stack[-1], len(self.row[0])
        self._finish_row(c)
        if top.v < size == c:  # the first of a run of equal rows that the next block goes on with
            self.pieces.append((self.place(self.n - 1), None, size, self.place(self.n - 1), str(self.row[2]), 1))
        lasts, conv = [], NO_ID
        for g in reversed(self.stack):
            self._flush(g)
            conv = min(conv, g.tail)
            lasts.append({"v": g.v, "at": g.at, "conv": conv, "shared": self.shared - g.shared, "leaves": self.leaves - g.leaves, "m": g.m})
            conv = min(conv, g.head)
        self.firsts[-1]["m"] = self.stack[0].m
        return {"block": self.block, "n": self.n, "least": self.least, "conv": self.conv, "shared": self.shared, "leaves": self.leaves, "firsts": self.firsts, "lasts": lasts[::-1], "before_first": self.before_first, "before_last": self.row[1][: max(0, top.v) + 1]}


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
_TYPES[FIRSTS] = pa.list_(pa.struct([(c, pa.int32() if c == "v" else pa.int64()) for c in ("v", "at", "conv", "shared", "leaves", "m")]))


def _arrow(columns: str) -> pa.StructType:
    """Columns "a int, b bigint" as an Arrow type."""
    return pa.struct([(name, _TYPES[kind]) for name, kind in (c.split(" ", 1) for c in columns.split(", "))])


def _spec(columns: str) -> str:
    """Columns "a int, b bigint" as the fields of a struct, "a:int,b:bigint"."""
    return ",".join(c.replace(" ", ":", 1) for c in columns.split(", "))


def scanned(blocks: DataFrame, piece: int = PIECE) -> DataFrame:
    """(chain, piece, edge), of which each row has one."""
    types = {"chain": _arrow(CHAIN), "piece": _arrow(PIECES), "edge": _arrow(EDGE)}

    def out(**rows: list) -> Iterator[pa.RecordBatch]:
        for kind, own in rows.items():
            if own:
                named = own if kind == "edge" else [dict(zip(types[kind].names, x, strict=True)) for x in own]
                yield pa.record_batch([pa.array(named, t) if k == kind else pa.nulls(len(own), t) for k, t in types.items()], names=list(types))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Block | None = None
        above = below = None
        for b in rows:
            for block, at, conv, keys, sizes in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if at < 0:
                    above = keys
                elif conv is None:
                    below = keys
                else:
                    if held is None or held.block != block:
                        if held is not None:
                            edge = held.edge(below)
                            yield from out(chain=held.chains, piece=held.pieces, edge=[edge])
                            below = None
                        held, above = Block(block, above, piece), None
                    held.add(keys, sizes, conv)
            if held is not None:
                yield from out(chain=held.chains, piece=held.pieces)
                held.chains, held.pieces = [], []
        if held is not None:
            edge = held.edge(below)
            yield from out(chain=held.chains, piece=held.pieces, edge=[edge])

    return blocks.mapInArrow(run, ", ".join(f"{k} struct<{x}>" for k, x in (("chain", _spec(CHAIN)), ("piece", _spec(PIECES)), ("edge", _spec(EDGE)))))


class Blocks:
    """One row a block: number of rows, least value and id, sums. Finds the block that holds a bound, and sums between blocks."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows)
        self.name = [r[0] for r in rows]
        self.index = {b: k for k, b in enumerate(self.name)}
        self.n, self.least, self.conv, self.shared, self.leaves = (np.array([r[k] for r in rows], np.int64) for k in range(1, 6))

    def before(self, block: int, v: int) -> int:
        return self.name[np.flatnonzero(self.least[: self.index[block]] < v)[-1]]

    def after(self, block: int, v: int) -> int | None:
        k = self.index[block] + 1
        found = np.flatnonzero(self.least[k:] < v)
        return self.name[k + int(found[0])] if len(found) else None

    def between(self, a: int, b: int | None) -> tuple[int, int, int, int]:
        """Rows, least id, shared and leaves of the blocks after a and before b."""
        x = slice(self.index[a] + 1, len(self.name) if b is None else self.index[b])
        return int(self.n[x].sum()), int(self.conv[x].min(initial=NO_ID)), int(self.shared[x].sum()), int(self.leaves[x].sum())


def open_values(edge: dict, blocks: Blocks) -> Iterator[dict]:
    """The values of a block that are open on either side, with the bounds that lie in the block."""
    b, firsts, lasts = edge["block"], edge["firsts"], edge["lasts"]
    last_first = len(firsts) - 1
    for k, x in enumerate([*firsts, *lasts[1:]]):
        own = {"block": b, "v": x["v"], "m": x["m"]}
        if x["v"] < 0:  # the start of the first block
            continue
        if k <= last_first:
            own |= {"lt": blocks.before(b, x["v"]), "before": edge["before_first"][: x["v"] + 1]}
        else:
            i = k - last_first
            own |= {"before": edge["before_last"][: x["v"] + 1]} | _left(lasts, i - 1, b)
        if k < last_first:
            own |= _right(firsts, k + 1)
        else:
            own["rt"] = blocks.after(b, x["v"])
        yield own


def _left(lasts: list, k: int, block: int) -> dict:
    """A left bound: the k-th last value of a block, and that value's own left bound."""
    x = lasts[k]
    own = {"l": block << SHIFT | x["at"], "lv": x["v"], "l_conv": x["conv"], "l_shared": x["shared"], "l_leaves": x["leaves"]}
    return own | ({"lp": block << SHIFT | lasts[k - 1]["at"]} if k else {"ref_block": block, "ref_v": x["v"]})


def _right(firsts: list, k: int) -> dict:
    x = firsts[k]
    return {"rv": x["v"], "r_at": x["at"], "r_conv": x["conv"], "r_shared": x["shared"], "r_leaves": x["leaves"]}


def bounded(g: dict, lasts: list | None, firsts: list | None, blocks: Blocks) -> dict:
    """An open value as a chain; lasts and firsts are the records of the blocks that hold its bounds."""
    if g["lt"] is not None:
        g |= {"ref_block": None, "ref_v": None, "lp": None} | _left(lasts, max(k for k, x in enumerate(lasts) if x["v"] < g["v"]), g["lt"])
    if g["rt"] is not None:
        g |= _right(firsts, min(k for k, x in enumerate(firsts) if x["v"] < g["v"]))
    elif g["rv"] is None:
        g |= {"rv": -1, "r_at": 0, "r_conv": NO_ID, "r_shared": 0, "r_leaves": 0}
    left = g["l"] >> SHIFT
    right = g["rt"] if g["rt"] is not None else None if g["lt"] is None or g["right_open"] else g["block"]
    n, conv, shared, leaves = blocks.between(left, right)
    n += int(blocks.n[blocks.index[left]]) - (g["l"] & ((1 << SHIFT) - 1)) + g["r_at"]
    p = max(g["lv"], g["rv"])
    by_right = g["rv"] > g["lv"]
    lp, ref_block, ref_v = (g["l"], None, None) if by_right else (g["lp"], g["ref_block"], g["ref_v"])
    if p < 0:
        lp = ref_block = ref_v = None
    return {
        "l": g["l"], "v": g["v"], "p": p, "n": n, "conv": min(conv, g["l_conv"], g["r_conv"]), "shared": shared + g["l_shared"] + g["r_shared"], "leaves": leaves + g["l_leaves"] + g["r_leaves"],
        "kids": g["m"] + 1, "before": g["before"][p + 1 : g["v"] + 1], "ends": None, "n_ends": 0, "lp": lp, "ref_block": ref_block, "ref_v": ref_v, "block": g["block"], "left_open": g["lt"] is not None,
    }


def open_chains(edges: DataFrame) -> DataFrame:
    """The chains of open values, one row a value and block; block and left_open tell the value."""
    blocks = Blocks([tuple(r) for r in edges.select("block", "n", "least", "conv", "shared", "leaves").collect()])  # one row a block
    group, chain = _arrow(f"{GROUP}, right_open boolean"), _arrow(f"{CHAIN}, block int, left_open boolean")
    rows_of = lambda rows, t: pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(t)))

    def opened(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for edge in b.to_pylist():
                yield rows_of([dict.fromkeys(group.names) | x | {"right_open": "rv" not in x} for x in open_values(edge, blocks)], group)

    def closed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            yield rows_of([bounded(x, x.pop("lasts"), x.pop("firsts"), blocks) for x in b.to_pylist()], chain)

    found = edges.mapInArrow(opened, f"{GROUP}, right_open boolean")
    found = found.join(edges.select(F.col("block").alias("lt"), "lasts"), "lt", "left").join(edges.select(F.col("block").alias("rt"), "firsts"), "rt", "left")
    return found.mapInArrow(closed, f"{CHAIN}, block int, left_open boolean")


def _found_left(rows: DataFrame, lefts: DataFrame, column: str, v: str) -> DataFrame:
    """rows whose column is known only as that of an open value get it."""
    known = rows.filter(F.col("ref_block").isNull())
    asked = rows.filter(F.col("ref_block").isNotNull()).join(lefts.select(F.col("block").alias("ref_block"), F.col("v").alias(v), F.col("l").alias("_l")), ["ref_block", v])
    return known.unionByName(asked.withColumn(column, F.col("_l")).drop("_l").select(*rows.columns))


def hashed_ends(pieces: DataFrame) -> DataFrame:
    """(l, v, sha, ends_here): the hash of each node's pieces, joined by commas in their order."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, n = None, None, 0
        done: list[tuple] = []
        for b in rows:
            for left, v, ids, k in zip(*(b.column(c).to_pylist() for c in ("l", "v", "ids", "n")), strict=True):
                if key != (left, v):
                    if key is not None:
                        done.append((*key, digest.hexdigest(), n))
                    key, digest, n = (left, v), hashlib.sha256(), 0
                digest.update((("," if n else "") + ids).encode())
                n += k
        if key is not None:
            done.append((*key, digest.hexdigest(), n))
        if done:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["l", "v", "sha", "ends_here"])

    return pieces.repartition(parts(pieces), "l", "v").sortWithinPartitions("l", "v", "place").select("l", "v", "ids", "n").mapInArrow(run, "l long, v int, sha string, ends_here long")


def trie(convs: DataFrame, piece: int = PIECE) -> DataFrame:
    """convs: (conv_id, keys, sizes). A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    tune(convs.sparkSession)
    found = settle(scanned(in_blocks(convs), piece))
    edges = settle(found.filter("edge is not null").select("edge.*"))
    opened = settle(open_chains(edges))
    lefts = opened.filter("left_open").select("block", "v", "l")
    columns = [c.split(" ", 1)[0] for c in CHAIN.split(", ")]
    # Values of one node in several blocks have its bounds alike, and each knows of its own places only.
    merged = opened.groupBy("l", "v").agg((F.sum(F.col("kids") - 1) + 1).alias("kids"), *(F.max(c).alias(c) for c in columns if c not in ("l", "v", "kids", "ref_block", "ref_v")), F.max(F.struct("ref_block", "ref_v")).alias("_ref"))
    merged = merged.withColumns({c: F.col("_ref")[c] for c in ("ref_block", "ref_v")}).select(*columns)
    chains = _found_left(found.filter("chain is not null").select("chain.*").unionByName(merged), lefts, "lp", "ref_v")
    ends = hashed_ends(_found_left(found.filter("piece is not null").select("piece.*"), lefts, "l", "v"))
    inline = chains.filter("ends is not null").withColumn("sha", F.sha2(F.col("ends").cast("binary"), 256))
    apart = chains.filter("ends is null").join(ends, ["l", "v"], "left")
    none = hashlib.sha256(b"").hexdigest()
    # Chains of one block have their ends taken off already.
    apart = apart.withColumn("sha", F.coalesce("sha", F.lit(none))).withColumn("kids", F.col("kids") - F.when(F.col("n_ends") == 0, F.coalesce("ends_here", F.lit(0).cast("long"))).otherwise(0))
    keep = ["l", "v", "p", "n", "conv", "shared", "leaves", "kids", "before", "lp", "sha"]
    whole = settle(inline.select(*keep).unionByName(apart.select(*keep)))
    parents = whole.select(F.col("l").alias("lp"), F.col("v").alias("p"), F.col("conv").alias("parent"))
    tops = whole.join(parents, ["lp", "p"], "left")
    nodes = tops.select("*", F.posexplode("before").alias("k", "chars"))
    bottom = F.col("p") + 1 + F.col("k") == F.col("v")
    return nodes.select(
        F.col("conv").alias("conv_id"), (F.col("p") + 1 + F.col("k")).cast("long").alias("depth"), F.when(F.col("k") == 0, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(bottom, F.col("kids")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("shared") - (F.col("n") - 1) * F.col("chars")).alias("saved_tokens"),
        F.when(bottom, F.col("sha")).otherwise(F.lit(none)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(turn_lists(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


#: The 16 values of the CRC-32 of four bits; SQL has no such function.
_CRC4 = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
ORACLE_OP12 = rf"""
WITH crc AS (SELECT {_CRC4} AS t),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: xor(xor(xor(a, b) >> 4, t[(xor(a, b) & 15) + 1]) >> 4, t[(xor(xor(a, b) >> 4, t[(xor(a, b) & 15) + 1]) & 15) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc),
made AS (
  SELECT i.conv_id, 0 AS part, t.k, role, text FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 100 AND t.k <= i.h
  UNION ALL
  SELECT i.conv_id, 1, t.k, role, text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.k > i.h),
lists AS (
  SELECT i.conv_id, list(md5(length(role) || ':' || role || text) ORDER BY part, k) FILTER (WHERE k IS NOT NULL) AS ts, list(length(text) ORDER BY part, k) FILTER (WHERE k IS NOT NULL) AS ns
  FROM ids i LEFT JOIN made USING (conv_id) GROUP BY i.conv_id),
members AS (
  SELECT conv_id, d, coalesce(array_to_string(ts[1:d], ''), '') AS key, coalesce(len(ts), 0) = d AS ends, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n
  FROM (SELECT *, unnest(generate_series(0, coalesce(len(ts), 0))) AS d FROM lists)),
nodes AS (
  SELECT key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY key, d),
kids AS (SELECT key[1:32 * (depth - 1)] AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
subtrees AS (
  SELECT key[1:32 * a] AS key, count(*) FILTER (WHERE leaf) AS n_leaves, sum((n_convs - 1) * n)::BIGINT AS saved_tokens
  FROM (SELECT o.*, k.key IS NULL AS leaf, unnest(generate_series(0, depth)) AS a FROM nodes o LEFT JOIN kids k USING (key)) GROUP BY 1)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, o.ends_sha256
FROM nodes o JOIN subtrees s USING (key) LEFT JOIN kids k USING (key) LEFT JOIN nodes p ON o.depth > 0 AND p.key = o.key[1:32 * (o.depth - 1)]
"""
