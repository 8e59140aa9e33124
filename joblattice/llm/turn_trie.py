"""Prefix trie of conversations by adaptive radix trees.

A turn's id is a 16-byte digest of its role and text, so a conversation is a byte key of fixed-width
big-endian ids. Conversations of one key are counted together and their keys are sorted by range,
hence every node of the trie is a stretch of the sorted keys. A task inserts runs of at most
``CHUNK`` keys into an adaptive radix tree (nodes of 4, 16, 48 or 256 slots, common bytes kept as a
path) and walks it: byte depths that are whole turns are the nodes of the trie. All nodes of a run
are complete but for the prefixes of its first and last key; the parts of those are added up by a
join on the prefix, a few rows for each run. So no key, prefix or group of copies has to be in one
task, however common it is, and a tree never holds more than a run.

``rebuilt`` gives each conversation c the first h turns of conversation c - c % 100 (all if fewer,
none if absent) and its own turns after its first h, with h = crc32(decimal c) % 6.

Turns are ordered by number, null first, then by id. Null roles and texts are empty. Rows with a
null conv_id belong to no conversation and take no part. Repeated rows are turns of their own. A
conversation without turns ends at the root. An empty table has no nodes. Extra columns are ignored.
One task holds 16 bytes and a length for each turn of one conversation, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import Scratch

WIDTH = 16
CHUNK = 20_000
CHUNK_BYTES = 16 << 20
IDS_IN_BLOCK_BITS = 12
NOTHING = hashlib.sha256(b"").hexdigest()
SUMS = ("children", "leaves", "saved")


class Node:
    """A radix node: ``path`` are the bytes all keys below share, ``row`` the key that ends here.

    Up to 4 and 16 slots the edge bytes are a sorted list beside the children; up to 48 they are a
    table of 256 places that name a slot; beyond, the children themselves are a table of 256.
    """

    __slots__ = ("path", "row", "slots", "bytes", "children")

    def __init__(self, path: bytes, row: int = -1):
        self.path, self.row, self.slots, self.bytes, self.children = path, row, 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.slots <= 16:
            at = self.bytes.find(byte)
            return self.children[at] if at >= 0 else None
        if self.slots == 48:
            at = self.bytes[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def add(self, byte: int, node: Node) -> None:
        if self.slots < 256 and len(self.children) == self.slots:
            self.grow()
        if self.slots <= 16:
            at = sum(b < byte for b in self.bytes)
            self.bytes.insert(at, byte)
            self.children.insert(at, node)
        elif self.slots == 48:
            self.children.append(node)
            self.bytes[byte] = len(self.children)
        else:
            self.children[byte] = node

    def grow(self) -> None:
        below = list(self.below())
        self.slots = {4: 16, 16: 48, 48: 256}[self.slots]
        if self.slots == 48:
            self.bytes, self.children = bytearray(256), []
        elif self.slots == 256:
            self.bytes, self.children = bytearray(), [None] * 256
        else:
            return
        for byte, node in below:
            self.add(byte, node)

    def below(self) -> Iterator[tuple[int, Node]]:
        """(edge byte, child) in the order of the bytes."""
        if self.slots <= 16:
            yield from zip(self.bytes, self.children)
        elif self.slots == 48:
            yield from ((b, self.children[at - 1]) for b, at in enumerate(self.bytes) if at)
        else:
            yield from ((b, node) for b, node in enumerate(self.children) if node is not None)

    def split(self, at: int) -> None:
        """Move what is behind the first ``at`` bytes of the path to a child."""
        lower = Node(self.path[at + 1 :], self.row)
        lower.slots, lower.bytes, lower.children = self.slots, self.bytes, self.children
        edge = self.path[at]
        self.path, self.row, self.slots, self.bytes, self.children = self.path[:at], -1, 4, bytearray(), []
        self.add(edge, lower)


def insert(root: Node, key: bytes, row: int) -> None:
    node, at = root, 0
    while True:
        path = node.path
        if not key.startswith(path, at):
            same = next((i for i, (a, b) in enumerate(zip(path, key[at : at + len(path)])) if a != b), len(key) - at)
            node.split(same)
            path = node.path
        at += len(path)
        if at == len(key):
            node.row = row
            return
        following = node.child(key[at])
        if following is None:
            node.add(key[at], Node(key[at + 1 :], row))
            return
        node, at = following, at + 1


def radix_tree(keys: list[bytes]) -> Node:
    root = Node(keys[0])
    root.row = 0
    for row, key in enumerate(keys[1:], 1):
        insert(root, key, row)
    return root


class Region:
    """The nodes of the trie along the path of one radix node, which all have the same members."""

    __slots__ = ("node", "above", "first", "last", "n", "least", "lo", "hi", "tops", "leaves", "saved",
                 "open_tops", "open_leaves", "open_saved")

    def __init__(self, node: Node, above: int, before: int, end: int):
        # byte depths behind ``before`` up to ``end``; whole turns of them are nodes
        self.node, self.above = node, above
        self.first, self.last = before // WIDTH + 1, end // WIDTH
        self.n = self.tops = self.leaves = self.saved = self.open_tops = self.open_leaves = self.open_saved = 0
        self.least, self.lo, self.hi = None, None, -1


def trie_rows(keys: list[bytes], chars: list[list[int]], counts: list[int], leasts: list[int], ends: list[str]) -> Iterator[tuple]:
    """The nodes of the trie over sorted distinct keys, as rows of ``PARTS`` without the run's number."""
    regions: list[Region] = []
    stack = [(radix_tree(keys), -1, -1)]
    while stack:
        node, above, before = stack.pop()
        # the edge byte comes before the path, but for the root
        end = len(node.path) if above < 0 else before + 1 + len(node.path)
        regions.append(Region(node, above, before, end))
        own = len(regions) - 1
        stack.extend((child, own, end) for _, child in node.below())
    final = len(keys) - 1
    kept: list[list[tuple]] = [[]] * len(regions)
    for i in range(len(regions) - 1, -1, -1):
        r = regions[i]
        row = r.node.row
        if row >= 0:
            r.n += counts[row]
            r.least = leasts[row] if r.least is None else min(r.least, leasts[row])
            r.lo, r.hi = row if r.lo is None else min(r.lo, row), max(r.hi, row)
        border = r.lo == 0 or r.hi == final
        if r.first <= r.last:
            leaves, saved = r.leaves if r.tops else 1, r.saved
            below, open_below = (r.tops, r.leaves, r.saved), (r.open_tops, r.open_leaves, r.open_saved)
            rows = []
            for depth in range(r.last, r.first - 1, -1):
                length = chars[r.lo][depth - 1] if depth else 0
                saved = saved + (r.n - 1) * length
                ending = ends[row] if depth == r.last and row >= 0 else None
                rows.append((depth, length, below[0], leaves, saved, *open_below, ending))
                below, open_below = (1, leaves, saved), (0, 0, 0) if border else (1, leaves, saved)
            kept[i] = rows[::-1]
            r.tops, r.leaves, r.saved = 1, leaves, saved
            r.open_tops, r.open_leaves, r.open_saved = (0, 0, 0) if border else (1, leaves, saved)
        if r.above >= 0:
            up = regions[r.above]
            up.n += r.n
            up.least = r.least if up.least is None else min(up.least, r.least)
            up.lo, up.hi = r.lo if up.lo is None else min(up.lo, r.lo), max(up.hi, r.hi)
            for name in ("tops", "leaves", "saved", "open_tops", "open_leaves", "open_saved"):
                setattr(up, name, getattr(up, name) + getattr(r, name))
    for i, r in enumerate(regions):
        border = r.lo == 0 or r.hi == final
        top = r.above
        while top >= 0 and not kept[top]:
            top = regions[top].above
        for depth, length, children, leaves, saved, *opened, ending in kept[i]:
            parent = r if depth > r.first else regions[top] if top >= 0 else None
            outer = parent is not None and (parent.lo == 0 or parent.hi == final)
            yield (
                keys[r.lo][: depth * WIDTH] if border else None,
                keys[r.lo][: (depth - 1) * WIDTH] if outer else None,
                r.least, depth, None if parent is None else parent.least, r.n, length, children, leaves, saved, *opened, ending)


PARTS = pa.schema([
    ("run", pa.int64()), ("edge", pa.binary()), ("parent_edge", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("chars", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()),
    ("saved", pa.int64()), ("open_children", pa.int64()), ("open_leaves", pa.int64()), ("open_saved", pa.int64()), ("ends", pa.string()),
])
PARTS_DDL = (
    "run long, edge binary, parent_edge binary, conv_id long, depth long, parent_conv_id long, n_convs long, chars long, "
    "children long, leaves long, saved long, open_children long, open_leaves long, open_saved long, ends string")


def _tries(batches):
    """Runs of sorted keys to nodes; a run's number is its task's and its place there."""
    task, number = TaskContext.get().partitionId() << 32, 0
    held, size = [[], [], [], [], []], 0

    def emitted():
        rows = [(task + number, *r) for r in trie_rows(*held)]
        for start in range(0, len(rows), 8192):
            columns = zip(*rows[start : start + 8192])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PARTS)], schema=PARTS)

    for batch in batches:
        for record in zip(*(batch.column(c).to_pylist() for c in ("key", "chars", "n", "least", "ends"))):
            for values, value in zip(held, record):
                values.append(value)
            size += len(record[0])
            if len(held[0]) == CHUNK or size >= CHUNK_BYTES:
                yield from emitted()
                held, size, number = [[], [], [], [], []], 0, number + 1
    if held[0]:
        yield from emitted()


ENDS = pa.schema([("key", pa.binary()), ("chars", pa.list_(pa.int32())), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])


def _digests(batches):
    """Sorted blocks of ids to one row for each key; the list of ids passes by and is never held."""
    path, record, digest = None, None, None
    for batch in batches:
        done = []
        for now, ids, n, least, key, chars in zip(*(batch.column(c).to_pylist() for c in ("path", "ids", "n", "least", "key", "chars"))):
            if now != path:
                if record:
                    done.append((*record, digest.hexdigest()))
                path, record, digest = now, [key, chars, 0, least], hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
            record[2] += n
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), ENDS)], schema=ENDS)
    if record:
        last = [(*record, digest.hexdigest())]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last), ENDS)], schema=ENDS)


def rebuilt(conversations: DataFrame, shared_turns: int = 5, group: int = 100) -> DataFrame:
    """(conv_id, turns) with the turns (id, chars) of each rebuilt conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        F.col("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"), F.length(text).alias("chars"))
    own = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    own = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["chars"].alias("chars"))).alias("turns"))
    heads = own.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, shared_turns).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (shared_turns + 1)).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base", "left").withColumn("h", h)
    nothing = F.slice("turns", 1, 0)
    return joined.select("conv_id", F.concat(
        F.coalesce(F.slice("head", F.lit(1), F.col("h")), nothing),
        F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


def _above(edge: str, turns: Column) -> Column:
    return F.substring(edge, F.lit(1), (turns * WIDTH).cast("int"))


def nodes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each
    node of the trie over ``conversations(conv_id, turns)``, as ``rebuilt`` gives them."""
    scratch = Scratch(conversations.sparkSession)
    keyed = conversations.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"))
    keyed = keyed.withColumn("path", F.md5("key")).withColumn("block", F.shiftright("conv_id", IDS_IN_BLOCK_BITS))
    # ids of a block are a bounded range, so its list is bounded whatever the number of copies
    blocks = keyed.groupBy("path", "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"),
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.first("key").alias("key"), F.first("chars").alias("chars"))
    paths = scratch.table("paths", blocks.repartition("path").sortWithinPartitions("path", "block").mapInArrow(
        _digests, "key binary, chars array<int>, n long, least long, ends string"))
    parts = scratch.table("parts", paths.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_tries, PARTS_DDL))

    edges = parts.filter("edge is not null")
    merged = scratch.table("merged", edges.groupBy("edge").agg(
        F.count(F.lit(1)).alias("runs"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"), F.max("chars").alias("chars"), F.max("ends").alias("ends"),
        *(F.max(c).alias(c) for c in SUMS), *(F.sum(f"open_{c}").alias(f"open_{c}") for c in SUMS),
    ).withColumn("parent_edge", F.when(F.col("depth") > 0, _above("edge", F.col("depth") - 1))))
    cut = merged.filter("runs > 1")
    within = merged.filter("depth > 0").groupBy(F.col("parent_edge").alias("edge")).agg(F.count(F.lit(1)).alias("edges"))
    # what each cut node, and each whole node right below one, adds to the nodes above it
    own = cut.select("edge", F.col("depth").alias("top"), F.col("open_leaves").alias("leaves"),
                     (F.col("open_saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    whole = merged.filter("runs = 1").join(cut.select(F.col("edge").alias("parent_edge")), "parent_edge", "left_semi").select(
        "edge", (F.col("depth") - 1).alias("top"), "leaves", "saved")
    added = own.union(whole).select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("turns"), "edge", "leaves", "saved")
    added = added.groupBy(_above("edge", F.col("turns")).alias("edge")).agg(F.sum("leaves").alias("all_leaves"), F.sum("saved").alias("all_saved"))
    heads = merged.select(F.col("edge").alias("parent_edge"), F.col("conv_id").alias("parent_conv_id"))
    split = F.col("runs") > 1
    summed = merged.join(within, "edge", "left").join(added, "edge", "left").join(heads, "parent_edge", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.when(split, F.col("open_children") + F.coalesce("edges", F.lit(0))).otherwise(F.col("children")).alias("n_children"),
        F.when(split, F.col("all_leaves")).otherwise(F.col("leaves")).alias("n_leaves"),
        F.when(split, F.col("all_saved")).otherwise(F.col("saved")).alias("saved_tokens"), "ends")

    inner = parts.filter("edge is null").select(
        "run", "parent_edge", "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends")
    # a parent that is cut has its least id from all runs; the run is part of the key, so no parent is a hot one
    known = edges.select("run", F.col("edge").alias("parent_edge")).join(heads.withColumnRenamed("parent_conv_id", "least"), "parent_edge")
    hung = inner.filter("parent_edge is not null").join(known, ["run", "parent_edge"]).withColumn("parent_conv_id", F.col("least"))
    columns = summed.columns
    every = summed.unionByName(inner.filter("parent_edge is null").select(columns)).unionByName(hung.select(columns))
    return every.withColumn("ends_sha256", F.coalesce("ends", F.lit(NOTHING))).drop("ends")
