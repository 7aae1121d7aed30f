"""Prefix trie of conversations: adaptive radix trees over fixed-width turn ids.

A turn's id is the 16 bytes of a digest of its role and text, in big-endian order, so a conversation is a string of bytes
whose turns begin at multiples of 16. Equal conversations become one key. The keys are sorted over all partitions, and
each shard, a range of keys that fits a task, gets an adaptive radix tree: a node has room for 4, 16, 48 or 256 next
bytes and changes its layout as it fills, and bytes that do not branch are kept as one stretch. A byte depth that
is a multiple of 16 is a turn depth and gives a node of the trie; others give none.

A beginning that very many conversations share is cut by the range borders like anything else. Neighbouring shards then
have the nodes on the way to the border in common. Each shard is told how many turns its first key has in common with
the key before, and the last one with the key after, counts what it shares only once, and its sums of these few
nodes are added up afterwards.

Per conversation only ids and sizes are brought together, 20 bytes a turn, texts never; a conversation's ids are one
value of a row, which holds up to a hundred million turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featmill.llm.common import materialize

WIDTH = 16  # bytes of a turn id
# Turns of a family's first conversation that others can begin with, and conversations of a family.
HEADS, FAMILY = 8, 5
# Bytes of keys in a shard; conversation ids in one piece of text; rows given back at a time.
SHARD_BYTES, PIECE, ROWS = 8 << 20, 1 << 16, 8192


# --- layouts of a node: what comes next, by byte ---


class Sorted:
    """Next bytes in order beside their children."""

    __slots__ = ("bytes", "kids")
    room = 4

    def __init__(self) -> None:
        self.bytes, self.kids = bytearray(), []

    def get(self, byte: int):
        k = self.bytes.find(byte)
        return self.kids[k] if k >= 0 else None

    def put(self, byte: int, child) -> "Sorted | Indexed":
        """The layout that holds the child: this one, or a larger one when this one is full."""
        k = self.bytes.find(byte)
        if k >= 0:
            self.kids[k] = child
            return self
        if len(self.kids) == self.room:
            return self.grown().put(byte, child)
        k = sum(b < byte for b in self.bytes)
        self.bytes.insert(k, byte)
        self.kids.insert(k, child)
        return self

    def grown(self) -> "Sorted | Indexed":
        larger = Wide() if self.room == Sorted.room else Indexed()
        for byte, child in zip(self.bytes, self.kids):
            larger = larger.put(byte, child)
        return larger

    def children(self) -> list:
        return self.kids


class Wide(Sorted):
    __slots__ = ()
    room = 16


class Indexed:
    """A place for each of 256 bytes, which says where the child is."""

    __slots__ = ("place", "kids")
    room, none = 48, 255

    def __init__(self) -> None:
        self.place, self.kids = bytearray([self.none]) * 256, []

    def get(self, byte: int):
        k = self.place[byte]
        return self.kids[k] if k != self.none else None

    def put(self, byte: int, child) -> "Indexed | Direct":
        k = self.place[byte]
        if k != self.none:
            self.kids[k] = child
            return self
        if len(self.kids) == self.room:
            larger = Direct()
            for b in range(256):
                if self.place[b] != self.none:
                    larger.put(b, self.kids[self.place[b]])
            return larger.put(byte, child)
        self.place[byte] = len(self.kids)
        self.kids.append(child)
        return self

    def children(self) -> list:
        return [self.kids[k] for k in self.place if k != self.none]


class Direct:
    """A child for each of 256 bytes."""

    __slots__ = ("kids",)
    room = 256

    def __init__(self) -> None:
        self.kids = [None] * 256

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, child) -> "Direct":
        self.kids[byte] = child
        return self

    def children(self) -> list:
        return [c for c in self.kids if c is not None]


class Node:
    """The stretch ``start`` to ``end`` of the key in ``row``; ``value`` is the row whose key ends here."""

    __slots__ = ("start", "end", "row", "value", "next", "above", "n", "first", "leaves", "saved", "kids", "over", "left", "right")

    def __init__(self, start: int, end: int, row: int, value: int | None = None) -> None:
        self.start, self.end, self.row, self.value = start, end, row, value
        self.next: Sorted | Wide | Indexed | Direct = Sorted()
        self.above: Node | None = None
        self.n = self.leaves = self.saved = self.kids = 0
        self.first = self.over = None
        self.left = self.right = False


def shared_bytes(a: bytes, b: bytes) -> int:
    """Length of the longest common beginning."""
    most, k = min(len(a), len(b)), 0
    while k < most and a[k : k + WIDTH] == b[k : k + WIDTH]:
        k += WIDTH
    while k < most and a[k] == b[k]:
        k += 1
    return min(k, most)


class RadixTree:
    """An adaptive radix tree with path compression over byte strings, each given once."""

    def __init__(self) -> None:
        self.keys: list[bytes] = []
        # The root's stretch ends at depth 0, a turn depth like any other.
        self.root = Node(-WIDTH, 0, 0)

    def insert(self, key: bytes) -> None:
        row, node = len(self.keys), self.root
        self.keys.append(key)
        while len(key) > node.end:
            child = node.next.get(key[node.end])
            if child is None:
                node.next = node.next.put(key[node.end], Node(node.end, len(key), row, row))
                return
            old = self.keys[child.row]
            same = shared_bytes(old[child.start : child.end], key[child.start : child.end])
            if same < child.end - child.start:
                # The key leaves the stretch: cut it there.
                fork = Node(child.start, child.start + same, child.row)
                node.next = node.next.put(key[node.end], fork)
                child.start = fork.end
                fork.next = fork.next.put(old[fork.end], child)
                child = fork
            node = child
        node.value = row

    def path(self, key: bytes) -> Iterator[Node]:
        """The nodes on the way to a key that is in the tree."""
        node = self.root
        while node is not None:
            yield node
            node = node.next.get(key[node.end]) if len(key) > node.end else None

    def nodes(self) -> list[Node]:
        """All nodes, parents before children, in the order of their keys."""
        out, open_ = [], [self.root]
        while open_:
            node = open_.pop()
            out.append(node)
            below = node.next.children()
            for child in below:
                child.above = node
            open_.extend(reversed(below))
        return out


def turn_nodes(keys: list[bytes], rows: list[tuple], before: int, after: int) -> Iterator[tuple]:
    """The trie's nodes of one shard; ``rows`` holds ``(sizes, n, first, ends)`` of each key, keys in ascending order.

    ``before`` and ``after`` are the numbers of turns that the first key has in common with the key before the shard and
    the last one with the key after it, -1 where there is none. Gives ``(node, parent, turn, shared, parent_shared, conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends)``. Numbers of shared nodes are this shard's
    part of a sum; what the shards before have in common with this one is counted by the first of them.
    """
    tree = RadixTree()
    for key in keys:
        tree.insert(key)
    for node in tree.path(keys[0]):
        node.left = True
    for node in tree.path(keys[-1]):
        node.right = True
    order = tree.nodes()
    for node in reversed(order):
        if node.value is not None:
            _, n, first, _ = rows[node.value]
            node.n += n
            node.first = first if node.first is None else min(first, node.first)
        if node.above is not None:
            up = node.above
            up.n += node.n
            up.first = node.first if up.first is None else min(node.first, up.first)

    def seen(node: Node, at: int) -> bool:
        return node.left and at <= WIDTH * before

    def ongoing(node: Node, at: int) -> bool:
        return node.right and at <= WIDTH * after

    def name(node: Node, at: int) -> str:
        return hashlib.md5(tree.keys[node.row][:at]).hexdigest()

    # Of the last turn depth at or above each node's end: its smallest member, name, and whether it is shared.
    for node in order:
        at = node.end // WIDTH * WIDTH
        if at > node.start:
            node.over = (node.first, name(node, at), seen(node, at) or ongoing(node, at))
        else:
            node.over = node.above.over

    for node in reversed(order):
        above = node.above.over if node.above is not None else (None, None, False)
        at = node.end // WIDTH * WIDTH
        sizes = rows[node.row][0]
        while at > node.start:
            old, more = seen(node, at), ongoing(node, at)
            here = node.value if at == node.end else None
            if at == node.end and here is not None and not more and not node.next.children():
                node.leaves += 1
            if at:
                node.saved += (node.n - (not old)) * sizes[at // WIDTH - 1]
            up = at - WIDTH
            # The parent lies on this stretch, or it is the last turn depth above it.
            over = (node.first, name(node, up), seen(node, up) or ongoing(node, up)) if up > node.start else above
            yield (
                name(node, at), over[1], tree.keys[node.row][max(0, up) : at].hex() if at else None, old or more, over[2], node.first,
                at // WIDTH, None if over[2] else over[0], node.n, node.kids, node.leaves, node.saved,
                rows[here][3] if here is not None else None,
            )
            node.kids = int(not old)
            at = up
        if node.above is not None:
            node.above.leaves += node.leaves
            node.above.saved += node.saved
            node.above.kids += node.kids


NODES = (
    "node string, parent string, turn string, shared boolean, parent_shared boolean, conv_id bigint, depth bigint,"
    " parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string"
)
_NODES = pa.schema(
    [(c, pa.string()) for c in ("node", "parent", "turn")] + [(c, pa.bool_()) for c in ("shared", "parent_shared")]
    + [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends", pa.string())]
)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns ``part, key, sizes, n, first, ends, before, after``, by part and key."""

    def found() -> Iterator[tuple]:
        part, keys, rows, ends = None, [], [], (-1, -1)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for p, key, sizes, n, first, tail, before, after in zip(*columns, strict=True):
                if p != part:
                    if keys:
                        yield from turn_nodes(keys, rows, *ends)
                    part, keys, rows, ends = p, [], [], (before, after)
                keys.append(key)
                rows.append((sizes, n, first, tail))
        if keys:
            yield from turn_nodes(keys, rows, *ends)

    return _batches(found(), _NODES)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(part, before, after)`` from ``part``, its first and last key, and the keys beside it."""
    for batch in batches:
        part, low, high, last, next_ = (c.to_pylist() for c in batch.columns)

        def turns(a: bytes | None, b: bytes | None) -> int:
            return -1 if a is None or b is None else shared_bytes(a, b) // WIDTH

        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.int32()), pa.array(map(turns, last, low), pa.int32()), pa.array(map(turns, high, next_), pa.int32())
            ],
            names=["part", "before", "after"],
        )


def turn_ids(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, id, size)``: each turn's id in hexadecimal digits and its text's bytes; nulls count as empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), named.alias("id"),
        F.octet_length(text).alias("size"),
    )


def rebuild(conversations: DataFrame) -> DataFrame:
    """``(conv_id, key, sizes)``: every conversation with the first turns of its family's first one.

    Conversation c begins with the first h turns of conversation c - c % 5, h being crc32(c) % 9, and goes on with its own
    turns after the first h. Turns are ordered by ``turn``, null first; turns that tie follow by their id. Rows without a
    ``conv_id`` belong to no conversation. Columns other than ``conv_id, turn, role, text`` are not read.
    """
    rows = turn_ids(conversations).where(F.col("conv_id").isNotNull())
    # A family's conversations meet in one partition, and so do their heads.
    rows = rows.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).repartition("family")
    whole = rows.groupBy("family", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "size"))).alias("own"))
    head = F.when(F.col("conv_id") == F.col("family"), F.slice("own", 1, HEADS))
    whole = whole.withColumn("head", F.max(head).over(Window.partitionBy("family")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEADS + 1)).cast("int")
    none = F.array().cast("array<struct<turn:bigint,id:string,size:int>>")
    turns = F.concat(
        F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), F.slice("own", F.col("h") + 1, F.size("own"))
    )
    whole = whole.withColumn("h", h).select("conv_id", turns.alias("turns"))
    return whole.select("conv_id", F.unhex(F.array_join("turns.id", "")).alias("key"), F.col("turns.size").alias("sizes"))


def endings(built: DataFrame) -> DataFrame:
    """``(node, at, ids)``: the ids of the conversations that end at each node, ascending and comma-joined, in pieces.

    ``at`` is a piece's first id. A node's ids may lie in several partitions; a piece holds up to 65,536 of them.
    """
    rows = built.select(F.md5("key").alias("node"), "conv_id")
    rows = rows.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    schema = pa.schema([("node", pa.string()), ("at", pa.int64()), ("ids", pa.string())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined() -> Iterator[tuple]:
            node, ids = None, []
            for batch in batches:
                for own, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if own != node or len(ids) == PIECE:
                        if ids:
                            yield node, ids[0], ",".join(map(str, ids))
                        node, ids = own, []
                    ids.append(i)
            if ids:
                yield node, ids[0], ",".join(map(str, ids))

        return _batches(joined(), schema)

    return rows.mapInArrow(pieces, "node string, at bigint, ids string")


def ending_digests(pieces: DataFrame) -> DataFrame:
    """``(node, ends)``: SHA-256 of each node's comma-joined ids, from the pieces one after another."""
    rows = pieces.repartition("node").sortWithinPartitions("node", "at")
    schema = pa.schema([("node", pa.string()), ("ends", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed() -> Iterator[tuple]:
            node, sha = None, hashlib.sha256()
            for batch in batches:
                for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if own == node:
                        sha.update(b",")
                    else:
                        if node is not None:
                            yield node, sha.hexdigest()
                        node, sha = own, hashlib.sha256()
                    sha.update(ids.encode())
            if node is not None:
                yield node, sha.hexdigest()

        return _batches(hashed(), schema)

    return rows.mapInArrow(digest, "node string, ends string")


def prefix_trie(built: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The nodes of the trie of ``built(conv_id, key, sizes)``, whose ``conv_id`` are distinct and not null.

    Columns: ``node, parent`` (names of the node and its parent, MD5 of their keys), ``turn`` (id of the last turn, null at
    the root), ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends``, the SHA-256 of the ids of those that end here, null where none does. Without
    conversations there are no nodes.
    """
    spark = built.sparkSession
    built = materialize(built, "rebuilt")
    keys = built.groupBy("key").agg(
        F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("first")
    ).withColumn("node", F.md5("key"))
    ends = ending_digests(endings(built))
    keys = materialize(keys.join(ends, "node").select("key", "sizes", "n", "first", "ends"), "keys")
    size = keys.agg(F.sum(F.length("key") + WIDTH)).first()[0] or 0
    parts = max(1, -(-size // shard_bytes))
    ranged = keys.repartitionByRange(parts, "key").sortWithinPartitions("key")
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "sorted-keys")
    # One row for each shard from here on.
    edges = ranged.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    along = Window.orderBy("part")
    edges = edges.select("part", "low", "high", F.lag("high").over(along).alias("last"), F.lead("low").over(along).alias("next"))
    borders = F.broadcast(edges.mapInArrow(_borders, "part int, before int, after int"))
    rows = ranged.join(borders, "part").select("part", "key", "sizes", "n", "first", "ends", "before", "after")
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "key")
    nodes = materialize(rows.mapInArrow(_shards, NODES), "nodes")
    # Nodes on the way to a border: as many as borders and turns before them at most.
    met = nodes.where("shared").groupBy("node", "parent", "turn", "parent_shared", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("parent_conv_id").alias("parent_conv_id"), F.max("ends").alias("ends"),
    )
    met = materialize(met, "met")
    names = [c for c in nodes.columns if c not in ("shared", "parent_shared")]
    whole = nodes.where(~F.col("shared")).select("parent_shared", *names).unionByName(met.select("parent_shared", *names))
    up = met.select(F.col("node").alias("_up"), F.col("conv_id").alias("_up_conv"))
    # Only rows below a shared node look for it, by its name; met is small enough to be sent to all or is sorted.
    found = whole.join(up, F.col("parent_shared") & (F.col("parent") == F.col("_up")), "left")
    return found.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up_conv")).select(*names)
