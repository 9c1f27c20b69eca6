"""Operator 11: prefix trie of conversations, as adaptive radix trees over fixed-width turn ids.

A turn's id is 16 bytes of the SHA-256 of its role and text; a conversation's key is
the big-endian ids of its turns one after the other, so keys of one prefix are neighbours
in byte order. Steps:

1. Conversations are rebuilt from ids only; texts are hashed where they are read and never shuffled.
2. Equal keys become one: number, smallest conversation, and the digest of the members that end
   there. Members are dealt by range of (key digest, conversation), so a sequence that a third of
   all conversations repeat is spread over tasks, and only joined pieces of ids are brought together.
3. Distinct keys are range-partitioned. Each task builds an adaptive radix tree of its keys:
   nodes of 4, 16, 48 and 256 children that grow when they are full, and compressed paths.
   Only byte depths that are a multiple of the id's width are nodes of the trie.
4. A task knows how many turns its first key shares with the last key of the range before, and its last key with
   the next range's first. With these two numbers all its figures add up: shared nodes are counted
   by the first range that has them. Only nodes on the path of a range's first or last key are merged.

A conversation is one row of ids (16 bytes a turn). One number for each range reaches the driver.

Edge cases: rows without conv_id belong to no conversation; a null turn comes first; turns of one
conversation with equal numbers are ordered by their ids; null role and text are empty; conversations without
a turn after rebuilding are members of the root; an empty table gives no rows; further columns are ignored.
The base of a conversation is the next lower multiple of 5, also for negative numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm.registry import table
from docsieve.session import cut

WIDTH = 16
#: Turns of distinct keys in a range, about: a task holds the tree of one range.
RANGE_TURNS = 200_000
#: Length of a piece of joined conversation numbers.
PIECE = 1 << 16
#: Parts into which the children of a shared node are dealt when they look it up.
SALTS = 16
FAMILY, HEADS = 5, 9


def turn_id(role: str, text: str) -> Column:
    """The id of a turn: SHA-256 of the role's length, the role and the text, cut to the width."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (id, bytes): the first turns of the family's first conversation, then the own turns behind as many."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), turn_id("role", "text").alias("id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes")).alias("turn"),
    )
    own = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes"))).alias("turns"))
    heads = own.where(F.pmod("conv_id", F.lit(FAMILY)) == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    taken = F.crc32(F.col("conv_id").cast("string")) % HEADS
    both = own.withColumns({"base": F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY)), "h": taken.cast("int")}).join(heads, "base", "left")
    first = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's key, its turns' bytes and the digest of the key."""
    for batch in batches:
        lists = batch.column("turns")
        offsets = lists.offsets.to_numpy().tolist()
        ids = lists.values.field("id").to_pylist()
        sizes = lists.values.field("bytes").to_pylist()
        keys = [b"".join(ids[s:e]) for s, e in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array([digest(k) for k in keys], pa.binary()), pa.array(keys, pa.binary()), pa.array([sizes[s:e] for s, e in zip(offsets, offsets[1:])], pa.list_(pa.int64()))],
            ["conv_id", "node", "key", "sizes"],
        )


def digest(key: bytes) -> bytes:
    """Names a node by all turns that lead to it."""
    return hashlib.sha256(key).digest()[:WIDTH]


ENDS = "node binary, lowest long, n long, piece string, key binary, sizes array<long>"


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and conversation -> per node pieces of joined conversation numbers; a node's first piece in a task has its key."""
    node, lowest, texts, size, known = None, None, [], 0, (None, None)

    def row() -> tuple[Any, ...]:
        return node, lowest, len(texts), ",".join(texts), *known

    def batch_of(rows: list[tuple[Any, ...]]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["node", "lowest", "n", "piece", "key", "sizes"])

    for batch in batches:
        rows = []
        for conv, name, key, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "node", "key", "sizes"))):
            if name != node or size > PIECE:
                if texts:
                    rows.append(row())
                known = (key, sizes) if name != node else (None, None)
                node, lowest, texts, size = name, conv, [], 0
            texts.append(str(conv))
            size += len(texts[-1]) + 1
        if rows:
            yield batch_of(rows)
    if texts:
        yield batch_of([row()])


DISTINCT = "node binary, lowest long, n long, ends string, key binary, sizes array<long>"


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and lowest conversation -> one row for each node with the digest of all its pieces."""
    held: list[Any] | None = None

    def batch_of(rows: list[list[Any]]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())]
        done = [[r[0], r[1], r[2], r[3].hexdigest(), r[4], r[5]] for r in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], ["node", "lowest", "n", "ends", "key", "sizes"])

    for batch in batches:
        rows = []
        for name, lowest, n, piece, key, sizes in zip(*(batch.column(c).to_pylist() for c in ("node", "lowest", "n", "piece", "key", "sizes"))):
            if held is not None and held[0] == name:
                held[2] += n
                held[3].update(b"," + piece.encode())
            else:
                if held is not None:
                    rows.append(held)
                held = [name, lowest, n, hashlib.sha256(piece.encode()), key, sizes]
        if rows:
            yield batch_of(rows)
    if held is not None:
        yield batch_of([held])


def shared(a: bytes, b: bytes) -> int:
    """Length of the common start."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Inner:
    """A tree node: compressed path, value of the key that ends here, and children by their next byte.

    Up to 16 children lie in two parallel sorted rows (of 4, then of 16 places); up to 48 behind a table of 256
    one-byte places; more in a table of 256 children.
    """

    __slots__ = ("path", "value", "room", "places", "children")

    def __init__(self, path: bytes, value: Any = None):
        self.path, self.value = path, value
        self.room, self.places, self.children = 4, bytearray(), []

    def child(self, byte: int) -> Inner | None:
        if self.room <= 16:
            at = self.places.find(byte)
            return self.children[at] if at >= 0 else None
        if self.room == 48:
            at = self.places[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, byte: int, child: Inner) -> None:
        """Set the child of a byte, new or not."""
        if self.room <= 16:
            at = self.places.find(byte)
            if at >= 0:
                self.children[at] = child
                return
            if len(self.places) < self.room:
                at = sum(1 for b in self.places if b < byte)
                self.places.insert(at, byte)
                self.children.insert(at, child)
                return
            self.grow()
            self.put(byte, child)
        elif self.room == 48:
            at = self.places[byte]
            if at:
                self.children[at - 1] = child
            elif len(self.children) < 48:
                self.children.append(child)
                self.places[byte] = len(self.children)
            else:
                self.grow()
                self.children[byte] = child
        else:
            self.children[byte] = child

    def grow(self) -> None:
        if self.room == 4:
            self.room = 16
        elif self.room == 16:
            index = bytearray(256)
            for at, byte in enumerate(self.places):
                index[byte] = at + 1
            self.room, self.places = 48, index
        else:
            every: list[Inner | None] = [None] * 256
            for byte, at in enumerate(self.places):
                if at:
                    every[byte] = self.children[at - 1]
            self.room, self.places, self.children = 256, bytearray(), every

    def items(self) -> Iterator[tuple[int, Inner]]:
        """Children in byte order."""
        if self.room <= 16:
            yield from zip(self.places, self.children)
        elif self.room == 48:
            yield from ((byte, self.children[at - 1]) for byte, at in enumerate(self.places) if at)
        else:
            yield from ((byte, child) for byte, child in enumerate(self.children) if child is not None)


class RadixTree:
    def __init__(self) -> None:
        self.root = Inner(b"")

    def insert(self, key: bytes, value: Any) -> None:
        above, byte, node, at = None, 0, self.root, 0
        while True:
            same = shared(node.path, key[at : at + len(node.path)])
            if same < len(node.path):  # the key leaves the compressed path: split it
                upper = Inner(node.path[:same])
                upper.put(node.path[same], node)
                node.path = node.path[same + 1 :]
                if above is None:
                    self.root = upper
                else:
                    above.put(byte, upper)
                node = upper
            at += same
            if at == len(key):
                node.value = value
                return
            child = node.child(key[at])
            if child is None:
                node.put(key[at], Inner(key[at + 1 :], value))
                return
            above, byte, node, at = node, key[at], child, at + 1


class Frame:
    """A tree node on the way of a walk, with what its finished children add up to."""

    def __init__(self, node: Inner, label: bytes, at: int, state: Any, name: bytes, rest: bytes):
        self.node, self.children, self.end = node, node.items(), at + len(label)
        self.names, self.above = [], []
        ahead = rest + label
        while len(ahead) >= WIDTH:  # turn-aligned depths on this edge
            state = state.copy()
            state.update(ahead[:WIDTH])
            ahead = ahead[WIDTH:]
            self.above.append(name)
            name = state.digest()[:WIDTH]
            self.names.append(name)
        self.state, self.name, self.rest = state, name, ahead
        self.n = self.new = self.leaves = self.saved = 0
        self.lowest, self.sizes, self.below = None, None, False
        self.waiting: list[int] = []

    def add(self, n: int, lowest: int, sizes: list[int]) -> None:
        self.n += n
        self.lowest = lowest if self.lowest is None else min(self.lowest, lowest)
        self.sizes = self.sizes or sizes

    def take(self, child: Frame) -> None:
        self.add(child.n, child.lowest, child.sizes)
        self.new, self.leaves, self.saved = self.new + child.new, self.leaves + child.leaves, self.saved + child.saved
        self.below |= child.below
        self.waiting += child.waiting


NODES = "node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, edge boolean, parent_conv_id long, parent_edge boolean"
NONE = hashlib.sha256(b"").hexdigest()


def names_of(key: bytes) -> list[bytes]:
    """The names of the nodes on a key's path, the root first."""
    state = hashlib.sha256(b"")
    out = [state.digest()[:WIDTH]]
    for at in range(0, len(key), WIDTH):
        state.update(key[at : at + WIDTH])
        out.append(state.digest()[:WIDTH])
    return out


def walked(tree: RadixTree, first: list[bytes], last: list[bytes], before: int, after: int) -> list[list[Any]]:
    """The trie's nodes of a range, columns as in NODES; `first` and `last` are the paths of its first and last key.

    `before` is the number of turns that the first key shares with the range before, `after` that of the last key and
    the range behind; -1 if there is none.
    """
    out: list[list[Any]] = []

    def emit(frame: Frame, depth: int, name: bytes, above: bytes | None, ends: str | None) -> None:
        on_first = depth < len(first) and first[depth] == name
        on_last = depth < len(last) and last[depth] == name
        introduced = not (on_first and depth <= before)
        # the range behind starts with a longer key, so a node where the two part has a child there
        if not frame.below and not (on_last and depth == after):
            frame.leaves += 1
        frame.saved += (frame.n - introduced) * (frame.sizes[depth - 1] if depth else 0)
        for i in frame.waiting:
            out[i][10], out[i][11] = frame.lowest, on_first or on_last
        out.append([name, above, depth, frame.lowest, frame.n, frame.new, frame.leaves, frame.saved, ends or "", on_first or on_last, None, False])
        frame.waiting, frame.new, frame.below = [len(out) - 1], int(introduced), True

    state = hashlib.sha256(b"")
    stack = [Frame(tree.root, b"", 0, state, state.digest()[:WIDTH], b"")]
    while stack:
        frame = stack[-1]
        step = next(frame.children, None)
        if step is not None:
            byte, child = step
            stack.append(Frame(child, bytes([byte]) + child.path, frame.end, frame.state, frame.name, frame.rest))
            continue
        stack.pop()
        value = frame.node.value
        ends = None
        if value is not None:
            n, lowest, ends, sizes = value
            frame.add(n, lowest, sizes)
        for i in reversed(range(len(frame.names))):
            depth = frame.end // WIDTH - (len(frame.names) - 1 - i)
            emit(frame, depth, frame.names[i], frame.above[i], ends if depth * WIDTH == frame.end else None)
        if stack:
            stack[-1].take(frame)
        elif frame.n:
            emit(frame, 0, frame.name, None, ends)
    return out


def edge_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths of a range's first and last key: range, which of the two, depth, node."""
    ends: dict[int, list[bytes]] = {}
    for batch in batches:
        for part, key in zip(batch.column("_range").to_pylist(), batch.column("key").to_pylist()):
            low, high = ends.setdefault(part, [key, key])
            ends[part] = [min(low, key), max(high, key)]
    for part, pair in ends.items():
        for which, key in enumerate(pair):
            names = names_of(key)
            for at in range(0, len(names), PIECE):
                some = names[at : at + PIECE]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(some), pa.int32()), pa.array([which] * len(some), pa.int32()), pa.array(range(at, at + len(some)), pa.int64()), pa.array(some, pa.binary())],
                    ["_range", "which", "depth", "node"],
                )


def grower(common: dict[int, tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The trie's nodes of each range, from a radix tree of its keys; `common` has the turns shared with the ranges around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, low, high, part = RadixTree(), None, None, None
        for batch in batches:
            for part, key, n, lowest, ends, sizes in zip(*(batch.column(c).to_pylist() for c in ("_range", "key", "n", "lowest", "ends", "sizes"))):
                tree.insert(key, (n, lowest, ends, sizes))
                low = key if low is None else min(low, key)
                high = key if high is None else max(high, key)
        if low is None:
            return
        rows = walked(tree, names_of(low), names_of(high), *common.get(part, (-1, -1)))
        kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.string(), pa.bool_(), pa.int64(), pa.bool_()]
        names = [c.split()[0] for c in NODES.split(", ")]
        for at in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 20_000]), kinds)], names)

    return run


def distinct_keys(conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence of turns: key, sizes, members that end there (number, smallest, digest)."""
    kind = "conv_id long, node binary, key binary, sizes array<long>"
    paths = cut(rebuilt(conversations).mapInArrow(keyed, kind))
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = paths.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pieces, ENDS)
    return cut(dealt.repartition(parts, "node").sortWithinPartitions("node", "lowest").mapInArrow(joined, DISTINCT))


def shared_turns(ranged: DataFrame) -> dict[int, tuple[int, int]]:
    """For each range: turns that its first key shares with the range before and its last key with the next one."""
    paths = cut(ranged.select("_range", "key").mapInArrow(edge_paths, "_range int, which int, depth long, node binary"))
    ranges = sorted(r[0] for r in paths.where("depth = 0 AND which = 0").select("_range").collect())
    if len(ranges) < 2:
        return {}
    follows = ranged.sparkSession.createDataFrame(list(zip(ranges, ranges[1:])), "_range int, next int")
    lasts = paths.where("which = 1").join(follows, "_range").select(F.col("next").alias("_range"), "depth", "node")
    same = paths.where("which = 0").join(lasts, ["_range", "depth", "node"]).groupBy("_range").agg(F.max("depth").alias("turns"))
    before = {r[0]: r[1] for r in same.collect()}
    return {r: (before.get(r, -1), before.get(follower, -1)) for r, follower in zip(ranges, [*ranges[1:], None])}


def trie(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations; see the module."""
    keys = distinct_keys(conversations)
    turns = keys.agg(F.sum(F.size("sizes"))).first()[0] or 0
    ranged = cut(keys.repartitionByRange(max(1, -(-turns // RANGE_TURNS)), "key").withColumn("_range", F.spark_partition_id()))
    nodes = cut(ranged.mapInArrow(grower(shared_turns(ranged)), NODES))
    merged = cut(nodes.where("edge").groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends").alias("ends"),
    ))
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    inner = nodes.where("NOT edge AND NOT parent_edge").select(*shown)
    # many nodes may hang below one shared node: deal them out, with the shared node in each part
    held = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    below = nodes.where("NOT edge AND parent_edge").drop("parent_conv_id").select("parent", *[c for c in shown if c != "parent_conv_id"], F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    along = merged.withColumn("salt", F.lit(0)).select("parent", *[c for c in shown if c != "parent_conv_id"], "salt")
    looked_up = below.unionByName(along).join(held, ["parent", "salt"], "left").select(*shown)
    return inner.unionByName(looked_up).select(
        *shown[:-1], F.when(F.col("ends") == "", F.lit(NONE)).otherwise(F.col("ends")).alias("ends_sha256"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op11_conversation_trie": op11_conversation_trie}

#: Prefixes are named by a hash of all their turns; a node's subtree is found through the smallest member of each node below.
ORACLES = {"op11_conversation_trie": """
WITH RECURSIVE step AS (
  SELECT i, 0 AS k, i::UBIGINT AS r FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::UBIGINT) ELSE r // 2 END FROM step WHERE k < 8
), remainders AS (SELECT list(r ORDER BY i) AS rem FROM step WHERE k = 8),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS at
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id),
convs AS (
  SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS base,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda h: ('0x' || h)::UBIGINT)),
      lambda c, b: xor(c // 256, rem[(xor(c % 256, b) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT % 9 AS h
  FROM sizes, remainders
), turns AS (
  SELECT c.conv_id, o.at AS d, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.at <= c.h
  UNION ALL
  SELECT c.conv_id, o.at - c.h + least(c.h, coalesce(s.n, 0)), o.role, o.text
  FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.at > c.h LEFT JOIN sizes s ON s.conv_id = c.base
), hashed AS (
  SELECT conv_id, d, strlen(text) AS bytes, md5(string_agg(md5(length(role) || ':' || role || text), '' ) OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM turns
), paths AS (
  SELECT conv_id, d, bytes, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY d), 'root') AS parent FROM hashed
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM convs
), lengths AS (SELECT conv_id, max(d) AS len FROM paths GROUP BY conv_id),
nodes AS (
  SELECT p.d, p.node, any_value(p.parent) AS parent, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(p.bytes) AS saved,
    coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE l.len = p.d), '') AS ends
  FROM paths p JOIN lengths l USING (conv_id) GROUP BY p.d, p.node
), children AS (SELECT parent AS node, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
known AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.node = n.node AND c.d = n.d),
subtrees AS (
  SELECT p.node, p.d, sum(k.saved) AS saved_tokens, sum((k.n_children = 0)::BIGINT) AS n_leaves
  FROM known k JOIN paths p ON p.conv_id = k.conv_id AND p.d <= k.d GROUP BY p.node, p.d
)
SELECT k.conv_id, k.d::BIGINT AS depth, a.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM known k JOIN subtrees s ON s.node = k.node AND s.d = k.d LEFT JOIN nodes a ON a.node = k.parent AND a.d = k.d - 1
"""}
