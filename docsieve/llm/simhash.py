"""Operator 13: near-duplicate documents by SimHash and a hierarchical index in Gray order.

A document's fingerprint has 64 bits: a bit is one if it is set in over half of the XXH64 values
of its word shingles, repeats included. Fingerprints with at most `bits` differing bits are linked.
Steps:

1. Fingerprints are computed in tasks, equal ones become one row.
2. Pairs that differ in at most three bits agree in one of four blocks of 16 bits, so each fingerprint goes into
   four cells (block, its value) and every link lies in a cell. A cell with more than `CELL` fingerprints is
   dealt anew by the same rule over the bits that are left (four blocks of 12, then 9, then 7), so no
   cell outgrows a task and no link is lost: in the last level a cell has at most 2^20 members.
3. A task indexes its cells: fingerprints are sorted by Gray rank, neighbours are joined into nodes, nodes
   into upper nodes. A node holds the bits that all its members share and its parent does not;
   a search from the top adds up the differences in these bits and leaves a whole group as soon as they exceed
   the limit. At the bottom the sum is the distance.
4. The links of a block of cells are reduced to a spanning forest, joined over all cells into components.

Nothing is collected. Text of any length is read in segments.

Edge cases: null, empty and wordless texts have the fingerprint zero and link like any other; with fewer words than
a shingle the whole sequence is one shingle; repeated rows and ties share a fingerprint; rows with a null id take part
and report the smallest id of their component, null if there is none; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import arrays
from docsieve.llm.near_duplicates import components
from docsieve.llm.registry import table
from docsieve.session import cut

SEED = 42
#: Bytes of a text that are split into words at a time.
SEGMENT = 1 << 20
#: Shingle hashes whose bits are counted at a time.
HASHES = 1 << 16
#: Fingerprints of a cell beyond which it is dealt anew.
CELL = 1024
#: Fingerprints that are indexed together: whole cells, at least one.
BLOCK = 1 << 16
#: Children of an index node.
FAN = 8
#: Pairs of query and node that a search holds at a time, about.
FRONTIER = 1 << 21
#: Rows of one fingerprint from which it is looked up apart, and the largest such table that is broadcast.
MANY, BROADCAST_ROWS = 10_000, 1_000_000

GAP = re.compile(rb"[ \t-\r]")


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The words of a lower-cased text, segment by segment."""
    at = 0
    while at < len(data):
        end = at + SEGMENT
        if end < len(data):
            gap = GAP.search(data, end)
            end = gap.start() if gap else len(data)
        yield data[at:end].split()
        at = end


def shingle_hashes(text: str | None, width: int) -> Iterator[list[int]]:
    """XXH64 of each run of `width` words joined by spaces; of the whole sequence if there are fewer words."""
    digest, before = xxhash.xxh64_intdigest, []
    met = 0
    for words in words_of((text or "").encode("utf-8", "surrogatepass").lower()):
        met += len(words)
        words = before + words
        before = words[1 - width :] if width > 1 else []
        if len(words) < width:
            continue
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = ends + 1 - sizes
        yield [digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    if 0 < met < width:
        yield [digest(b" ".join(before), SEED)]


def fingerprints(texts: list[str | None], width: int = 3) -> np.ndarray:
    """The fingerprint of each text as an unsigned number."""
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[int] = []
    owners: list[tuple[int, int]] = []

    def count() -> None:
        if held:
            bits = np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            rows = np.array([o for o, _ in owners])
            sizes = np.array([n for _, n in owners])
            np.add.at(ones, rows, np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64))
            np.add.at(total, rows, sizes)
            held.clear()
            owners.clear()

    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text, width):
            held += hashes
            owners.append((i, len(hashes)))
            if len(held) >= HASHES:
                count()
    count()
    return ((2 * ones > total[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def sketcher(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, "text"):
            found = fingerprints(batch.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def submasks(mask: int, parts: int) -> list[int]:
    """The bits outside the mask in so many blocks, each together with the mask."""
    free = [i for i in range(64) if not mask >> i & 1]
    edges = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[s:e]) for s, e in zip(edges, edges[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def divided(mask: Column, masks: list[int], parts: int) -> Column:
    """The masks into which a cell's mask is divided, one row each."""
    entries = [(F.lit(signed(m)), F.array(*(F.lit(signed(s)) for s in submasks(m, parts)))) for m in masks]
    return F.explode(F.element_at(F.create_map(*(c for entry in entries for c in entry)), mask))


def dealt(prints: DataFrame, bits: int) -> DataFrame:
    """fp, mask, value: every pair within `bits` differing bits shares a cell (mask, value)."""
    parts = bits + 1
    masks, done = [0], None
    cells = prints.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        cells = cells.select("fp", divided(F.col("mask"), masks, parts).alias("mask"))
        if done is not None:  # two ways of dealing may end in the same mask
            cells = cells.distinct()
        cells = cut(cells.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value")))
        masks = sorted({s for m in masks for s in submasks(m, parts)})
        free = 64 - min(m.bit_count() for m in masks)
        heavy = cut(cells.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).select("mask", "value"))
        last = free <= 20 or heavy.isEmpty()
        light = cells if last else cells.join(heavy, ["mask", "value"], "left_anti")
        done = light if done is None else done.unionByName(light)
        if last:
            return done
        cells = cells.join(heavy, ["mask", "value"], "left_semi").select("fp", "mask")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where a bit pattern stands in the Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Cells of fingerprints in Gray order under a hierarchy of nodes.

    A level has for each node its children (a range of the level below), the last fingerprint below it, and the
    bits that all fingerprints below share and those of its parent do not.
    """

    def __init__(self, prints: np.ndarray, cell: np.ndarray):
        order = np.lexsort((gray_rank(prints), cell))
        self.prints, self.cell = prints[order], cell[order]
        self.levels = []
        low = high = self.prints
        owner, last = self.cell, np.arange(len(prints))
        shared = np.full(len(prints), ~np.uint64(0))
        while True:
            # runs of neighbours in one cell
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
            starts = np.flatnonzero(place % FAN == 0)
            ends = np.r_[starts[1:], len(owner)]
            up_low, up_high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            up_shared = ~(up_low ^ up_high)
            own = shared & ~np.repeat(up_shared, ends - starts)
            self.levels.append((low, own, last, starts, ends))
            low, high, shared, owner, last = up_low, up_high, up_shared, owner[starts], last[ends - 1]
            if len(starts) == len(first):
                break
        self.roots = owner

    def links(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs i < j of positions in one cell that differ in at most `bits` bits."""
        size = np.bincount(np.searchsorted(self.roots, self.cell), minlength=len(self.roots))
        root = np.searchsorted(self.roots, self.cell)
        cost = np.cumsum(size[root])
        start = 0
        while start < len(cost):
            stop = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + FRONTIER, "right")))
            query = np.arange(start, stop)
            node, sum_ = root[query], np.zeros(len(query), np.uint8)
            for low, own, last, starts, ends in reversed(self.levels):
                many = ends[node] - starts[node]
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                query, child, sum_ = np.repeat(query, many), np.repeat(starts[node], many) + step, np.repeat(sum_, many)
                keep = last[child] > query
                query, child, sum_ = query[keep], child[keep], sum_[keep]
                sum_ = sum_ + np.bitwise_count((self.prints[query] ^ low[child]) & own[child])
                keep = sum_ <= bits
                query, node, sum_ = query[keep], child[keep], sum_[keep]
            yield query, node
            start = stop


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after linking i with j: every member of a group has its smallest label."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def linker(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by cell -> a spanning forest of the links in each block of cells."""

    def forest(prints: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
        index = GrayIndex(prints, cell)
        label = np.arange(len(prints))
        for i, j in index.links(bits):
            label = joined(label, i, j)
        at = np.flatnonzero(label != np.arange(len(label)))
        sides = (index.prints[at].view(np.int64), index.prints[label[at]].view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(s) for s in sides], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in ("mask", "value", "fp")])
            held.append(rows)
            size += batch.num_rows
            if size < BLOCK:
                continue
            rows = np.concatenate(held, axis=1)
            new = (np.diff(rows[:2], axis=1) != 0).any(axis=0)
            edge = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            if edge:
                yield forest(rows[2, :edge].view(np.uint64), np.cumsum(np.r_[False, new[: edge - 1]]))
            held, size = [rows[:, edge:]], rows.shape[1] - edge
        if size:
            rows = np.concatenate(held, axis=1)
            yield forest(rows[2].copy().view(np.uint64), np.cumsum(np.r_[False, (np.diff(rows[:2], axis=1) != 0).any(axis=0)]))

    return run


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (the fingerprint's 64 bits) and component_id."""
    kind = docs.schema[key].dataType.simpleString()
    sketches = cut(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(sketcher(width), f"doc_id {kind}, fp long"))
    prints = cut(sketches.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = dealt(prints.select("fp"), bits)
    links = cut(cells.repartition(parts, "mask", "value").sortWithinPartitions("mask", "value").mapInArrow(linker(bits), "a long, b long").distinct())
    roots = components(links).withColumnRenamed("node", "fp")
    named = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(named.select("fp", "n", "root").join(smallest, "root").select("fp", "n", "component_id"))
    shown = ["doc_id", "fp", "component_id"]
    hot = named.where(F.col("n") > MANY).select("fp", "component_id")
    if not 0 < hot.count() <= BROADCAST_ROWS:
        return sketches.join(named, "fp").select(*shown)
    hot = F.broadcast(hot)
    rest = sketches.join(hot, "fp", "left_anti").join(named.where(F.col("n") <= MANY), "fp")
    return sketches.join(hot, "fp").select(*shown).unionByName(rest.select(*shown))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints and components of fingerprints with at most three differing bits."""
    return find(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op13_simhash": op13_simhash}
ORACLES: dict[str, str] = {}
