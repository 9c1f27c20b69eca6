"""Operator 6: near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its distinct runs of five lower-cased words. Two
permutations of the 32-bit numbers make the whole signature: the first scatters the
shingles, the second is applied to the scattered value shifted by k for the k-th
coordinate. Rows and bands follow from the similarity, so that a pair at the
threshold shares no band with a chance below `MISS`.

Steps, each on distributed tables:

1. Documents with equal sets are one class (128-bit hash of the set); only
   classes go on, so copies never meet each other.
2. First round: a bucket (one band value) with several classes names as its centre the class that
   shares most crowded buckets; a class is paired with the best centre of
   its buckets. Near copies collapse onto their centre with one pair each.
3. A pair whose two-bit signatures differ more than the threshold allows (4.5 standard
   deviations) is dropped inside the join; every other new pair is verified on its full
   sets, once. Verified links are joined into components.
4. Further rounds look at buckets that hold several components. There all classes outside
   the largest component become centres (`QUOTA` of them in the first such round, as
   many times more in each next one) and are paired with the classes of other components, each
   pair in the first bucket that it shares. Once no bucket has more outside classes
   than centres, every pair across components has been compared and the rounds end.

Nothing is collected; no group is held in one task.

Edge cases: null and wordless texts have an empty set and link with nothing; texts of
fewer than five words are one shingle; repeated rows and ties fall into one class; rows
with a null id take part and report the smallest id of their component, null
if there is none; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsieve.llm import arrays, bloom
from docsieve.llm.registry import table
from docsieve.session import cut

WIDTH = 5
#: Chance that a pair at the threshold shares no band.
MISS = 1e-5
#: Standard deviations beyond which a pair is dropped on its signatures alone (a chance of 3 in a million).
DEVIATIONS = 4.5
#: Coordinates of a signature, at least; the bands use as many of them as they need. Two bits of each are compared.
COORDINATES = 1024
#: Rows of an Arrow batch while texts are read, so that batches of long texts stay small.
BATCH_ROWS = 1000
LOW_BITS = 0x5555555555555555
#: Centres of a bucket in the second round; they grow by this factor from round to round.
QUOTA = 64


def banding(similarity: float) -> tuple[int, int]:
    """Rows of a band and number of bands for a similarity in (0, 1]."""
    rows = 8 if similarity >= 0.9 else 6 if similarity >= 0.7 else 4
    return rows, math.ceil(math.log(MISS) / math.log(1 - min(similarity, 0.99) ** rows))


def scatter(x: np.ndarray, tmp: np.ndarray) -> None:
    """A permutation of 32-bit numbers, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=tmp)
        np.bitwise_xor(x, tmp, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=tmp)
    np.bitwise_xor(x, tmp, out=x)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, text by text, and how many each text has (with repeats)."""
    data, offsets = arrays.text_bytes(column)
    data = arrays.LOWER[data]
    starts, ends, owner = arrays.spans(data, offsets, arrays.SEPARATOR)
    words = arrays.span_hashes(data, starts, ends)
    n_words = np.bincount(owner, minlength=len(column))
    hashes, at = arrays.windows(words, owner, WIDTH)
    short = np.flatnonzero((n_words > 0) & (n_words < WIDTH))
    first = np.cumsum(n_words) - n_words
    whole = np.zeros(len(short), np.uint64)
    for j in range(WIDTH - 1):
        has = n_words[short] > j
        whole[has] += words[first[short[has]] + j] * (arrays.BYTE_VALUE[j] | np.uint64(1))
    whole = arrays.mix(whole + n_words[short].astype(np.uint64))
    hashes = np.concatenate([hashes, whole])
    of = np.concatenate([owner[at], short])
    order = np.argsort(of, kind="stable")
    return hashes[order], np.bincount(of, minlength=len(column))


def distinct_sets(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    ends = np.cumsum(counts)
    return [np.unique(hashes[e - c : e]) if c else hashes[:0] for c, e in zip(counts.tolist(), ends.tolist())]


def signatures(hashes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """`size` coordinates for each text that has shingles, by two permutations and circular shifts."""
    filled = counts > 0
    starts = (np.cumsum(counts) - counts)[filled]
    base = (hashes >> np.uint64(32)).astype(np.uint32)
    moved, tmp = np.empty_like(base), np.empty_like(base)
    np.bitwise_xor(base, np.uint32(0x9E3779B9), out=base)
    scatter(base, tmp)
    out = np.empty((len(starts), size), np.uint32)
    for k in range(size if len(starts) else 0):
        np.add(base, np.uint32(k), out=moved)
        scatter(moved, tmp)
        out[:, k] = np.minimum.reduceat(moved, starts)
    return out


SET_SALT = np.uint64(0xA5A5A5A5A5A5A5A5)


def class_key(members: np.ndarray) -> bytes | None:
    """A 128-bit key of a set of hashes; null for the empty set."""
    if not len(members):
        return None
    sums = [arrays.mix(m).sum(dtype=np.uint64) for m in (members, members ^ SET_SALT)]
    return np.array(sums, np.uint64).tobytes()


def coordinates(rows: int, bands: int) -> int:
    return max(COORDINATES, rows * bands)


def lists(values: np.ndarray, has: np.ndarray) -> pa.Array:
    """A list per row from a matrix that has a row for each True of `has`; null elsewhere."""
    ends = np.zeros(len(has) + 1, np.int32)
    np.cumsum(has * values.shape[1], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()), mask=pa.array(~has))


def sketcher(text: str, rows: int, bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The other columns with class, set size, two bits of each coordinate, and band values."""
    size = coordinates(rows, bands)
    words = -(-2 * size // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, text, 1 << 20):
            hashes, counts = shingles(batch.column(text))
            sets = distinct_sets(hashes, counts)
            sign = signatures(hashes, counts, size)
            band = np.zeros((len(sign), bands), np.uint64) + arrays.mix(np.arange(1, bands + 1, dtype=np.uint64))
            for j in range(rows):
                band += arrays.mix(sign[:, j : rows * bands : rows].astype(np.uint64) + np.uint64(1)) * (arrays.BYTE_VALUE[j] | np.uint64(1))
            bits = np.zeros((len(sign), words * 64), np.uint8)
            bits[:, : 2 * size : 2], bits[:, 1 : 2 * size : 2] = sign & 1, sign >> 1 & 1
            names = [x for x in batch.schema.names if x != text]
            yield pa.RecordBatch.from_arrays(
                [batch.column(x) for x in names] + [
                    pa.array([class_key(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    lists(np.packbits(bits, axis=1).view(np.int64), counts > 0),
                    lists(arrays.mix(band).view(np.int64), counts > 0),
                ],
                [*names, "class", "n_shingles", "bits", "bands"],
            )
        arrays.release()

    return run


def differing(left: str, right: str, words: int) -> Column:
    """Coordinates in which two signatures differ."""
    def word(i: int) -> Column:
        x = F.col(left)[i].bitwiseXOR(F.col(right)[i])
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOW_BITS)))

    return sum((word(i) for i in range(1, words)), word(0))


def set_maker(wanted: bloom.Filter | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Class and sorted set of each wanted text, once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes | None] = {None}
        for batch in batches:
            if wanted:
                keys = batch.column("_key").to_numpy()
                batch = batch.filter(pa.array(wanted.hit(keys, arrays.mix(keys.view(np.uint64)))))
            for part in arrays.slices([batch], "text", 1 << 20):
                found = {}
                for members in distinct_sets(*shingles(part.column("text"))):
                    key = class_key(members)
                    if key not in seen:
                        seen.add(key)
                        found[key] = members
                if found:
                    ends = np.cumsum([0, *map(len, found.values())], dtype=np.int32)
                    flat = np.concatenate(list(found.values())).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["class", "members"])
        arrays.release()

    return run


def hash_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("_key").to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(arrays.mix(keys.view(np.uint64)).view(np.int64))], ["h1", "h2"])


def text_key(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    The texts are read again. A Bloom filter of the wanted rows keeps all others from being
    worked on and shuffled; beyond `bloom.MAX_BYTES` the wanted rows are joined instead.
    """
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(nodes.select("class", "_key"), "class").select("class", "_key"))
    size, hashes = bloom.bits_for(wanted.count(), 0.005)
    texts = docs.select(text_key(key, text).alias("_key"), F.col(text).alias("text"))
    if size // 8 <= bloom.MAX_BYTES:
        held = bloom.build(wanted.select("_key").mapInArrow(hash_pairs, "h1 long, h2 long"), 0, size, hashes)
    else:
        held, texts = None, texts.join(wanted.select("_key").distinct(), "_key", "left_semi")
    sets = texts.mapInArrow(set_maker(held), "class binary, members array<long>").dropDuplicates(["class"])
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("members").alias("left")), "a").join(sets.select(F.col("class").alias("b"), F.col("members").alias("right")), "b")
    sizes = both.select("a", "b", (F.size("left") + F.size("right")).alias("total"), F.size(F.array_intersect("left", "right")).alias("common"))
    return sizes.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of a link, by alternating large and small stars."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u != v").distinct())
        # done when all edges are stars: no centre has an edge of its own
        if edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def close(percent: int, size: int) -> Column:
    """Whether the signatures `bits` and `other_bits` may belong to a pair at the threshold."""
    # two bits of a coordinate differ in three of four cases where the coordinate differs
    share = 0.75 * (1 - percent / 100)
    most = math.ceil(size * share + DEVIATIONS * math.sqrt(size * share * (1 - share)))
    return differing("bits", "other_bits", -(-2 * size // 64)) <= most


def first_round(live: DataFrame, marked: DataFrame) -> DataFrame:
    """Each class with the best centre of its buckets, and both signatures."""
    centres = live.join(marked.select("class", "degree"), "class").groupBy("bucket").agg(F.max(F.struct("degree", "class")).alias("c"))
    best = live.select("bucket", "class").join(centres, "bucket").groupBy("class").agg(F.max("c")["class"].alias("other")).where("class != other")
    signed = marked.select("class", "bits")
    return best.join(signed, "class").join(signed.select(F.col("class").alias("other"), F.col("bits").alias("other_bits")), "other")


def further_round(live: DataFrame, marked: DataFrame, roots: DataFrame, bands: int, quota: int) -> tuple[DataFrame, bool]:
    """Pairs across the components of a bucket with both signatures, and whether some bucket has more classes outside its main component."""
    named = marked.select("class", "degree").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    placed = live.select("bucket", "class").join(named, "class")
    shares = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    split = shares.groupBy("bucket").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("all"), F.max("n").alias("most")).where("roots > 1")
    placed = cut(placed.join(split.select("bucket", "main", (F.col("all") - F.col("most")).alias("outside")), "bucket"))
    waiting = not placed.where(F.col("outside") > quota).isEmpty()
    order = Window.partitionBy("bucket").orderBy(F.desc("degree"), "class")
    centres = placed.where("root != main").withColumn("at", F.row_number().over(order)).where(F.col("at") <= quota)
    signed = marked.select("class", "bits", "marks")
    left = placed.select("bucket", "class", "root").join(signed, "class")
    right = centres.select("bucket", "class", "root").join(signed, "class").select(
        "bucket", F.col("class").alias("other"), F.col("root").alias("other_root"), F.col("bits").alias("other_bits"), F.col("marks").alias("other_marks"),
    )
    # a pair is met in the first bucket that both share
    shared = F.coalesce(*(F.when(F.col("marks")[i] == F.col("other_marks")[i], F.col("marks")[i]) for i in range(bands)))
    return left.join(right, "bucket").where((F.col("root") != F.col("other_root")) & (shared == F.shiftright("bucket", 32).cast("int"))), waiting


def link(sketches: DataFrame, docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """node (a class) and root for every class that has a link to another one."""
    rows, bands = banding(percent / 100)
    size = coordinates(rows, bands)
    nodes = cut(sketches.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("_key").alias("_key"), F.first("bits").alias("bits"), F.first("bands").alias("bands")))
    member = nodes.select("class", F.explode("bands").alias("bucket"))
    crowded = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = cut(member.join(crowded, "bucket"))
    # the upper half of a band value marks it well enough for comparing the bands of two classes
    marks = F.transform("bands", lambda b: F.shiftright(b, 32).cast("int")).alias("marks")
    marked = cut(nodes.select("class", "bits", marks).join(live.groupBy("class").agg(F.sum("n").alias("degree")), "class"))
    links, roots, seen, quota, waiting = None, None, None, QUOTA, True
    while True:
        if roots is None:
            met = first_round(live, marked)
        else:
            met, waiting = further_round(live, marked, roots, bands, quota)
            quota *= QUOTA
        pairs = met.where(close(percent, size)).select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        if roots is None or not pairs.isEmpty():
            found = verified(pairs, nodes, docs, key, text, percent)
            links = cut(found if links is None else links.unionByName(found))
            seen = pairs if seen is None else seen.unionByName(pairs)
            roots = components(links)
        if not waiting:
            return roots


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, groups: bool = False) -> DataFrame:
    """One row per document: doc_id, _key, class, n_shingles and component_id; with `groups`, root (a class, null for empty sets) instead of component_id.

    `_key` is `text_key` of the row, for joining the result to the documents.
    """
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _find(docs, key, text, percent, groups)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for the jobs run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _find(docs: DataFrame, key: str, text: str, percent: int, groups: bool) -> DataFrame:
    rows, bands = banding(percent / 100)
    kind = docs.schema[key].dataType.simpleString()
    sketches = cut(docs.select(F.col(key).alias("doc_id"), text_key(key, text).alias("_key"), F.col(text).alias("text")).mapInArrow(
        sketcher("text", rows, bands), f"doc_id {kind}, _key long, class binary, n_shingles long, bits array<long>, bands array<long>",
    ))
    roots = link(sketches, docs, key, text, percent).withColumnRenamed("node", "class")
    classes = sketches.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("first"))
    classes = classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    if groups:
        return sketches.select("doc_id", "_key", "class", "n_shingles").join(classes.select("class", "root"), "class", "left")
    smallest = classes.groupBy("root").agg(F.min("first").alias("smallest"))
    named = classes.join(smallest, "root").select("class", "smallest")
    return sketches.select("doc_id", "_key", "class", "n_shingles").join(named, "class", "left").select(
        "doc_id", "_key", "class", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the smallest document that links of 85 percent or more reach."""
    found = find(table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


QUERIES = {"op6_near_duplicates": op6_near_duplicates}
ORACLES: dict[str, str] = {}
