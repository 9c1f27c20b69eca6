"""Operator 2: document quality by histogram gradient-boosted trees over document statistics.

One pass over the whole texts turns each document into numbers (rates of signs,
capitals, repeated lines and words, lengths), taken from the text alone. The trees are fitted in
numpy on at most `sample` labelled documents, those with the smallest hash of their id (rows of one id count once);
rows held out (crc32 of the id as text, modulo 3, is 1) are never among them. Values are
binned by quantiles of the sample, each level of a tree is grown from
histograms of gradients, and the trees are flattened into arrays of features,
thresholds and leaf values. Scoring walks all documents of a batch down one tree at a
time with array operations.

Edge cases: null and empty texts have all statistics 0 and get a score as any other;
several labels of a document count by their mean, null labels not at all;
without labels of both kinds every score is the share of good labels (0.5 without
any); rows with a null id are not held out; repeated rows get equal scores; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import arrays
from docsieve.llm.quality_rules import MEASURES, measure
from docsieve.llm.registry import table
from docsieve.session import cut

#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST, SMOOTH = 60, 4, 64, 0.15, 10.0, 1.0
COUNTED = {"exclaim": b"!", "bar": b"|", "digit": b"0123456789", "stop": b".?", "comma": b",;:", "quote": b"\"'()[]{}"}


def features(column: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    m = dict(zip(MEASURES, (x.astype(float) for x in measure(column))))
    data, offsets = arrays.text_bytes(column)
    starts, ends, owner = arrays.spans(data, offsets, arrays.SEPARATOR)
    n = len(column)
    salt = arrays.mix(np.arange(1, n + 1, dtype=np.uint64))
    _, first = np.unique(arrays.span_hashes(data, starts, ends) ^ salt[owner], return_index=True)
    words, chars = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1)
    lengths = (ends - starts).astype(float)
    square = np.bincount(owner, lengths**2, n) / words - (np.bincount(owner, lengths, n) / words) ** 2
    return np.column_stack([
        np.log1p(m["n_words"]), m["word_chars"] / words, np.sqrt(np.maximum(square, 0)), m["n_symbols"] / words, m["n_other"] / chars,
        m["n_upper"] / np.maximum(m["n_letters"], 1), m["n_letters"] / chars, m["n_dup_lines"] / np.maximum(m["n_lines"], 1), m["n_lines"] / words,
        m["n_repeat_words"] / words, np.bincount(owner[first], minlength=n) / words,
        *(arrays.per_text(arrays.byte_class(b)[data], offsets) / words for b in COUNTED.values()),
    ])


class Trees:
    """Complete trees of one depth as arrays: per tree the inner nodes in heap order and the leaves."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees of the logistic loss, grown level by level from histograms."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    none = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if len(np.unique(y)) < 2:
        return none
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    flat = binned + np.arange(width) * BINS
    total = np.full(len(y), base)
    out = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            size = count * width * BINS
            sums = [np.cumsum(np.bincount(at, np.repeat(v, width), size).reshape(count, width, BINS), axis=2) for v in (g, h, np.ones(len(y)))]
            whole = [s[:, :, -1:] for s in sums]
            gain = sums[0] ** 2 / (sums[1] + SMOOTH) + (whole[0] - sums[0]) ** 2 / (whole[1] - sums[1] + SMOOTH) - whole[0] ** 2 / (whole[1] + SMOOTH)
            gain[(sums[2] < LEAST) | (whole[2] - sums[2] < LEAST)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            f, b = np.divmod(best, BINS)
            for i in range(count):
                if gain[i, f[i], b[i]] > 1e-9 and b[i] < len(edges[f[i]]):
                    feature[first + i], threshold[first + i] = f[i], edges[f[i]][b[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = -RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + SMOOTH)
        total += leaf[at]
        out.append((feature, threshold, leaf))
    return Trees(base, *(np.array(v) for v in zip(*out)))


def featurizer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrays.slices([batch], "text"):
            x = features(part.column("text"))
            offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))], ["doc_id", "features"])


def matrix(lists: pa.Array, rows: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def scorer(trees: Trees) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = trees.score(matrix(batch.column("features"), batch.num_rows))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def smallest(rows: DataFrame, order: str, size: int) -> DataFrame:
    """The `size` rows with the smallest long `order`, which is spread evenly.

    A threshold leaves about 1.2 * `size` rows before they are sorted, so that the task that merges the
    sorted tops gets no `size` rows from each of its inputs. Should too few pass it, all rows are sorted.
    """
    total = rows.count()
    edge = -(1 << 63) + int((1 << 64) * min(1.0, 1.2 * size / max(total, 1)))
    below = rows.where(F.col(order) < F.lit(min(edge, (1 << 63) - 1)))
    return (below if below.count() >= min(size, total) else rows).orderBy(order).limit(size)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted class of each row."""
    kind = docs.schema[key].dataType.simpleString()
    stats = cut(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(featurizer, f"doc_id {kind}, features array<double>"))
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg((F.avg(label) >= 0.5).cast("double").alias("y")).where(~held_out("doc_id"))
    once = stats.join(known, "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.min("y").alias("y"))
    fitted = smallest(cut(once.withColumn("_hash", F.xxhash64("doc_id"))), "_hash", sample).select("features", "y").toArrow()
    width = len(COUNTED) + 11
    x = np.array(fitted["features"].to_pylist(), float).reshape(-1, width)
    trees = fit(x, fitted["y"].to_numpy())
    return stats.mapInArrow(scorer(trees), f"doc_id {kind}, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
ORACLES: dict[str, str] = {}
