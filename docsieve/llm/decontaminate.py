"""Operator 8: benchmark decontamination with a BM25 index of the test items and block-max WAND.

The index is built over the test items: per word the items that hold it, with their
BM25 weights, in blocks of neighbouring items with the largest weight of each block.
Weights are divided by the item's threshold, a share of the score that the item gives itself,
so that every item is retrieved at 1. Each half of a passage asks for a word once.

Every passage of every document is a query. Passages are two neighbouring halves of
equal length, at least as long as the item: items are searched by classes of length (64 words and its doublings), so each
item inside a document lies inside one passage, and a very long item costs a pass of its own but widens no passage of the others. A passage whose words' largest weights do not add up to 1 is left at once. For the others
the block bounds are added up, for so many passages at a time that the table of passages and blocks has
`CELLS` cells and the lists that are read `POSTINGS` entries, whatever the number of items;
only (passage, block) pairs whose bound reaches 1 are scored item by item,
and only items that reach 1 are verified. Words are compared without marks and in lower case. No other pair can reach the threshold, so
the result equals a full scan. Verification takes the item apart into a question (all
but the last sentence) and an answer (the last sentence; the second half
of an item of one sentence) and asks for a share of the five-word runs of each. Either takes words from
the other until it holds 14 words and three tenths of the item, or half of it; runs of parts of less than 14 words are
shorter, and items of less than 10 words are one part. So a changed or missing word, or a tenth of the item cut off at
an end, leaves half of the runs of each part. Items of fewer than `min_words` words are searched as a whole: they
are found where all their words stand in a row. An item of one word is found wherever the word stands.

Scripts without spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese, Tibetan and others) count by character: each is a
word, their marks are separators. Other runs without ASCII marks are words.

The index is sent to the tasks in groups of items of bounded size; each group of a length class makes one
pass over the documents, so more items cost passes, not memory.

Edge cases: null and empty texts hold nothing; items without a word and
null items are skipped; repeated rows are reported each; equal items
are both reported; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import arrays
from docsieve.llm.registry import table

K1, B = 1.2, 0.75
WIDTH = 5
BLOCK = 4
HALF_WORDS = 64
#: Least words and least part of an item's words in its question and in its answer; items too short for both are halved, those below WHOLE words are not taken apart.
LEAST_WORDS, LEAST_SHARE, WHOLE = 14, 0.3, 10
#: Words are runs of ASCII letters, digits and all other characters beyond ASCII; but characters of scripts without spaces are words and their marks are separators.
SEPARATOR = ~arrays.byte_class(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
MARKS = [(0x3000, 0x3004), (0x3008, 0x3020), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]
SPACELESS = [(0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0x2FFF), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0xA4CF),
             (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]
#: Bytes of item text whose index is sent to the tasks at once.
GROUP_BYTES = 8 << 20
#: Cells of the table of block bounds, and list entries added to it at a time.
CELLS, POSTINGS = 1 << 20, 1 << 18
#: Bytes of text that are searched together.
SLICE_BYTES = 1 << 20


def code_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A table of all code points that is True inside the ranges."""
    table = np.zeros(0x110000, bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word."""
    starts, ends, owner = arrays.spans(data, offsets, SEPARATOR)
    lead = np.flatnonzero(data >= 0xE0)
    if not len(lead):
        return starts, ends, owner
    long = data[lead] >= 0xF0
    first, second, third = (data[lead + j].astype(np.int64) & (63 if j else 15) for j in range(3))
    code = (first << 12) | (second << 6) | third
    code[long] = ((code[long] & 0x7FFF) << 6) | (data[lead[long] + 3] & 63)
    marks = code_class(MARKS)[code]
    alone = marks | code_class(SPACELESS)[code]
    if not alone.any():
        return starts, ends, owner
    marks, lead, after = marks[alone], lead[alone], (lead + 3 + long)[alone]
    of = np.searchsorted(starts, lead, "right") - 1
    inner, more = lead[lead > starts[of]], after[after < ends[of]]
    starts, ends = (np.unique(np.concatenate(x)) for x in ((starts, inner, more), (ends, inner, more)))
    word = ~np.isin(starts, lead[marks])
    starts, ends = starts[word], ends[word]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def text_words(texts: list[str]) -> list[np.ndarray]:
    """The word hashes of each text, A-Z lower-cased."""
    data, offsets = arrays.text_bytes(pa.array(texts, pa.string()))
    data = arrays.LOWER[data]
    starts, ends, owner = word_spans(data, offsets)
    hashes = arrays.span_hashes(data, starts, ends)
    return np.split(hashes, np.searchsorted(owner, np.arange(1, len(texts)))) if texts else []


def last_sentence(text: str) -> str:
    """The last sentence, or nothing for a text of one sentence."""
    return "".join(re.split(r"(?<=[.!?])\s+|(?<=[。！？])\s*(?=[^\s。！？])", text.strip())[1:][-1:])


def question_and_answer(words: np.ndarray, last: int) -> list[np.ndarray]:
    """An item's words taken apart; `last` is the number of words in its last sentence, 0 if it has one only."""
    n = len(words)
    if n < WHOLE:
        return [words]
    least = min(n // 2, max(LEAST_WORDS, math.ceil(LEAST_SHARE * n)))
    at = min(max(n - last if last else n // 2, least), n - least)
    return [words[:at], words[at:]]


def run_width(n: int) -> int:
    """Words in a run of a part of n words: so few that one word lies in at most half of the runs."""
    return max(1, min(WIDTH, (n + 1) // 3))


def runs(words: np.ndarray, width: int) -> np.ndarray:
    return np.unique(arrays.windows(words, np.zeros(len(words), np.int8), width)[0])


def segments(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after another."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class Index:
    """Inverted lists of items with normalised BM25 weights, and of blocks with their largest ones."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[int, int], total: int, mean: float, share: float, min_words: int = 8):
        self.ids = [i for i, _ in items]
        words = text_words([t for _, t in items])
        last = text_words([last_sentence(t) for _, t in items])
        parts = [question_and_answer(w, len(end)) for w, end in zip(words, last)]
        widths = [len(w) if len(w) < min_words else None for w in words]
        self.parts = [[(width or run_width(len(w)), runs(w, width or run_width(len(w)))) for w in p] for p, width in zip(parts, widths)]
        postings = []
        for n, w in enumerate(words):
            terms, tf = np.unique(w, return_counts=True)
            df = np.array([frequency[t] for t in terms.tolist()], float)
            weight = np.log1p((total - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            postings.append((terms, np.full(len(terms), n), weight / max(1e-12, share * float(weight.sum()))))
        terms, item, weight = (np.concatenate(x) for x in zip(*postings))
        self.vocabulary, term = np.unique(terms, return_inverse=True)
        order = np.lexsort((item, term))
        self.item, self.weight = item[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        self.most = np.maximum.reduceat(self.weight, self.first[:-1])
        self.stride = len(items) // BLOCK + 1
        self.key = term[order].astype(np.int64) * self.stride + self.item // BLOCK
        starts = np.flatnonzero(np.diff(self.key, prepend=-1))
        self.block_of, self.bound = self.item[starts] // BLOCK, np.maximum.reduceat(self.weight, starts)
        self.block_first = np.searchsorted(term[order][starts], np.arange(len(self.vocabulary) + 1))
        self.blocks = (len(items) - 1) // BLOCK + 1

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def hopeful(self, terms: np.ndarray, half: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """Which halves lie in a passage whose largest weights add up to the threshold; `joined` tells which halves go on into the next one."""
        most = np.bincount(half, self.most[terms], len(joined) + 1)
        passage = most[:-1] + np.where(joined, most[1:], 0)
        reached = passage >= 1 - 1e-9
        return reached | np.r_[False, reached[:-1] & joined[:-1]]

    def bounds(self, terms: np.ndarray, half: np.ndarray, halves: int) -> np.ndarray:
        """Added bounds of each (half, block)."""
        out = np.zeros(halves * self.blocks)
        n = self.block_first[terms + 1] - self.block_first[terms]
        ends = np.cumsum(n)
        start = 0
        while start < len(terms):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + POSTINGS, "right")))
            some = n[start:stop]
            at = np.repeat(self.block_first[terms[start:stop]], some) + segments(some)
            np.add.at(out, np.repeat(half[start:stop], some) * self.blocks + self.block_of[at], self.bound[at])
            start = stop
        return out.reshape(halves, self.blocks)

    def candidates(self, terms: np.ndarray, half: np.ndarray, joined: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first half of a passage, block) wherever the block's bounds reach the threshold; `half` is sorted."""
        alive = self.hopeful(terms, half, joined)
        wanted = alive[half]
        terms, half = terms[wanted], half[wanted]
        # the halves of one chunk and the next half behind it; rows of halves without a hopeful passage are left out
        rows = np.flatnonzero(alive)
        step = max(1, CELLS // self.blocks - 1)
        for start in range(0, len(rows), step):
            own = rows[start : start + step + 1]
            low, high = np.searchsorted(half, [own[0], own[-1] + 1])
            table = self.bounds(terms[low:high], np.searchsorted(own, half[low:high]), len(own))
            follows = joined[own[:-1]] & (np.diff(own) == 1)
            table[:-1][follows] += table[1:][follows]
            some = table[:step]
            for at, block in zip(*(x.tolist() for x in np.nonzero(some >= 1 - 1e-9))):
                yield int(own[at]), block

    def scores(self, terms: np.ndarray, block: int) -> np.ndarray:
        """Scores of the items of a block for a passage's words."""
        wanted = terms * self.stride + block
        low = np.searchsorted(self.key, wanted)
        n = np.searchsorted(self.key, wanted, "right") - low
        at = np.repeat(low, n) + segments(n)
        return np.bincount(self.item[at] - block * BLOCK, self.weight[at], BLOCK)

    def overlaps(self, words: np.ndarray, item: int) -> list[float]:
        """Share of the question's and of the answer's runs among the words."""
        return [float(np.isin(wanted, runs(words, width), assume_unique=True).mean()) for width, wanted in self.parts[item]]


def searcher(index: Index, half_words: int, overlap: float, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, "text", SLICE_BYTES):
            data, offsets = arrays.text_bytes(batch.column("text"))
            data = arrays.LOWER[data]
            starts, ends, owner = word_spans(data, offsets)
            if not len(starts):
                continue
            hashes = arrays.span_hashes(data, starts, ends)
            n_words = np.bincount(owner, minlength=batch.num_rows)
            first = np.cumsum(n_words) - n_words
            n_halves = -(-n_words // half_words)
            first_half = np.cumsum(n_halves) - n_halves
            half = first_half[owner] + (np.arange(len(owner)) - first[owner]) // half_words
            terms = index.lookup(hashes)
            known = np.flatnonzero(terms >= 0)
            # each half asks for a word once
            asked = np.unique(half[known] * len(index.vocabulary) + terms[known])
            asked_half, asked = np.divmod(asked, len(index.vocabulary))
            first_asked = np.searchsorted(asked_half, np.arange(n_halves.sum() + 2))
            of = np.repeat(np.arange(batch.num_rows), n_halves)
            joined = np.r_[of[:-1] == of[1:], False]
            found: dict[tuple[int, int], tuple[float, float, float]] = {}
            for h, block in index.candidates(asked, asked_half, joined):
                row = int(of[h])
                begin = int(first[row] + (h - first_half[row]) * half_words)
                stop = int(min(begin + 2 * half_words, first[row] + n_words[row]))
                last = h + 1 + (h + 1 < len(of) and of[h + 1] == row)
                scores = index.scores(asked[first_asked[h] : first_asked[last]], block)
                for i in np.flatnonzero(scores >= 1 - 1e-9).tolist():
                    item = block * BLOCK + i
                    shares = index.overlaps(hashes[begin:stop], item)
                    if min(shares) >= overlap:
                        now = (float(scores[i]), shares[0], shares[-1])
                        found[row, item] = max(now, found.get((row, item), now))
            if found:
                rows, items = zip(*found)
                values = zip(*found.values())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), pa.array([index.ids[i] for i in items], kind), *(pa.array(v, pa.float64()) for v in values)],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )
        arrays.release()

    return run


def words_of(text: str) -> F.Column:
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    marks, spaceless = ("".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) for ranges in (MARKS, SPACELESS))
    apart = F.regexp_replace(lower, f"([{spaceless}])", " $1 ")
    return F.filter(F.split(apart, f"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F{marks}]+"), lambda w: w != "")


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
          share: float = 0.6, overlap: float = 0.5, min_words: int = 8) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for each item that a document holds.

    share: part of an item's own score that a passage has to reach; overlap: part of
    the runs of question and answer, each. min_words: items of fewer words have to stand in the document as a whole.
    """
    spark = docs.sparkSession
    kinds = {"doc": docs.schema[key].dataType.simpleString(), "item": items.schema[item_key].dataType.simpleString()}
    schema = f"doc_id {kinds['doc']}, item_id {kinds['item']}, score double, question_overlap double, answer_overlap double"
    listed = items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text"), words_of(item_text).alias("words")).where(F.size("words") > 0)
    total, mean = listed.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    if not total:
        return spark.createDataFrame([], schema)
    # items of a length class share passages of that length, so a long item does not widen those of the others
    doublings = F.greatest(F.lit(0), F.ceil(F.log2(F.size("words") / F.lit(HALF_WORDS)))).cast("int")
    listed = listed.withColumn("doublings", doublings)
    sizes = listed.groupBy("doublings").agg(F.sum(F.octet_length("text")).alias("bytes")).orderBy("doublings").collect()
    frequency = listed.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    queries = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = pa.int64() if kinds["item"] == "bigint" else pa.int32() if kinds["item"] == "int" else pa.string()
    parts = []
    for length, g, groups in ((r["doublings"], g, -(-r["bytes"] // GROUP_BYTES)) for r in sizes for g in range(-(-r["bytes"] // GROUP_BYTES))):
        own = listed.where((F.col("doublings") == length) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g))
        known = [(r["item_id"], r["text"]) for r in own.select("item_id", "text").orderBy(F.size("words"), "item_id", "text").collect()]
        if not known:
            continue
        counts = own.select(F.explode("words").alias("word")).distinct().join(frequency, "word").collect()
        frequencies = dict(zip((int(w[0]) for w in text_words([r["word"] for r in counts])), (r["df"] for r in counts)))
        index = Index(known, frequencies, total, mean, share, min_words)
        parts.append(queries.mapInArrow(searcher(index, HALF_WORDS << length, overlap, kind), schema))
    return reduce(DataFrame.unionByName, parts)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items that documents hold, one row for each document and item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLES: dict[str, str] = {}
