"""Operator 10: secrets by patterns and by a battery of randomness tests with false-discovery control.

Base spans come from three patterns. Beyond them every token of 16 or more
characters of the usual encodings (A-Z a-z 0-9 + / _ = -) is a candidate, but for plain
numbers, which are the business of personal data, and tokens without a letter or digit or of one
repeated sign (separator lines, masks), which encode nothing. Its encoding is inferred as the smallest of
hex, base32, base36 and base64 that holds it. Three statistics are taken:

* chi-squared uniformity over the encoding's alphabet, per character;
* runs: changes of the character class (digit, lower, upper, other) per step;
* serial correlation: the share of neighbouring pairs that are common in the language.

Mean and spread of each under natural text are measured over all distinct candidates of the corpus that
hold no digit, with the outer fortieths of either side drawn in, and weigh against a prior that counts as 100 candidates. So
neither copies nor a few odd tokens set them. A statistic's p-value is the chance that natural text looks so random. The p-values are joined by Fisher's method.
Candidates are then controlled for false discoveries by the step-up rule of Benjamini and
Hochberg inside each class of lengths, over the whole corpus: Spark adds up counts by length class and
by hundredth of log10 p, so the table that is collected has a fixed number of rows at any size.

Edge cases: null and empty texts have no spans and the hash of nothing; equal
candidates get equal verdicts; repeated rows are each reported; an empty table gives no rows;
further columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import arrays
from docsieve.llm.registry import table
from docsieve.session import cut

KINDS = ["assign", "access", "hex", "random"]
#: Fixed patterns of the base kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CANDIDATE = re.compile(r"(?![0-9]{16,}(?![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{16,}")
ENCODES = re.compile(r"(?!(.)\1*=*$)(?=.*[A-Za-z0-9])")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ENCODINGS = [("hex", "0123456789abcdef"), ("hex", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
             ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")]
#: Length classes and the false-discovery rate inside each.
LENGTHS = [16, 20, 24, 32, 48, 64, 128]
RATE = 0.01
#: Candidates that the prior of natural text counts as, steps of a statistic in its histogram, the share that is drawn in on either side, and the spread of a normal variable after that.
PRIOR, STEPS, TAIL, DRAWN_IN = 100, 1000, 0.025, 0.9556
FLOOR = -30.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the base kinds, unordered."""
    found = []
    for m in ASSIGN.finditer(text):
        if len(m.group(2)) >= 6:
            found.append((m.start(), m.end(), "assign"))
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def encoding(token: str) -> str:
    body = set(token.rstrip("=").replace("-", "+").replace("_", "/"))
    for name, alphabet in ENCODINGS:
        if body <= set(alphabet):
            return alphabet
    return ENCODINGS[-1][1]


def chi_squared(token: str, alphabet: str) -> float:
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    counts: dict[str, int] = {}
    for c in body:
        counts[c] = counts.get(c, 0) + 1
    mean = len(body) / len(alphabet)
    return sum(n * n for n in counts.values()) / mean - len(body)


def class_changes(token: str) -> int:
    kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o" for c in token]
    return sum(a != b for a, b in zip(kinds, kinds[1:]))


def lower_tail(z: float) -> float:
    return max(1e-15, 0.5 * math.erfc(-z / math.sqrt(2)))


class Nature:
    """Common pairs of natural text, and the mean and the spread of each statistic over natural tokens."""

    def __init__(self, pairs: dict[str, int]):
        total, kept = sum(pairs.values()), 0
        self.common: set[str] = set()
        for p in sorted(pairs, key=lambda p: (-pairs[p], p)):
            if kept >= 0.9 * total:
                break
            self.common.add(p)
            kept += pairs[p]
        # before anything is measured: natural text is far from uniform, rarely changes class and keeps to common pairs
        self.mean, self.spread = [1.5, 0.03, 0.85], [0.6, 0.06, 0.12]

    def statistics(self, token: str) -> list[float]:
        """Excess of chi-squared over its degrees of freedom, class changes and common pairs, each per character or step."""
        alphabet, steps, low = encoding(token), len(token) - 1, token.lower()
        excess = (chi_squared(token, alphabet) - (len(alphabet) - 1)) / len(token)
        return [excess, class_changes(token) / steps, sum(low[i : i + 2] in self.common for i in range(steps)) / steps]

    def measure(self, tables: list[dict[int, int]]) -> None:
        """Takes mean and spread from a histogram of each statistic, next to the prior."""
        for i, table in enumerate(tables):
            steps = np.array(sorted(table), float)
            counts = np.array([table[b] for b in sorted(table)], float)
            n = counts.sum()
            if not n:
                continue
            seen = np.cumsum(counts)
            low, high = (steps[np.searchsorted(seen, q * n)] for q in (TAIL, 1 - TAIL))
            drawn = np.clip(steps, low, high) / STEPS
            mean = float((drawn * counts).sum() / n)
            variance = float(((drawn - mean) ** 2 * counts).sum() / n) / DRAWN_IN**2
            self.spread[i] = max(0.02, math.sqrt((PRIOR * self.spread[i] ** 2 + n * variance) / (PRIOR + n)))
            self.mean[i] = (PRIOR * self.mean[i] + n * mean) / (PRIOR + n)

    def log_p(self, token: str) -> float:
        """log10 of the joint p-value under natural text: small for random strings."""
        half = 0.0
        for x, mean, spread, sign in zip(self.statistics(token), self.mean, self.spread, (1, -1, 1)):
            half -= math.log(lower_tail(sign * (x - mean) / spread))
        return max(FLOOR, (-half + math.log(1 + half + half * half / 2)) / math.log(10))


def length_class(n: int) -> int:
    return max(x for x in LENGTHS if x <= n)


def collector(text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The other columns with base spans and the starts and strings of candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, text):
            bases, starts, tokens = [], [], []
            for value in batch.column(text).to_pylist():
                value = value or ""
                spans = base_spans(value)
                bases.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
                free = [m for m in CANDIDATE.finditer(value) if ENCODES.match(m.group()) and not any(s < m.end() and m.start() < e for s, e, _ in spans)]
                starts.append([m.start() for m in free])
                tokens.append([m.group() for m in free])
            names = [n for n in batch.schema.names if n != text]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(bases, span), pa.array(starts, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.string()))],
                [*names, "base", "starts", "tokens"],
            )

    return run


def nature_of(found: DataFrame) -> Nature:
    """Rates over all distinct candidates without a digit; what is collected are the pairs of the alphabet and a histogram of each statistic."""
    words = found.select(F.explode("tokens").alias("token")).where(~F.col("token").rlike("[0-9]")).distinct()

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, int] = {}
            for token in batch.column("token").to_pylist():
                low = token.lower()
                for pair in {low[i : i + 2] for i in range(len(low) - 1)}:
                    counts[pair] = counts.get(pair, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pair", "n"])

    pairs = words.mapInArrow(pairs_of, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    nature = Nature({r["pair"]: r["n"] for r in pairs})

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([nature.statistics(t) for t in batch.column("token").to_pylist()], float).reshape(-1, 3)
            for i, v in enumerate(values.T):
                steps, n = np.unique(np.rint(STEPS * v).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), i)), pa.array(steps), pa.array(n)], ["i", "step", "n"])

    tables: list[dict[int, int]] = [{}, {}, {}]
    for r in words.mapInArrow(histograms, "i long, step long, n long").groupBy("i", "step").agg(F.sum("n").alias("n")).collect():
        tables[r["i"]][r["step"]] = r["n"]
    nature.measure(tables)
    return nature


def scorer(nature: Nature) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds hundredths of log10 p of each candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [[math.floor(100 * nature.log_p(t)) for t in tokens] for tokens in batch.column("tokens").to_pylist()]
            sizes = [[len(t) for t in tokens] for tokens in batch.column("tokens").to_pylist()]
            keep = [n for n in batch.schema.names if n != "tokens"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(sizes, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.int64()))], [*keep, "sizes", "scores"])

    return run


def limits(scored: DataFrame, rate: float) -> dict[int, int]:
    """Per length class the largest score (hundredths of log10 p) that the step-up rule accepts."""
    bins = scored.select(F.explode(F.arrays_zip("sizes", "scores")).alias("c")).select("c.sizes", "c.scores")
    bin_of = F.lit(LENGTHS[0])
    for n in LENGTHS[1:]:
        bin_of = F.when(F.col("sizes") >= n, n).otherwise(bin_of)
    table = bins.groupBy(bin_of.alias("length"), "scores").agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for length in LENGTHS:
        rows = sorted((r["scores"], r["n"]) for r in table if r["length"] == length)
        total, seen = sum(n for _, n in rows), 0
        for score, n in rows:
            seen += n
            if 10 ** ((score + 1) / 100) * total <= rate * seen:
                out[length] = score
    return out


def reporter(accepted: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, spans = [], [], []
            for base, starts, sizes, scores in zip(*(batch.column(n).to_pylist() for n in ("base", "starts", "sizes", "scores"))):
                found = [(b["start"], b["end"], b["kind"]) for b in base]
                counts.append([sum(k == kind for _, _, k in found) for kind in KINDS[:3]])
                hashes.append(hashlib.sha256(joined(found).encode()).hexdigest())
                more = [(s, s + n, "random") for s, n, score in zip(starts, sizes, scores) if score <= accepted.get(length_class(n), -(10**9))]
                spans.append(joined(found + more))
            kinds = np.array(counts, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, kinds), pa.array(hashes, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans and all spans, for each row."""
    kind = docs.schema[key].dataType.simpleString()
    span = "array<struct<start: long, end: long, kind: string>>"
    found = cut(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(collector("text"), f"doc_id {kind}, base {span}, starts array<long>, tokens array<string>"))
    scored = cut(found.mapInArrow(scorer(nature_of(found)), f"doc_id {kind}, base {span}, starts array<long>, sizes array<long>, scores array<long>"))
    return scored.mapInArrow(reporter(limits(scored, rate)), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLES: dict[str, str] = {}
