"""Operator 7: quality rules on whole documents, with verdicts on their hosts.

One pass over the texts measures each document. Rule failures are then added up by
host. A host's failure rate is shrunk towards the rate of all hosts with a beta
prior whose mean and strength are estimated from the hosts themselves (moments,
less the variance that sampling alone explains), so a host of three documents is
not judged by them alone. Verdicts go back to the documents by a join on the host.

A document is rejected if it fails a base rule. The other rules may be failed once
on an ordinary host and never on a host whose shrunk rate of failing documents is
over `host_limit`. A document that fails no rule always stays.

Edge cases: a null text counts as empty and fails the word rule; null hosts form a
host of their own; repeated rows count each; an empty table gives no rows; of further
columns none is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import arrays
from docsieve.llm.registry import table
from docsieve.session import cut

WINDOW = 8
#: Bytes of text that are measured together.
SLICE_BYTES = 512 << 10
SYMBOL = arrays.byte_class(b"#*$%&|<>")
LETTER = arrays.byte_class(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
UPPER = arrays.byte_class(bytes(range(0x41, 0x5B)))
#: Printable ASCII that is neither letter nor space.
OTHER = arrays.byte_class(bytes(range(0x21, 0x7F))) & ~LETTER
NEWLINE = arrays.byte_class(b"\n")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_other", "n_upper", "n_letters"]


def measure(column: pa.Array) -> list[np.ndarray]:
    """The measures of each text, in the order of MEASURES."""
    data, offsets = arrays.text_bytes(column)
    n = len(column)
    starts, ends, owner = arrays.spans(data, offsets, arrays.SEPARATOR)
    salt = arrays.mix(np.arange(1, n + 1, dtype=np.uint64))
    characters = (data & 0xC0) != 0x80
    counts = [arrays.per_text(x, offsets) for x in (characters & ~arrays.SEPARATOR[data], SYMBOL[data])]
    # lines that hold a word; an equal line of the same text has an equal key
    line_starts, line_ends, line_owner = arrays.spans(data, offsets, NEWLINE)
    at = np.searchsorted(starts, line_starts)
    worded = np.flatnonzero((at < len(starts)) & (starts[np.minimum(at, len(starts) - 1)] < line_ends)) if len(starts) else np.zeros(0, np.int64)
    line_owner = line_owner[worded]
    keys = arrays.mix(arrays.span_hashes(data, line_starts[worded], line_ends[worded]) ^ salt[line_owner])
    _, first = np.unique(keys, return_index=True)
    lines = np.bincount(line_owner, minlength=n)
    duplicates = lines - np.bincount(line_owner[first], minlength=n)
    # words inside a window that the same text holds twice
    keys, at = arrays.windows(arrays.span_hashes(data, starts, ends), owner, WINDOW)
    keys = arrays.mix(keys ^ salt[owner[at]])
    order = np.argsort(keys)
    same = np.zeros(len(keys), bool)
    equal = keys[order][1:] == keys[order][:-1]
    same[order[1:]] |= equal
    same[order[:-1]] |= equal
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, at[same], 1)
    np.add.at(step, at[same] + WINDOW, -1)
    covered = np.cumsum(step[:-1]) > 0
    repeats = np.bincount(owner[covered], minlength=n)
    tail = [arrays.per_text(x[data], offsets) for x in (OTHER, UPPER, LETTER)]
    return [np.bincount(owner, minlength=n), *counts, lines, duplicates, repeats, *tail]


def measurer(text: str, keep_text: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches, text, SLICE_BYTES):
            kept = [i for i, name in enumerate(batch.schema.names) if keep_text or name != text]
            columns = [batch.column(i) for i in kept] + [pa.array(x.astype(np.int64)) for x in measure(batch.column(text))]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[i] for i in kept] + MEASURES)
        arrays.release()

    return run


def base_failed() -> Column:
    """Too few words, or too many inside repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def soft_rules() -> dict[str, Column]:
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "other": 100 * F.col("n_other") > 12 * F.col("word_chars"),
        "shouting": 2 * F.col("n_upper") > F.col("n_letters"),
        "dup_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
    }


def host_verdicts(facts: DataFrame, host: str, failed: str, host_limit: float) -> DataFrame:
    """Per host: documents, failing ones, the shrunk rate and whether the host is bad."""
    hosts = facts.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("f"))
    moments = hosts.agg(
        F.sum("n").alias("all_n"), F.sum("f").alias("all_f"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("squares"),
    ).select(
        "all_n", "hosts", (F.col("all_f") / F.col("all_n")).alias("mean"), F.col("squares"),
    ).withColumn("noise", F.col("mean") * (1 - F.col("mean"))).select(
        "mean", "noise",
        ((F.col("squares") - F.col("all_n") * F.col("mean") * F.col("mean") - F.col("noise") * F.col("hosts")) / F.col("all_n")).alias("spread"),
    ).select(
        "mean",
        # no spread beyond sampling: the prior is as strong as it may be
        F.when(F.col("spread") <= F.col("noise") / 1_000_001, 1_000_000.0).otherwise(F.greatest(F.lit(1.0), F.col("noise") / F.col("spread") - 1)).alias("strength"),
    )
    rate = (F.col("f") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return hosts.crossJoin(F.broadcast(moments)).select("host", "n", "f", rate.alias("rate"), (rate > host_limit).alias("bad_host"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", host_limit: float = 0.5) -> DataFrame:
    """Measures and verdict of each document."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"doc_id {kinds[key]}, host {kinds[host]}, " + ", ".join(f"{m} long" for m in MEASURES)
    facts = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text")).mapInArrow(measurer("text"), schema)
    soft = soft_rules()
    facts = cut(facts.withColumn("base_failed", base_failed()).withColumn("n_soft", sum((c.cast("int") for c in soft.values()), F.lit(0))))
    facts = facts.withColumn("failed", F.col("base_failed") | (F.col("n_soft") > 0))
    verdicts = host_verdicts(facts, "host", "failed", host_limit).select(F.col("host").alias("_host"), "bad_host", F.col("rate").alias("host_rate"))
    kept = ~F.col("base_failed") & (F.col("n_soft") <= F.when(F.col("bad_host"), 0).otherwise(1))
    return facts.join(verdicts, F.col("host").eqNullSafe(F.col("_host"))).withColumn("kept", kept).drop("_host", "failed")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents, with their source as host."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


QUERIES = {"op7_quality_rules": op7_quality_rules}

#: Facts of `documents` by plain lists of words, lines and windows; used by the pipeline's checks too.
FACTS_SQL = r"""
docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS l FROM docs),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(l) AS line FROM tokens) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM tokens)),
twice AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM win JOIN twice USING (r, g), range(8) t(k) GROUP BY r),
counted AS (SELECT r, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  length(regexp_replace(text, '[^\x21-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) AS n_other, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM tokens LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
facts AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  (10 * n_symbols > n_words)::INT + (100 * n_other > 12 * word_chars)::INT + (2 * n_upper > n_letters)::INT + (100 * n_dup_lines > 30 * n_lines)::INT AS n_soft FROM counted),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR n_soft > 0) AS f FROM facts GROUP BY source),
total AS (SELECT sum(n) AS all_n, count(*) AS k, sum(f) / sum(n) AS mean, sum(f * f / n) AS squares FROM hosts),
prior AS (SELECT mean, mean * (1 - mean) AS noise, (squares - all_n * mean * mean - mean * (1 - mean) * k) / all_n AS spread FROM total),
verdicts AS (SELECT source, (f + mean * s) / (n + s) > 0.5 AS bad FROM hosts,
  (SELECT mean, CASE WHEN spread <= noise / 1000001 THEN 1000000.0 ELSE greatest(1.0, noise / spread - 1) END AS s FROM prior)),
judged AS (SELECT f.*, NOT base_failed AND n_soft <= CASE WHEN bad THEN 0 ELSE 1 END AS kept FROM facts f JOIN verdicts v ON f.source IS NOT DISTINCT FROM v.source)
"""
ORACLES = {"op7_quality_rules": f"WITH {FACTS_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"}
