"""Operators as filters and rewriters of whole document tables.

Each function takes a table with the columns of `documents` (doc_id, text, source, n_chars and
any others, in any order, names may clash with those that operators use) and returns
the same columns. Columns travel under positional names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.llm import arrays, decontaminate, near_duplicates, personal_data, quality_rules
from docsieve.llm.tagger import Tagger
from docsieve.session import cut

#: Largest table of hosts or row keys that is broadcast to the texts, at so many bytes a row; a larger one is joined.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 64
#: Bytes of text that are masked together.
SLICE_BYTES = 1 << 20


class Positions:
    """A table under positional column names, and the way back."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.frame = docs.toDF(*(f"c{i}" for i in range(len(self.names))))
        self.schema = self.frame.schema

    def of(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def restored(self, frame: DataFrame) -> DataFrame:
        return frame.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(self.names)))

    def keyed(self) -> DataFrame:
        """With `_key`, which tells rows of one id apart by their text."""
        return self.frame.withColumn("_key", near_duplicates.text_key(self.of("doc_id"), self.of("text")))

    def matched(self, rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        """A semi or anti join of keyed rows with the row keys (_id, _key) of a cut table."""
        keys = bounded(keys)
        return rows.join(keys, (rows["_key"] == keys["_key"]) & rows[self.of("doc_id")].eqNullSafe(keys["_id"]), how)


def bounded(small: DataFrame) -> DataFrame:
    """A cut table, to be broadcast while its size is within bounds, so that the texts beside it stay where they are."""
    return F.broadcast(small) if small.count() * ROW_BYTES <= BROADCAST_BYTES else small


def quality(docs: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """Documents that the quality rules keep.

    The texts are measured twice, once for the hosts and once for the verdicts. The bad hosts
    are broadcast to the texts; only beyond `BROADCAST_BYTES` of them are texts shuffled by host.
    """
    at = Positions(docs)
    text, host = at.of("text"), at.of("source")
    soft = sum((c.cast("int") for c in quality_rules.soft_rules().values()), F.lit(0))
    narrow = T.StructType([T.StructField(host, at.schema[host].dataType), *(T.StructField(m, T.LongType()) for m in quality_rules.MEASURES)])
    facts = at.frame.select(host, text).mapInArrow(quality_rules.measurer(text), narrow).withColumn("failed", quality_rules.base_failed() | (soft > 0))
    bad = bounded(cut(quality_rules.host_verdicts(facts, host, "failed", host_limit).where("bad_host").select("host", "bad_host")))
    wide = T.StructType([*at.schema, *(T.StructField(m, T.LongType()) for m in quality_rules.MEASURES)])
    judged = at.frame.mapInArrow(quality_rules.measurer(text, keep_text=True), wide).where(~quality_rules.base_failed() & (soft <= 1))
    return at.restored(judged.join(bad, F.col(host).eqNullSafe(F.col("host")), "left").where((soft == 0) | F.col("bad_host").isNull()))


def unique(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, a null id last. Repeated rows are one document.

    The rows to drop are found in the narrow table of keys; texts are filtered where they lie. Only rows
    that are repeated as they are (id and text) are brought together.
    """
    at = Positions(docs)
    key, text = at.of("doc_id"), at.of("text")
    found = near_duplicates.find(at.frame, key, text, percent, groups=True)
    first = found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_key"))).alias("first"))
    gone = found.join(first, "root").where((F.col("first._key") != F.col("_key")) | ~F.col("first.doc_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), "_key").distinct()
    kept = at.matched(at.keyed(), cut(gone), "left_anti")
    many = cut(found.groupBy(F.col("doc_id").alias("_id"), "_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id", "_key"))
    if not many.isEmpty():
        again = at.matched(kept, many, "left_semi").dropDuplicates(["_key", key])
        kept = at.matched(kept, many, "left_anti").unionByName(again)
    return at.restored(kept)


def clean_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold no test item."""
    at = Positions(docs)
    rows = at.keyed()
    hits = decontaminate.leaks(rows.select(F.struct(F.col(at.of("doc_id")).alias("_id"), "_key").alias("k"), F.col(at.of("text")).alias("text")), items, "k", "text")
    return at.restored(at.matched(rows, cut(hits.select("doc_id._id", "doc_id._key").distinct()), "left_anti"))


def masker(tagger: Tagger, text: str, length: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices([batch], text, SLICE_BYTES):
                values = part.column(text).to_pylist()
                parts = [personal_data.zones(v or "") for v in values]
                tagged = personal_data.tagged_spans(tagger, parts)
                masked = [
                    v if v is None else personal_data.masked(v, personal_data.settled(personal_data.base_spans(v), found, zones))
                    for v, found, zones in zip(values, tagged, parts)
                ]
                columns = dict(zip(part.schema.names, part.columns))
                columns[text] = pa.array(masked, part.schema.field(text).type)
                if length:
                    old = columns[length].to_pylist()
                    sizes = [o if m == v else len(m) for o, m, v in zip(old, masked, values)]
                    columns[length] = pa.array(sizes, part.schema.field(length).type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        arrays.release()

    return run


def private(docs: DataFrame, sample: int = personal_data.SAMPLE) -> DataFrame:
    """Documents with personal data replaced by its kind in angle brackets; n_chars follows."""
    at = Positions(docs)
    text = at.of("text")
    zones = at.frame.select(F.col(text).alias("text")).mapInArrow(personal_data.zone_maker, "zones array<struct<start: long, text: string>>")
    tagger = personal_data.trained(zones, sample)
    length = at.of("n_chars") if "n_chars" in at.names else None
    return at.restored(at.frame.mapInArrow(masker(tagger, text, length), at.schema))
