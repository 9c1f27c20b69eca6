"""Operator 9: token counts by batch encoding in Arrow functions that return lengths only.

Batches are cut into slices of equal bytes. Texts of any length are split where no
piece of the vocabulary can cross: before a run of spaces. The library adds one
leading space to what it encodes, so each part is handed over without its first
space. Equal parts of a task are encoded once; only their lengths are kept.

The split is checked against the vocabulary: a model with a piece that holds a
space after another character is refused.

Edge cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are
counted each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import arrays
from docsieve.llm.registry import table

SPACE = "▁"
#: Parts whose length a task remembers; beyond that it starts anew.
REMEMBERED = 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def check_split(model: sentencepiece.SentencePieceProcessor) -> None:
    """Raise if a piece could cross a split before a run of spaces."""
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if SPACE in piece.lstrip(SPACE):
            raise ValueError(f"piece {piece!r} crosses the start of a word")


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each part: from behind the first space of a run to the next run."""
    space = data == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    inner = offsets[(offsets >= 0) & (offsets < len(data))]
    first[inner] = False
    at = np.flatnonzero(first)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    starts = np.concatenate([offsets[filled], at + 1])
    ends = np.concatenate([at, offsets[filled + 1]])
    starts.sort()
    ends.sort()
    return starts, ends, np.searchsorted(offsets, ends, "left") - 1


class Lengths:
    """Token counts of parts, remembered by hash."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor):
        self.model = model
        self.keys = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int32)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys, first, where = np.unique(arrays.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        counts = np.ones(len(keys), np.int32)
        if len(self.keys):
            counts[known] = self.counts[at[known]]
        fresh = np.flatnonzero(~known)
        raw = data.tobytes()
        texts = [raw[s:e].decode() for s, e in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist())]
        # a part without characters is the single space that ends a text: one token
        counts[fresh] = [len(ids) or 1 for ids in self.model.encode(texts, num_threads=1)] if texts else []
        if len(self.keys) > REMEMBERED:
            self.keys, self.counts = keys, counts
        else:
            merged = np.concatenate([self.keys, keys[fresh]])
            order = np.argsort(merged)
            self.keys, self.counts = merged[order], np.concatenate([self.counts, counts[fresh]])[order]
        return counts[where]


def counter(key: str, text: str, model: bytes, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(sentencepiece.SentencePieceProcessor(model_proto=model))
        for batch in arrays.slices(batches, text):
            column = pc.fill_null(batch.column(text), "")
            data, offsets = arrays.text_bytes(pc.replace_substring(column, SPACE, " "))
            starts, ends, owner = parts(data, offsets)
            tokens = np.bincount(owner, weights=lengths.of(data, starts, ends), minlength=batch.num_rows).astype(np.int64)
            sizes = pc.binary_length(column).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), sizes, pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """Key, bytes, tokens and whether the tokens exceed the limit, for each row."""
    with open(model_path or default_model(), "rb") as file:
        model = file.read()
    check_split(sentencepiece.SentencePieceProcessor(model_proto=model))
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        counter("doc_id", "text", model, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean",
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
