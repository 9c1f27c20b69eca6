"""Bloom filters over 128-bit keys (h1, h2): bits are set in tasks and combined by a grouped bitwise or."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest filter that is sent to tasks.
MAX_BYTES = 64 << 20


def positions(h1: np.ndarray, h2: np.ndarray, number: int, size: int, hashes: int) -> np.ndarray:
    """Bit positions of each key, one column for each hash function; filters of other numbers are independent."""
    step = (np.arange(hashes, dtype=np.uint64) + np.uint64(number * 64 + 1))[None, :]
    mixed = h1.view(np.uint64)[:, None] + step * (h2.view(np.uint64)[:, None] | np.uint64(1))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed % np.uint64(size)


def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("h1").to_numpy(), batch.column("h2").to_numpy()


def bit_maker(number: int, size: int, hashes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = positions(*columns(batch), number, size, hashes).ravel()
            words, where = np.unique(at >> np.uint64(6), return_inverse=True)
            masks = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(masks, where, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(masks.view(np.int64))], ["word", "mask"])

    return run


class Filter:
    def __init__(self, number: int, words: np.ndarray, size: int, hashes: int):
        self.number, self.words, self.size, self.hashes = number, words, size, hashes

    def hit(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = positions(h1, h2, self.number, self.size, self.hashes)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def keeper(held: Filter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys (h1, h2) that the filter takes in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.hit(*columns(batch))))

    return run


def bits_for(keys: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions for so many keys at this rate of mistakes."""
    return max(64, math.ceil(-keys * math.log(rate) / math.log(2) ** 2)), max(1, round(-math.log2(rate)))


def build(keys: DataFrame, number: int, size: int, hashes: int) -> Filter:
    """The filter of the keys (h1, h2); its size is the caller's bound."""
    bits = keys.select("h1", "h2").mapInArrow(bit_maker(number, size, hashes), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(size // 64 + 1, np.uint64)
    words[bits["word"].to_numpy()] = bits["mask"].to_numpy().view(np.uint64)
    return Filter(number, words, size, hashes)
