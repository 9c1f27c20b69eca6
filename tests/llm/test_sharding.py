"""Shards and slots against a plain jump hash."""

import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from docsieve.llm import sharding


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_equal_the_published_loop(docs):
    rows = sharding.shard(docs).collect()
    assert all(r.shard == jump(r.doc_id, 16) and r.grown_shard == jump(r.doc_id, 17) for r in rows)
    assert {r.grown_shard for r in rows if r.grown_shard != r.shard} <= {16}
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_odd_rows(odd, odd_rows, none):
    rows = sharding.shard(odd).collect()
    assert sharding.shard(none).count() == 0
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in odd_rows
    )
    assert all(r.shard == jump(r.doc_id or 0, 16) for r in rows)


def test_no_python_in_the_plan(docs):
    plan = sharding.shard(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("shards", [1, 47, 48, 49, 10_000])
def test_few_jumps_suffice_and_the_rest_is_finished(spark, shards, monkeypatch):
    rng = random.Random(shards)
    keys = [rng.getrandbits(63) - 2**62 for _ in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    want = [jump(k, shards) for k in keys]
    assert [r.s for r in df.select(sharding.jump_hash(F.col("k"), shards).alias("s")).collect()] == want
    monkeypatch.setattr(sharding, "STEPS", 3)
    few = df.limit(20) if shards > 1000 else df
    assert [r.s for r in few.select(sharding.jump_hash(F.col("k"), shards).alias("s")).collect()] == want[: few.count()]


def test_strings_count_by_their_hash_and_other_types_are_refused(spark):
    ids = ["doc-1", "doc-2", "", "5", None]
    df = spark.createDataFrame([(i, "t") for i in ids], "doc_id string, text string")
    signed = lambda i: 0 if i is None else xxhash.xxh64(i.encode(), seed=42).intdigest()
    got = {r.doc_id: r.shard for r in sharding.shard(df).collect()}
    assert got == {i: jump(signed(i), 16) for i in ids}
    with pytest.raises(TypeError, match="whole numbers"):
        sharding.shard(df.select(F.lit(1.5).alias("doc_id"), "text"))
