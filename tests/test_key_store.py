"""The store of keys against a plain set: many batches, retries, few files, and parts that lookups leave out."""

import random

import pytest

from docsieve.sources.keys import KeyStore

SHAPE = "tenant_id string, sha256 string"


def keys(spark, rows):
    return spark.createDataFrame(rows, SHAPE).coalesce(1)


def draw(rng, n):
    return [(f"t{rng.randrange(2)}", f"{rng.randrange(400):064x}"[::-1]) for _ in range(n)]


def batch(store, spark, rows, number):
    """One micro-batch as the stream runs it; the keys that were new to it."""
    store.tidy(number)
    fresh = store.unknown(keys(spark, list(dict.fromkeys(rows))), number).persist()
    found = {tuple(r) for r in fresh.collect()}
    store.add(fresh, number)
    fresh.unpersist()
    return found


def test_many_batches_leave_few_files_and_no_key_twice(spark, tmp_path):
    rng, seen, store = random.Random(3), set(), KeyStore(spark, str(tmp_path / "keys"), fan=3)
    for number in range(13):
        rows = draw(rng, 12) if number != 4 else []
        fresh = batch(store, spark, rows, number)
        assert fresh == set(rows) - seen
        seen |= set(rows)
        if number in (7, 11):
            # the same batch again, as after a crash before the stream's own commit
            assert batch(store, spark, rows, number) == fresh
    live = store.segments(13)
    assert sum(s["keys"] for s in live) == len(seen) and len(live) <= 2 * 3
    store.tidy(13)
    files = [p for p in (tmp_path / "keys").rglob("*.parquet")]
    assert len(files) == 2 * len(live)
    stored = store._data([s["name"] for s in live])
    assert {(r.tenant_id, r.sha256) for r in stored.collect()} == seen and stored.count() == len(seen)


def test_lookups_read_only_parts_that_may_hold_a_key(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "keys"))
    held = [("t", f"{i % 256:02x}{i:062x}") for i in range(4000)]
    store.add(keys(spark, held), 0)
    strangers = [("t", f"{i % 256:02x}{i + 10_000:062x}") for i in range(4000)]
    assert store.candidates(keys(spark, strangers), 1).count() < 40
    assert store.candidates(keys(spark, held), 1).count() == 4000
    one = store.unknown(keys(spark, [held[5], ("u", held[5][1]), strangers[0]]), 1)
    assert {tuple(r) for r in one.collect()} == {("u", held[5][1]), strangers[0]}


def test_an_older_batch_is_refused(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "keys"))
    for number in (0, 1):
        batch(store, spark, [("t", f"{number:064x}")], number)
    with pytest.raises(ValueError, match="folder of its own"):
        store.tidy(0)
