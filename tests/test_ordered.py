"""Ordered operators: heavy keys are split, results equal a plain fold whatever the partitioning."""

import random

import pytest
from pyspark.sql import functions as F

from docsieve.operators import admission, drift, windows
from docsieve.plans import queries_drift as Q


def skewed(spark, n=600, parts=7):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}", i, rng.randrange(-5, 20), rng.random() < 0.6) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, i int, v int, f boolean").repartition(parts), sorted(rows, key=lambda r: (r[0], r[1]))


def test_running_equals_a_fold(spark):
    df, rows = skewed(spark)
    got = windows.running(df, ["k"], ["i"], sums={"s": F.col("v")}, maxima={"m": F.col("v")}, index="n", parts=5)
    want, state = {}, {}
    for k, i, v, _ in rows:
        s, m, n = state.get(k, (0, -99, 0))
        state[k] = (s + v, max(m, v), n + 1)
        want[(k, i)] = state[k]
    assert {(r.k, r.i): (r.s, r.m, r.n) for r in got.collect()} == want


def test_chunks_split_a_heavy_key(spark):
    df, _ = skewed(spark)
    chunks = windows.chunked(df, ["k"], ["i"], 5).where("k = 'hot'")
    assert chunks.select("_chunk").distinct().count() >= 3


def test_runs_equal_a_fold(spark):
    df, rows = skewed(spark)
    got = {(r.k, r.i): r.run for r in windows.runs(df, ["k"], ["i"], "f", "run", parts=6).collect()}
    want, length = {}, {}
    for k, i, _, f in rows:
        length[k] = length.get(k, 0) + 1 if f else 0
        want[(k, i)] = length[k]
    assert got == want


def test_long_runs_cross_chunks(spark):
    df = spark.range(500).select(F.lit("a").alias("k"), F.col("id").alias("i"), (F.col("id") != 3).alias("f"))
    assert windows.runs(df, ["k"], ["i"], "f", "run", parts=8).agg(F.max("run")).first()[0] == 496


def test_trailing_sums(spark):
    df, rows = skewed(spark)
    run = windows.running(df, ["k"], ["i"], sums={"s": F.col("v")}, index="n")
    got = {(r.k, r.i): r.t for r in windows.trailing_sums(run, ["k"], "n", {"t": "s"}, 10).collect()}
    want, seen = {}, {}
    for k, i, v, _ in rows:
        seen.setdefault(k, []).append(v)
        if len(seen[k]) >= 10:
            want[(k, i)] = sum(seen[k][-10:])
    assert got == want


def test_top_per_key_is_cut_before_the_shuffle(spark):
    df, _ = skewed(spark)
    top = windows.top_per_key(df, ["k"], [F.col("i")], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 3


@pytest.mark.parametrize("segment", [200_000, 37])
def test_budget_replay_equals_a_fold(spark, sf, segment):
    log, budgets = Q.budget_log(spark, sf), Q.budgets(spark, sf)
    cap = {r.tenant_id: int(r.budget_usd * 1_000_000) for r in budgets.collect()}
    state, want = {}, {}
    for r in sorted(log.collect(), key=lambda r: r.seq):
        spent, open_, waiting = state.get(r.tenant_id, (0, 0, frozenset()))
        reserved, actual, ok = int(r.reserved * 1_000_000), int(r.actual * 1_000_000), None
        if r.kind == "reserve":
            ok = spent + reserved <= cap[r.tenant_id]
            if ok:
                spent, open_, waiting = spent + reserved, open_ + 1, waiting | {r.reserve_seq}
        elif r.reserve_seq in waiting:
            spent = max(spent + (actual if r.kind == "settle" else 0) - reserved, 0)
            open_, waiting = max(open_ - 1, 0), waiting - {r.reserve_seq}
        state[r.tenant_id] = (spent, open_, waiting)
        want[(r.tenant_id, r.seq)] = (ok, round(spent / 1e6, 6), open_)
    out = admission.budget_replay(log.repartition(5), budgets, segment)
    got = {(r.tenant_id, r.seq): (r.granted, round(r.spent_usd, 6), r.unsettled) for r in out.collect()}
    assert got == want
    assert {True, False} <= {g for g, _, _ in got.values()}


def test_budget_replay_without_refusals_without_budget_and_with_repeated_closings(spark):
    rows = [
        ("a", 1, "reserve", 1, 2.0, 1.0), ("a", 2, "settle", 1, 2.0, 1.0), ("a", 3, "settle", 1, 2.0, 1.0), ("a", 4, "release", 9, 5.0, 0.0),
        ("b", 1, "reserve", 1, 2.0, 1.0), ("b", 2, "settle", 1, 2.0, 1.0),
    ]
    log = spark.createDataFrame(rows, "tenant_id string, seq long, kind string, reserve_seq long, reserved double, actual double")
    log = log.withColumns({c: F.col(c).cast("decimal(12,6)") for c in ("reserved", "actual")})
    budgets = spark.createDataFrame([("a", 10.0)], "tenant_id string, budget_usd double")
    one = admission.budget_replay(log.where("tenant_id = 'a'"), budgets).orderBy("seq").collect()
    assert [(r.granted, r.spent_usd, r.unsettled) for r in one] == [(True, 2.0, 1), (None, 1.0, 0), (None, 1.0, 0), (None, 1.0, 0)]
    both = {(r.tenant_id, r.seq): (r.granted, r.spent_usd, r.unsettled) for r in admission.budget_replay(log, budgets).collect()}
    assert both["b", 1] == (False, 0.0, 0) and both["b", 2] == (None, 0.0, 0) and len(both) == 6


@pytest.mark.parametrize("segment", [200_000, 11])
def test_token_bucket_equals_a_fold(spark, sf, segment):
    requests = Q.bucket_requests(spark, sf)
    rate, burst = 0.002, 3.0
    refill, state, want = rate / 60, {}, {}
    for r in sorted(requests.collect(), key=lambda r: (r.at, r.seq)):
        tokens, touched = state.get(r.tenant_id, (burst, r.at))
        have = min(tokens + (r.at - touched) * refill, burst)
        ok = have >= 1
        state[r.tenant_id] = (have - 1, r.at) if ok else (tokens, touched)
        want[r.seq] = (ok, round(have - 1 if ok else have, 6), 0.0 if ok else round((1 - have) / refill, 2))
    out = admission.token_bucket(requests.repartition(3), rate, burst, segment)
    got = {r.seq: (r.allowed, round(r.tokens_left, 6), r.retry_after) for r in out.collect()}
    assert {s: v[:2] for s, v in got.items()} == {s: v[:2] for s, v in want.items()}
    assert all(abs(got[s][2] - want[s][2]) < 0.02 for s in want)
    assert {True, False} == {v[0] for v in got.values()}


def test_running_distance_equals_incremental_centroid(spark):
    docs = [f"invoice total {i % 3} paid word{i % 5} " + "alpha " * (i % 4) for i in range(12)] + ["", "###"]
    df = spark.createDataFrame([("t", "d", i, i, x) for i, x in enumerate(docs)], "tenant_id string, doc_type string, doc_id int, seq int, text string")
    keys = ["tenant_id", "doc_type"]
    profiles = drift.text_profile(df, "doc_id", keys, 64)
    signals = df.selectExpr("*", "CAST(NULL AS DOUBLE) AS doc_confidence", "CAST(NULL AS BOOLEAN) AS validation_passed")
    models = drift.key_models(signals, keys, "doc_id", "seq", {"profile_dim": 64})
    got = {r.doc_id: r.value for r in drift.distances(models, drift.judged(signals, models, keys, "doc_id", "seq", {"profile_dim": 64}), keys, "doc_id").collect()}
    dense = {i: [0.0] * 64 for i in range(len(docs))}
    for r in profiles.collect():
        dense[r.doc_id][r.bucket] = r.weight
    norm = lambda v: sum(x * x for x in v) ** 0.5
    center, want = None, {}
    for i in range(len(docs)):
        p = dense[i]
        if center is not None:
            n = norm(p) * norm(center)
            want[i] = 0.0 if not n else max(0.0, 1 - sum(a * b for a, b in zip(p, center)) / n)
        center = p if center is None else [c + (x - c) / (i + 1) for c, x in zip(center, p)]
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_later_documents_against_a_frozen_model(spark):
    """A hot key and a small one, ties in the order, missing signals, texts without tokens; no shuffle of texts."""
    keys, cfg = ["tenant_id", "doc_type"], {"profile_dim": 32, "baseline_n": 4}
    rows = [("hot", "d", i, i // 2, None if i % 7 == 3 else f"alpha word{i % 5} " * (i % 3), None if i % 5 == 0 else 0.9 - i / 100, None if i % 4 == 0 else i % 3 > 0) for i in range(40)]
    rows += [("one", "d", 100, 0, "beta", 0.5, True), ("two", "d", 101, 0, "beta", 0.5, True), ("two", "d", 102, 1, "", None, None)]
    stream = spark.createDataFrame(rows, "tenant_id string, doc_type string, doc_id int, seq int, text string, doc_confidence double, validation_passed boolean").repartition(6)
    models = drift.key_models(stream, keys, "doc_id", "seq", cfg)
    late = drift.judged(stream, models, keys, "doc_id", "seq", cfg)
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 0
    got = {r.doc_id: r.text_distance for r in late.collect()}
    assert set(got) == set(range(4, 40))
    dense = {}
    for r in drift.text_profile(stream, "doc_id", (), 32).collect():
        dense.setdefault(r.doc_id, [0.0] * 32)[r.bucket] = r.weight
    zero = [0.0] * 32
    center = [sum(dense.get(i, zero)[b] for i in range(4)) / 4 for b in range(32)]
    size = sum(c * c for c in center) ** 0.5
    for i, value in got.items():
        dot = sum(a * b for a, b in zip(dense.get(i, zero), center))
        assert abs(value - (1 - dot / size if i in dense else 0.0)) < 1e-9
    stats = {(r.tenant_id, r.signal): (r.n, r.mean) for r in drift.baseline_stats(models, keys).collect()}
    assert stats["hot", "validation_failure"] == (3, 1 / 3) and stats["hot", "doc_confidence"][0] == 3 and stats["hot", "text_distance"][0] == 3
    assert ("one", "text_distance") not in stats and stats["two", "doc_confidence"] == (1, 0.5)
