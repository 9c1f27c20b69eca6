"""Streams against their batch twins."""

import math

from pyspark.sql import functions as F

from docsieve.plans import queries_drift as Q
from docsieve.plans import views
from docsieve.streaming import admission as stream_admission
from docsieve.streaming import documents as D
from docsieve.streaming import drift as stream_drift


def as_stream(spark, df, tmp_path, name, order, files=3):
    """Write a DataFrame as a few files in order and read them back one per micro-batch."""
    path = str(tmp_path / name)
    rows = df.toPandas().sort_values(order)
    size = math.ceil(len(rows) / files)
    for i in range(files):
        part = spark.createDataFrame(rows.iloc[i * size : (i + 1) * size], df.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_to_table(spark, df, tmp_path, name):
    out = str(tmp_path / f"{name}_out")
    query = (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}_cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.read.parquet(out)


def test_drift_stream_equals_batch(spark, sf, tmp_path):
    docs = Q.stream(spark, "/root/testdata/sf0.01").where(F.col("tenant_id") == "es").drop("n")
    plan_input = docs.cache()
    seen = run_to_table(spark, stream_drift.observe(as_stream(spark, plan_input, tmp_path, "drift", "seq")), tmp_path, "drift").toPandas()
    from docsieve.operators.drift import DriftPlan

    batch = DriftPlan(plan_input, Q.KEYS)
    z = {(r.doc_id, r.signal): r.z for r in batch.scored.collect()}
    got = {}
    for r in seen.itertuples():
        for s in ("doc_confidence", "validation_failure", "text_distance"):
            v = getattr(r, f"z_{s}")
            if v is not None and not math.isnan(v):
                got[(r.doc_id, s)] = v
    assert set(got) == set(z) and z
    assert all(abs(got[k] - z[k]) < 1e-6 for k in z)
    flags = batch.flags().collect()[0]
    new = seen[seen.newly_flagged]
    assert (flags.status == "drifting") == (len(new) == 1)
    if len(new):
        assert int(new.doc_id.iloc[0]) == flags.flagged_document
    assert set(seen.sort_values("n_observed").status.tail(1)) == {flags.status}


def test_a_heavy_key_comes_in_bounded_micro_batches_and_leaves_its_state(spark, tmp_path):
    """Order and bounds of the replay; the stored state equals the batch plan's last one."""
    from docsieve.operators.drift import DriftPlan
    from docsieve.plans import queries_streams as S

    docs = Q.stream(spark, "/root/testdata/sf0.01").where("tenant_id IN ('en', 'es')").cache()
    stream = S.replay_in_order(spark, docs, "ordered", "seq", rows=150)
    out, checkpoint = str(tmp_path / "seen"), str(tmp_path / "cp")
    query = stream_drift.observe(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(240)
    sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(sizes) > 3 and max(sizes) < 400 and sum(sizes) == docs.count()
    seen = spark.read.schema(stream_drift.OUTPUT).parquet(out)
    ranks = seen.join(docs.select("doc_id", "seq"), "doc_id").orderBy("tenant_id", "seq").select("tenant_id", "n_observed").collect()
    assert all(b.n_observed == a.n_observed + 1 for a, b in zip(ranks, ranks[1:]) if a.tenant_id == b.tenant_id)
    batch = DriftPlan(docs, Q.KEYS)
    want = {(r.tenant_id, r.signal): (round(r.baseline_mean, 5), r.baseline_n, r.last_z and round(r.last_z, 2), r.consecutive) for r in batch.status().collect()}
    stored = stream_drift.stored_keys(spark, checkpoint)
    got = {(r.tenant_id, s): (round(v.baseline_mean, 5), v.baseline_n, v.last_z and round(v.last_z, 2), v.consecutive) for r in stored.collect() for s, v in r.signals.items()}
    assert got == want
    assert {(r.tenant_id, r.status, r.first_flagged) for r in stored.collect()} == {(r.tenant_id, r.status, r.flagged_document) for r in batch.flags().collect()}


def test_a_changed_profile_width_drops_the_distance(spark, sf, tmp_path):
    """A stored mean profile of another width is not compared and, in the baseline, started anew."""
    rows = [("t", "d", i, i, f"word{i % 3} total", 0.9, True) for i in range(12)]
    docs = spark.createDataFrame(rows, "tenant_id string, doc_type string, doc_id long, seq long, text string, doc_confidence double, validation_passed boolean")
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part, dim in ((docs.where("seq < 6"), 64), (docs.where("seq >= 6"), 32)):
        part.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(docs.schema).parquet(path)
        seen = stream_drift.observe(stream, {"baseline_n": 4, "profile_dim": dim})
        seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(240)
    got = {r.doc_id: r for r in spark.read.schema(stream_drift.OUTPUT).parquet(out).collect()}
    assert len(got) == 12 and [got[i].n_observed for i in range(12)] == list(range(1, 13))
    known = lambda v: v is not None and not math.isnan(v)
    assert all(known(got[i].z_text_distance) == (4 <= i < 6) and known(got[i].z_doc_confidence) == (i >= 4) for i in range(12))


def test_budget_stream_equals_batch(spark, sf, tmp_path):
    log = Q.budget_log(spark, sf).drop("event_id")
    budgets = Q.budgets(spark, sf)
    from docsieve.operators.admission import budget_replay

    want = {(r.tenant_id, r.seq): (r.granted, round(r.spent_usd, 6), r.unsettled) for r in budget_replay(log, budgets).collect()}
    micro = lambda c: (F.col(c) * 1000000).cast("bigint").alias(c)
    ready = log.join(budgets, "tenant_id").select("tenant_id", "seq", "kind", "reserve_seq", micro("reserved"), micro("actual"), micro("budget_usd"))
    seen = run_to_table(spark, stream_admission.budget_stream(as_stream(spark, ready, tmp_path, "budget", "seq")), tmp_path, "budget")
    got = {(r.tenant_id, r.seq): (r.granted, round(r.spent_usd, 6), r.unsettled) for r in seen.collect()}
    assert got == want


def test_token_bucket_stream_equals_batch(spark, sf, tmp_path):
    requests = Q.bucket_requests(spark, sf)
    from docsieve.operators.admission import token_bucket

    want = {(r.tenant_id, r.seq): (r.allowed, round(r.tokens_left, 6)) for r in token_bucket(requests, 0.002, 3.0).collect()}
    seen = run_to_table(spark, stream_admission.token_bucket_stream(as_stream(spark, requests, tmp_path, "bucket", "seq"), 0.002, 3.0), tmp_path, "bucket")
    got = {(r.tenant_id, r.seq): (r.allowed, round(r.tokens_left, 6)) for r in seen.collect()}
    assert got == want
    assert {a for a, _ in got.values()} == {True, False}


def test_ingest_stream_stores_each_document_once(spark, sf, tmp_path):
    docs = views.table(spark, sf, "documents")
    objects = docs.select(
        F.concat(F.lit("t"), (F.col("doc_id") % 2).cast("string"), F.lit("/dropbox/invoice/f"), F.col("doc_id").cast("string")).alias("key"),
        F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("%PDF-"), "text")).cast("binary").alias("content"),
        (F.lit(views.EPOCH).cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id"))).alias("received_at"),
    )
    doubled = objects.unionByName(objects.withColumn("received_at", F.col("received_at") + F.make_dt_interval(mins=F.lit(5))))
    stream = as_stream(spark, doubled, tmp_path, "objects", "received_at", files=2)
    root = str(tmp_path / "store")
    query = D.ingest_stream(stream, root, str(tmp_path / "cp"), ("invoice",))
    query.awaitTermination(240)
    stored = spark.read.parquet(f"{root}/documents")
    want = objects.select(F.split("key", "/")[0], F.sha2("content", 256)).distinct().count()
    assert stored.count() == want
    assert {r.status for r in stored.select("status").distinct().collect()} == {"received", "failed"}


def test_new_documents_that_arrive_late_are_stored(spark, tmp_path):
    rows = [(f"t/dropbox/invoice/f{i}", f"%PDF-{i // 2}".encode(), i) for i in range(12)]
    late = spark.createDataFrame(rows, "key string, content binary, at int").select(
        "key", "content", (F.lit(views.EPOCH).cast("timestamp") - F.make_dt_interval(hours=F.col("at") * 3)).alias("received_at")
    )
    stream = as_stream(spark, late, tmp_path, "late", "key", files=6)
    root = str(tmp_path / "store")
    D.ingest_stream(stream, root, str(tmp_path / "cp"), ("invoice",)).awaitTermination(240)
    stored = spark.read.parquet(f"{root}/documents")
    assert stored.count() == stored.select("sha256").distinct().count() == 6


def stream_pages(spark, sf):
    pages = views.pages(spark, sf).select(F.col("doc_id"), "tenant_id", "text", F.lit("parsed").alias("status")).orderBy("doc_id").limit(400)
    scans = pages.limit(3).select((-F.col("doc_id") - 1).alias("doc_id"), "tenant_id", F.lit("scan").alias("text"), "status")
    return pages.unionByName(pages.limit(5).withColumn("status", F.lit("approved"))).unionByName(scans).cache()


def test_document_stream_equals_batch(spark, sf, tmp_path):
    pages, desk, root = stream_pages(spark, sf), D.Desk.of("invoice"), str(tmp_path / "store")
    D.document_stream(as_stream(spark, pages, tmp_path, "pages", "doc_id"), root, str(tmp_path / "cp"), desk).awaitTermination(240)
    twin = desk.final_answers(desk.first_answers(pages).cache()).cache()
    want = {(r.doc_id, r.decision, round(r.doc_confidence, 6)) for r in twin.where("status <> 'needs_ocr'").collect()}
    assert len(want) == 400
    stored = D.read_committed(spark, root, "extractions")
    assert {(r.doc_id, r.decision, round(r.doc_confidence, 6)) for r in stored.collect()} == want
    cells = D.read_committed(spark, root, "extraction_fields")
    assert cells.where("name = 'vendor'").count() == len(want)
    assert cells.where("name LIKE 'line_items.%' AND confidence IS NULL").count() == 0
    states = D.read_committed(spark, root, "document_states")
    assert states.where("status = 'needs_ocr'").count() == 3 and states.count() == 403
    used = D.read_committed(spark, root, "usage_events")
    rows = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert rows(used) == rows(D.usage_events(twin, "invoice"))
    assert used.select("event_id").distinct().count() == used.count()
    asked = stored.where("trigger IS NOT NULL").count()
    assert 0 < asked < 400 and used.where("purpose = 'escalation'").count() == asked
    assert stored.where("trigger IS NOT NULL AND (calls <> 2 OR model NOT LIKE '%extractor-v1')").count() == 0


def test_a_cell_takes_its_confidence_from_a_map_of_its_page(spark):
    """One look-up per cell, and no search by a lambda; a field without a score has none."""
    kinds = "doc_id long, tenant_id string, status string, cells array<struct<name: string, value: string>>, scores array<struct<field: string, confidence: double>>"
    rows = [(1, "t", "approved", [("a", "x"), ("b.0.c", None), ("z", "y")], [("a", 0.5), ("b", None)]), (2, "t", "approved", None, None), (3, "t", "needs_ocr", [("a", "x")], [("a", 1.0)])]
    rest = ["decision", "doc_confidence", "flagged_fields", "validation_passed", "calibration", "output", "trigger", "text"]
    calls = F.expr("cast(array() as array<struct<purpose: string, tier: string, model: string, input_tokens: bigint, output_tokens: bigint>>)")
    answers = spark.createDataFrame(rows, kinds).select("*", *[F.lit(None).cast("string").alias(c) for c in rest], calls.alias("calls"))
    cells = D.stored_tables(answers, "invoice")["extraction_fields"]
    got = {tuple(r) for r in cells.select("doc_id", "name", "value", "confidence").collect()}
    assert got == {(1, "a", "x", 0.5), (1, "b.0.c", None, None), (1, "z", "y", None), (2, None, None, None)}
    assert cells.columns == ["doc_id", "tenant_id", "name", "value", "confidence"]
    assert "lambda" not in cells._jdf.queryExecution().optimizedPlan().toString()


def test_the_stronger_tier_reads_only_what_the_first_one_doubts(spark, sf):
    """Where the small tier loses a letter without doubt its answer stays; the strong one's own answer counts elsewhere."""
    desk = D.Desk.of("invoice")
    first = desk.first_answers(stream_pages(spark, sf)).cache()
    final = desk.final_answers(first)
    before = {r.doc_id: r.output for r in first.where("trigger IS NULL").collect()}
    after = {r.doc_id: r for r in final.collect()}
    assert all(after[d].output == out and len(after[d].calls) <= 1 for d, out in before.items())
    strong = D.process(stream_pages(spark, sf), desk.definition, desk.hints, desk.tiers["frontier"], desk.model)
    alone = {r.doc_id: r.decision for r in strong.select("doc_id", "decision").collect()}
    again = [d for d in after if d not in before]
    assert again and all(after[d].decision == alone[d] for d in again)


def test_a_run_killed_between_sinks_leaves_nothing_visible(spark, sf, tmp_path, monkeypatch):
    pages, desk = stream_pages(spark, sf), D.Desk.of("invoice")
    root, checkpoint = str(tmp_path / "store"), str(tmp_path / "cp")
    stream = as_stream(spark, pages, tmp_path, "pages", "doc_id", files=2)
    kept, done = D.commit_batch, []

    def dies(tables, folder, name, batch):
        if batch == 1:
            half = dict(list(tables.items())[:2])
            for sink, df in half.items():
                df.write.mode("overwrite").partitionBy("tenant_id").parquet(f"{folder}/{sink}/stream={name}/batch={batch}")
            raise RuntimeError("executor and driver lost")
        kept(tables, folder, name, batch)
        done.append(batch)

    monkeypatch.setattr(D, "commit_batch", dies)
    try:
        D.document_stream(stream, root, checkpoint, desk).awaitTermination(240)
    except Exception as stopped:  # noqa: BLE001 - the stream's own exception type differs by version
        assert "lost" in str(stopped)
    assert done == [0]
    counts = lambda: [D.read_committed(spark, root, s).select("doc_id").distinct().count() for s in ("extractions", "extraction_fields", "document_states")]
    first = counts()
    assert first[0] == first[1] and first[2] < 403
    monkeypatch.setattr(D, "commit_batch", kept)
    D.document_stream(stream, root, checkpoint, desk).awaitTermination(240)
    assert counts() == [400, 400, 403]


def test_a_committed_batch_is_not_written_again_and_streams_do_not_mix(spark, tmp_path):
    root = str(tmp_path)
    table = lambda v: {"document_states": spark.createDataFrame([(1, "t", v)], "doc_id int, tenant_id string, status string")}
    D.commit_batch(table("a"), root, "one", 0)
    D.commit_batch(table("b"), root, "one", 0)
    D.commit_batch(table("c"), root, "two", 0)
    assert sorted(r.status for r in D.read_committed(spark, root, "document_states").collect()) == ["a", "c"]


def test_nothing_committed_is_an_error_of_its_own(spark, tmp_path):
    try:
        D.read_committed(spark, str(tmp_path), "extractions")
    except LookupError as missing:
        assert "committed" in str(missing)
    else:
        raise AssertionError("a table without a commit was read")


def test_a_stream_of_profiles_equals_a_stream_of_texts(spark, tmp_path):
    """Profiles made before the replay stand for the texts, and the replay of a query holds no text."""
    from docsieve.operators import drift
    from docsieve.plans import queries_streams as S

    docs = Q.stream(spark, "/root/testdata/sf0.001").where("tenant_id = 'en'").drop("n").cache()
    texts = run_to_table(spark, stream_drift.observe(as_stream(spark, docs, tmp_path, "texts", "seq")), tmp_path, "texts")
    profiles = S.replay_in_order(spark, drift.profiled(docs), "profiles", "seq")
    assert "text" not in profiles.columns
    seen = run_to_table(spark, stream_drift.observe(profiles), tmp_path, "profiles")
    assert sorted(map(str, texts.collect())) == sorted(map(str, seen.collect())) and seen.count() == docs.count()
