"""Streaming operators driven over whole tables until all input is read (M7, N3, N4, P6) and F2."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.definition import load_definition
from docsieve.operators import drift, evaluate, metering, tenancy, triage
from docsieve.plans import oracle_views as O
from docsieve.plans import queries_drift as Q
from docsieve.plans import views
from docsieve.plans.catalog import query
from docsieve.plans.queries_study import _READ
from docsieve.plans.queries_tables import _EXTR, _SQL_FLYING, DBL, _budget, _extractions, _priced
from docsieve.session import cut, scratch_table
from docsieve.streaming import documents as D
from docsieve.streaming import drift as stream_drift


def replay(spark, df, name):
    """A stored table read back as a stream."""
    path = scratch_table(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


#: Rows of a micro-batch of a replay in order; they are narrow.
ORDERED_ROWS = 100_000


def replay_in_order(spark, df, name, order, rows=None):
    """A stored table read back as a stream in the given order, one file of about `rows` rows per micro-batch.

    Files are taken in the order of their times, so the ranges are written one after another, each
    row twice in all.
    """
    rows = rows or ORDERED_ROWS
    ranges, ranged, path = max(1, -(-df.count() // rows)), scratch_table(spark, name), scratch_table(spark, name)
    df.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(ranged)
    whole = spark.read.schema(f"{df.schema.simpleString()[7:-1].replace(':', ' ')}, _range int").parquet(ranged)
    for i in range(ranges):
        whole.where(F.col("_range") == i).drop("_range").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, df, name):
    """Run an append stream until its input is used up: what it wrote, and its checkpoint."""
    out, checkpoint = scratch_table(spark, name), scratch_table(spark, name)
    writer = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out), checkpoint


def observed(spark, stream):
    """The drift observations of a whole table taken as a stream, and the checkpoint that holds its state.

    Texts are read once, by all tasks, before the stream is put in order: a micro-batch is one file, which one task would have to read.
    """
    path = scratch_table(spark, "profiles")
    drift.profiled(stream).write.parquet(path)
    return drain(spark, stream_drift.observe(replay_in_order(spark, spark.read.parquet(path), "drift", "seq")), "observed")


_LONG = " UNION ALL ".join(f"SELECT doc_id, '{s}' AS signal, round(z, 4) + 0.0 AS z FROM runs WHERE signal = '{s}'" for s in drift.DIRECTION)


@query(f"WITH {Q._SIGNALS} {_LONG}")
def observe(spark, sf):
    """M7 over all documents as a stream; its z-scores equal the batch twin's."""
    seen, _ = observed(spark, Q.stream(spark, sf))
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"z_{s}").alias("z")) for s in drift.DIRECTION])
    long = seen.select("doc_id", F.inline_outer(pairs)).where(F.col("z").isNotNull() & ~F.isnan("z"))
    return long.withColumn("z", F.round("z", 4) + F.lit(0.0))


@query(f"WITH {Q._SIGNALS}, f AS (SELECT tenant_id, min(doc_id) AS first_flagged FROM runs WHERE consecutive >= 3 GROUP BY 1) SELECT s.tenant_id, count(*) AS n_observed, CASE WHEN max(first_flagged) IS NOT NULL THEN 'drifting' WHEN count(*) < 50 THEN 'baseline' ELSE 'stable' END AS status, max(first_flagged) AS first_flagged FROM stream s LEFT JOIN f ON s.tenant_id = f.tenant_id GROUP BY 1")
def observe_status(spark, sf):
    """M7 / M8: the last state of each stream, read from the state store, and the document that raised the flag."""
    _, checkpoint = observed(spark, Q.stream(spark, sf))
    return stream_drift.stored_keys(spark, checkpoint).select("tenant_id", "n_observed", "status", "first_flagged")


@query("SELECT 't' || (doc_id % 3) AS tenant_id, sha256(CASE WHEN doc_id % 2 = 0 THEN '%PDF-' || text ELSE text END) AS sha256, CASE WHEN max(doc_id % 2) = 0 THEN 'received' ELSE 'failed' END AS status FROM documents GROUP BY 1, 2")
def ingest_stream(spark, sf):
    """Every document delivered twice, the older half in later micro-batches; each is stored once per tenant and content."""
    docs = views.table(spark, sf, "documents")
    i = F.col("doc_id")
    body = F.when(i % 2 == 0, F.concat(F.lit("%PDF-"), "text")).otherwise(F.col("text"))
    once = docs.select(
        F.concat(F.lit("t"), (i % 3).cast("string"), F.lit("/dropbox/invoice/f"), i.cast("string")).alias("key"),
        body.cast("binary").alias("content"),
        F.timestamp_seconds(F.lit(1704067200) + i).alias("received_at"),
    )
    root = scratch_table(spark, "intake")
    path, middle = scratch_table(spark, "objects"), F.percentile_approx("received_at", 0.5)
    split = once.join(F.broadcast(once.agg(middle.alias("_middle"))))
    for late in (F.col("received_at") > F.col("_middle"), F.col("received_at") <= F.col("_middle"), F.lit(True)):
        split.where(late).select(*once.columns).write.mode("append").parquet(path)
    stream = spark.readStream.schema(once.schema).option("maxFilesPerTrigger", 4).parquet(path)
    D.ingest_stream(stream, root, scratch_table(spark, "intake"), ("invoice",)).awaitTermination()
    return spark.read.parquet(f"{root}/documents").select("tenant_id", "sha256", "status")


def _processed(spark, sf):
    """All invoice pages through the document stream: the folder of its tables."""
    pages = views.pages(spark, sf).withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.lit("scan")).otherwise(F.col("text")))
    stored = pages.select("doc_id", "tenant_id", "text", F.lit("parsed").alias("status"))
    root = scratch_table(spark, "processed")
    D.document_stream(replay(spark, stored, "pages"), root, scratch_table(spark, "processed"), D.Desk.of("invoice")).awaitTermination()
    return root


@query(f"WITH {_READ} SELECT doc_id, CASE WHEN needs_ocr THEN 'needs_ocr' WHEN n = 0 OR quirk THEN 'needs_review' ELSE 'approved' END AS status FROM costed")
def document_stream(spark, sf):
    """All pages through gate, reading by both tiers, scoring and routing as one streaming query with four tables."""
    return D.read_committed(spark, _processed(spark, sf), "document_states").select("doc_id", "status")


_PROMPT = len(metering.system_prompt(load_definition()) + metering.user_prefix(load_definition()))


@query(
    f"""WITH {_READ}, calls AS (SELECT *, unnest(CASE WHEN reason IS NULL THEN ['extraction'] ELSE ['extraction', 'escalation'] END) AS purpose FROM costed WHERE NOT needs_ocr)
    SELECT tenant_id, purpose, CASE purpose WHEN 'extraction' THEN 'mock:mock-extractor-small-v1' ELSE 'mock:mock-extractor-v1' END AS model, count(*) AS calls,
      CAST(sum(CAST(floor((chars + {_PROMPT}) / 4) + 1 AS BIGINT)) AS BIGINT) AS input_tokens FROM calls JOIN (SELECT doc_id, tenant_id FROM clean) USING (doc_id) GROUP BY 1, 2, 3"""
)
def document_stream_usage(spark, sf):
    """N4's metered calls: one of the small tier per digital page, one more of the strong tier per escalated page."""
    used = D.read_committed(spark, _processed(spark, sf), "usage_events")
    return used.groupBy("tenant_id", "purpose", "model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"))


_ARMS = Q._SIGNALS.replace(
    Q._STREAM,
    """
stream AS (
  SELECT doc_id * 2 + arm AS doc_id, CASE arm WHEN 0 THEN 'control' ELSE 'swap' END AS tenant_id, 'prose' AS doc_type,
    CASE WHEN arm = 1 AND swapped THEN 'statement of charges ' || n_chars ELSE text END AS text,
    0.95::DOUBLE AS doc_confidence, NOT (arm = 1 AND swapped) AS passed, row_number() OVER (PARTITION BY arm ORDER BY doc_id) AS pos
  FROM (SELECT *, doc_id >= (SELECT 0.6::DOUBLE * count(*) FROM documents) AS swapped FROM documents), (SELECT unnest([0, 1]) AS arm))""",
)


@query(f"WITH {_ARMS}, f AS (SELECT tenant_id, min(pos) FILTER (WHERE consecutive >= 3) AS detected FROM runs GROUP BY 1), m AS (SELECT tenant_id, min(pos) FILTER (WHERE NOT passed) AS swap_at, count(*) AS documents FROM stream GROUP BY 1) SELECT m.tenant_id AS arm, documents, swap_at - 1 AS swap_at, detected - 1 AS detected_at, CASE WHEN swap_at > 1 AND detected > 1 THEN detected - swap_at + 1 END AS lag FROM m LEFT JOIN f ON m.tenant_id = f.tenant_id")
def drift_experiment(spark, sf):
    """A stream whose layout changes after 60 % of the documents beside an unchanged control arm."""
    docs = views.table(spark, sf, "documents")
    edge = docs.agg((F.lit(0.6) * F.count("*")).alias("edge"))
    arms = docs.join(F.broadcast(edge)).withColumn("arm", F.explode(F.array(F.lit(0), F.lit(1))))
    hit = (F.col("arm") == 1) & (F.col("doc_id") >= F.col("edge"))
    stream = arms.select(
        (F.col("doc_id") * 2 + F.col("arm")).alias("doc_id"),
        F.when(F.col("arm") == 0, "control").otherwise("swap").alias("tenant_id"),
        F.lit("prose").alias("doc_type"),
        F.col("doc_id").alias("seq"),
        F.when(hit, F.concat(F.lit("statement of charges "), F.col("n_chars").cast("string"))).otherwise(F.col("text")).alias("text"),
        F.lit(0.95).alias("doc_confidence"),
        (~hit).alias("validation_passed"),
    )
    plan = drift.DriftPlan(stream, Q.KEYS)
    flagged = plan.runs().where(F.col("consecutive") >= 3).select("doc_id").distinct().withColumn("flagged", F.lit(True))
    slim = plan.stream.select("tenant_id", "doc_id", "seq", "validation_passed").join(flagged, "doc_id", "left")
    rows = slim.select("tenant_id", "doc_id", "seq", "validation_passed", F.coalesce("flagged", F.lit(False)).alias("flagged"))
    steps = cut(evaluate.concat_streams(rows.where("validation_passed"), rows.where("NOT validation_passed"), ["tenant_id"], ["seq"]))
    counts = steps.groupBy("tenant_id").agg(F.count("*").alias("documents"))
    return evaluate.stream_marks(steps, ["tenant_id"]).join(counts, "tenant_id").withColumnRenamed("tenant_id", "arm")


@query(f"WITH {_EXTR} SELECT extraction_id, c_custkey AS document_id FROM extr JOIN customer ON c_custkey = document_id WHERE c_custkey % 2 = 0 AND vendor IS NOT NULL")
def synthetic_extractions(spark, sf):
    """extractions joined to their documents, limited to one storage folder, signals present."""
    key = F.concat(F.lit("t/"), F.when(F.col("c_custkey") % 2 == 0, "synth").otherwise("live"), F.lit("/f"))
    docs = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), key.alias("s3_key"))
    extracted = _extractions(spark, sf).where(F.col("output").isNotNull()).select("extraction_id", "document_id")
    return extracted.join(docs.where(F.col("s3_key").like("%/synth/%")), "document_id").select("extraction_id", "document_id")


_BY_TENANT = Q._SIGNALS.replace("lang AS tenant_id", "'t' || (doc_id % 10) AS tenant_id").replace("PARTITION BY lang ORDER", "PARTITION BY doc_id % 10 ORDER")
_HELD = ", ".join(f"coalesce(last_value({s}.consecutive IGNORE NULLS) OVER (PARTITION BY s.tenant_id ORDER BY s.pos), 0) AS {s}_run" for s in drift.DIRECTION)
_BESIDE = " ".join(f"LEFT JOIN (SELECT * FROM runs WHERE signal = '{s}') {s} ON {s}.doc_id = s.doc_id" for s in drift.DIRECTION)
_RAISED = ", ".join(f"CASE WHEN {s}_run >= 3 THEN '{s}' END" for s in sorted(drift.DIRECTION))


@query(
    f"""WITH {_BY_TENANT}, steps AS (SELECT s.doc_id, s.tenant_id, s.pos, {_HELD} FROM stream s {_BESIDE}),
        raised AS (SELECT *, concat_ws(',', {_RAISED}) AS flagged FROM steps),
        state AS (SELECT tenant_id, count(*) AS observed, arg_max(flagged, pos) FILTER (WHERE flagged <> '') AS flagged, min(doc_id) FILTER (WHERE flagged <> '') AS first_flagged FROM raised GROUP BY 1),
        z AS (SELECT tenant_id, arg_max(z, pos) AS z FROM runs WHERE signal = 'text_distance' GROUP BY 1),
        {O.USAGE}, d AS (SELECT 't' || (doc_id % 10) AS tenant_id, status FROM (WITH {O.DOCS} SELECT * FROM docs)),
        spend AS (SELECT tenant_id, CAST(sum(cost_usd) AS DECIMAL(14,6)) AS spent, CAST(CASE WHEN tenant_id IN ('t1', 't4') THEN 1.0 ELSE 20.0 END AS DECIMAL(14,6)) AS budget,
          round(CAST(sum(cost_usd) FILTER (WHERE slug = 'invoice') AS DOUBLE) / count(DISTINCT document_id) FILTER (WHERE slug = 'invoice'), 6) AS per_invoice FROM priced GROUP BY 1),
        tally AS (SELECT tenant_id, count(*) FILTER (WHERE status IN {_SQL_FLYING}) AS in_flight, count(*) FILTER (WHERE status = 'approved') AS approved FROM d GROUP BY 1)
        SELECT tenant_id, CAST(spent AS DOUBLE) AS spent, CAST(greatest(budget - spent, 0) AS DOUBLE) AS remaining, CASE WHEN spent >= budget THEN 'paused' ELSE 'active' END AS status,
        in_flight, approved, per_invoice, CASE WHEN flagged IS NOT NULL THEN 'drifting' WHEN observed >= 50 THEN 'stable' ELSE 'baseline' END AS drift_status, observed AS drift_observed,
        flagged AS drift_flagged, first_flagged AS drift_first, round(z, 3) + 0.0 AS distance_z
        FROM spend JOIN tally USING (tenant_id) LEFT JOIN state USING (tenant_id) LEFT JOIN z USING (tenant_id)"""
)
def usage_summary(spark, sf):
    """Q3 with the drift state of each tenant's stream, read from the state store of the finished stream."""
    tenant = F.concat(F.lit("t"), (F.col("doc_id") % 10).cast("string"))
    _, checkpoint = observed(spark, Q.stream(spark, sf).withColumn("tenant_id", tenant))
    docs = views.document_rows(spark, sf).withColumn("tenant_id", tenant)
    units = metering.unit_costs(_priced(spark, sf), ("tenant_id",))
    out = tenancy.usage_summary(_budget(spark, sf), docs, units, triage.IN_FLIGHT, stream_drift.stored_keys(spark, checkpoint))
    prose = F.try_element_at("drift", F.lit("prose"))
    return out.select(
        "tenant_id", DBL("spent_usd").alias("spent"), DBL("remaining_usd").alias("remaining"), F.col("tenant_status").alias("status"), "in_flight",
        F.try_element_at("status_counts", F.lit("approved")).alias("approved"), F.try_element_at("cost_per_document", F.lit("invoice")).alias("per_invoice"),
        prose["status"].alias("drift_status"), prose["n_observed"].alias("drift_observed"), prose["flagged_signals"].alias("drift_flagged"), prose["first_flagged"].alias("drift_first"),
        (F.try_element_at(prose["signals"], F.lit("text_distance"))["last_z"] + F.lit(0.0)).alias("distance_z"),
    )
