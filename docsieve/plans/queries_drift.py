"""Queries over drift detection and ordered admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.functions.values import hash_draw
from docsieve.operators import admission, drift, metering
from docsieve.plans import oracle_views as O
from docsieve.plans import views
from docsieve.plans.catalog import query
from docsieve.session import cut

KEYS = ["tenant_id", "doc_type"]


def stream(spark, sf):
    """Documents per language in arrival order; confidence drops late, some signals are missing."""
    i = F.col("doc_id")
    u = hash_draw(views.SEED, "confidence", i.cast("string")) / F.lit(4294967296.0)
    late = F.col("doc_id") % 1000 >= 600
    confidence = F.when(i % 17 != 0, F.when(late, u * 0.2 + 0.6).otherwise(u * 0.1 + 0.9))
    return views.table(spark, sf, "documents").select(
        "doc_id",
        F.col("lang").alias("tenant_id"),
        F.lit("prose").alias("doc_type"),
        i.alias("seq"),
        "text",
        confidence.alias("doc_confidence"),
        F.when(i % 19 != 0, F.col("n_chars") >= 100).alias("validation_passed"),
    )


def plan(spark, sf):
    return drift.DriftPlan(stream(spark, sf), KEYS)


_STREAM = f"""
stream AS (
  SELECT doc_id, lang AS tenant_id, 'prose' AS doc_type, text,
    CASE WHEN doc_id % 17 <> 0 THEN CASE WHEN doc_id % 1000 >= 600 THEN {O.draw('confidence', 'CAST(doc_id AS VARCHAR)')} / 4294967296.0::DOUBLE * 0.2::DOUBLE + 0.6::DOUBLE
      ELSE {O.draw('confidence', 'CAST(doc_id AS VARCHAR)')} / 4294967296.0::DOUBLE * 0.1::DOUBLE + 0.9::DOUBLE END END AS doc_confidence,
    CASE WHEN doc_id % 19 <> 0 THEN n_chars >= 100 END AS passed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos
  FROM documents)"""

_PROFILE = f"""{_STREAM},
counts AS (SELECT doc_id, tenant_id, pos, CAST(('0x' || substr(sha256(token), 1, 8))::BIGINT % 1024 AS INT) AS bucket, ln(1 + count(*)) AS raw
  FROM (SELECT doc_id, tenant_id, pos, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM stream) GROUP BY 1, 2, 3, 4),
profile AS MATERIALIZED (SELECT doc_id, tenant_id, pos, bucket, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM counts)"""

_DISTANCE = f"""{_PROFILE},
prefix AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY tenant_id, bucket ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM profile WHERE pos <= 50),
dots AS (SELECT doc_id, sum(s * weight) AS dot, sum(weight * weight) AS own FROM prefix GROUP BY 1),
base AS (SELECT stream.doc_id, tenant_id, pos, coalesce(dot, 0) AS dot, coalesce(own, 0) AS own FROM stream LEFT JOIN dots USING (doc_id) WHERE pos <= 50),
early AS (SELECT doc_id, tenant_id, pos, dot, own, sqrt(sum(2 * dot + own) OVER (PARTITION BY tenant_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS size FROM base),
center AS (SELECT tenant_id, bucket, sum(weight) / (SELECT max(pos) FROM stream s2 WHERE s2.tenant_id = p.tenant_id AND pos <= 50) AS mean_weight FROM profile p WHERE pos <= 50 GROUP BY 1, 2),
len AS (SELECT tenant_id, sqrt(sum(mean_weight * mean_weight)) AS length FROM center GROUP BY 1),
late AS (SELECT doc_id, sum(weight * coalesce(mean_weight, 0)) AS dot FROM profile LEFT JOIN center USING (tenant_id, bucket) WHERE pos > 50 GROUP BY 1),
dist AS (
  SELECT doc_id, tenant_id, pos, greatest(0.0::DOUBLE, least(2.0::DOUBLE, CASE WHEN own = 0 OR size = 0 THEN 0.0::DOUBLE ELSE 1 - dot / (sqrt(own) * size) END)) AS value FROM early WHERE pos > 1
  UNION ALL
  SELECT s.doc_id, s.tenant_id, s.pos, greatest(0.0::DOUBLE, least(2.0::DOUBLE, CASE WHEN dot IS NULL OR coalesce(length, 0) = 0 THEN 0.0::DOUBLE ELSE 1 - dot / length END))
  FROM stream s LEFT JOIN late ON s.doc_id = late.doc_id LEFT JOIN len ON s.tenant_id = len.tenant_id WHERE s.pos > 50)"""

_SIGNALS = f"""{_DISTANCE},
sigs AS MATERIALIZED (SELECT doc_id, tenant_id, pos, 'doc_confidence' AS signal, doc_confidence AS value FROM stream WHERE doc_confidence IS NOT NULL
  UNION ALL SELECT doc_id, tenant_id, pos, 'validation_failure', CASE WHEN passed THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END FROM stream WHERE passed IS NOT NULL
  UNION ALL SELECT doc_id, tenant_id, pos, 'text_distance', value FROM dist),
st AS (SELECT tenant_id, signal, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM sigs WHERE pos <= 50 GROUP BY 1, 2),
stats AS (SELECT *, CASE WHEN signal = 'validation_failure' THEN greatest(sqrt((mean * n + 0.5) / (n + 1) * (1 - (mean * n + 0.5) / (n + 1))), 0.01)
   WHEN n < 2 THEN 0.01 ELSE greatest(sd, 0.01) END AS sigma FROM st),
scored AS MATERIALIZED (SELECT doc_id, tenant_id, pos, signal, (value - mean) / sigma AS z,
   CASE WHEN signal = 'doc_confidence' THEN (value - mean) / sigma <= -3 ELSE (value - mean) / sigma >= 3 END AS breach FROM sigs JOIN stats USING (tenant_id, signal) WHERE pos > 50 AND n >= 2),
isl AS (SELECT *, sum(CASE WHEN breach THEN 0 ELSE 1 END) OVER (PARTITION BY tenant_id, signal ORDER BY pos) AS g FROM scored),
runs AS MATERIALIZED (SELECT *, CASE WHEN breach THEN row_number() OVER (PARTITION BY tenant_id, signal, g ORDER BY pos) - CASE WHEN g > 0 THEN 1 ELSE 0 END ELSE 0 END AS consecutive FROM isl)"""


@query(f"WITH {_PROFILE} SELECT doc_id, bucket, round(weight, 9) AS weight FROM profile")
def text_profile(spark, sf):
    return drift.text_profile(stream(spark, sf), "doc_id").select("doc_id", "bucket", F.round("weight", 9).alias("weight"))


@query(f"WITH {_DISTANCE}, own AS (SELECT doc_id, tenant_id, bucket, weight FROM profile), size AS (SELECT doc_id, sqrt(sum(weight * weight)) AS n FROM own GROUP BY 1), clen AS (SELECT tenant_id, sqrt(sum(mean_weight * mean_weight)) AS n FROM center GROUP BY 1), hit AS (SELECT doc_id, sum(weight * mean_weight) AS dot FROM own JOIN center USING (tenant_id, bucket) GROUP BY 1) SELECT s.doc_id, round(greatest(0.0::DOUBLE, least(2.0::DOUBLE, CASE WHEN coalesce(size.n * clen.n, 0) = 0 THEN 0.0::DOUBLE ELSE 1 - coalesce(dot, 0.0::DOUBLE) / (size.n * clen.n) END)), 6) + 0.0 AS distance FROM stream s LEFT JOIN size USING (doc_id) LEFT JOIN clen USING (tenant_id) LEFT JOIN hit USING (doc_id)")
def cosine_distance(spark, sf):
    """Distance of every document's profile to the frozen centroid of its key."""
    drifted = plan(spark, sf)
    centers = drifted.centers.select("tenant_id", "bucket", F.col("mean_weight").alias("weight"))
    profiles = drifted.profiles.select("doc_id", "bucket", "weight")
    pairs = drifted.stream.select("doc_id", "tenant_id")
    return drift.cosine_distance(pairs, profiles, centers, ["bucket"], ("doc_id", "tenant_id")).select("doc_id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


@query(f"WITH {_STREAM} SELECT tenant_id, doc_id, pos AS rank FROM stream WHERE pos <= 50")
def baseline_slice(spark, sf):
    return drift.baseline_slice(stream(spark, sf), KEYS, "seq").select("tenant_id", "doc_id", F.col("_rank").cast("bigint").alias("rank"))


@query(f"WITH {_DISTANCE} SELECT tenant_id, bucket, round(mean_weight, 9) AS mean_weight FROM center")
def centroid(spark, sf):
    return plan(spark, sf).centers.select("tenant_id", "bucket", F.round("mean_weight", 9).alias("mean_weight"))


@query(f"WITH {_DISTANCE} SELECT doc_id, round(value, 6) + 0.0 AS distance FROM dist")
def text_distance(spark, sf):
    return plan(spark, sf).distances.select("doc_id", (F.round("value", 6) + F.lit(0.0)).alias("distance"))


@query(f"WITH {_SIGNALS} SELECT tenant_id, signal, n, round(mean, 6) AS mean, round(sigma, 6) AS sigma FROM stats")
def baseline_stats(spark, sf):
    return plan(spark, sf).stats.select("tenant_id", "signal", "n", F.round("mean", 6).alias("mean"), F.round("sigma", 6).alias("sigma"))


@query(f"WITH {_SIGNALS} SELECT doc_id, signal, round(z, 4) + 0.0 AS z, breach FROM scored")
def z_and_breach(spark, sf):
    return plan(spark, sf).scored.select("doc_id", "signal", (F.round("z", 4) + F.lit(0.0)).alias("z"), "breach")


@query(f"WITH {_SIGNALS} SELECT doc_id, signal, consecutive FROM runs")
def consecutive_breaches(spark, sf):
    return plan(spark, sf).runs().select("doc_id", "signal", "consecutive")


@query(f"WITH {_SIGNALS}, f AS (SELECT tenant_id, array_to_string(list_sort(list(DISTINCT signal)), ',') AS flagged, min(doc_id) AS first_document FROM runs WHERE consecutive >= 3 GROUP BY 1) SELECT tenant_id, CASE WHEN flagged IS NULL THEN 'stable' ELSE 'drifting' END AS status, flagged, first_document FROM (SELECT DISTINCT tenant_id FROM stream WHERE pos > 50) LEFT JOIN f USING (tenant_id)")
def drift_flags(spark, sf):
    return plan(spark, sf).flags().select("tenant_id", "status", F.array_join("ever_flagged", ",").alias("flagged"), F.col("flagged_document").alias("first_document"))


@query(f"WITH {_SIGNALS}, last AS (SELECT tenant_id, signal, arg_max(z, pos) AS z, arg_max(consecutive, pos) AS consecutive FROM runs GROUP BY 1, 2) SELECT tenant_id, signal, round(mean, 6) AS baseline_mean, n AS baseline_n, round(z, 3) AS last_z, coalesce(consecutive, 0) AS consecutive FROM stats LEFT JOIN last USING (tenant_id, signal)")
def drift_status(spark, sf):
    return plan(spark, sf).status().drop("doc_type")


# --- admission --------------------------------------------------------------------------------


def budget_log(spark, sf):
    """Each metered call reserves its worst case and settles three events later; every ninth is released."""
    priced = metering.with_cost(metering.with_worst_case_cost(views.usage(spark, sf)).drop("model_tier"))
    i, cap = F.col("event_id"), F.col("worst_case_usd")
    common = lambda seq, kind: priced.select("tenant_id", seq.alias("seq"), kind.alias("kind"), (i * 2).alias("reserve_seq"), cap.alias("reserved"), F.col("cost_usd").alias("actual"), "event_id")
    settled = F.when(i % 9 == 0, "release").otherwise("settle")
    return common(i * 2, F.lit("reserve")).unionByName(common((i + 60) * 2 + 1, settled))


def budgets(spark, sf):
    cap = F.when(F.col("tenant_id") == "t5", 1000).otherwise(F.substring("tenant_id", 2, 1).cast("int") + 1).cast("decimal(14,6)")
    return views.usage(spark, sf).select("tenant_id").distinct().withColumn("budget_usd", cap)


_REPLAY = f"""RECURSIVE {O.USAGE.strip()}, calls AS (
  SELECT event_id, tenant_id, input_tokens * CASE WHEN tier = 'frontier' THEN 5 ELSE 1 END + 8192 * CASE WHEN tier = 'frontier' THEN 25 ELSE 5 END AS reserved,
    input_tokens * CASE WHEN tier = 'frontier' THEN 5 ELSE 1 END + output_tokens * CASE WHEN tier = 'frontier' THEN 25 ELSE 5 END AS actual FROM usage
), log AS (
  SELECT tenant_id, event_id * 2 AS seq, 'reserve' AS kind, event_id * 2 AS rs, reserved, actual FROM calls
  UNION ALL SELECT tenant_id, (event_id + 60) * 2 + 1, CASE WHEN event_id % 9 = 0 THEN 'release' ELSE 'settle' END, event_id * 2, reserved, actual FROM calls
), steps AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY seq) AS pos, CASE WHEN tenant_id = 't5' THEN 1000 WHEN tenant_id = 't9' THEN -1 ELSE substr(tenant_id, 2, 1)::BIGINT + 1 END * 1000000 AS cap FROM log
), fold AS (
  SELECT tenant_id, 0::BIGINT AS pos, 0::BIGINT AS seq, '' AS kind, NULL::BOOLEAN AS granted, 0::BIGINT AS spent, 0::BIGINT AS unsettled, []::BIGINT[] AS waiting FROM (SELECT DISTINCT tenant_id FROM log)
  UNION ALL
  SELECT s.tenant_id, s.pos, s.seq, s.kind, CASE WHEN s.kind = 'reserve' THEN f.spent + reserved <= cap END,
    CASE WHEN s.kind = 'reserve' THEN CASE WHEN f.spent + reserved <= cap THEN f.spent + reserved ELSE f.spent END
         WHEN list_contains(f.waiting, rs) THEN f.spent - reserved + CASE WHEN s.kind = 'settle' THEN actual ELSE 0 END ELSE f.spent END,
    CASE WHEN s.kind = 'reserve' THEN f.unsettled + CASE WHEN f.spent + reserved <= cap THEN 1 ELSE 0 END WHEN list_contains(f.waiting, rs) THEN f.unsettled - 1 ELSE f.unsettled END,
    CASE WHEN s.kind = 'reserve' THEN CASE WHEN f.spent + reserved <= cap THEN list_append(f.waiting, rs) ELSE f.waiting END ELSE list_filter(f.waiting, lambda x: x <> rs) END
  FROM fold f JOIN steps s ON s.tenant_id = f.tenant_id AND s.pos = f.pos + 1
)"""


@query(f"WITH {_REPLAY} SELECT tenant_id, seq, kind, granted, spent / 1000000 AS spent_usd, unsettled FROM fold WHERE pos > 0")
def budget_replay(spark, sf):
    """Greedy admission in order; one tenant has no budget."""
    return admission.budget_replay(budget_log(spark, sf), budgets(spark, sf).where("tenant_id <> 't9'"))


def bucket_requests(spark, sf):
    return views.table(spark, sf, "events").select(
        F.concat(F.lit("t"), (F.col("user_id") % 10).cast("string")).alias("tenant_id"),
        F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("at"),
    )


_BUCKET = """RECURSIVE asked AS MATERIALIZED (
  SELECT 't' || (user_id % 10) AS tenant_id, event_id AS seq, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts), event_id) AS pos FROM events
), bucket AS (
  SELECT tenant_id, 0::BIGINT AS pos, 0::BIGINT AS seq, false AS allowed, 3.0::DOUBLE AS available, 3.0::DOUBLE AS tokens, min(t) AS touched FROM asked GROUP BY 1
  UNION ALL
  SELECT tenant_id, pos, seq, have >= 1, have, CASE WHEN have >= 1 THEN have - 1 ELSE tokens END, CASE WHEN have >= 1 THEN t ELSE touched END
  FROM (SELECT a.tenant_id, a.pos, a.seq, a.t, b.tokens, b.touched, least(b.tokens + (a.t - b.touched) * (0.02::DOUBLE / 60.0::DOUBLE), 3.0::DOUBLE) AS have FROM bucket b JOIN asked a ON a.tenant_id = b.tenant_id AND a.pos = b.pos + 1)
)"""


@query(f"WITH {_BUCKET} SELECT tenant_id, seq, allowed, round(CASE WHEN allowed THEN tokens ELSE available END, 6) AS tokens_left, CASE WHEN allowed THEN 0.0::DOUBLE ELSE round(round((1 - available) / (0.02::DOUBLE / 60.0::DOUBLE), 2), 1) END AS retry_after FROM bucket WHERE pos > 0")
def token_bucket(spark, sf):
    """A bucket slow enough to refuse some requests."""
    out = admission.token_bucket(bucket_requests(spark, sf), rate_per_minute=0.02, burst=3.0)
    return out.select("tenant_id", "seq", "allowed", F.round("tokens_left", 6).alias("tokens_left"), F.round("retry_after", 1).alias("retry_after"))


@query(
    f"""WITH {O.DOCS} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'budget_exceeded' ELSE status END AS status,
        CASE WHEN doc_id % 4 = 0 THEN 'tenant budget exhausted: spent ' || CAST(doc_id % 9 AS VARCHAR) || '.50 of 10.00 USD' END AS last_error FROM docs"""
)
def pause_on_budget(spark, sf):
    docs = views.document_rows(spark, sf).withColumn("last_error", F.lit(None).cast("string"))
    spent = (F.col("doc_id") % 9 + F.expr("0.50BD")).cast("decimal(12,2)")
    refused = docs.where(F.col("doc_id") % 4 == 0).select("doc_id", spent.alias("spent_usd"), F.lit(10).cast("decimal(12,2)").alias("budget_usd"))
    return admission.pause_on_budget(docs, refused).select("doc_id", "status", "last_error")
