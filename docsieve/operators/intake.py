"""Intake: storage events, routing, content checks and deduplication (A1-A5, A10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Intake prefix, upload limit, file magic and the messages stored with refused files.
PREFIX = "dropbox"
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
PDF_MAGIC = "%PDF-"
NOT_A_PDF = "not a PDF: the object does not begin with %PDF-"
EVENT_SCHEMA = (
    "Records array<struct<eventName:string, s3:struct<bucket:struct<name:string>, object:struct<key:string, size:bigint>>>>"
)


def parse_storage_events(events: DataFrame, value: str = "value") -> DataFrame:
    """A1: one row per created object: bucket, key, size. Other event kinds and incomplete records drop out."""
    records = F.explode(F.from_json(F.col(value), EVENT_SCHEMA)["Records"]).alias("r")
    others = [c for c in events.columns if c != value]
    rows = events.select(*others, records).select(
        *others,
        F.regexp_replace(F.col("r.eventName"), "^s3:", "").alias("_name"),
        F.col("r.s3.bucket.name").alias("bucket"),
        F.try_url_decode(F.col("r.s3.object.key")).alias("key"),
        F.col("r.s3.object.size").alias("size"),
    )
    wanted = F.startswith(F.col("_name"), F.lit("ObjectCreated")) & (F.col("bucket") != "") & (F.col("key") != "")
    return rows.where(wanted).drop("_name")


def route_key(key: Column, slugs: tuple[str, ...], prefix: str = PREFIX) -> tuple[Column, Column]:
    """A2: `{tenant}/{prefix}/{doc_type?}/{file}` into tenant and document type; NULLs when it is not ours."""
    parts = F.split(key, "/")
    ours = (F.size(parts) >= 3) & (F.get(parts, F.lit(1)) == prefix)
    kind = F.get(parts, F.lit(2))
    return F.when(ours, F.get(parts, F.lit(0))), F.when(ours & (F.size(parts) > 3) & kind.isin(*slugs), kind)


def classify_blob(blobs: DataFrame, content: str = "content") -> DataFrame:
    """A3: hash, size and verdict. A dropped file that is no PDF keeps a failed row with a reason."""
    body = F.col(content)
    is_pdf = F.substring(body, 1, 5) == F.lit(PDF_MAGIC).cast("binary")
    return blobs.withColumns(
        {
            "sha256": F.sha2(body, 256),
            "size": F.octet_length(body).cast("bigint"),
            "status": F.when(is_pdf, "received").otherwise("failed"),
            "last_error": F.when(~is_pdf, NOT_A_PDF),
            "doc_type": F.coalesce("doc_type", F.lit("invoice")) if "doc_type" in blobs.columns else F.lit("invoice"),
        }
    )


def upload_checks(doc_type: Column, rate_ok: Column, size: Column, head: Column, slugs: tuple[str, ...]) -> Column:
    """A4: the first reason to refuse an upload, NULL when it is fine. A refused upload writes no row."""
    return (
        F.when(~doc_type.isin(*slugs), 400)
        .when(~rate_ok, 429)
        .when(size > MAX_UPLOAD_BYTES, 413)
        .when(size == 0, 400)
        .when(head != PDF_MAGIC, 400)
    )


def dedupe_content(arrivals: DataFrame, order: tuple[str, str] = ("received_at", "doc_id")) -> DataFrame:
    """A5: the same bytes of one tenant are one document: `first_id` and `duplicate` on every arrival.

    The first arrival comes from a mergeable minimum, so a hash shared by very
    many copies is reduced before the shuffle; the join back is split by AQE
    where one hash is hot, because the left side carries the copies.
    """
    first = F.min(F.struct(*order)).alias("_first")
    firsts = arrivals.groupBy("tenant_id", "sha256").agg(first)
    joined = arrivals.join(firsts, ["tenant_id", "sha256"], "left")
    first_id = F.col("_first")[order[1]]
    return joined.withColumns({"first_id": first_id, "duplicate": F.col(order[1]) != first_id}).drop("_first")


def dedupe_against(arrivals: DataFrame, stored: DataFrame) -> DataFrame:
    """A5 across batches: arrivals whose bytes the tenant already stored point to the stored document."""
    known = stored.groupBy("tenant_id", "sha256").agg(F.min(F.struct("received_at", "doc_id"))["doc_id"].alias("stored_id"))
    within = dedupe_content(arrivals).join(known, ["tenant_id", "sha256"], "left")
    return within.withColumns(
        {
            "duplicate": F.col("duplicate") | F.col("stored_id").isNotNull(),
            "first_id": F.coalesce("stored_id", "first_id"),
        }
    ).drop("stored_id")


def tenant_object_scope(objects: DataFrame, tenant: str = "tenant_id", key: str = "key") -> DataFrame:
    """A10: keys outside the tenant's own folder, or climbing out of it."""
    inside = F.startswith(F.col(key), F.concat(F.col(tenant), F.lit("/"))) & ~F.contains(F.col(key), F.lit(".."))
    return objects.where(~F.coalesce(inside, F.lit(False)))
