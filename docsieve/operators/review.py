"""Review queue and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.operators.windows import top_per_key

# Fixed value: hours until a review task is due, unless the deployment says otherwise.
SLA_HOURS = 24


def latest_extraction(extractions: DataFrame) -> DataFrame:
    """H1: the newest extraction per document; ties go to the larger id."""
    order = [F.col("created_at").desc(), F.col("extraction_id").desc()]
    return top_per_key(extractions, ["document_id"], order, 1).drop("_rank")


def document_view(documents: DataFrame, extractions: DataFrame, cells: DataFrame, tables: tuple[str, ...] = ("line_items",)) -> DataFrame:
    """every document with its newest extraction and a map of that one's scored fields.

    Cells of tables inherit one score and are left out; so are fields without a score.
    A map has as many entries as the definition has fields.
    """
    latest = latest_extraction(extractions)
    scored = cells.where(F.col("confidence").isNotNull() & ~F.split_part("name", F.lit("."), F.lit(1)).isin(*tables))
    maps = scored.join(latest.select("extraction_id"), "extraction_id", "left_semi").groupBy("extraction_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "confidence")))).alias("field_confidence")
    )
    return documents.join(latest, "document_id", "left").join(maps, "extraction_id", "left")


def ensure_review_tasks(extractions: DataFrame, existing: DataFrame, now: Column, sla_hours: int = SLA_HOURS) -> DataFrame:
    """K1: one open task per extraction that needs review and has none; its deadline is frozen now."""
    fresh = extractions.where(F.col("decision") == "needs_review").join(
        existing.select("extraction_id"), "extraction_id", "left_anti"
    )
    return fresh.select(
        F.sha2(F.concat_ws(":", F.lit("task"), F.col("extraction_id").cast("string")), 256).alias("task_id"),
        "extraction_id",
        "document_id",
        "tenant_id",
        F.lit("open").alias("status"),
        (now + F.make_dt_interval(hours=F.lit(sla_hours))).alias("sla_due_at"),
        "flagged_fields",
        now.alias("created_at"),
    )


def review_detail(tasks: DataFrame, extractions: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per flagged field of a task, with the cell's value and confidence where stored."""
    flagged = tasks.select("task_id", "extraction_id", "status", F.explode_outer("flagged_fields").alias("name"))
    with_doc = flagged.join(extractions.select("extraction_id", "doc_confidence"), "extraction_id")
    return with_doc.join(fields, ["extraction_id", "name"], "left")


def queue_depth(tasks: DataFrame, now: Column) -> DataFrame:
    """Open tasks, those past their deadline and the age of the oldest in seconds."""
    is_open = F.col("status") == "open"
    oldest = F.min(F.when(is_open, F.col("created_at")))
    return tasks.agg(
        F.count_if(is_open).alias("open"),
        F.count_if(is_open & (F.col("sla_due_at") < now)).alias("breached"),
        F.coalesce(F.timestamp_diff("SECOND", oldest, now), F.lit(0)).alias("oldest_seconds"),
    )


def open_tasks(tasks: DataFrame, limit: int = 50) -> DataFrame:
    """I2."""
    return tasks.where(F.col("status") == "open").orderBy("created_at", "task_id").limit(limit)


def breached_tasks(tasks: DataFrame, now: Column) -> DataFrame:
    """Open tasks past their deadline, by deadline."""
    return tasks.where((F.col("status") == "open") & (F.col("sla_due_at") < now)).orderBy("sla_due_at", "task_id")


def unknown_fields(corrections: Column, output: Column) -> Column:
    """Corrected names that the extraction does not have."""
    return F.array_sort(F.array_except(F.map_keys(corrections), F.map_keys(output)))


def _case_rows(df: DataFrame, source: str, keep_equal: bool) -> DataFrame:
    """One row per corrected field with the value it had; `changed` tells whether it is an evaluation case."""
    rows = df.select(
        *[c for c in df.columns if c not in ("corrections", "output")],
        "output",
        F.explode("corrections").alias("field_name", "corrected_value"),
    )
    previous = F.try_element_at("output", F.col("field_name"))
    emits = F.lit(True) if keep_equal else ~previous.eqNullSafe(F.col("corrected_value"))
    return rows.withColumns({"extracted_value": previous, "emits_case": emits, "source": F.lit(source)}).drop("output")


def apply_client_corrections(corrections: DataFrame, documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """K3: judge one correction set per document against its latest extraction.

    A set is refused as a whole: empty, unknown document, nothing extracted yet,
    or a field the extraction lacks. `applied` carries the new output.
    """
    latest = latest_extraction(extractions).select("document_id", "extraction_id", "output")
    known = documents.select("document_id", F.lit(True).alias("_known"))
    joined = corrections.join(known, "document_id", "left").join(latest, "document_id", "left")
    unknown = unknown_fields(F.col("corrections"), F.col("output"))
    refused = (
        F.when(F.size("corrections") == 0, "no field named")
        .when(F.col("_known").isNull(), "document not found")
        .when(F.col("extraction_id").isNull(), "no extraction to correct")
        .when(F.size(unknown) > 0, F.concat(F.lit("not fields of this extraction: "), F.array_join(unknown, ", ")))
    )
    merged = F.map_concat(F.map_filter("output", lambda k, _: ~F.array_contains(F.map_keys("corrections"), k)), "corrections")
    judged = joined.withColumn("refused", refused).drop("_known")
    return judged.withColumn("applied", F.when(F.col("refused").isNull(), merged))


def client_eval_cases(judged: DataFrame) -> DataFrame:
    """K3: the evaluation cases of accepted sets; an equal value is a no-op."""
    accepted = judged.where(F.col("refused").isNull()).drop("applied", "refused")
    return _case_rows(accepted, "client_correction", keep_equal=False)


def resolve_tasks(resolutions: DataFrame, tasks: DataFrame, extractions: DataFrame) -> DataFrame:
    """K4: judge resolutions (task_id, resolution, corrections). Accepted ones close the task and approve the document."""
    joined = resolutions.join(
        tasks.select("task_id", "extraction_id", "document_id", F.col("status").alias("task_status")), "task_id", "left"
    ).join(extractions.select("extraction_id", "output"), "extraction_id", "left")
    refused = (
        F.when((F.col("resolution") == "corrected") & (F.size("corrections") == 0), "a corrected resolution requires corrections")
        .when(F.col("task_status").isNull(), "task not found")
        .when(F.col("task_status") == "resolved", "already resolved")
    )
    done = F.col("refused").isNull()
    return joined.withColumn("refused", refused).withColumns(
        {
            "new_task_status": F.when(done, "resolved").otherwise(F.col("task_status")),
            "new_document_status": F.when(done, "approved"),
        }
    )


def review_eval_cases(judged: DataFrame) -> DataFrame:
    """K4: one case per corrected field, also where the value did not change."""
    return _case_rows(judged.where(F.col("refused").isNull()).drop("refused"), "human_review", keep_equal=True)


def correction_stats(cases: DataFrame) -> DataFrame:
    """G15."""
    return cases.groupBy("field_name", "source").agg(F.count("*").alias("n"))


def list_documents(documents: DataFrame, status: str | None, doc_type: str | None, limit: int, offset: int, known: tuple[str, ...]) -> DataFrame:
    """A page of documents, newest first, with the total of the filter on every row."""
    if status is not None and status not in known:
        raise ValueError(f"unknown status {status!r}")
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit has to be 1 to 200 and offset not negative")
    kept = documents
    if status is not None:
        kept = kept.where(F.col("status") == status)
    if doc_type is not None:
        kept = kept.where(F.col("doc_type") == doc_type)
    total = kept.agg(F.count("*").alias("total"))
    page = kept.orderBy(F.col("received_at").desc(), F.col("doc_id").desc()).offset(offset).limit(limit)
    return page.join(F.broadcast(total))
