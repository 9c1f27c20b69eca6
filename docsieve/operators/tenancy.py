"""Tenant scoping (Q1-Q3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NoTenant(PermissionError):
    """A tenant-owned table was read without a tenant."""


def scoped(df: DataFrame, tenant: str | None) -> DataFrame:
    """Q1: only the bound tenant's rows; the filter is pushed down and prunes `tenant_id` partitions."""
    if not tenant:
        raise NoTenant("bind a tenant before reading its tables")
    return df.where(F.col("tenant_id") == tenant)


def foreign_rows(df: DataFrame, tenant: str | None) -> DataFrame:
    """Q2: rows that a write bound to this tenant must refuse."""
    if not tenant:
        raise NoTenant("bind a tenant before writing its tables")
    return df.where(~F.coalesce(F.col("tenant_id") == tenant, F.lit(False)))


def usage_summary(budget: DataFrame, documents: DataFrame, units: DataFrame, in_flight: tuple[str, ...], drift: DataFrame) -> DataFrame:
    """Q3: one row per tenant: budget state, documents in flight and by status, cost per definition, drift per document type.

    `drift` has one row per tenant and document type (`streaming.drift.stored_keys`); tenants without one have no drift entries.
    """
    by_status = documents.groupBy("tenant_id", "status").agg(F.count("*").alias("n"))
    counts = by_status.groupBy("tenant_id").agg(
        F.sum(F.when(F.col("status").isin(*in_flight), F.col("n")).otherwise(0)).alias("in_flight"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"),
    )
    costs = units.groupBy("tenant_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("slug", "cost_per_document")))).alias("cost_per_document")
    )
    shown = [c for c in drift.columns if c not in ("tenant_id", "doc_type")]
    states = drift.groupBy("tenant_id").agg(F.map_from_entries(F.collect_list(F.struct("doc_type", F.struct(*shown)))).alias("drift"))
    joined = budget.join(counts, "tenant_id", "left").join(costs, "tenant_id", "left").join(states, "tenant_id", "left")
    return joined.withColumn("tenant_status", F.when(F.col("exceeded"), "paused").otherwise("active")).withColumn(
        "in_flight", F.coalesce("in_flight", F.lit(0))
    )
