"""The registry of queries: a name, a callable (spark, sf_dir) -> DataFrame, and its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        key = name or run.__name__
        if key in QUERIES:
            raise ValueError(f"query {key!r} is registered twice")
        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = oracle
        return run

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every section once and hand out the registry."""
    from docsieve.plans import (  # noqa: F401
        queries_evidence,
        queries_reading,
        queries_records,
        queries_tables,
        queries_drift,
        queries_streams,
        queries_study,
    )

    return dict(QUERIES), dict(ORACLES)
