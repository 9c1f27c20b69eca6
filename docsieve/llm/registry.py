"""Queries of the subpackage: name -> callable (spark, sf_dir), and the SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from docsieve.llm import conversation_trie, decontaminate, near_duplicates, personal_data, quality_classifier, quality_rules, secret_scan, sentencepieces, sharding, simhash, spelling, token_counts, url_filters

    modules = [sharding, decontaminate, near_duplicates, quality_classifier, quality_rules, url_filters, token_counts, secret_scan, personal_data, sentencepieces, conversation_trie, spelling, simhash]
    queries = {name: run for m in modules for name, run in m.QUERIES.items()}
    oracles = {name: sql for m in modules for name, sql in m.ORACLES.items()}
    return queries, oracles
