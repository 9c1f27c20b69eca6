"""A sample of the queries of every section is compared with its SQL twin on the smallest data."""

import pytest

from docsieve.plans import catalog
from tests.oracle_check import compare, duck

QUERIES, ORACLES = catalog.load()
CHEAP = [
    "norm_text", "norm_amount", "norm_date", "dedupe_content", "cost_rollup", "unit_costs", "cumulative_spend", "rescue_plan",
    "apply_client_corrections", "route_key", "parse_storage_events", "evaluate_rules", "golden_split", "phase_summary", "rolling_precision",
    "validate_payload", "ingest_stream", "budget_replay", "token_bucket", "groundedness", "route_extraction", "cosine_distance", "stranded_documents", "failure_stamp",
]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 100


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, sf, name):
    ok, note = compare(QUERIES[name](spark, sf), duck(sf), ORACLES[name])
    assert ok, note


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["tenant_view"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in plan
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]
