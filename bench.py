"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and once measured, writing to the `noop` sink so
that every row and column is computed. Per-document milliseconds are reported
beside the seconds, to compare with a per-document baseline; the slope between
a smaller data set ($BENCH_SMALL_DIR, by default sf0.01 beside the large one) and the large one
leaves out planning, which does not grow with the data.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docsieve.plans import catalog  # noqa: E402
from docsieve.session import build_session  # noqa: E402

HEADLINE = {
    "evaluate_rules": "orders",
    "route_extraction": "orders",
    "extract_record": "orders",
    "normalize_record": "orders",
    "validate_payload": "orders",
    "score_extraction": "orders",
    "groundedness": "orders",
    "sweep": "orders",
    "text_profile": "documents",
    "dedupe_content": "documents",
    "z_and_breach": "documents",
    "unit_costs": "events",
    "cumulative_spend": "events",
    "latest_extraction": "events",
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalog.load()
    rows = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in set(HEADLINE.values())}
    small = os.environ.get("BENCH_SMALL_DIR", os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.01"))
    fewer = {t: spark.read.parquet(f"{small}/{t}.parquet").count() for t in set(HEADLINE.values())} if os.path.isdir(small) else {}
    seconds, per_row, slope = {}, {}, {}

    def run(name: str, folder: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name, table in HEADLINE.items():
        if only and name not in only:
            continue
        run(name, sf)
        seconds[name] = round(run(name, sf), 3)
        per_row[name] = round(1000 * seconds[name] / rows[table], 4)
        if fewer and rows[table] > fewer[table]:
            slope[name] = round(1000 * max(0.0, seconds[name] - run(name, small)) / (rows[table] - fewer[table]), 4)
        print(f"{name}: {seconds[name]}s, {per_row[name]} ms/row", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "ms_per_row": per_row, "slope_ms_per_row": slope, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
