"""N1 and N2 on streams: budget reservations and token buckets as keyed state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from docsieve.operators.admission import BURST, RATE_PER_MINUTE


def budget_stream(log: DataFrame) -> DataFrame:
    """N1 over a stream of (tenant_id, seq, kind, reserve_seq, reserved, actual, budget_usd), amounts in whole micro-dollars.

    State per tenant: spent, unsettled calls and the reservations still open.
    """

    def admit(key, batches, state):
        spent, unsettled, waiting = state.get if state.exists else (0, 0, [])
        waiting = set(waiting)
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            granted = None
            if r.kind == "reserve":
                granted = spent + int(r.reserved) <= int(r.budget_usd)
                if granted:
                    spent, unsettled = spent + int(r.reserved), unsettled + 1
                    waiting.add(int(r.reserve_seq))
            elif int(r.reserve_seq) in waiting:
                waiting.discard(int(r.reserve_seq))
                paid = int(r.actual) if r.kind == "settle" else 0
                spent, unsettled = max(spent + paid - int(r.reserved), 0), max(unsettled - 1, 0)
            out.append((key[0], int(r.seq), r.kind, granted, spent / 1e6, unsettled))
        state.update((spent, unsettled, sorted(waiting)))
        yield pd.DataFrame(out, columns=["tenant_id", "seq", "kind", "granted", "spent_usd", "unsettled"])

    return log.groupBy("tenant_id").applyInPandasWithState(
        admit, "tenant_id string, seq bigint, kind string, granted boolean, spent_usd double, unsettled bigint",
        "spent bigint, unsettled bigint, waiting array<bigint>", "append", "NoTimeout",
    )


def token_bucket_stream(requests: DataFrame, rate_per_minute: float = RATE_PER_MINUTE, burst: float = BURST) -> DataFrame:
    """N2 over a stream of (tenant_id, seq, at); time is the events' own, in seconds."""
    refill = rate_per_minute / 60.0

    def take(key, batches, state):
        tokens, touched = state.get if state.exists else (burst, None)
        out = []
        for r in pd.concat(list(batches)).sort_values(["at", "seq"]).itertuples(index=False):
            touched = r.at if touched is None else touched
            available = min(tokens + (r.at - touched) * refill, burst)
            ok = available >= 1
            if ok:
                tokens, touched = available - 1, r.at
            wait = 0.0 if ok else round(max(1.0 - available, 0.0) / refill if refill else 60.0, 2)
            out.append((key[0], int(r.seq), bool(ok), float(tokens if ok else available), wait))
        state.update((float(tokens), float(touched)))
        yield pd.DataFrame(out, columns=["tenant_id", "seq", "allowed", "tokens_left", "retry_after"])

    return requests.groupBy("tenant_id").applyInPandasWithState(
        take, "tenant_id string, seq bigint, allowed boolean, tokens_left double, retry_after double",
        "tokens double, touched double", "append", "NoTimeout",
    )
