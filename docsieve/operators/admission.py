"""Order-dependent admission per tenant (N1, N2, N5): budget reservations and token buckets.

Both are folds over a tenant's events in order. Where the outcome follows from a
running sum or from a known state, no fold happens; the rest is folded in
bounded segments with the state carried from one segment to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.operators import windows
from docsieve.session import cut, scratch_table

# Token bucket defaults, and how many rows of one key a task may hold at once.
RATE_PER_MINUTE = 60.0
BURST = 30.0
SEGMENT_ROWS = 200_000


def fold_segments(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fold: Callable[[pd.DataFrame], pd.DataFrame],
    out_schema: str,
    state: Sequence[str],
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Apply an order-dependent fold per key without holding more than `segment_rows` of a key.

    `fold` gets one segment with the carried `state` columns (NULL at the start)
    and returns rows that carry the state after each row.
    """
    placed = windows.running(df, keys, order, index="_pos")
    segment = F.floor((F.col("_pos") - 1) / F.lit(segment_rows)).cast("int")
    path = scratch_table(df.sparkSession, "fold")
    placed.withColumn("_segment", segment).write.partitionBy("_segment").parquet(path)
    kinds = T.StructType([*placed.schema, T.StructField("_segment", T.IntegerType())])
    stored = df.sparkSession.read.schema(kinds).parquet(path)
    last = stored.agg(F.max("_segment")).first()[0]
    done, carried = None, None
    for i in range((last or 0) + 1):
        part = stored.where(F.col("_segment") == i).drop("_segment")
        if carried is None:
            types = dict(x.strip().rsplit(" ", 1) for x in out_schema.split(","))
            part = part.withColumns({s: F.lit(None).cast(types[s]) for s in state})
        else:
            part = part.join(carried, list(keys), "left")
        out = cut(part.groupBy(*keys).applyInPandas(fold, out_schema))
        final = out.groupBy(*keys).agg(F.max_by(F.struct(*state), F.col("_pos")).alias("_s")).select(*keys, "_s.*")
        carried = cut(final if carried is None else final.unionByName(carried.join(final.select(*keys), list(keys), "left_anti")))
        done = out if done is None else done.unionByName(out)
    return done


def budget_replay(log: DataFrame, budgets: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Replay reserve / settle / release rows per tenant in `seq` order.

    A reservation is granted iff spent + reserved stays within the budget; a tenant
    without a budget gets nothing granted. A reservation is closed once: its first settle or
    release behind it counts if it was granted, all further ones change nothing. Up to
    the first reservation that would not fit, everything is granted and spent is
    a running sum; only the rows from there on are folded, because a refusal
    does not add. Columns: tenant_id, seq, kind, reserve_seq, reserved, actual.
    """
    amount = "decimal(18,6)"
    reserve = F.col("kind") == "reserve"
    earlier = Window.partitionBy("tenant_id", "reserve_seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.count_if(reserve).over(earlier), F.lit(0)) > 0
    log = log.withColumn("_closes", F.when(~reserve, known & (F.coalesce(F.count_if(~reserve & (F.col("seq") > F.col("reserve_seq"))).over(earlier), F.lit(0)) == 0)))
    delta = (
        F.when(reserve, F.col("reserved"))
        .when(~F.col("_closes"), F.lit(0))
        .when(F.col("kind") == "settle", F.col("actual") - F.col("reserved"))
        .otherwise(-F.col("reserved"))
    ).cast(amount)
    opened = F.when(reserve, 1).when(F.col("_closes"), -1).otherwise(0)
    run = windows.running(log, ["tenant_id"], ["seq"], sums={"_spent": delta, "_open": opened})
    run = run.join(budgets.select("tenant_id", F.col("budget_usd").cast(amount).alias("budget_usd")), "tenant_id", "left")
    run = run.withColumn("budget_usd", F.coalesce("budget_usd", F.lit(-1).cast(amount)))
    run = cut(run.withColumn("_spent", F.col("_spent").cast(amount)))
    too_much = (F.col("kind") == "reserve") & (F.col("_spent") > F.col("budget_usd"))
    first = run.where(too_much).groupBy("tenant_id").agg(F.min("seq").alias("_stop"))
    marked = run.join(first, "tenant_id", "left")
    free = F.col("_stop").isNull() | (F.col("seq") < F.col("_stop"))
    granted = F.when(F.col("kind") == "reserve", F.lit(True))
    easy = marked.where(free).select(
        "tenant_id", "seq", "kind", granted.alias("granted"), F.col("_spent").cast("double").alias("spent_usd"), F.col("_open").cast("bigint").alias("unsettled")
    )
    at_stop = F.max_by(F.struct("_spent", "_open"), F.col("seq"))
    start = marked.where(free).groupBy("tenant_id").agg(at_stop.alias("_s")).select("tenant_id", F.col("_s._spent").alias("start_spent"), F.col("_s._open").cast("bigint").alias("start_open"))
    tail = marked.where(~free).join(start, "tenant_id", "left").select(
        "tenant_id", "seq", "kind", "reserve_seq",
        *[(F.col(c) * 1000000).cast("bigint").alias(c) for c in ("reserved", "actual", "budget_usd")],
        (F.coalesce("start_spent", F.lit(0)) * 1000000).cast("bigint").alias("start_spent"),
        F.coalesce("start_open", F.lit(0)).alias("start_open"),
        (F.col("reserve_seq") < F.col("_stop")).alias("before_stop"), "_closes",
    )

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        head = rows.iloc[0]
        fresh = pd.isna(head["state_spent"])
        spent = int(head["start_spent"] if fresh else head["state_spent"])
        unsettled = int(head["start_open"] if fresh else head["state_open"])
        waiting = set() if fresh or not head["state_waiting"] else {int(x) for x in head["state_waiting"].split(",")}
        out = []
        for r in rows.rename(columns={"_closes": "closes"}).itertuples(index=False):
            ok = None
            if r.kind == "reserve":
                ok = spent + int(r.reserved) <= int(r.budget_usd)
                if ok:
                    spent, unsettled = spent + int(r.reserved), unsettled + 1
                    waiting.add(int(r.seq))
            elif r.closes and (r.before_stop or int(r.reserve_seq) in waiting):
                waiting.discard(int(r.reserve_seq))
                paid = int(r.actual) if r.kind == "settle" else 0
                spent, unsettled = max(spent + paid - int(r.reserved), 0), max(unsettled - 1, 0)
            out.append((r.tenant_id, r.seq, r.kind, ok, spent / 1e6, unsettled, 0, spent, unsettled))
        done = pd.DataFrame(out, columns=["tenant_id", "seq", "kind", "granted", "spent_usd", "unsettled", "_pos", "state_spent", "state_open"])
        done["granted"] = done["granted"].astype(object)
        done["_pos"] = rows["_pos"].to_numpy()
        done["state_waiting"] = ""
        done.loc[done.index[-1], "state_waiting"] = ",".join(str(x) for x in sorted(waiting))
        return done

    schema = (
        "tenant_id string, seq bigint, kind string, granted boolean, spent_usd double, unsettled bigint, _pos bigint, "
        "state_spent bigint, state_open bigint, state_waiting string"
    )
    hard = fold_segments(tail, ["tenant_id"], ["seq"], fold, schema, ["state_spent", "state_open", "state_waiting"], segment_rows)
    return easy.unionByName(hard.select(*easy.columns))


def token_bucket(
    requests: DataFrame, rate_per_minute: float = RATE_PER_MINUTE, burst: float = BURST, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """One token per request, refilled over time up to `burst`; refusals say when to retry.

    A pause long enough to refill the whole bucket makes the state known, so
    each stretch between such pauses is folded on its own. Columns: tenant_id, seq, at (seconds).
    """
    refill = rate_per_minute / 60.0
    with_gap = windows.previous(requests, ["tenant_id"], ["at", "seq"], "_before", "at")
    full = F.col("_before").isNull() | ((F.col("at") - F.col("_before")) * refill >= burst)
    stretches = windows.running(with_gap, ["tenant_id"], ["at", "seq"], sums={"stretch": full.cast("int")})

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "seq"])
        head = rows.iloc[0]
        fresh = pd.isna(head["state_tokens"])
        tokens = burst if fresh else float(head["state_tokens"])
        touched = float(head["at"]) if fresh else float(head["state_at"])
        allowed, left, retry, kept, when = [], [], [], [], []
        for at in rows["at"].to_numpy(dtype=float):
            available = min(tokens + (at - touched) * refill, burst)
            ok = available >= 1
            if ok:
                tokens, touched = available - 1, at
            allowed.append(ok)
            left.append(tokens if ok else available)
            retry.append(0.0 if ok else round(max(1.0 - available, 0.0) / refill if refill else 60.0, 2))
            kept.append(tokens)
            when.append(touched)
        return pd.DataFrame(
            {
                "tenant_id": rows["tenant_id"].to_numpy(), "stretch": rows["stretch"].to_numpy(), "seq": rows["seq"].to_numpy(),
                "allowed": allowed, "tokens_left": left, "retry_after": retry, "_pos": rows["_pos"].to_numpy(),
                "state_tokens": kept, "state_at": when,
            }
        )

    schema = (
        "tenant_id string, stretch bigint, seq bigint, allowed boolean, tokens_left double, retry_after double, _pos bigint, "
        "state_tokens double, state_at double"
    )
    out = fold_segments(
        stretches.select("tenant_id", F.col("stretch").cast("bigint"), "seq", F.col("at").cast("double")),
        ["tenant_id", "stretch"], ["at", "seq"], fold, schema, ["state_tokens", "state_at"], segment_rows,
    )
    return out.select("tenant_id", "seq", "allowed", "tokens_left", "retry_after")


def pause_on_budget(documents: DataFrame, refused: DataFrame) -> DataFrame:
    """Documents whose reservation was refused wait as `budget_exceeded`; they can be resumed.

    `refused`: doc_id, spent_usd and budget_usd at the refusal, one row per document.
    """
    reason = F.concat(
        F.lit("tenant budget exhausted: spent "), F.col("spent_usd").cast("string"), F.lit(" of "), F.col("budget_usd").cast("string"), F.lit(" USD")
    )
    joined = documents.join(refused.select("doc_id", reason.alias("_reason")), "doc_id", "left")
    paused = F.col("_reason").isNotNull()
    return joined.withColumns(
        {
            "status": F.when(paused, "budget_exceeded").otherwise(F.col("status")),
            "last_error": F.when(paused, F.col("_reason")).otherwise(F.col("last_error")),
        }
    ).drop("_reason")
