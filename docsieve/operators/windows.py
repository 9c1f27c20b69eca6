"""Ordered computations per key that never put a whole key into one task.

A plain window `PARTITION BY key` sends all rows of a key to one task. Here rows
are range-partitioned by (key, order), so a heavy key spans many chunks; a window
runs inside (key, chunk) and the chunk totals, a few rows per key, carry over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.session import cut

_ADD = ("sum", "count")


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Add `_chunk`: contiguous ranges of (keys, order). `order` must end in a unique column.

    The result is checkpointed, because range bounds are sampled and both readers
    of the chunks must see the same ones.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order)
    return cut(ranged.withColumn("_chunk", F.spark_partition_id()))


def _carry(chunks: DataFrame, keys: Sequence[str], totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """What the earlier chunks of each key add up to; one row per (key, chunk)."""
    per_chunk = chunks.groupBy(*keys, "_chunk").agg(*[agg.alias(n) for n, (_, agg) in totals.items()])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = {}
    for n, (how, _) in totals.items():
        carried[n] = {"sum": F.sum, "max": F.max}[how](F.col(n)).over(before)
    return per_chunk.select(*keys, "_chunk", *[c.alias(f"_carry_{n}") for n, c in carried.items()])


def _attach(chunks: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return chunks.join(carry, [*keys, "_chunk"], "left")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    index: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Running sums, running maxima and the 1-based position of each row within its key, row included."""
    sums, maxima = sums or {}, maxima or {}
    prepared = df.withColumns({f"_in_{n}": c for n, c in {**sums, **maxima}.items()}) if sums or maxima else df
    chunks = chunked(prepared, keys, order, parts)
    totals: dict[str, tuple[str, Column]] = {n: ("sum", F.sum(f"_in_{n}")) for n in sums}
    totals |= {n: ("max", F.max(f"_in_{n}")) for n in maxima}
    if index:
        totals[index] = ("sum", F.count(F.lit(1)))
    whole = _attach(chunks, _carry(chunks, keys, totals), keys)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for n in sums:
        kind = prepared.schema[f"_in_{n}"].dataType
        local, carried = F.sum(f"_in_{n}").over(upto), F.col(f"_carry_{n}")
        total = F.when(local.isNull(), carried).when(carried.isNull(), local).otherwise(local + carried)
        out[n] = total if kind.typeName() != "decimal" else total.cast(local_type(kind))
    for n in maxima:
        out[n] = F.greatest(F.max(f"_in_{n}").over(upto), F.col(f"_carry_{n}"))
    if index:
        out[index] = F.row_number().over(inside).cast("bigint") + F.coalesce(F.col(f"_carry_{index}"), F.lit(0))
    drop = [f"_in_{n}" for n in {**sums, **maxima}] + [f"_carry_{n}" for n in totals]
    return whole.withColumns(out).drop("_chunk", *drop)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, value: str, parts: int | None = None) -> DataFrame:
    """Add the value of the row before, for a value that grows with the order (a timestamp, a sequence number)."""
    chunks = chunked(df, keys, order, parts)
    whole = _attach(chunks, _carry(chunks, keys, {name: ("max", F.max(value))}), keys)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return whole.withColumn(name, F.coalesce(F.lag(value).over(inside), F.col(f"_carry_{name}"))).drop("_chunk", f"_carry_{name}")


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, name: str, parts: int | None = None) -> DataFrame:
    """Add the length of the unbroken run of true `flag`s that ends at each row (0 where the flag is false).

    A run that enters a chunk from the left is handed over by the trailing runs
    of the earlier chunks, one row per (key, chunk).
    """
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = (
        chunked(df, keys, order, parts)
        .withColumn("_rn", F.row_number().over(inside))
        .withColumn("_reset", F.max(F.when(~F.col(flag), F.col("_rn"))).over(upto))
    )
    ends = local.groupBy(*keys, "_chunk").agg(F.max("_rn").alias("_n"), F.max("_reset").alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_chunk")
    grouped = ends.withColumn("_group", F.count("_last").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    in_group = Window.partitionBy(*keys, "_group").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    trailing = grouped.withColumn("_open", F.sum(F.col("_n") - F.coalesce("_last", F.lit(0))).over(in_group))
    carry = trailing.select(*keys, "_chunk", F.lag("_open").over(along).alias("_in"))
    joined = local.join(carry, [*keys, "_chunk"], "left")
    length = F.when(F.col("_reset").isNull(), F.col("_rn") + F.coalesce("_in", F.lit(0))).otherwise(F.col("_rn") - F.col("_reset"))
    return joined.withColumn(name, length.cast("bigint")).drop("_chunk", "_rn", "_reset", "_in")


def local_type(kind) -> str:
    return f"decimal({min(38, kind.precision + 10)},{kind.scale})"


def trailing_sums(
    indexed: DataFrame, keys: Sequence[str], index: str, running_sums: dict[str, str], window: int
) -> DataFrame:
    """Sums over the last `window` rows from running sums: S(i) - S(i - window), full windows only.

    Two rows of one key are matched by position, so the work per row is constant.
    """
    earlier = indexed.select(
        *keys, (F.col(index) + window).alias(index), *[F.col(s).alias(f"_before_{n}") for n, s in running_sums.items()]
    )
    full = indexed.where(F.col(index) >= window).join(earlier, [*keys, index], "left")
    outs = [(F.col(s) - F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n) for n, s in running_sums.items()]
    return full.select(*indexed.columns, *outs)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "_rank") -> DataFrame:
    """The first n rows of each key. Spark cuts every map task to n rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
