"""Operator 1: jump consistent hashing of stable keys to shards, in built-in functions only.

A key's shard depends on the key and the number of shards alone. The published
generator (a 64-bit linear congruential step per jump) is computed in exact
decimals, because Spark's long product raises an error on overflow. Appending a
shard moves a key only into the new one.

Slots number the rows of a shard without gaps in key order. No shard passes
through one task: rows are range-partitioned by (shard, key), numbered inside each
range, and the ranges' sizes are summed up in a table of counts.

Edge cases: keys are whole numbers, or strings or bytes, which count by their 64-bit hash (so the string `5` is another
key than the number 5); other types are refused. A null key counts as key 0; a null text has size 1 and checksum 0;
repeated rows are numbered one after another; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.functions.values import bind
from docsieve.llm.registry import table
from docsieve.session import cut

#: Constants of the published algorithm.
FACTOR = 2862933555777941757
WORD = 1 << 64
HIGH = 1 << 33
#: Jumps that are tried for every key. A key jumps about ln(shards) times, so few keys of many shards need more.
STEPS = 48
#: Rows of a range that is numbered in one task.
RANGE_ROWS = 1_000_000


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of a long key among `shards`, 0 at least."""
    unsigned = key.cast("decimal(20,0)") + F.when(key < 0, F.lit(str(WORD)).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))
    state = F.struct(
        F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"), unsigned.cast("decimal(20,0)").alias("seed"),
    )

    def step(s: Column, _: Column) -> Column:
        seed = ((s["seed"] * F.lit(str(FACTOR)).cast("decimal(19,0)") + F.lit(1)) % F.lit(str(WORD)).cast("decimal(20,0)")).cast("decimal(20,0)")
        part = F.floor(seed / F.lit(str(HIGH)).cast("decimal(20,0)")).cast("long") + 1
        target = F.floor((s["next"] + 1).cast("double") * F.lit(float(1 << 31)) / part.cast("double")).cast("long")
        jumped = F.struct(s["next"].alias("shard"), target.alias("next"), seed.alias("seed"))
        return F.when(s["next"] < shards, jumped).otherwise(s)

    def jumps(steps: int, start: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)

    if shards <= STEPS:
        return jumps(shards, state)["shard"].cast("int")
    rest = lambda s: F.when(s["next"] < shards, jumps(shards - STEPS, s)["shard"]).otherwise(s["shard"])
    return bind(jumps(STEPS, state), rest).cast("int")


def key_number(df: DataFrame, key: str) -> Column:
    """The key as a long: whole numbers as they are, strings and bytes by XXH64, null as 0."""
    kind = df.schema[key].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.xxhash64(key)).cast("long")
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"keys are whole numbers, strings or bytes; {key!r} is {kind.simpleString()}")
    return F.coalesce(F.col(key), F.lit(0)).cast("long")


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """Key, size, checksum, shard, slot within the shard and the shard after one more is appended."""
    body = F.coalesce(F.col(text), F.lit(""))
    number = key_number(docs, key)
    placed = cut(docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        jump_hash(number, shards).alias("shard"),
        jump_hash(number, shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"),
    ))
    ranges = max(1, -(-placed.count() // RANGE_ROWS))
    order = ["shard", "doc_id", "text_crc32", "size", "_row"]
    ranged = cut(placed.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("doc_id", "text_crc32", "size", "_row"))
    numbered = ranged.withColumn("_at", inside - 1)
    return numbered.join(offsets, ["shard", "_range"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_before") + F.col("_at")).cast("long").alias("slot"), "grown_shard",
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the key law."""
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op1_sharding": op1_sharding}

#: The generator in huge integers as a recursive query; the checksum byte by byte over a table of 256 remainders.
ORACLES = {"op1_sharding": """
WITH RECURSIVE step AS (
  SELECT i, 0 AS k, i::UBIGINT AS r FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::UBIGINT) ELSE r // 2 END FROM step WHERE k < 8
), remainders AS (SELECT list(r ORDER BY i) AS rem FROM step WHERE k = 8),
jump AS (
  SELECT n, d AS doc_id, -1::BIGINT AS shard, 0::BIGINT AS nxt, (CASE WHEN d < 0 THEN d::HUGEINT + 18446744073709551616 ELSE coalesce(d, 0)::HUGEINT END) AS seed
  FROM (SELECT DISTINCT doc_id AS d FROM documents), (VALUES (16), (17)) v(n)
  UNION ALL
  SELECT n, doc_id, nxt, floor((nxt + 1)::DOUBLE * 2147483648.0 / (((seed * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1)::DOUBLE)::BIGINT,
    (seed * 2862933555777941757 + 1) % 18446744073709551616
  FROM jump WHERE nxt < n
), placed AS (
  SELECT a.doc_id, a.shard, b.shard AS grown_shard FROM jump a JOIN jump b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.n = 16 AND b.n = 17 AND a.nxt >= 16 AND b.nxt >= 17
), sums AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT)),
      lambda c, b: xor(c // 256, rem[(xor(c % 256, b) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM documents, remainders
)
SELECT s.doc_id, s.size::BIGINT AS size, s.text_crc32, 'key' AS law, p.shard::INT AS shard,
  row_number() OVER (PARTITION BY p.shard ORDER BY s.doc_id NULLS FIRST, s.text_crc32, s.size) - 1 AS slot, p.grown_shard::INT AS grown_shard
FROM sums s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id
"""}
