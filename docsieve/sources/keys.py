"""The keys of stored documents: a few sorted segments with a Bloom index, merged level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions.tables import literal_table
from docsieve.sources.tables import path_exists

KEY = ("tenant_id", "sha256")
#: Words of a block of the Bloom index, one bit of each is set by a key, and keys that share a block on average: 16 bits a key.
WORDS, KEYS_PER_BLOCK = 8, 32
#: Keys of a file, and blocks of a file of the index.
FILE_KEYS, FILE_BLOCKS = 2_000_000, 500_000


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64(*KEY), blocks)


def _masks() -> list[Column]:
    """The bit that a key sets in each word of its block."""
    other = F.xxhash64(F.lit("bits"), *KEY)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(other, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


class KeyStore:
    """Which (tenant, hash) pairs earlier micro-batches stored.

    A micro-batch adds one segment: its keys sorted by `part` (the first two digits of the hash), and an index of
    blocks of 512 bits, one block per key. When `fan` segments stand on a level they become one of the next,
    so n batches leave fewer than `fan` segments on each of log(n) levels, and a key is rewritten once per level. Lookups
    join the arrivals with their blocks of every segment; only segments and parts that may hold an arrival are then read, and
    compared with exactly.

    The manifest of batch n names the segments that hold after it. A batch that runs again starts from the newest manifest below
    its number, so it neither sees nor repeats its own keys. Folders that the newest earlier manifest does not name are
    deleted at the start of a batch, when no retry can need them. One writer at a time. The driver holds one row per
    segment, and the parts that candidates lie in (256 a segment at most).
    """

    def __init__(self, spark: SparkSession, root: str, fan: int = 8):
        self.spark, self.root, self.fan = spark, root.rstrip("/"), fan
        self._asked: list[DataFrame] = []

    def _children(self, folder: str) -> list[str]:
        if not path_exists(self.spark, f"{self.root}/{folder}"):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        return [f.getPath().getName() for f in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)]

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def segments(self, before: int) -> list[dict]:
        """What the newest complete manifest below a batch's number names."""
        numbers = sorted((int(n) for n in self._children("manifests") if int(n) < before), reverse=True)
        for n in numbers:
            if path_exists(self.spark, f"{self.root}/manifests/{n}/_SUCCESS"):
                rows = self.spark.read.schema("name string, level int, keys bigint, blocks bigint").json(f"{self.root}/manifests/{n}").collect()
                return [{**r.asDict(), "manifest": n} for r in rows]
        return []

    def tidy(self, before: int) -> None:
        """Delete what the manifest that a batch starts from does not name. A batch older than the newest one is refused."""
        if any(int(n) > before for n in self._children("manifests")):
            raise ValueError(f"{self.root} holds later batches than {before}: a stream that starts anew needs a folder of its own")
        live = self.segments(before)
        names = {s["name"] for s in live}
        for folder in ("data", "index"):
            for name in self._children(folder):
                if name not in names:
                    self._delete(f"{folder}/{name}")
        for n in self._children("manifests"):
            if live and int(n) < live[0]["manifest"]:
                self._delete(f"manifests/{n}")

    def _data(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema("part string, tenant_id string, sha256 string").parquet(*[f"{self.root}/data/{n}" for n in names])

    def candidates(self, arrivals: DataFrame, before: int) -> DataFrame | None:
        """(tenant, hash, part, segment) where the index does not exclude a stored key; None without segments."""
        live = [s for s in self.segments(before) if s["keys"]]
        if not live:
            return None
        listed = F.array(*[F.struct(F.lit(s["name"]).alias("segment"), F.lit(s["blocks"]).cast("long").alias("blocks")) for s in live])
        asked = arrivals.select(*KEY).distinct().select(*KEY, *[m.alias(f"_m{i}") for i, m in enumerate(_masks())], F.inline(listed))
        asked = asked.withColumn("block", _block(F.col("blocks"))).drop("blocks")
        words = ", ".join(f"w{i} bigint" for i in range(WORDS))
        index = self.spark.read.schema(f"segment string, block bigint, {words}").parquet(*[f"{self.root}/index/{s['name']}" for s in live])
        found = asked.join(index, ["segment", "block"])
        for i in range(WORDS):
            found = found.where(F.col(f"w{i}").bitwiseAND(F.col(f"_m{i}")) != 0)
        return found.select(*KEY, F.substring("sha256", 1, 2).alias("part"), "segment")

    def unknown(self, arrivals: DataFrame, before: int) -> DataFrame:
        """The arrivals whose key no earlier batch stored."""
        maybe = self.candidates(arrivals, before)
        if maybe is None:
            return arrivals
        maybe = maybe.persist()
        where = maybe.select("segment", "part").distinct().collect()
        self._asked.append(maybe)
        if not where:
            return arrivals
        stored = self._data(sorted({r["segment"] for r in where})).where(F.col("part").isin(sorted({r["part"] for r in where})))
        known = stored.join(maybe.select(*KEY).distinct(), list(KEY), "left_semi").select(*KEY)
        return arrivals.join(known, list(KEY), "left_anti")

    def _write(self, keys: DataFrame, name: str) -> tuple[int, int]:
        """A segment and its index; returns its keys and blocks."""
        count = keys.count()
        blocks = max(1, -(-count // KEYS_PER_BLOCK))
        files = max(1, -(-count // FILE_KEYS))
        dealt = keys.coalesce(1) if files == 1 else keys.repartitionByRange(files, "part", "sha256")
        dealt.select("part", *KEY).sortWithinPartitions("part", "sha256").write.mode("overwrite").parquet(f"{self.root}/data/{name}")
        masks = keys.select(_block(F.lit(blocks)).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks())])
        rows = masks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]).select(F.lit(name).alias("segment"), "*")
        files = max(1, -(-blocks // FILE_BLOCKS))
        (rows.coalesce(1) if files == 1 else rows.repartitionByRange(files, "block")).write.mode("overwrite").parquet(f"{self.root}/index/{name}")
        return count, blocks

    def add(self, keys: DataFrame, number: int) -> None:
        """Store the keys of a batch (none of them stored before), and merge levels that are full."""
        live = [{k: s[k] for k in ("name", "level", "keys", "blocks")} for s in self.segments(number)]
        level, full = 0, []
        while True:
            same = [s for s in live if s["level"] == level]
            if len(same) + 1 < self.fan:
                break
            full, level = full + same, level + 1
        fresh = keys.select(F.substring("sha256", 1, 2).alias("part"), *KEY)
        merged = fresh.unionByName(self._data([s["name"] for s in full])) if full else fresh
        name = f"{level}-{number}"
        count, blocks = self._write(merged, name)
        held = [s for s in live if s not in full] + [{"name": name, "level": level, "keys": count, "blocks": blocks}]
        rows = literal_table(self.spark, ["name", "level", "keys", "blocks"], [tuple(s.values()) for s in held])
        rows.coalesce(1).write.mode("overwrite").json(f"{self.root}/manifests/{number}")
        while self._asked:
            self._asked.pop().unpersist()
