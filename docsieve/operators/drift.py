"""Drift detection in batch (M1-M6, M8, H6, H7): a frozen baseline per key, z-scores, runs of breaches.

`stream` tables carry the key columns, a per-document order column, the text and
two optional signals: `doc_confidence` and `validation_passed`.

A document's profile is one pair of arrays in its row, made where the text is read. The first documents of a
key become one model row (`key_models`): frozen centroid, mean and sigma of each signal, and the last
document of the baseline. Every later document is judged against that row inside its own, so
texts are never shuffled and nothing is joined document by document.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.definition import load_settings
from docsieve.operators import windows
from docsieve.session import cut

# The direction in which each signal is bad, and the 0/1 signals.
DIRECTION = {"doc_confidence": "down", "validation_failure": "up", "text_distance": "up"}
RATE_SIGNALS = ("validation_failure",)
#: Largest table of key models that is broadcast, by rows times the size of a row.
BROADCAST_BYTES = 64 << 20
#: Profiles in an Arrow batch; tokens whose bucket a task remembers.
PROFILE_ROWS, REMEMBERED = 1000, 1 << 20


def settings() -> dict:
    return load_settings("drift")


def bucket_of(token: Column, dim: int) -> Column:
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def profiler(text: str, dim: int):
    """Arrow function: the other columns with `buckets` and `weights` of the text. It refers to nothing outside itself."""
    limit, most = PROFILE_ROWS, REMEMBERED
    token_of = re.compile("[a-z0-9]+")

    def profile(value: str | None, known: dict[str, int]) -> tuple[list[int], list[float]]:
        counts: dict[int, int] = {}
        for token, n in Counter(token_of.findall((value or "").lower())).items():
            bucket = known.get(token)
            if bucket is None:
                if len(known) >= most:
                    known.clear()
                bucket = known[token] = int.from_bytes(hashlib.sha256(token.encode()).digest()[:4], "big") % dim
            counts[bucket] = counts.get(bucket, 0) + n
        raw = [math.log1p(n) for n in counts.values()]
        norm = math.sqrt(sum(w * w for w in raw))
        return list(counts), [w / norm for w in raw]

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, limit):
                part = batch.slice(start, limit)
                pairs = [profile(value.as_py(), known) for value in part.column(text)]
                names = [c for c in part.schema.names if c != text]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array([b for b, _ in pairs], pa.list_(pa.int32())), pa.array([w for _, w in pairs], pa.list_(pa.float64()))],
                    [*names, "buckets", "weights"],
                )

    return run


def profiled(stream: DataFrame, dim: int | None = None) -> DataFrame:
    """The stream's rows with the profile of `text` in its place: `buckets` and `weights`, both empty without tokens. No exchange."""
    kept = [f for f in stream.schema if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    return stream.select(*(f.name for f in kept), "text").mapInArrow(profiler("text", dim or settings()["profile_dim"]), schema)


def text_profile(stream: DataFrame, doc: str, keep: Sequence[str] = (), dim: int | None = None) -> DataFrame:
    """M1: sparse rows (doc, bucket, weight), log1p counts scaled to length one. Texts without tokens have no rows."""
    rows = profiled(stream.select(doc, *keep, "text"), dim)
    return rows.select(doc, *keep, F.inline(F.arrays_zip(F.col("buckets").alias("bucket"), F.col("weights").alias("weight"))))


def cosine_distance(pairs: DataFrame, left: DataFrame, right: DataFrame, on: Sequence[str], ids: tuple[str, str]) -> DataFrame:
    """M2 for the given pairs of sparse profiles (id, bucket columns `on`, weight): 1 - cosine, clamped to [0, 2].

    Profiles without a common bucket are 1 apart; an empty or zero profile is 0 apart from all.
    """
    a, b = ids
    wanted = pairs.select(a, b).distinct()
    norms = lambda df, i, n: df.groupBy(i).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(n))
    common = wanted.join(left.select(a, *on, "weight"), a).join(right.select(b, *on, F.col("weight").alias("_w")), [b, *on])
    dots = common.groupBy(a, b).agg(F.sum(F.col("weight") * F.col("_w")).alias("dot"))
    scaled = wanted.join(norms(left, a, "_na"), a, "left").join(norms(right, b, "_nb"), b, "left").join(dots, [a, b], "left")
    lengths = F.coalesce(F.col("_na") * F.col("_nb"), F.lit(0.0))
    distance = F.when(lengths == 0, 0.0).otherwise(F.lit(1.0) - F.coalesce("dot", F.lit(0.0)) / F.nullif(lengths, F.lit(0.0)))
    return scaled.select(a, b, F.greatest(F.lit(0.0), F.least(F.lit(2.0), distance)).alias("distance"))


def baseline_slice(stream: DataFrame, keys: Sequence[str], order: str | Sequence[str], n: int | None = None) -> DataFrame:
    """H7: the first n documents of each key with their position `_rank`; at most n rows of a key leave a task."""
    columns = [order] if isinstance(order, str) else list(order)
    return windows.top_per_key(stream, keys, [F.col(c) for c in columns], n or settings()["baseline_n"])


def with_models(rows: DataFrame, models: DataFrame, keys: Sequence[str], row_bytes: int) -> DataFrame:
    """Rows beside their key's row of a small cut table: broadcast while that is within bounds, else joined."""
    small = models.count() * row_bytes <= BROADCAST_BYTES
    return rows.join(F.broadcast(models) if small else models, list(keys))


def modeller(keys: Sequence[str], doc: str, order: str, cfg: dict):
    """Pandas function over one key's baseline (at most `baseline_n` rows). It refers to nothing outside itself."""
    signals, rates = list(DIRECTION), set(RATE_SIGNALS)

    def spread(signal: str, values: list[float], mean: float) -> float:
        n = len(values)
        if signal in rates:
            share = (mean * n + 0.5) / (n + 1)
            return max(math.sqrt(share * (1 - share)), cfg["min_std"])
        if n < 2:
            return cfg["min_std"]
        return max(math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1)), cfg["min_std"])

    def model(key, rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values([order, doc])
        total, early, seen = np.zeros(cfg["profile_dim"]), [], {s: [] for s in signals}
        for at, r in enumerate(rows.itertuples(index=False)):
            buckets, weights = np.asarray(r.buckets, np.int64), np.asarray(r.weights, float)
            if at:  # measured against the mean of those before it
                size, own = math.sqrt(total @ total), math.sqrt(weights @ weights)
                away = 1.0 - (total[buckets] @ weights) / (size * own) if size and own else 0.0
                away = max(0.0, min(2.0, away))
                early.append({"doc": getattr(r, doc), "at": getattr(r, order), "value": away})
                seen["text_distance"].append(away)
            total[buckets] += weights
            if not pd.isna(r.doc_confidence):
                seen["doc_confidence"].append(float(r.doc_confidence))
            if not pd.isna(r.validation_passed):
                seen["validation_failure"].append(0.0 if r.validation_passed else 1.0)
        center = total / len(rows)
        out = {**dict(zip(keys, key)), "last_at": rows[order].iloc[-1], "last_doc": rows[doc].iloc[-1], "centroid": center.tolist(), "length": math.sqrt(center @ center), "early": early}
        for s, values in seen.items():
            mean = sum(values) / len(values) if values else None
            out |= {f"n_{s}": len(values), f"mean_{s}": mean, f"sigma_{s}": spread(s, values, mean) if values else None}
        return pd.DataFrame([out])

    return model


def key_models(stream: DataFrame, keys: Sequence[str], doc: str, order: str, cfg: dict | None = None) -> DataFrame:
    """M3 and M4, one row per key over its first documents.

    `centroid` (the mean profile, frozen) and `length`, `early` (distance of each baseline document to the mean of
    those before it), n, mean and sigma of each signal, and the baseline's last document (`last_at`, `last_doc`).
    """
    cfg = {**settings(), **(cfg or {})}
    first = baseline_slice(stream.select(*keys, order, doc), keys, [order, doc], cfg["baseline_n"])
    ends = cut(first.groupBy(*keys).agg(F.max(F.struct(order, doc)).alias("_end")))
    base = with_models(stream.select(*keys, doc, order, "text", "doc_confidence", "validation_passed"), ends, keys, 64)
    base = profiled(base.where(F.struct(order, doc) <= F.col("_end")).drop("_end"), cfg["profile_dim"])
    kind = {f.name: f.dataType.simpleString() for f in stream.schema}
    columns = [f"{k} {kind[k]}" for k in keys] + [
        f"last_at {kind[order]}", f"last_doc {kind[doc]}", "centroid array<double>", "length double", f"early array<struct<doc: {kind[doc]}, at: {kind[order]}, value: double>>",
        *(f"n_{s} bigint, mean_{s} double, sigma_{s} double" for s in DIRECTION),
    ]
    return cut(base.groupBy(*keys).applyInPandas(modeller(list(keys), doc, order, cfg), ", ".join(columns)))


def clamped(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), distance))


def judged(stream: DataFrame, models: DataFrame, keys: Sequence[str], doc: str, order: str, cfg: dict | None = None) -> DataFrame:
    """Every later document beside its key's model, with `text_distance` to the frozen centroid."""
    cfg = {**settings(), **(cfg or {})}
    rows = profiled(stream.select(*keys, doc, order, "text", "doc_confidence", "validation_passed"), cfg["profile_dim"])
    both = with_models(rows, models.drop("early"), keys, 8 * cfg["profile_dim"] + 256).where(F.struct(order, doc) > F.struct("last_at", "last_doc"))
    products = F.zip_with("buckets", "weights", lambda b, w: w * F.get("centroid", b))
    dot = F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
    known = (F.size("buckets") > 0) & (F.col("length") > 0)
    return both.withColumn("text_distance", F.when(known, clamped(1.0 - dot / F.col("length"))).otherwise(0.0)).drop("buckets", "weights", "centroid", "length", "last_at", "last_doc")


def distances(models: DataFrame, late: DataFrame, keys: Sequence[str], doc: str) -> DataFrame:
    """M3 for all documents that have one: (key, doc, value); the first document of a key has none."""
    early = models.select(*keys, F.inline("early")).select(*keys, F.col("doc").alias(doc), "value")
    return early.unionByName(late.select(*keys, doc, F.col("text_distance").alias("value")))


def baseline_stats(models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M4 as rows: n, mean and sigma per (key, signal) that the baseline has."""
    rows = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"n_{s}").alias("n"), F.col(f"mean_{s}").alias("mean"), F.col(f"sigma_{s}").alias("sigma")) for s in DIRECTION])
    return models.select(*keys, F.inline(rows)).where("n > 0")


def centroid(models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M3 as rows: the frozen mean weight per (key, bucket) that occurs, with the centroid's length."""
    return models.select(*keys, "length", F.posexplode("centroid").alias("bucket", "mean_weight")).where("mean_weight > 0")


def z_and_breach(late: DataFrame, keys: Sequence[str], doc: str, order: str, threshold: float | None = None) -> DataFrame:
    """M5: z of every later value and whether it breaches in its bad direction; a missing value leaves its signal out."""
    t = float(threshold if threshold is not None else settings()["z_threshold"])
    values = {"doc_confidence": F.col("doc_confidence").cast("double"), "validation_failure": (~F.col("validation_passed")).cast("double"), "text_distance": F.col("text_distance")}
    rows = F.array(*[
        F.struct(F.lit(s).alias("signal"), v.alias("value"), F.col(f"n_{s}").alias("n"), F.col(f"mean_{s}").alias("mean"), F.col(f"sigma_{s}").alias("sigma")) for s, v in values.items()
    ])
    long = late.select(*keys, doc, order, F.inline(rows)).where(F.col("value").isNotNull() & (F.col("n") >= 2))
    down = F.col("signal").isin(*[s for s, d in DIRECTION.items() if d == "down"])
    scored = long.withColumn("z", (F.col("value") - F.col("mean")) / F.col("sigma"))
    return scored.withColumn("breach", F.when(down, F.col("z") <= -t).otherwise(F.col("z") >= t))


def consecutive_breaches(scored: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """H6: length of the breach run per (key, signal); absent signals neither extend nor reset it."""
    return windows.runs(scored, [*keys, "signal"], [order], "breach", "consecutive")


def drift_flags(run_lengths: DataFrame, later: DataFrame, keys: Sequence[str], doc: str, order: str, k: int | None = None) -> DataFrame:
    """M6 per key: sticky status, signals ever flagged, and the first document that raised a flag."""
    need = k or settings()["consecutive_k"]
    hit = F.col("consecutive") >= need
    flagged = run_lengths.where(hit).groupBy(*keys).agg(
        F.array_sort(F.collect_set("signal")).alias("ever_flagged"),
        F.min_by(doc, order).alias("flagged_document"),
        F.min(order).alias("first_flagged_at"),
    )
    seen = later.groupBy(*keys).agg(F.count("*").alias("n_later"))
    joined = seen.join(flagged, list(keys), "left")
    return joined.withColumn("status", F.when(F.col("ever_flagged").isNotNull(), "drifting").otherwise("stable"))


def drift_status(run_lengths: DataFrame, stats: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """M8: baseline and latest state of each signal."""
    last = run_lengths.groupBy(*keys, "signal").agg(
        F.max_by(F.struct("z", "consecutive"), F.col(order)).alias("_last")
    )
    joined = stats.join(last, [*keys, "signal"], "left")
    return joined.select(
        *keys, "signal", F.round("mean", 6).alias("baseline_mean"), F.col("n").alias("baseline_n"),
        F.round(F.col("_last.z"), 3).alias("last_z"), F.coalesce(F.col("_last.consecutive"), F.lit(0)).alias("consecutive"),
    )


class DriftPlan:
    """All batch stages over one stream table, each one a DataFrame. The models of the keys are built once."""

    def __init__(self, stream: DataFrame, keys: Sequence[str] = ("tenant_id", "doc_type"), doc: str = "doc_id", order: str = "seq"):
        self.keys, self.doc, self.order, self.stream = list(keys), doc, order, stream
        self.models = key_models(stream, self.keys, doc, order)
        self.stats = baseline_stats(self.models, self.keys)
        self.centers = centroid(self.models, self.keys)

    @property
    def later(self) -> DataFrame:
        ends = self.models.select(*self.keys, "last_at", "last_doc")
        return with_models(self.stream.drop("text"), ends, self.keys, 64).where(F.struct(self.order, self.doc) > F.struct("last_at", "last_doc")).drop("last_at", "last_doc")

    @property
    def profiles(self) -> DataFrame:
        return text_profile(self.stream, self.doc, self.keys)

    @property
    def judged(self) -> DataFrame:
        return judged(self.stream, self.models, self.keys, self.doc, self.order)

    @property
    def distances(self) -> DataFrame:
        return distances(self.models, self.judged, self.keys, self.doc)

    @property
    def scored(self) -> DataFrame:
        return z_and_breach(self.judged, self.keys, self.doc, self.order)

    def runs(self) -> DataFrame:
        return consecutive_breaches(self.scored, self.keys, self.order)

    def flags(self) -> DataFrame:
        return drift_flags(self.runs(), self.later, self.keys, self.doc, self.order)

    def status(self) -> DataFrame:
        return drift_status(self.runs(), self.stats, self.keys, self.order)
