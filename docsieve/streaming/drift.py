"""M7: drift observation as keyed streaming state, one observation per arriving document."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from docsieve.operators import drift

#: Fixed value: the store that this state needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTPUT = (
    "tenant_id string, doc_type string, doc_id bigint, n_observed bigint, status string, z_doc_confidence double, "
    "z_validation_failure double, z_text_distance double, breaching string, flagged string, newly_flagged boolean"
)
SIGNALS = tuple(drift.DIRECTION)
#: Per signal: documents, mean, sum of squared deviations, breaches in a row, last z.
STATS = ", ".join(f"{s}_n bigint, {s}_mean double, {s}_m2 double, {s}_run bigint, {s}_z double" for s in SIGNALS)
#: Documents, the last signals that were flagged (null: none ever), the first document that was, and the figures per signal.
SEEN = f"n bigint, flags string, first_flagged bigint, {STATS}"


def observer(settings: dict | None = None) -> StatefulProcessor:
    """The state of one key: counts and running moments in `seen`, the mean profile in `center`.

    The class is built here and refers to nothing outside, so executors need no copy of the package. The profile is
    read back and written only while the baseline is collected; afterwards it does not change.
    """
    cfg = {**drift.settings(), **(settings or {})}
    down = {s for s, d in drift.DIRECTION.items() if d == "down"}
    rates, signals, seen_schema = set(drift.RATE_SIGNALS), SIGNALS, SEEN

    class Observer(StatefulProcessor):
        def init(self, handle) -> None:
            self.seen = handle.getValueState("seen", seen_schema)
            self.center = handle.getValueState("center", "profile array<double>")

        def close(self) -> None:
            pass

        def sigma(self, signal: str, s: dict) -> float:
            if signal in rates:
                p = (s["mean"] * s["n"] + 0.5) / (s["n"] + 1)
                return max(math.sqrt(p * (1 - p)), cfg["min_std"])
            return cfg["min_std"] if s["n"] < 2 else max(math.sqrt(s["m2"] / (s["n"] - 1)), cfg["min_std"])

        def handleInputRows(self, key, rows, timerValues):
            import numpy as np

            n, flags, first, stats = 0, None, None, {s: {"n": 0, "mean": 0.0, "m2": 0.0, "run": 0, "z": None} for s in signals}
            if self.seen.exists():
                n, flags, first, *flat = self.seen.get()
                for i, s in enumerate(signals):
                    stats[s] = dict(zip(("n", "mean", "m2", "run", "z"), flat[5 * i : 5 * i + 5]))
            center = np.array(self.center.get()[0], float) if self.center.exists() else None
            size = math.sqrt(center @ center) if center is not None else 0.0
            moved = False
            # a micro-batch is bounded, so these are few and narrow rows; they come unordered
            arrived = pd.concat(list(rows)).sort_values(["seq", "doc_id"])
            out = []
            for r in arrived.itertuples(index=False):
                values = {}
                if not pd.isna(r.doc_confidence):
                    values["doc_confidence"] = float(r.doc_confidence)
                if not pd.isna(r.validation_passed):
                    values["validation_failure"] = 0.0 if r.validation_passed else 1.0
                if center is not None and len(center) == cfg["profile_dim"]:
                    dot = center[np.asarray(r.buckets, np.int64)] @ np.asarray(r.weights, float)
                    values["text_distance"] = max(0.0, min(2.0, 1.0 - float(dot) / size)) if size and len(r.buckets) else 0.0
                n += 1
                z, breaching = {}, []
                if n <= cfg["baseline_n"]:
                    for s, v in values.items():
                        have = stats[s]
                        have["n"] += 1
                        away = v - have["mean"]
                        have["mean"] += away / have["n"]
                        have["m2"] += away * (v - have["mean"])
                    if center is None or len(center) != cfg["profile_dim"]:
                        center = np.zeros(cfg["profile_dim"])
                        center[np.asarray(r.buckets, np.int64)] = np.asarray(r.weights, float)
                    else:
                        center = center - center / n
                        center[np.asarray(r.buckets, np.int64)] += np.asarray(r.weights, float) / n
                    size, moved = math.sqrt(center @ center), True
                    status = "stable" if n >= cfg["baseline_n"] else "baseline"
                else:
                    status = "stable"
                    for s, v in values.items():
                        have = stats[s]
                        if have["n"] < 2:
                            continue
                        have["z"] = z[s] = (v - have["mean"]) / self.sigma(s, have)
                        bad = z[s] <= -cfg["z_threshold"] if s in down else z[s] >= cfg["z_threshold"]
                        have["run"] = have["run"] + 1 if bad else 0
                        if bad:
                            breaching.append(s)
                flagged = sorted(s for s in signals if stats[s]["run"] >= cfg["consecutive_k"])
                fresh = bool(flagged) and flags is None
                if fresh:
                    first = int(r.doc_id)
                if flagged:
                    flags = ",".join(flagged)
                if flags is not None:
                    status = "drifting"
                out.append((*key, int(r.doc_id), n, status, *(z.get(s) for s in signals), ",".join(sorted(breaching)), ",".join(flagged), fresh))
            self.seen.update((n, flags, first, *(v for s in signals for v in stats[s].values())))
            if moved:
                self.center.update((center.tolist(),))
            names = ["tenant_id", "doc_type", "doc_id", "n_observed", "status", *(f"z_{s}" for s in signals), "breaching", "flagged", "newly_flagged"]
            yield pd.DataFrame(out, columns=names).astype({f"z_{s}": "float64" for s in signals})

    return Observer()


def observe(stream: DataFrame, settings: dict | None = None) -> DataFrame:
    """M7 over a stream of (tenant_id, doc_type, doc_id, seq, text, doc_confidence, validation_passed).

    Profiles are made before the state operator, spread over all tasks; the state keeps moments and one mean profile per
    key, never documents. A micro-batch has to be bounded by its source (`maxFilesPerTrigger`, `maxBytesPerTrigger`)
    and to come in the order of `seq`; rows of one micro-batch may come in any order. A stream of rows that
    `drift.profiled` has already read carries `buckets` and `weights` in the place of `text`.
    """
    stream.sparkSession.conf.set(*STORE)
    dim = {**drift.settings(), **(settings or {})}["profile_dim"]
    signals = ("tenant_id", "doc_type", "doc_id", "seq", "doc_confidence", "validation_passed")
    ready = "buckets" in stream.columns
    narrow = stream.select(*signals, "buckets", "weights") if ready else drift.profiled(stream.select(*signals, "text"), dim)
    return narrow.groupBy("tenant_id", "doc_type").transformWithStateInPandas(
        statefulProcessor=observer(settings), outputStructType=OUTPUT, outputMode="Append", timeMode="None",
    )


def stored_keys(spark: SparkSession, checkpoint: str) -> DataFrame:
    """M8 from the stream's own state, as of the last finished micro-batch: one row per key.

    `signals` maps each signal that the baseline has to its mean, count, last z and breaches in a row.
    """
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "seen").load()
    held = lambda s: F.struct(
        F.lit(s).alias("key"),
        F.struct(F.round(f"value.{s}_mean", 6).alias("baseline_mean"), F.col(f"value.{s}_n").alias("baseline_n"), F.round(f"value.{s}_z", 3).alias("last_z"), F.col(f"value.{s}_run").alias("consecutive")).alias("value"),
    )
    known = F.filter(F.array(*[held(s) for s in SIGNALS]), lambda e: e["value"]["baseline_n"] > 0)
    status = F.when(F.col("value.flags").isNotNull(), "drifting").when(F.col("value.n") >= drift.settings()["baseline_n"], "stable").otherwise("baseline")
    return state.select(
        F.col("key.tenant_id").alias("tenant_id"), F.col("key.doc_type").alias("doc_type"), status.alias("status"), F.col("value.n").alias("n_observed"),
        F.col("value.flags").alias("flagged_signals"), F.col("value.first_flagged").alias("first_flagged"), F.map_from_entries(known).alias("signals"),
    )
