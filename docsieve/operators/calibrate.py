"""Threshold calibration."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsieve.definition import FEATURES
from docsieve.session import cut

# The sweep grid, the coverage limits of an operating point and the frontier's targets.
GRID = 200
MIN_RATE = 0.05
COVERAGE_TOLERANCE = 0.02
TARGETS = (0.995, 0.99, 0.985, 0.98, 0.97, 0.95)


def calibration_rows(features: DataFrame, correctness: DataFrame, classes: DataFrame) -> DataFrame:
    """Long (doc, field) rows with features, correctness (1 unless known) and fault class."""
    labelled = features.join(correctness, ["doc_id", "field"], "left").join(classes, "doc_id", "left")
    return labelled.withColumns(
        {"correct": F.coalesce("correct", F.lit(1)), "error_class": F.coalesce("error_class", F.lit("unknown"))}
    )


def _edge(i: Column, parts: int) -> Column:
    """The i-th of parts + 1 evenly spaced points from 0 to 1, as multiples of the step with an exact end."""
    return F.when(i >= parts, F.lit(1.0)).otherwise(i.cast("double") * F.lit(1.0 / parts))


def _bin_of(p: Column, parts: int) -> Column:
    """The largest i whose edge is <= p. A plain floor is off by one where edges are inexact, so the neighbours decide."""
    guess = F.least(F.floor(p * parts).cast("int"), F.lit(parts))
    up = (guess < parts) & (_edge(guess + 1, parts) <= p)
    return F.when(up, guess + 1).when(_edge(guess, parts) > p, guess - 1).otherwise(guess)


def sweep(scores: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Approve rate and precision at 201 thresholds, from one pass over the scores.

    Scores are counted per grid bin; each threshold is then a suffix sum over at most 201 bins.
    """
    bins = scores.groupBy(_bin_of(F.col(p), GRID).alias("i")).agg(
        F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("right")
    )
    grid = scores.sparkSession.range(GRID + 1).select(F.col("id").cast("int").alias("i"))
    filled = grid.join(bins, "i", "left").na.fill(0, ["n", "right"])
    above = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everyone = Window.partitionBy()
    approved, right = F.sum("n").over(above), F.sum("right").over(above)
    return filled.select(
        _edge(F.col("i"), GRID).alias("threshold"),
        (approved / F.sum("n").over(everyone)).alias("rate"),
        F.when(approved > 0, right / approved).otherwise(F.lit(1.0)).alias("precision"),
    )


def operating_point(curve: DataFrame, targets: Sequence[float] = (0.99,)) -> DataFrame:
    """Per target, the most precise point within 0.02 of the widest feasible coverage.

    Without a feasible point the best usable one is reported as not met. The curve has 201 rows.
    """
    grid = curve.select(F.array(*[F.lit(float(t)) for t in targets]).alias("_t"), "*")
    rows = grid.select(F.explode("_t").alias("target"), "threshold", "rate", "precision")
    usable = F.col("rate") >= MIN_RATE
    feasible = usable & (F.col("precision") >= F.col("target"))
    widest = F.max(F.when(feasible, F.col("rate"))).over(Window.partitionBy("target"))
    marked = rows.withColumn("_widest", widest)
    affordable = feasible & (F.col("rate") >= F.col("_widest") - COVERAGE_TOLERANCE)
    best = lambda keep: F.max_by(
        F.struct("threshold", "rate", "precision"), F.when(keep, F.struct("precision", "rate", (-F.col("threshold")).alias("low")))
    )
    picked = marked.groupBy("target").agg(best(affordable).alias("_good"), best(usable).alias("_any"), F.max("_widest").alias("_w"))
    met = F.col("_w").isNotNull()
    nothing = F.struct(F.lit(1.0).alias("threshold"), F.lit(0.0).alias("rate"), F.lit(1.0).alias("precision"))
    point = F.when(met, F.col("_good")).otherwise(F.coalesce("_any", nothing))
    return picked.select("target", met.alias("met"), point.alias("_p")).select("target", "met", "_p.*")


def frontier(curve: DataFrame) -> DataFrame:
    """O7."""
    return operating_point(curve, TARGETS)


def reliability_bins(scores: DataFrame, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """Mean prediction, share correct and size per bin; the last bin is closed, empty ones are left out."""
    return scores.groupBy(F.least(_bin_of(F.col(p), bins), F.lit(bins - 1)).alias("bin")).agg(
        F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"), F.count("*").alias("n")
    )


def breakdown(scores: DataFrame, key: str, threshold: float) -> DataFrame:
    """Size, approve rate, precision (NaN when nothing is approved) and recall of errors per group."""
    ok, wrong = F.col("p") >= threshold, F.col("y") == 0
    missed, errors = F.count_if(ok & wrong), F.count_if(wrong)
    return scores.groupBy(key).agg(
        F.count("*").alias("n"),
        F.avg(ok.cast("double")).alias("approve_rate"),
        F.coalesce(F.avg(F.when(ok, F.col("y").cast("double"))), F.lit(float("nan"))).alias("precision"),
        (F.lit(1.0) - missed / F.greatest(errors, F.lit(1))).alias("recall_of_errors"),
    )


def surviving_errors(scores: DataFrame, threshold: float) -> DataFrame:
    """Wrong fields that would still be approved."""
    kept = scores.where((F.col("p") >= threshold) & (F.col("y") == 0))
    return kept.groupBy("error_class", "field").agg(F.count("*").alias("n"))


def _newton_sums(z: list[Column], weights: Sequence[float], label: Column, times: Column) -> list[Column]:
    """Loss, gradient and upper half of the Gram matrix, weighted by p (1 - p), as plain sums at the given weights."""
    margin = F.lit(float(weights[-1]))
    for w, c in zip(weights, z[:-1]):
        margin = margin + F.lit(float(w)) * c
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_margin")))
    loss = F.greatest(F.col("_margin"), F.lit(0.0)) - label * F.col("_margin") + F.log1p(F.exp(-F.abs(F.col("_margin"))))
    curve = times * p * (F.lit(1.0) - p)
    half = [F.sum(curve * z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]
    return [margin.alias("_margin"), F.sum(times * loss), *[F.sum(times * (p - label) * c) for c in z], *half]


def fit_logistic(rows: DataFrame, names: Sequence[str] = FEATURES, l2: float = 1.0, max_iter: int = 60, tol: float = 1e-12, still: float = 1e-9) -> dict:
    """Standardised, L2-regularised logistic regression; weights, bias, mean and deviation.

    Newton's method over an aggregated Gram matrix. Equal feature vectors are counted once; a step is one aggregate
    without keys over the distinct ones (loss, gradient and the upper half of the matrix, partial sums in each task), and the driver
    solves a system with one unknown per feature and one for the bias. A step that does not lower the loss is halved. The
    penalty l2 / 2 is on the weights alone.

    Rows with a NULL feature or label are left out; without rows there is nothing to fit and a ValueError is raised. A
    constant feature has the deviation 1e-9 and the weight 0. The fit ends with a step that moves no weight by more than
    `still`, which does not depend on the number of rows. With one label alone the bias has no optimum: that fit
    stops where the gradient per row is below `tol`, or after `max_iter` steps.
    """
    import numpy as np

    whole = rows.select(*[F.col(c).cast("double").alias(c) for c in names], F.col("correct").cast("double").alias("_label")).na.drop()
    distinct = cut(whole.groupBy(*names, "_label").agg(F.count("*").cast("double").alias("_times")))
    times = F.col("_times")
    n, low, high, *means = distinct.agg(F.sum(times), F.min("_label"), F.max("_label"), *[F.sum(times * F.col(c)) / F.sum(times) for c in names]).first()
    if not n:
        raise ValueError("there are no rows to fit")
    spread = distinct.agg(*[F.sqrt(F.sum(times * (F.col(c) - F.lit(m)) * (F.col(c) - F.lit(m))) / F.sum(times)) for c, m in zip(names, means)]).first()
    std = [s + 1e-9 for s in spread]
    z = [(F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(names, means, std)]
    scaled = distinct.select(*[c.alias(f"_z{i}") for i, c in enumerate(z)], F.lit(1.0).alias(f"_z{len(z)}"), "_label", "_times")
    size = len(names) + 1
    columns = [F.col(f"_z{i}") for i in range(size)]
    penalty = np.array([l2] * (size - 1) + [0.0])
    upper = np.triu_indices(size)

    def sums_at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        margin, *sums = _newton_sums(columns, w.tolist(), F.col("_label"), times)
        loss, *rest = scaled.withColumn("_margin", margin).agg(*sums).first()
        gram = np.zeros((size, size))
        gram[upper] = rest[size:]
        gram = gram + np.triu(gram, 1).T + np.diag(penalty)
        return loss + float(penalty @ (w * w)) / 2, np.array(rest[:size]) + penalty * w, gram

    w = np.zeros(size)
    loss, gradient, gram = sums_at(w)
    for _ in range(max_iter):
        if low == high and np.abs(gradient).max() <= tol * n:
            break
        step, share = np.linalg.solve(gram, gradient), 1.0
        if np.abs(step).max() <= still:
            w = w - step
            break
        tried = sums_at(w - step)
        while tried[0] > loss + 1e-12 * abs(loss) and share > 1e-6:
            share /= 2
            tried = sums_at(w - share * step)
        w = w - share * step
        loss, gradient, gram = tried
    return {"weights": [float(v) for v in w[:-1]], "bias": float(w[-1]), "mean": list(means), "std": std, "rows": int(n)}


def predict(rows: DataFrame, fit: dict, names: Sequence[str] = FEATURES) -> DataFrame:
    z = F.lit(fit["bias"])
    for c, w, m, s in zip(names, fit["weights"], fit["mean"], fit["std"]):
        z = z + F.lit(w) * ((F.col(c) - F.lit(m)) / F.lit(s))
    return rows.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def model_artifact(spark: SparkSession, fit: dict, point: DataFrame, slug: str, version: int, names: Sequence[str] = FEATURES) -> DataFrame:
    """The model file as one row of JSON, ready for `load_confidence_model`."""
    head = {
        "schema_version": 2, "model": "logistic", "features": list(names), "weights": fit["weights"], "bias": fit["bias"],
        "standardization": {"mean": fit["mean"], "std": fit["std"]},
        "calibrated_for": {"pipeline_slug": slug, "pipeline_version": version}, "provenance": {"train_rows": fit["rows"]},
    }
    body = F.lit(json.dumps(head)[:-1])
    best = F.to_json(F.struct("threshold", F.col("target").alias("target_precision"), F.col("met").alias("target_met"), F.col("precision").alias("measured_precision"), F.col("rate").alias("auto_approve_rate")))
    return point.select(F.concat(body, F.lit(', "operating_point": '), best, F.lit("}")).alias("json"))
