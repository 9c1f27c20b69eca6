"""Golden-set evaluation and experiment summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.definition import ConfidenceModel, Definition, FieldSpec, load_settings
from docsieve.functions.tables import literal_table, with_struct
from docsieve.functions.values import canonical_fields, estimate_tokens, norm_by_kind, parse_gate
from docsieve.operators import evidence, reading, rules, scoring, windows
from docsieve.operators.drift import DIRECTION
from docsieve.session import cut

# Fixed value: how many documents of a type are set aside for evaluation.
GOLDEN_SIZE = 100


def golden_split(labels: DataFrame, size: int = GOLDEN_SIZE, kind: str = "doc_type", doc: str = "doc_id") -> DataFrame:
    """H2: per type, the first min(size, max(1, n // 3)) labels in hash order."""
    counts = labels.groupBy(kind).agg(F.count("*").alias("_n"))
    order = [F.sha2(F.col(doc).cast("string"), 256), F.col(doc)]
    ranked = windows.top_per_key(labels, [kind], order, size).join(counts, kind)
    wanted = F.least(F.lit(size), F.greatest(F.lit(1), F.floor(F.col("_n") / 3)))
    return ranked.where(F.col("_rank") <= wanted).drop("_n", "_rank")


def train_holdout(rows: DataFrame, golden: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Everything outside the golden set, and everything inside."""
    ids = golden.select(doc)
    return rows.join(ids, doc, "left_anti"), rows.join(ids, doc, "left_semi")


def matches(kind: str, extracted: Column, expected: Column, canonical: bool = True) -> Column:
    """Equality by field kind; missing or unreadable values never match."""
    if not canonical:
        extracted, expected = norm_by_kind(extracted, kind), norm_by_kind(expected, kind)
    return F.coalesce(extracted == expected, F.lit(False))


def _row_matches(spec: FieldSpec, canonical: bool):
    def both(pair: Column) -> Column:
        same = F.lit(True)
        for c in spec.columns.values():
            same = same & matches(c.kind, pair["x"][c.name], pair["y"][c.name], canonical)
        return same

    return both


def compare(record: Column, expected: Column, definition: Definition, canonical: bool = True) -> dict[str, Column]:
    """One boolean per field; a table matches when it has the same length and every cell is equal."""
    out = {}
    for name, spec in definition.fields.items():
        if spec.kind != "table":
            out[name] = matches(spec.kind, record[name], expected[name], canonical)
            continue
        ours, theirs = F.coalesce(record[name], F.array()), F.coalesce(expected[name], F.array())
        pairs = F.zip_with(ours, theirs, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        out[name] = (F.size(ours) == F.size(theirs)) & F.forall(pairs, _row_matches(spec, canonical))
    return out


def field_results(compared: DataFrame, definition: Definition, keep: Sequence[str], prefix: str = "ok") -> DataFrame:
    """P4 long: (keep…, field, correct)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"{prefix}_{n}").alias("correct")) for n in definition.fields])
    return compared.select(*keep, F.inline_outer(pairs))


# Micro-dollars a token in and out by tier, and the tokens of an answer, as the evaluation prices its calls.
PRICES = {"small": (1, 5), "frontier": (5, 25)}
ANSWER_TOKENS = 256


def read_both_tiers(pages: DataFrame, definition: Definition, hints: dict, tiers: dict, model: ConfidenceModel) -> DataFrame:
    """Pages read by both tiers: canonical records, cost, and why the small tier's answer is escalated (NULL: it is kept).

    `pages` has doc_id, layout, text and `expected`, the true record. Pages without enough text need OCR and are not escalated.
    `reread` is false where both tiers read the same, so that the records are equal; only other pages are read twice.
    """
    fields = list(definition.fields)
    out = pages.withColumn("needs_ocr", parse_gate(F.col("text")) == "needs_ocr")
    for tier, (given, answered) in PRICES.items():
        micros = (estimate_tokens(F.col("text")) * given + ANSWER_TOKENS * answered).cast("decimal(18,0)")
        out = out.withColumn(f"cost_{tier}", (micros * F.expr("0.000001BD")).cast("decimal(12,6)"))
    out = reading.extract_record(out, hints, tiers["small"], fields, output="_raw")
    out = with_struct(out, "rec_small", canonical_fields(F.col("_raw"), definition))
    out = out.withColumn("reread", reading.reads_anew(tiers["small"], tiers["frontier"], hints, raw="_raw")).drop("_raw")
    # a page that both read alike has no second text, so that its second reading costs next to nothing
    out = out.withColumn("_again", F.when(F.col("reread"), F.col("text")))
    out = reading.extract_record(out, hints, tiers["frontier"], fields, text="_again", output="_raw")
    anew = canonical_fields(F.col("_raw"), definition)
    out = with_struct(out, "rec_frontier", {n: F.when(F.col("reread"), c).otherwise(F.col("rec_small")[n]) for n, c in anew.items()}).drop("_raw", "_again")
    judged = scoring.route_extraction(evidence.with_signals(out, definition, record="rec_small"), definition, model)
    passed = rules.validation_passed(scoring.RULE, definition)
    reason = scoring.escalation_trigger(definition.policy, F.lit(False), passed, F.col("decision"))
    return judged.withColumn("trigger", F.when(~F.col("needs_ocr"), reason)).select(
        "doc_id", "layout", "needs_ocr", "trigger", "reread", "expected", "rec_small", "rec_frontier", "cost_small", "cost_frontier"
    )


def judge_modes(both: DataFrame, definition: Definition) -> DataFrame:
    """One row per (document, mode) of `read_both_tiers`, in a form that is the same for every document type.

    Columns: doc_type, doc_id, layout, needs_ocr, mode (single: the strong tier alone; routed: the small tier first),
    escalated, cost_usd and `judged`, an array of (field, correct). Types can be united and judged by one plan.
    """

    def results(ok: dict[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("field"), c.alias("correct")) for n, c in ok.items()])

    judged = {tier: results(compare(F.col(f"rec_{tier}"), F.col("expected"), definition)) for tier in PRICES}
    both = both.withColumn("_small", judged["small"])
    both = both.withColumn("_frontier", F.when(F.col("reread"), judged["frontier"]).otherwise(F.col("_small")))
    again = F.col("trigger").isNotNull()

    def mode(name: str, escalated: Column, cost: Column, result: Column) -> Column:
        return F.struct(F.lit(name).alias("mode"), escalated.alias("escalated"), cost.cast("decimal(12,6)").alias("cost_usd"), result.alias("judged"))

    routed_cost = F.col("cost_small") + F.when(again, F.col("cost_frontier")).otherwise(F.lit(0))
    single = mode("single", F.lit(False), F.col("cost_frontier"), F.col("_frontier"))
    routed = mode("routed", again, routed_cost, F.when(again, F.col("_frontier")).otherwise(F.col("_small")))
    modes = F.array(single, routed) if definition.policy.escalate_to else F.array(single)
    return both.select(F.lit(definition.slug).alias("doc_type"), "doc_id", "layout", "needs_ocr", F.inline(modes))


def judged_fields(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """`judge_modes` long: (keep…, field, correct) of digital pages."""
    # a plain filter would be pushed below the pages and print each of them once more
    return rows.select(*keep, F.inline(F.when(~F.col("needs_ocr"), F.col("judged"))))


def accuracy_matrix(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Percent correct by field and layout with all margins; `all` marks a margin. Results exclude needs_ocr."""
    grouped = results.groupBy(*keys, "field", "layout", "correct").agg(F.count("*").alias("n"))
    margins = F.explode(
        F.array(*[F.struct(f.alias("field"), l.alias("layout")) for f in (F.col("field"), F.lit("all")) for l in (F.col("layout"), F.lit("all"))])
    )
    spread = grouped.select(*keys, "correct", "n", margins.alias("m"))
    right = F.sum(F.when(F.col("correct"), F.col("n")).otherwise(0))
    return spread.groupBy(*keys, F.col("m.field").alias("field"), F.col("m.layout").alias("layout")).agg(
        F.sum("n").alias("cells"), (F.lit(100.0) * right / F.sum("n")).alias("accuracy")
    )


def cost_note(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """G7 over one row per (document, mode): mean cost routed and single, escalated share, saving, accuracies, per `keys`."""
    # conditions instead of a filter, which would be pushed below the pages and print each of them once more
    digital = ~F.col("needs_ocr")
    mode = lambda m, c: F.when(digital & (F.col("mode") == m), c)
    agg = results.groupBy(*keys).agg(
        F.count_if(digital).alias("_digital"),
        F.avg(mode("routed", F.col("cost_usd").cast("double"))).alias("routed_cost"),
        F.avg(mode("single", F.col("cost_usd").cast("double"))).alias("single_cost"),
        F.count_if(digital & (F.col("mode") == "routed") & F.col("escalated")).alias("escalated"),
        F.count_if(digital & (F.col("mode") == "routed")).alias("documents"),
        *[
            (F.lit(100.0) * F.sum(mode(m, F.col("correct"))) / F.sum(mode(m, F.col("total")))).alias(f"{m}_accuracy")
            for m in ("routed", "single")
        ],
    )
    single = F.col("single_cost")
    agg = (agg.where("_digital > 0") if keys else agg).drop("_digital")
    return agg.withColumns(
        {
            "escalated_percent": F.lit(100.0) * F.col("escalated") / F.col("documents"),
            "saving_percent": F.when(single > 0, (F.lit(1.0) - F.col("routed_cost") / single) * 100).otherwise(F.lit(0.0)),
            "cost_share": F.when(single > 0, F.col("routed_cost") / single).otherwise(F.lit(0.0)),
        }
    )


def gate_checks(accuracy: DataFrame) -> DataFrame:
    """Measured accuracy against the floors; a type without floors is a failing check.

    `accuracy`: doc_type, mode (single or routed), field (`all` for the overall one), accuracy.
    """
    floors = []
    for slug, spec in load_settings("eval_thresholds").items():
        floors += [(slug, "single", "all", spec["min_overall"]), (slug, "routed", "all", spec["min_overall_routed"])]
        floors += [(slug, "single", f, v) for f, v in spec["min_fields"].items()]
    table = literal_table(accuracy.sparkSession, ["doc_type", "mode", "field", "floor"], [(a, b, c, float(d)) for a, b, c, d in floors])
    measured = table.join(accuracy.select("doc_type").distinct(), "doc_type", "left_semi").join(
        accuracy, ["doc_type", "mode", "field"], "left"
    )
    guarded = measured.where((F.col("mode") == "single") | F.col("accuracy").isNotNull())
    checks = guarded.select("doc_type", "mode", "field", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), "floor")
    bare = accuracy.select("doc_type").distinct().join(table, "doc_type", "left_anti").select(
        "doc_type", F.lit("single").alias("mode"), F.lit("threshold configured").alias("field"), F.lit(0.0).alias("accuracy"), F.lit(1.0).alias("floor")
    )
    return checks.unionByName(bare).withColumn("passed", F.col("accuracy") >= F.col("floor"))


# --- experiment streams -----------------------------------------------------------------------


def concat_streams(stable: DataFrame, drifted: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Stable then drifted documents with a phase and a running 0-based index per stream."""
    both = stable.withColumn("phase", F.lit("stable")).withColumn("_part", F.lit(0)).unionByName(
        drifted.withColumn("phase", F.lit("drifted")).withColumn("_part", F.lit(1))
    )
    placed = windows.running(both, keys, ["_part", *order], index="_at")
    return placed.withColumn("index", F.col("_at") - 1).drop("_at", "_part")


def rolling_precision(steps: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """H3: field precision over the last `window` approved documents, full windows only."""
    approved = steps.where(F.col("approved")).select(*keys, "index", "fields_correct", "fields_total")
    run = windows.running(
        approved, keys, ["index"], sums={"_c": F.col("fields_correct"), "_t": F.col("fields_total")}, index="_i"
    )
    sums = windows.trailing_sums(cut(run), keys, "_i", {"correct": "_c", "total": "_t"}, window)
    return sums.select(*keys, "index", (F.col("correct") / F.col("total")).alias("precision"))


def rolling_approve_rate(steps: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """H4: share approved among the last `window` documents, full windows only."""
    narrow = steps.select(*keys, "index", F.col("approved").cast("bigint").alias("_a"))
    run = windows.running(narrow, keys, ["index"], sums={"_s": F.col("_a")}, index="_i")
    sums = windows.trailing_sums(cut(run), keys, "_i", {"approved": "_s"}, window)
    return sums.select(*keys, "index", (F.col("approved") / F.lit(window)).alias("rate"))


def stream_marks(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """H5: where the swap happened, where drift was flagged first, and the lag between them."""
    marks = steps.groupBy(*keys).agg(
        F.min(F.when(F.col("phase") == "drifted", F.col("index"))).alias("swap_at"),
        F.min(F.when(F.col("flagged"), F.col("index"))).alias("detected_at"),
    )
    both = (F.col("swap_at") > 0) & (F.col("detected_at") > 0)
    return marks.withColumn("lag", F.when(both, F.col("detected_at") - F.col("swap_at") + 1))


def first_breach(series: DataFrame, marks: DataFrame, keys: Sequence[str], floor: float, value: str = "precision") -> DataFrame:
    """H5: the first index below the floor, and the first one at or after the swap."""
    joined = series.join(marks.select(*keys, "swap_at"), list(keys))
    below = F.col(value) < floor
    return joined.groupBy(*keys).agg(
        F.min(F.when(below, F.col("index"))).alias("first_breach"),
        F.min(F.when(below & (F.col("index") >= F.col("swap_at")), F.col("index"))).alias("breach_after_swap"),
    )


def phase_summary(steps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rates, precisions, confidence and cost per phase in one pass."""
    ok = F.col("approved")
    share = lambda c: F.avg(c.cast("double"))
    ratio = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b))
    return steps.groupBy(*keys, "phase").agg(
        F.count("*").alias("n"),
        share(ok).alias("approve_rate"),
        ratio(F.when(ok, F.col("fields_correct")), F.when(ok, F.col("fields_total"))).alias("approved_precision"),
        F.avg(F.when(ok, F.col("all_correct").cast("double"))).alias("approved_doc_precision"),
        ratio(F.col("fields_correct"), F.col("fields_total")).alias("field_accuracy"),
        F.avg("doc_confidence").alias("mean_confidence"),
        share(F.col("escalated")).alias("escalation_rate"),
        share(~F.col("validation_passed")).alias("validation_failure_rate"),
        F.avg(F.col("cost_usd").cast("double")).alias("cost_per_doc"),
    )


def signal_behaviour(scores: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Mean z, breaches in the bad direction and the largest z per signal and phase."""
    down = F.col("signal").isin(*[s for s, d in DIRECTION.items() if d == "down"])
    breach = F.when(down, F.col("z") <= -threshold).otherwise(F.col("z") >= threshold)
    return scores.groupBy("signal", "phase").agg(
        F.count("*").alias("n"), F.avg("z").alias("mean_z"), F.count_if(breach).alias("breaches"), F.max_by("z", F.abs("z")).alias("largest_z")
    )
