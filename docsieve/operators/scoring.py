"""Confidence and routing (E1-E11) over the signals of `evidence.with_signals`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.definition import ConfidenceModel, Definition, RoutingPolicy, load_settings
from docsieve.functions.tables import Prefixed, literal_table, with_prefixed
from docsieve.operators.evidence import DATE_CORROBORATED_AT, GROUNDED_AT

# The prior penalties of the heuristic score.
FAILED_RULE = 0.30
FAILED_SOFT_RULE = 0.15
RETRY = 0.10
FRAGMENTED_DOC = 0.10
NONPOSITIVE_DOC = 0.25
SUSPECT_FIELD = 0.20
UNGROUNDED = 0.35
UNCORROBORATED = 0.35


RULE, RESIDUAL, EV, P = Prefixed("rule"), Prefixed("residual"), Prefixed("ev"), Prefixed("p")


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def _clamp(penalty: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - penalty)), 4)


class _Ledger:
    """Penalties and reasons gathered per document and per field while the expression is built."""

    def __init__(self, definition: Definition):
        self.doc: list[tuple[Column, float, Column]] = []
        self.fields: dict[str, list[tuple[Column, float, Column]]] = {n: [] for n in definition.fields}

    def charge(self, when: Column, doc: float, doc_reason: str | Column | None, fields: dict[str, tuple[float, str | Column]]):
        as_column = lambda r: F.lit(r) if isinstance(r, str) else r
        if doc_reason is not None:
            self.doc.append((when, doc, as_column(doc_reason)))
        for name, (weight, reason) in fields.items():
            if name in self.fields:
                self.fields[name].append((when, weight, as_column(reason)))

    @staticmethod
    def confidence(entries) -> Column:
        return _clamp(_total([F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, w, _ in entries]))

    @staticmethod
    def reasons(entries) -> Column:
        if not entries:
            return F.array().cast("array<string>")
        return F.array_compact(F.array(*[F.when(c, r) for c, _, r in entries]))


def score_extraction(df: DataFrame, definition: Definition, with_text: bool = True) -> DataFrame:
    """Penalties with reasons; `doc_score`, `doc_reasons` and `field_scores` (name, confidence, reasons)."""
    ev, book = EV, _Ledger(definition)
    for rule in definition.document_rules:
        weight = FAILED_SOFT_RULE if rule.soft else FAILED_RULE
        reason = f"failed:{rule.name}"
        book.charge(~RULE[rule.name], weight, reason, {f: (weight, reason) for f in rule.fields})
    book.charge(F.col("attempts") > 1, RETRY, "needed_schema_retry", {})
    for n in definition.text_fields:
        book.charge(ev[f"{n}_fragmented"], FRAGMENTED_DOC, f"{n}_looks_fragmented", {n: (SUSPECT_FIELD, "looks_fragmented")})
    for n in definition.positive_fields:
        book.charge(ev[f"{n}_nonpositive"], NONPOSITIVE_DOC, f"nonpositive_{n}", {n: (SUSPECT_FIELD, "nonpositive")})
    for n in definition.text_fields:
        book.charge(ev[f"{n}_short"], 0.0, None, {n: (SUSPECT_FIELD, "implausibly_short")})
    for table in {r.params["items"]: None for r in definition.row_rules}:
        bad = ev[f"{table}_bad_rows"]
        shown = F.concat(F.lit("row_arithmetic:["), F.array_join(bad.cast("array<string>"), ", "), F.lit("]"))
        book.charge(F.size(bad) > 0, 0.0, None, {table: (SUSPECT_FIELD, shown)})
    if with_text:
        for n in definition.text_fields:
            s = ev[f"{n}_grounded"]
            book.charge(s < GROUNDED_AT, UNGROUNDED, f"ungrounded:{n}", {n: (UNGROUNDED, F.concat(F.lit("ungrounded:"), s))})
        for t in definition.table_fields:
            s = ev[f"{t}_grounded_min"]
            shown = F.concat(F.lit("ungrounded_row_text:"), s)
            book.charge(s < GROUNDED_AT, UNGROUNDED, f"ungrounded:{t}_text", {t: (UNGROUNDED, shown)})
        for n in definition.grounded_enums:
            value = F.col("record")[n]
            missing = F.coalesce(ev[f"{n}_grounded"] == 0.0, F.lit(False))
            doc_reason = F.concat(F.lit(f"enum_not_in_document:{n}="), value)
            book.charge(missing, UNGROUNDED, doc_reason, {n: (UNGROUNDED, F.concat(F.lit("not_in_document:"), value))})
        for n in definition.date_fields:
            s = ev[f"{n}_corroborated"]
            shown = F.concat(F.lit("not_on_page:"), s)
            book.charge(s < DATE_CORROBORATED_AT, UNCORROBORATED, f"uncorroborated_date:{n}", {n: (UNCORROBORATED, shown)})
        for rule in definition.date_order_rules:
            s = ev["payment_term"]
            missed = F.coalesce(s < DATE_CORROBORATED_AT, F.lit(False))
            shown = F.concat(F.lit("term_mismatch:"), s)
            touched = {f: (UNCORROBORATED / 2, shown) for f in rule.fields if f in definition.date_fields}
            book.charge(missed, UNCORROBORATED, "payment_term_mismatch", touched)
    per_field = [
        F.struct(F.lit(n).alias("name"), book.confidence(e).alias("confidence"), book.reasons(e).alias("reasons"))
        for n, e in book.fields.items()
    ]
    return df.withColumns(
        {
            "doc_score": book.confidence(book.doc),
            "doc_reasons": book.reasons(book.doc),
            "field_scores": F.array(*per_field),
        }
    )


def field_confidence(field_scores: Column, name: Column) -> Column:
    """E6 (lookup form): the score of a stored cell; table cells and counts inherit the table's score."""
    owner = F.split_part(name, F.lit("."), F.lit(1))
    hit = F.filter(field_scores, lambda f: f["name"] == owner)
    return F.get(hit, F.lit(0))["confidence"]


def features_for(field: str, definition: Definition, with_text: bool = True) -> list[Column]:
    """The seven features of one field, in fitted order."""
    ev, outcomes, misses = EV, RULE, RESIDUAL
    touching = [r for r in definition.document_rules if field in r.fields]
    failed = _total([(~outcomes[r.name]).cast("double") for r in touching])
    sizes = [F.when(~outcomes[r.name], F.abs(misses[r.name])).otherwise(F.lit(0.0)) for r in touching if r.arithmetic]
    worst = F.greatest(F.lit(0.0), *sizes) if sizes else F.lit(0.0)
    residual = F.log1p(worst / F.greatest(F.abs(ev["scale"]), F.lit(1.0)))
    one = F.lit(1.0)
    grounded, date_score = one, one
    if with_text:
        if field in definition.table_fields:
            grounded = ev[f"{field}_grounded_min"]
        elif field in definition.text_fields or field in definition.grounded_enums:
            grounded = F.coalesce(ev[f"{field}_grounded"], one)
        if field in definition.date_fields:
            date_score = F.least(ev[f"{field}_corroborated"], F.coalesce(ev["payment_term"], one))
    suspect = F.lit(False)
    if field in definition.text_fields:
        suspect = suspect | ev[f"{field}_fragmented"]
    if field in definition.positive_fields:
        suspect = suspect | ev[f"{field}_nonpositive"]
    broken = F.lit(0.0)
    if any(r.params["items"] == field for r in definition.row_rules):
        broken = (F.size(ev[f"{field}_bad_rows"]) > 0).cast("double")
    retried = (F.col("attempts") > 1).cast("double")
    return [failed, residual, grounded, suspect.cast("double"), broken, retried, date_score]


def probability(features: list[Column], model: ConfidenceModel) -> Column:
    """The fitted logistic model as literal arithmetic."""
    z = F.lit(model.bias)
    for x, mean, std, weight in zip(features, model.mean, model.std, model.weights, strict=True):
        z = z + F.lit(weight) * ((x - F.lit(mean)) / F.lit(std or 1e-9))
    return F.bround(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6)


def with_features(df: DataFrame, definition: Definition, with_text: bool = True) -> DataFrame:
    """E2 wide: `features`, an array of (field, x) in declared order."""
    rows = [
        F.struct(F.lit(n).alias("field"), F.array(*features_for(n, definition, with_text)).alias("x"))
        for n in definition.fields
    ]
    return df.withColumn("features", F.array(*rows))


def route_extraction(df: DataFrame, definition: Definition, model: ConfidenceModel, with_text: bool = True) -> DataFrame:
    """A field below the threshold is flagged, a flagged document needs review."""
    probabilities = {n: probability(features_for(n, definition, with_text), model) for n in definition.fields}
    out = with_prefixed(df, "p", probabilities)
    p = {n: P[n] for n in definition.fields}
    flagged = F.array_compact(F.array(*[F.when(c < model.threshold, F.lit(n)) for n, c in p.items()]))
    return out.withColumn("flagged_fields", flagged).withColumns(
        {
            "decision": F.when(F.size("flagged_fields") > 0, "needs_review").otherwise("approved"),
            "doc_confidence": F.least(*p.values()),
            "calibration": F.lit(model.calibration_tag(definition.slug)),
        }
    )


def failed_report(df: DataFrame, record: str = "record") -> DataFrame:
    """No usable record means zero confidence and one reason."""
    failed = F.col(record).isNull()
    return df.withColumns(
        {
            "doc_score": F.when(failed, F.lit(0.0)).otherwise(F.col("doc_score")),
            "doc_reasons": F.when(failed, F.array(F.lit("extraction_failed"))).otherwise(F.col("doc_reasons")),
        }
    )


def cell_confidence(cells: DataFrame, scores: DataFrame, on: str = "extraction_id") -> DataFrame:
    """Long cells (B7) with the score of their field; unknown names keep NULL."""
    owner = F.split_part(F.col("name"), F.lit("."), F.lit(1))
    return cells.withColumn("field", owner).join(scores.select(on, "field", "confidence"), [on, "field"], "left")


def routed_confidence(name: Column, definition: Definition) -> Column:
    """E6 within a routed row: the probability of the field that a cell belongs to; unknown names keep NULL."""
    owner = F.split_part(name, F.lit("."), F.lit(1))
    return F.coalesce(*[F.when(owner == n, P[n]) for n in definition.fields])


def escalation_trigger(policy: RoutingPolicy, failed: Column, passed: Column, decision: Column) -> Column:
    """The most serious reason the policy listens to; NULL keeps the first answer."""
    checks = {"extraction_failed": failed, "validation_failed": ~passed, "needs_review": decision == "needs_review"}
    reason = F.lit(None).cast("string")
    if not policy.escalate_to:
        return reason
    for name in reversed(list(checks)):
        if name in policy.escalate_on:
            reason = F.when(checks[name], F.lit(name)).otherwise(reason)
    return reason


def two_tier_select(primary: DataFrame, escalated: DataFrame, on: str, answer: str = "record") -> DataFrame:
    """Keep the stronger tier's answer where it has one; cost and calls add up.

    Both inputs carry `on`, `answer`, `cost_usd`; `escalated` holds only documents that were escalated.
    """
    second = escalated.select(on, F.col(answer).alias("_answer"), F.col("cost_usd").alias("_cost"), F.lit(1).alias("_ran"))
    joined = primary.join(second, on, "left")
    return joined.select(
        *[c for c in primary.columns if c not in (answer, "cost_usd")],
        F.coalesce("_answer", answer).alias(answer),
        (F.col("cost_usd") + F.coalesce(F.col("_cost"), F.lit(0))).alias("cost_usd"),
        (F.lit(1) + F.coalesce("_ran", F.lit(0))).alias("calls"),
        F.col("_ran").isNotNull().alias("escalated"),
    )


def tier_models(spark: SparkSession) -> DataFrame:
    """E10 as a dimension: (provider, tier, model)."""
    rows = [(p, t, m) for p, tiers in load_settings("model_routing")["tiers"].items() for t, m in tiers.items()]
    return literal_table(spark, ["provider", "tier", "model"], rows)


def model_for_tier(provider: Column, tier: Column) -> Column:
    """E10 as an expression; NULL for a pair nobody configured."""
    tiers = load_settings("model_routing")["tiers"]
    pairs = [F.lit(x) for p, names in tiers.items() for t, m in names.items() for x in (f"{p}/{t}", m)]
    return F.try_element_at(F.create_map(*pairs), F.concat_ws("/", provider, tier))


def field_confidences(definition: Definition) -> Column:
    """The routed probabilities as an array of (field, confidence), for storage and long form."""
    return F.array(*[F.struct(F.lit(n).alias("field"), P[n].alias("confidence")) for n in definition.fields])


def weakest_fields(definition: Definition, n: int = 3) -> Column:
    """The n least certain fields, weakest first, declared order among equals."""
    pairs = F.array(
        *[
            F.struct(P[f].alias("p"), F.lit(i).alias("at"), F.lit(f).alias("field"))
            for i, f in enumerate(definition.fields)
        ]
    )
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda s: s["field"])
