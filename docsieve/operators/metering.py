"""Prices, costs, rollups and budgets as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.definition import Definition, load_settings
from docsieve.functions.tables import literal_table

COST = "decimal(12,6)"
# Fixed value: the longest answer a call may produce.
MAX_OUTPUT_TOKENS = 8192


class UnknownModel(ValueError):
    """A metered call names a model without a price."""


def load_pricing(spark: SparkSession) -> DataFrame:
    """(model, model_tier, price_in, price_out) in USD per million tokens."""
    models = load_settings("model_pricing")["models"]
    rows = [(m, p["tier"], str(p["input"]), str(p["output"])) for m, p in models.items()]
    return literal_table(spark, ["model", "model_tier", "price_in", "price_out"], rows).select(
        "model", "model_tier", F.col("price_in").cast("decimal(8,2)").alias("price_in"), F.col("price_out").cast("decimal(8,2)").alias("price_out")
    )


def _cost(tokens_in: Column, tokens_out: Column) -> Column:
    tokens = lambda t: t.cast("decimal(12,0)")
    millionths = tokens(tokens_in) * F.col("price_in") + tokens(tokens_out) * F.col("price_out")
    return F.round(millionths * F.expr("0.000001BD"), 6).cast(COST)


def with_price(usage: DataFrame) -> DataFrame:
    """usage with its price; a model without one keeps NULLs, see `unpriced`."""
    return usage.join(load_pricing(usage.sparkSession), "model", "left")


def with_cost(usage: DataFrame, strict: bool = True) -> DataFrame:
    """(in * price_in + out * price_out) / 1e6, half up to six places.

    With `strict`, a model nobody priced fails the job instead of costing nothing.
    """
    priced = with_price(usage)
    cost = _cost(F.col("input_tokens"), F.col("output_tokens"))
    if strict:
        problem = F.raise_error(F.concat(F.lit("no price for model "), F.col("model")))
        cost = F.when(F.col("model_tier").isNull(), problem.cast(COST)).otherwise(cost)
    return priced.withColumn("cost_usd", cost).drop("price_in", "price_out")


def with_worst_case_cost(usage: DataFrame, max_output: int = MAX_OUTPUT_TOKENS) -> DataFrame:
    """The most a call can cost, for reserving budget before it runs."""
    return with_price(usage).withColumn("worst_case_usd", _cost(F.col("input_tokens"), F.lit(max_output))).drop("price_in", "price_out")


def unpriced(usage: DataFrame) -> DataFrame:
    """F3's must-match side: calls whose model has no price."""
    return usage.join(load_pricing(usage.sparkSession), "model", "left_anti")


_KIND_NOTES = {
    "date": "dates as YYYY-MM-DD",
    "money": "amounts as plain decimals with a point",
    "quantity": "quantities as plain decimals",
    "rate": "rates as decimal fractions",
}


def system_prompt(definition: Definition) -> str:
    """The instruction part of a request, built once on the driver."""
    kinds = {s.kind for s in definition.fields.values()}
    notes = definition.prompt.get("field_notes", {})
    lines = [text for kind, text in _KIND_NOTES.items() if kind in kinds]
    lines += [
        f"{n}: one of {', '.join(s.values)}" for n, s in definition.fields.items() if s.kind == "enum" and n not in notes
    ]
    lines += [f"{n}: {note}" for n, note in notes.items()]
    head = " ".join(x for x in (f"Read the fields of a {definition.slug}.", definition.prompt.get("intro")) if x)
    return head + "\n" + "\n".join(f"- {line}" for line in lines)


def user_prefix(definition: Definition) -> str:
    return f"Text of the {definition.slug}:\n\n"


def prompt_text(text: Column, definition: Definition) -> Column:
    return F.concat(F.lit(system_prompt(definition)), F.lit(user_prefix(definition)), text)


def cost_rollup(usage: DataFrame) -> DataFrame:
    """G1: calls, distinct documents, tokens and cost per definition, tier and model."""
    return usage.groupBy(F.coalesce("slug", F.lit("unknown")).alias("slug"), "model_tier", "model").agg(
        F.count("*").alias("calls"),
        F.count_distinct("document_id").alias("documents"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def unit_costs(usage: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per definition: documents, calls, cost, escalations per document and cost by tier."""
    slug = F.coalesce("slug", F.lit("unknown"))
    tiers = ("small", "frontier")
    spent = lambda tier: F.sum(F.when(F.col("model_tier") == tier, F.col("cost_usd")))
    totals = usage.groupBy(*keys, slug.alias("slug")).agg(
        F.count_distinct("document_id").alias("documents"),
        F.count("*").alias("calls"),
        F.sum("cost_usd").alias("cost_usd"),
        F.count_if(F.col("purpose") == "escalation").alias("escalations"),
        *[spent(t).alias(f"_{t}") for t in tiers],
    )
    by_tier = F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(t).alias("tier"), F.col(f"_{t}").alias("cost")) for t in tiers]),
            lambda e: e["cost"].isNotNull(),
        )
    )
    docs = F.col("documents")
    per_doc = F.when(docs > 0, F.round(F.col("cost_usd").cast("double") / docs, 6)).otherwise(F.lit(0.0))
    return totals.select(
        *keys,
        "slug",
        "documents",
        "calls",
        "cost_usd",
        F.when(docs > 0, F.col("escalations") / docs).otherwise(F.lit(0.0)).alias("escalation_rate"),
        per_doc.alias("cost_per_document"),
        by_tier.alias("cost_by_tier"),
    )


def budget_state(tenants: DataFrame, spend: DataFrame) -> DataFrame:
    """spent, budget, remaining and exceeded per tenant; no counter yet means nothing spent."""
    spent = F.coalesce(F.col("spent_usd"), F.lit(0).cast("decimal(14,6)"))
    zero = F.lit(0).cast("decimal(14,6)")
    return tenants.join(spend, "tenant_id", "left").select(
        "tenant_id",
        spent.alias("spent_usd"),
        "budget_usd",
        F.greatest(F.col("budget_usd") - spent, zero).alias("remaining_usd"),
        (spent >= F.col("budget_usd")).alias("exceeded"),
    )


def spend_reconciliation(usage: DataFrame, counters: DataFrame) -> DataFrame:
    """Metered cost against the spend counter, tenants missing on either side included."""
    metered = usage.groupBy("tenant_id").agg(F.sum("cost_usd").alias("metered_usd"))
    zero = F.lit(0).cast("decimal(14,6)")
    joined = metered.join(counters.select("tenant_id", "spent_usd"), "tenant_id", "full")
    metered_, counter = F.coalesce("metered_usd", zero), F.coalesce("spent_usd", zero)
    return joined.select("tenant_id", metered_.alias("metered_usd"), counter.alias("counter_usd"), (metered_ - counter).alias("difference"))
