"""Consistency rules (C1-C9) compiled from a definition to Column expressions.

A rule that cannot be evaluated has failed: every predicate goes through `strict`.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.definition import Definition, Rule
from docsieve.functions import exact
from docsieve.functions.tables import literal_table

#: Sums and differences keep 25 digits before the point and 12 behind it; beyond that a rule cannot be evaluated.
TOTAL = "decimal(37,12)"


def strict(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def _limit(rule: Rule) -> Decimal:
    return Decimal(str(rule.params.get("tolerance", "0.01")))


def _tolerance(rule: Rule) -> Column:
    return F.lit(_limit(rule)).cast("decimal(18,8)")


def _plus(total: Column, value: Column) -> Column:
    return F.try_add(total, value).try_cast(TOTAL)


def _sum_items(record: Column, table: str, column: str) -> Column:
    zero = F.lit(0).cast(TOTAL)
    return F.aggregate(
        F.coalesce(record[table], F.array()), zero, lambda total, row: _plus(total, row[column])
    )


def _factors(rule: Rule, record: Column) -> tuple[Column, Column, Column]:
    left, right = (record[f] for f in rule.params["factors"])
    return left, right, record[rule.params["result"]]


def _difference(rule: Rule, record: Column) -> Column:
    """What a sum misses its target by, exact."""
    if rule.type == "sum_equals":
        found = _sum_items(record, rule.params["items"], rule.params["item_field"])
    else:
        first, *rest = [record[t].try_cast(TOTAL) for t in rule.params["terms"]]
        found = first
        for term in rest:
            found = _plus(found, term)
    return F.try_subtract(found, record[rule.params["target"]])


def residual(rule: Rule, record: Column) -> Column:
    """Signed miss of a document-level arithmetic rule as a double, rounded once; NULL when it cannot be evaluated."""
    if rule.type in ("sum_equals", "terms_equal"):
        return _difference(rule, record).cast("double")
    return exact.as_double(exact.product_miss(*_factors(rule, record)))


def _sum_equals(rule: Rule, record: Column) -> Column:
    return F.abs(_difference(rule, record)) <= _tolerance(rule)


def _product_equals(rule: Rule, record: Column) -> Column:
    if rule.per_row:
        return F.size(bad_rows(rule, record)) == 0
    return exact.product_within(*_factors(rule, record), _limit(rule))


def _date_order(rule: Rule, record: Column) -> Column:
    return record[rule.params["later"]] >= record[rule.params["earlier"]]


def _regex(rule: Rule, record: Column) -> Column:
    return record[rule.params["field"]].cast("string").rlike(f"\\A(?:{rule.params['pattern']})\\z")


def required_fields(record: Column, definition: Definition, names: tuple[str, ...]) -> Column:
    checks = []
    for name in names:
        kind, value = definition.fields[name].kind, record[name]
        if kind == "table":
            checks.append(F.size(F.coalesce(value, F.array())) > 0)
        elif kind in ("text", "enum"):
            checks.append(value.isNotNull() & (value != ""))
        else:
            checks.append(value.isNotNull())
    out = checks[0]
    for check in checks[1:]:
        out = out & check
    return out


# The extension point: a new rule type is one more compiler from (rule, record) to a predicate.
COMPILERS = {
    "sum_equals": _sum_equals,
    "terms_equal": _sum_equals,
    "product_equals": _product_equals,
    "date_order": _date_order,
    "regex": _regex,
}


def evaluate_rule(rule: Rule, record: Column, definition: Definition) -> Column:
    if rule.type == "required":
        return strict(required_fields(record, definition, rule.fields))
    return strict(COMPILERS[rule.type](rule, record))


def rule_outcomes(record: Column, definition: Definition) -> dict[str, Column]:
    """Outcome per document-level rule; row rules are reported by `inconsistent_rows`."""
    return {r.name: evaluate_rule(r, record, definition) for r in definition.document_rules}


def evaluate_rules(record: Column, definition: Definition) -> Column:
    """C9 as one struct."""
    return F.struct(*[c.alias(n) for n, c in rule_outcomes(record, definition).items()])


def validation_passed(outcomes, definition: Definition, record: Column | None = None) -> Column:
    """All document rules passed; `outcomes` is anything indexed by rule name. No record means not passed."""
    passed = F.lit(True)
    for rule in definition.document_rules:
        passed = passed & outcomes[rule.name]
    return passed if record is None else F.when(record.isNull(), F.lit(False)).otherwise(passed)


def rule_misses(record: Column, definition: Definition) -> dict[str, Column]:
    """Signed miss per document-level arithmetic rule, 0.0 when it cannot be evaluated."""
    return {
        r.name: F.coalesce(residual(r, record), F.lit(0.0))
        for r in definition.document_rules
        if r.arithmetic
    }


def residuals(record: Column, definition: Definition) -> Column:
    """C8 as one struct."""
    return F.struct(*[c.alias(n) for n, c in rule_misses(record, definition).items()])


def bad_rows(rule: Rule, record: Column) -> Column:
    """C4: indices of the table rows that break a per-row product, unreadable rows included."""
    def broken(row: Column) -> Column:
        return F.coalesce(~exact.product_within(*_factors(rule, row), _limit(rule)), F.lit(True))

    rows = F.coalesce(record[rule.params["items"]], F.array())
    marked = F.transform(rows, lambda row, i: F.when(broken(row), i))
    return F.filter(marked, lambda i: i.isNotNull())


def inconsistent_rows(record: Column, definition: Definition) -> dict[str, Column]:
    """C4 per table; where two row rules guard one table, the later one wins."""
    return {rule.params["items"]: bad_rows(rule, record) for rule in definition.row_rules}


def long_form_rules(headers: DataFrame, rows: DataFrame, definition: Definition, doc: str = "doc_id") -> DataFrame:
    """C1 and C4 for tables stored one row per line, of any length.

    Nothing is collected per document: sums and counts of bad rows are mergeable
    aggregates, so a document with very many rows is reduced before the shuffle.
    `headers` has the scalar fields as columns, `rows` the columns of the table.
    """
    aggregates = []
    for rule in definition.rules:
        if rule.type == "sum_equals":
            aggregates.append(F.try_sum(F.col(rule.params["item_field"]).try_cast(TOTAL)).alias(f"_{rule.name}"))
        elif rule.per_row:
            left, right, result = (F.col(f) for f in (*rule.params["factors"], rule.params["result"]))
            broken = F.coalesce(~exact.product_within(left, right, result, _limit(rule)), F.lit(True))
            aggregates.append(F.count_if(broken).alias(f"_{rule.name}"))
    out = headers.join(rows.groupBy(doc).agg(*aggregates), doc, "left")
    for rule in definition.rules:
        if rule.type == "sum_equals":
            total = F.coalesce(F.col(f"_{rule.name}"), F.lit(0).cast(TOTAL))
            passed = strict(F.abs(F.try_subtract(total, F.col(rule.params["target"]))) <= _tolerance(rule))
            out = out.withColumn(rule.name, passed).drop(f"_{rule.name}")
        elif rule.per_row:
            out = out.withColumn(f"{rule.name}_bad", F.coalesce(F.col(f"_{rule.name}"), F.lit(0))).drop(f"_{rule.name}")
    return out


# Document states, the states that need no more work, and the stage that resumes the others.
STATUSES = (
    "received", "parsing", "parsed", "extracting", "extracted",
    "needs_ocr", "approved", "needs_review", "budget_exceeded", "failed",
)
TERMINAL = ("approved", "needs_review", "needs_ocr", "failed", "extracted")
RESUME_STAGE = {
    "received": "parse",
    "parsing": "parse",
    "parsed": "extract",
    "extracting": "extract",
    "budget_exceeded": "extract",
}


def status_domain_check(documents: DataFrame) -> DataFrame:
    """States outside the declared set, or neither terminal nor resumable, with their row counts."""
    known = set(TERMINAL) | set(RESUME_STAGE)
    declared = literal_table(documents.sparkSession, ["status"], [(s,) for s in STATUSES if s in known])
    return documents.groupBy("status").agg(F.count("*").alias("n")).join(declared, "status", "left_anti")
