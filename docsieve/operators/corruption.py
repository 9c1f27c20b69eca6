"""Planned faults for calibration (O1, O2): a pure function of (seed, document key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.tables import with_struct
from docsieve.functions.values import hash_draw

# Fault classes, the field each one spoils, replacement names and legal forms.
ERROR_CLASSES = ("arithmetic_drift", "wrong_vendor", "truncated_vendor", "transposed_line_amounts", "shifted_date")
CLASS_FIELD = {
    "arithmetic_drift": "total",
    "wrong_vendor": "vendor",
    "truncated_vendor": "vendor",
    "transposed_line_amounts": "line_items",
    "shifted_date": "invoice_date",
}
IMPOSTORS = (
    "Birkenfeld Spedition GmbH",
    "Lindqvist Optik Ltd",
    "Oakhurst Machine Works PLC",
    "Rowe & Adeyemi AG",
    "Kestrel Verpackung KG",
    "Sandpiper Tools Co.",
)
LEGAL_FORMS = ("ag", "kg", "gmbh", "ohg", "plc", "ltd", "inc", "llc", "e.v.", "e.g.", "co.", "&")


def plan_corruption(key: Column, rate: float, seed: int, classes: tuple[str, ...] = ERROR_CLASSES) -> Column:
    """O1: the fault class of a document, NULL for the share that stays intact."""
    chosen = F.get(F.array(*[F.lit(c) for c in classes]), hash_draw(seed, "class", key) % len(classes))
    return F.when(hash_draw(seed, "plan", key) < int(rate * 2**32), chosen)


def _pick(names: tuple[str, ...], draw: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), draw % len(names))


def _drifted_total(total: Column, size: Column, sign: Column) -> Column:
    share = ((size % 451 + 50).cast("decimal(6,0)") * F.expr("0.0001BD")).cast("decimal(6,4)")
    step = F.greatest(F.round(total * share, 2), F.lit(1).cast("decimal(18,4)")).cast("decimal(18,4)")
    return F.when(sign % 2 == 0, total + step).otherwise(total - step).cast("decimal(18,4)")


def _initials(name: Column) -> Column:
    tokens = F.filter(F.split(name, "\\s+"), lambda t: t != "")
    short = F.transform(tokens, lambda t: F.when(F.lower(t).isin(*LEGAL_FORMS), t).otherwise(F.substring(t, 1, 1)))
    return F.array_join(short, " ")


def _replace(row: Column, columns: list[str], **new: Column) -> Column:
    return F.struct(*[new.get(c, row[c]).alias(c) for c in columns])


def _transposed(items: Column, first: Column, second: Column, columns: list[str]) -> Column:
    n = F.size(items)
    i = first % F.greatest(n, F.lit(1))
    j = (i + 1 + second % F.greatest(n - 1, F.lit(1))) % F.greatest(n, F.lit(1))
    amount_at = lambda at: F.get(items, at.cast("int"))["amount"]

    def swapped(row: Column, at: Column) -> Column:
        amount = F.when(at == i, amount_at(j)).when(at == j, amount_at(i)).otherwise(row["amount"])
        return _replace(row, columns, amount=amount)

    within = F.transform(items, lambda r: _replace(r, columns, quantity=r["unit_price"], unit_price=r["quantity"]))
    return F.when(n >= 2, F.transform(items, swapped)).otherwise(within)


def apply_corruption(df: DataFrame, key: Column, seed: int, record: str = "record", plan: str = "error_class") -> DataFrame:
    """O2: spoil the planned field of each record; records without a plan are untouched."""
    rec, planned = F.col(record), F.col(plan)
    draw = lambda purpose: hash_draw(seed, purpose, key)
    kind = df.schema[record].dataType
    columns = kind["line_items"].dataType.elementType.fieldNames()
    spoiled = {
        "total": F.when(planned == "arithmetic_drift", _drifted_total(rec["total"], draw("size"), draw("sign"))),
        "vendor": F.when(planned == "wrong_vendor", _pick(IMPOSTORS, draw("vendor"))).when(
            planned == "truncated_vendor", _initials(rec["vendor"])
        ),
        "line_items": F.when(
            planned == "transposed_line_amounts", _transposed(rec["line_items"], draw("first"), draw("second"), columns)
        ),
        "invoice_date": F.when(
            planned == "shifted_date", F.date_sub(rec["invoice_date"], (draw("days") % 18 + 3).cast("int"))
        ),
    }
    parts = {n: F.coalesce(spoiled[n], rec[n]) if n in spoiled else rec[n] for n in kind.fieldNames()}
    return with_struct(df, record, parts)
