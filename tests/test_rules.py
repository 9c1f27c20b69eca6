"""Rules and scores on literal records; anything that cannot be evaluated fails."""

import datetime as dt
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from docsieve.definition import load_confidence_model, load_definition
from docsieve.operators import evidence, rules, scoring

INVOICE = load_definition()
CLEAN = dict(
    vendor="Fernandez-Harris", invoice_number="INV-2026-00042", invoice_date=dt.date(2026, 1, 17), due_date=dt.date(2026, 2, 16),
    currency="USD", subtotal=Dec("1000.0000"), tax_rate=Dec("0.07500000"), tax=Dec("75.0000"), total=Dec("1075.0000"),
    line_items=[
        dict(description="Desk", quantity=Dec("2.0000"), unit_price=Dec("400.0000"), amount=Dec("800.0000")),
        dict(description="Chair", quantity=Dec("1.0000"), unit_price=Dec("200.0000"), amount=Dec("200.0000")),
    ],
)
PAGE = "Fernandez-Harris\nINVOICE INV-2026-00042\nJan 17, 2026 due Feb 16, 2026\nDesk 2 $400.00 $800.00\nChair 1 $200.00\nTotal $1,075.00"


def frame(spark, **changes):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("record", INVOICE.record_type()), T.StructField("text", T.StringType())])
    return spark.createDataFrame([({**CLEAN, **changes}, PAGE)], schema)


def outcome(spark, **changes):
    return frame(spark, **changes).select(rules.evaluate_rules(F.col("record"), INVOICE).alias("o")).first().o.asDict()


def test_clean_record_passes_every_rule(spark):
    assert all(outcome(spark).values())


@pytest.mark.parametrize(
    "changes, broken",
    [
        (dict(total=Dec("1075.02")), {"subtotal_plus_tax_equals_total"}),
        (dict(subtotal=None), {"line_items_sum_to_subtotal", "subtotal_plus_tax_equals_total", "tax_matches_rate"}),
        (dict(tax=Dec("75.03"), total=Dec("1075.03")), {"tax_matches_rate"}),
        (dict(invoice_date=None), {"invoice_date_parses", "due_date_not_before_invoice_date"}),
        (dict(due_date=dt.date(2026, 1, 16)), {"due_date_not_before_invoice_date"}),
        (dict(line_items=[]), {"line_items_sum_to_subtotal"}),
        (dict(line_items=None), {"line_items_sum_to_subtotal"}),
        (dict(total=Dec("1075.01")), set()),
    ],
)
def test_broken_records(spark, changes, broken):
    assert {n for n, ok in outcome(spark, **changes).items() if not ok} == broken


def test_bad_rows_name_their_index(spark):
    items = [CLEAN["line_items"][0], {**CLEAN["line_items"][1], "amount": Dec("201")}, {**CLEAN["line_items"][1], "quantity": None}]
    bad = rules.inconsistent_rows(F.col("record"), INVOICE)["line_items"]
    assert frame(spark, line_items=items).select(bad).first()[0] == [1, 2]


def scored(spark, **changes):
    df = scoring.score_extraction(evidence.with_signals(frame(spark, **changes), INVOICE), INVOICE)
    return scoring.route_extraction(df, INVOICE, load_confidence_model()).first()


def test_clean_record_is_approved_with_full_score(spark):
    r = scored(spark)
    assert (r.doc_score, r.doc_reasons, r.decision, r.flagged_fields) == (1.0, [], "approved", [])
    assert r.doc_confidence > 0.97


def test_invented_vendor_is_flagged(spark):
    r = scored(spark, vendor="Meridian Logistics GmbH")
    assert r.decision == "needs_review" and r.flagged_fields == ["vendor"]
    assert "ungrounded:vendor" in r.doc_reasons and r.doc_score == 0.65


def test_wrong_total_lowers_the_fields_of_its_rule_only(spark):
    r = scored(spark, total=Dec("1175.00"))
    per_field = {f["name"]: f["confidence"] for f in r.field_scores}
    assert per_field["total"] == per_field["tax"] == per_field["subtotal"] == 0.7
    assert per_field["vendor"] == 1.0 and r.doc_score == 0.7


def test_short_text_lowers_the_field_but_not_the_document(spark):
    r = scored(spark, vendor="F")
    assert {f["name"]: f["confidence"] for f in r.field_scores}["vendor"] == 0.8 and r.doc_score == 1.0


def test_scores_are_clamped(spark):
    r = scored(spark, vendor="B B AG", total=None, subtotal=None, tax=None, invoice_date=None, due_date=None, currency="EUR")
    assert r.doc_score == 0.0 and r.decision == "needs_review"
