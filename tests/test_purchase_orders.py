"""The second document type: read, checked, scored, routed and judged by the code that serves invoices."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docsieve.definition import confidence_model_for, load_definition, load_hints, load_settings
from docsieve.functions.tables import with_struct
from docsieve.functions.values import canonical_fields
from docsieve.operators import evaluate, evidence, reading, scoring

ORDER = load_definition("purchase_order")
HINTS = load_hints("purchase_order")
TIERS = load_settings("reader_tiers")

EURO = """BESTELLUNG
B
raun Handel GmbH
Bestellnummer: BA-2024/0815
Bestelldatum: 31.08.2024
Lieferung innerhalb von 14 Tagen bis 14.09.2024
Lieferant: Kessler KG
Pos. Beschreibung Menge Preis Betrag
1 Schreibtisch 2 400,00 € 800,00 €
2 Lampe 1 1.200,50 € 1.200,50 €
Zwischensumme 2.000,50 €
Versandkosten 0,00 €
Gesamtbetrag 2.000,50 €"""
STANDARD = """Northgate Stores Ltd
PURCHASE ORDER
PO Number: PO-2024-00042
Order Date: 03/02/2024
Delivery Date: 03/16/2024
Vendor: Harbor Tools Inc
QTY ITEM PRICE AMOUNT
2 Desk frame $400.00 $800.00
Subtotal $800.00
Freight $48.00
Order Total $848.00"""


def read(spark, pages, tier="frontier"):
    df = spark.createDataFrame(list(enumerate(pages)), "doc_id int, text string")
    raw = reading.extract_record(df, HINTS, TIERS[tier], list(ORDER.fields))
    return with_struct(raw, "record", canonical_fields(F.col("raw"), ORDER)).drop("raw")


def routed(df):
    return scoring.route_extraction(evidence.with_signals(df, ORDER), ORDER, confidence_model_for(ORDER))


def test_both_layouts_are_read(spark):
    euro, standard = (r.record for r in read(spark, [EURO, STANDARD]).orderBy("doc_id").collect())
    assert (euro.buyer, euro.vendor, euro.po_number, euro.currency) == ("Braun Handel GmbH", "Kessler KG", "BA-2024/0815", "EUR")
    assert (euro.order_date, euro.delivery_date) == (dt.date(2024, 8, 31), dt.date(2024, 9, 14))
    assert (euro.subtotal, euro.shipping, euro.total) == (Decimal("2000.5"), 0, Decimal("2000.5"))
    assert [(i.description, i.quantity) for i in euro.line_items] == [("Schreibtisch", 2), ("Lampe", 1)]
    assert (standard.buyer, standard.vendor, standard.po_number) == ("Northgate Stores Ltd", "Harbor Tools Inc", "PO-2024-00042")
    assert (standard.shipping, standard.total) == (48, 848)


def test_small_tier_loses_the_first_letter_only(spark):
    record = read(spark, [EURO], "small").first().record
    assert record.buyer == "raun Handel GmbH" and record.total == Decimal("2000.5")


def test_signals_follow_the_declared_kinds(spark):
    df = routed(read(spark, [EURO, STANDARD]))
    assert not [c for c in df.columns if "invoice" in c or "tax" in c]
    ev = scoring.EV
    rows = df.orderBy("doc_id").select("decision", "calibration", ev["payment_term"].alias("term"), ev["buyer_grounded"].alias("buyer"),
                                       ev["line_items_grounded_min"].alias("items"), ev["delivery_date_corroborated"].alias("delivery")).collect()
    assert [r.decision for r in rows] == ["approved"] * 2
    assert {r.calibration for r in rows} == {"borrowed:invoice"}
    assert (rows[0].term, rows[1].term) == (1.0, None)
    assert all((r.buyer, r.items, r.delivery) == (1.0, 1.0, 1.0) for r in rows)


def test_freight_that_does_not_add_up_touches_its_own_fields(spark):
    df = scoring.score_extraction(evidence.with_signals(read(spark, [STANDARD.replace("$848.00", "$2,000.00")]), ORDER), ORDER)
    scores = {s.name: s.confidence for s in df.first().field_scores}
    assert {n for n, c in scores.items() if c < 1.0} == {"subtotal", "shipping", "total"}


def test_empty_and_missing_pages_are_read_as_unknown(spark):
    empty, missing = (r.record for r in read(spark, ["", None]).orderBy("doc_id").collect())
    assert empty.buyer == empty.vendor == "UNKNOWN" and empty.total == 0 and len(empty.line_items) == 1
    assert missing.buyer == "UNKNOWN"


def test_a_torn_total_falls_back_along_the_chain(spark):
    torn = "\n".join(l for l in STANDARD.split("\n") if not l.startswith(("Subtotal", "Order Total")))
    record = read(spark, [torn]).first().record
    assert (record.subtotal, record.total, record.shipping) == (800, 800, 48)


def test_hints_name_a_field_once_and_only_known_kinds():
    assert reading.hints_by_field(HINTS)["delivery_date"] == ("date_fields", 1)
    with pytest.raises(ValueError, match="two hints"):
        reading.hints_by_field({"id_fields": {"a": "x"}, "rate_fields": ["a"]})
    with pytest.raises(ValueError, match="no way to read"):
        reading.hints_by_field({"colours": ["a"]})


def test_types_are_judged_by_one_plan(spark, sf):
    """Both modes of a purchase order: cost adds up, wrong cells are counted, scans are left out."""
    expected = read(spark, [EURO, STANDARD]).select("doc_id", F.col("record").alias("expected"))
    pages = spark.createDataFrame([(0, EURO, "euro"), (1, STANDARD, "standard"), (2, "scan", "standard")], "doc_id int, text string, layout string")
    both = evaluate.read_both_tiers(pages.join(expected, "doc_id", "left"), ORDER, HINTS, TIERS, confidence_model_for(ORDER))
    rows = evaluate.judge_modes(both, ORDER)
    assert rows.columns == ["doc_type", "doc_id", "layout", "needs_ocr", "mode", "escalated", "cost_usd", "judged"]
    wrong = evaluate.judged_fields(rows, ["doc_id", "mode"]).where(~F.col("correct")).collect()
    assert [(r.doc_id, r.mode, r.field) for r in wrong] == [(0, "routed", "buyer")]
    assert rows.where("needs_ocr").select("mode", "escalated").distinct().count() == 2


def test_gate_holds_each_type_to_its_own_floors(spark):
    accuracy = spark.createDataFrame(
        [("purchase_order", "single", "all", 99.6), ("purchase_order", "single", "shipping", 98.0), ("letter", "single", "all", 100.0)],
        "doc_type string, mode string, field string, accuracy double",
    )
    got = {(r.doc_type, r.mode, r.field): r.passed for r in evaluate.gate_checks(accuracy).collect()}
    assert got[("purchase_order", "single", "all")] and not got[("purchase_order", "single", "shipping")]
    assert not got[("purchase_order", "single", "total")]
    assert got[("letter", "single", "threshold configured")] is False
    assert ("purchase_order", "routed", "all") not in got and not [k for k in got if k[0] == "invoice"]
