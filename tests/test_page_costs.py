"""What reading, scoring and checking of a page must not do: work that grows faster than the page, or that nobody reads."""

import json
import time

from pyspark.sql import functions as F

import __spark_entry__ as entry
from docsieve.definition import load_definition
from docsieve.functions import values as V
from docsieve.operators import evidence, reading, rules, validation

INVOICE = load_definition("invoice")


def rows_of(spark, texts, *columns):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [tuple(r) for r in df.select("i", *columns).orderBy("i").drop("i").collect()]


def test_long_runs_of_digits_are_searched_once(spark):
    """A run that is no rate and no amount was tried again from each of its digits."""
    run, text = "1" * 6000, F.col("text")
    start = time.time()
    got = rows_of(spark, [run, f"{run} 19 %", f"{run} 2,50 €"], reading.find_rate(text), F.regexp_extract_all(text, F.lit(reading.EU_MONEY), F.lit(0)))
    assert got == [("0", []), ("19 %", []), ("0", ["2,50 €"])]
    assert time.time() - start < 20


def test_amounts_and_dates_on_odd_lines(spark):
    text = F.col("text")
    amounts = lambda t: F.regexp_extract_all(t, F.lit(reading.EU_MONEY), F.lit(0))
    texts = ["1.234,56€ 2,00 €", ".5,00 €", "..,00 €", "5.,00 €", "a1,00 €b2.00,11 €", "1,000 €"]
    assert [r[0] for r in rows_of(spark, texts, amounts(text))] == [["1.234,56€", "2,00 €"], [".5,00 €"], [], [], ["1,00 €", "2.00,11 €"], []]
    gap = " " * 12
    texts = [f"Dec{gap}12, 2024", "Dec\n1,\n2024", "xyDec 12, 2024 (May 3 2024)", "Septemberxx 3, 2024", "1May 3, 2024", "Dec 123, 2024", None]
    found = [r[0] if r[0] is None else [d.isoformat() for d in r[0]] for r in rows_of(spark, texts, evidence.dates_in_text(text))]
    assert found == [["2024-12-12"], ["2024-12-01"], ["2024-05-03"], [], [], [], None]


def test_lines_are_trimmed_where_one_can_be(spark):
    texts = [None, "", " ", "a\nb", "a\n\nb", " a\nb", "a \nb", "a\n b", "a\rb\r\n", "a\n"]
    want = [None, [], [], ["a", "b"], ["a", "b"], ["a", "b"], ["a", "b"], ["a", "b"], ["a", "b"], ["a"]]
    assert [r[0] for r in rows_of(spark, texts, reading.lines_of(F.col("text")))] == want


def test_a_residual_is_worked_out_where_its_rule_failed(spark):
    raw = {"subtotal": "10.00", "tax": "1.005", "total": "11.00", "tax_rate": "0.1", "line_items": []}
    given = spark.createDataFrame([(json.dumps(raw),), (json.dumps(raw | {"total": "12.00"}),)], "answer string")
    record = V.normalize_record(F.from_json("answer", INVOICE.record_type(raw=True)), INVOICE)
    scored = evidence.with_signals(given.select(record.alias("record"), "answer"), INVOICE, text=None)
    rule = next(r for r in INVOICE.document_rules if r.type == "terms_equal")
    got = scored.orderBy("record.total").select(f"rule_{rule.name}", F.round(f"residual_{rule.name}", 6)).collect()
    assert [tuple(r) for r in got] == [(True, 0.0), (False, -0.995)]
    kept = scored.orderBy("record.total").select(F.round(rules.rule_misses(F.col("record"), INVOICE)[rule.name], 6)).first()[0]
    assert kept == 0.005


def test_cells_find_their_score_without_a_second_scoring(spark, sf):
    cells = entry.queries()["cell_confidence"](spark, sf)
    assert cells._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    names = spark.createDataFrame([("line_items.0.amount", 0.5), ("total", 0.25), ("unheard_of", 0.75)], "name string, p double")
    from docsieve.operators import scoring

    scored = names.select("name", *[(F.col("p") + i).alias(f"p_{f}") for i, f in enumerate(INVOICE.fields)])
    at = list(INVOICE.fields).index
    got = [r[0] for r in scored.select(scoring.routed_confidence(F.col("name"), INVOICE)).collect()]
    assert got == [0.5 + at("line_items"), 0.25 + at("total"), None]


def test_names_of_cells_are_those_of_the_flat_form(spark):
    rows = "array<struct<description:string,quantity:string,unit_price:string,amount:string>>"
    given = spark.createDataFrame([([("a", "1", "2", "3"), (None, None, None, None)],), ([],), (None,)], f"line_items {rows}")
    parts = [F.col("line_items") if n == "line_items" else F.lit("1").alias(n) for n in INVOICE.fields]
    record = V.normalize_record(F.struct(*parts), INVOICE)
    same = given.select((V.cell_names(record, INVOICE) == V.flatten_fields(record, INVOICE)["name"]).alias("same")).collect()
    assert [r.same for r in same] == [True] * 3


def test_a_payload_is_parsed_twice_and_sound_rows_are_not_searched(spark):
    row = dict.fromkeys(("description", "quantity", "unit_price", "amount"), "1")
    good = dict.fromkeys(INVOICE.fields, "1") | {"currency": "EUR", "invoice_date": "2024-01-01", "due_date": "2024-01-02", "line_items": [row, row]}
    short = {k: v for k, v in row.items() if k != "quantity"}
    answers = [good, good | {"line_items": [row, short]}, good | {"line_items": [row, row | {"amount": None}]}, good | {"line_items": [row, None]}, good | {"line_items": []}]
    df = spark.createDataFrame(list(enumerate(map(json.dumps, answers))), "i int, payload string")
    checked = validation.validate_payload(df, INVOICE).select("i", "errors")
    got = [r.errors for r in checked.orderBy("i").collect()]
    at = "ValidationError: line_items/1"
    assert got == [[], [f"{at}: 'quantity' is a required property"], [f"{at}/amount: not of type 'string'"], [f"{at}: not of type 'object'"], []]
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "json_object_keys" not in plan and "from_json(MapType" not in plan
