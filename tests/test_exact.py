"""Wide decimals through records, rules and residuals, against plain fractions."""

import random
from decimal import Decimal as Dec
from decimal import localcontext
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from docsieve.definition import load_definition
from docsieve.functions import exact
from docsieve.functions import values as V
from docsieve.operators import rules

INVOICE = load_definition()
LIMIT = Dec("0.01")


def numbers(dice):
    whole = dice.randrange(10 ** dice.choice([0, 1, 3, 9, 20, 25]) or 1)
    places = dice.choice([0, 2, 4, 6, 12])
    value = Fraction(whole) + Fraction(dice.randrange(10**places), 10**places)
    return -value if dice.random() < 0.3 else value


def decimal(x):
    with localcontext() as c:
        c.prec = 60
        return Dec(x.numerator) / Dec(x.denominator)


def test_products_equal_fractions(spark):
    dice, rows, want = random.Random(7), [], []
    for _ in range(1500):
        a, b = numbers(dice), numbers(dice)
        if abs(a * b) >= 10**24:
            b = Fraction(dice.randrange(10**12), 10**12)
        off = dice.choice([Fraction(0), Fraction(1, 100), Fraction(-1, 100), Fraction(1, 100) + Fraction(1, 10**12), Fraction(-1, 100) - Fraction(1, 10**12), Fraction(dice.randrange(-50, 50), 1000)])
        r = Fraction(int((a * b + off) * 10**12), 10**12)
        if abs(r) >= 10**25:
            continue
        rows.append(tuple(decimal(x) for x in (a, b, r)))
        want.append((a * b - r, abs(a * b - r) <= Fraction(1, 100)))
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a decimal(37,12), b decimal(37,12), r decimal(37,12)")
    whole, part = exact.product_miss(F.col("a"), F.col("b"), F.col("r"))
    got = frame.select("i", whole.alias("w"), part.alias("p"), exact.product_within(F.col("a"), F.col("b"), F.col("r"), LIMIT).alias("ok")).orderBy("i").collect()
    assert len(got) > 1000
    for g, (miss, ok) in zip(got, want):
        assert Fraction(g.w) + Fraction(g.p) == miss and 0 <= g.p < 1 and g.ok == ok


def test_unrepresentable_products_are_null(spark):
    frame = spark.createDataFrame([(Dec(10) ** 24, Dec(10) ** 24, Dec(1)), (None, Dec(1), Dec(1))], "a decimal(37,12), b decimal(37,12), r decimal(37,12)")
    rows = frame.select(exact.product_within(F.col("a"), F.col("b"), F.col("r"), LIMIT).alias("ok"), exact.as_double(exact.product_miss(F.col("a"), F.col("b"), F.col("r"))).alias("miss")).collect()
    assert [(r.ok, r.miss) for r in rows] == [(None, None)] * 2


WIDE = dict(
    vendor="V", invoice_number="INV-2026-00042", invoice_date="2026-01-17", due_date="2026-02-16", currency="USD",
    subtotal="12345678901234567890.123456", tax_rate="7.123456 %", tax="879439004430727900.443073", total="13225117905665295790.566529",
    line_items=[dict(description="a", quantity="0.00004", unit_price="1.234567", amount="0.00004938268"), dict(description="b", quantity="1", unit_price="12345678901234567890.12340661732", amount="12345678901234567890.12340661732")],
)


@pytest.mark.parametrize("changes, broken", [
    ({}, set()),
    ({"total": "13225117905665295790.576529"}, set()),
    ({"total": "13225117905665295790.576530"}, {"subtotal_plus_tax_equals_total"}),
    ({"subtotal": "12345678901234567890.133457", "total": "13225117905665295790.576530"}, {"line_items_sum_to_subtotal"}),
    ({"tax": "879439004430727900.463073", "total": "13225117905665295790.586529"}, {"tax_matches_rate"}),
])
def test_wide_records_keep_every_place(spark, changes, broken):
    raw = {**WIDE, **changes}
    rate = Fraction(Dec("7.123456")) / 100
    tax = Fraction(Dec(raw["subtotal"])) * rate
    if not changes:
        assert abs(tax - Fraction(Dec(raw["tax"]))) < Fraction(1, 100)
    rows = "array<struct<description:string,quantity:string,unit_price:string,amount:string>>"
    schema = "raw struct<" + ",".join(f"{n}:{rows if n == 'line_items' else 'string'}" for n in INVOICE.fields) + ">"
    frame = spark.createDataFrame([(raw,)], schema).select(V.normalize_record(F.col("raw"), INVOICE).alias("record"))
    r = frame.first().record
    assert r.subtotal == Dec(raw["subtotal"]) and r.line_items[0].quantity == Dec("0.00004") and r.line_items[0].unit_price == Dec("1.234567") and r.tax_rate == Dec("0.07123456")
    got = frame.select(rules.evaluate_rules(F.col("record"), INVOICE).alias("o"), rules.residuals(F.col("record"), INVOICE).alias("m"), V.json_record(F.col("record"), INVOICE).alias("j"), rules.inconsistent_rows(F.col("record"), INVOICE)["line_items"].alias("bad")).first()
    assert {n for n, ok in got.o.asDict().items() if not ok} == broken and got.bad == []
    assert f'"subtotal":"{raw["subtotal"]}"' in got.j and '"quantity":"0.00004"' in got.j
    miss = Fraction(Dec(raw["subtotal"])) + Fraction(Dec(raw["tax"])) - Fraction(Dec(raw["total"]))
    assert got.m.subtotal_plus_tax_equals_total == float(miss) and abs(got.m.tax_matches_rate - float(tax - Fraction(Dec(raw["tax"])))) < 1e-9
