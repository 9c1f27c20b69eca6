"""Literal tables for canonical values and evidence."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docsieve.functions import values as V
from docsieve.operators import evidence


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


AMOUNTS = {
    "25.832,09 €": "25832.09", "11,51 €": "11.51", "12.839,82": "12839.82", "768,70 €": "768.70",
    "$1,152.24": "1152.24", "1,234": "1234", "$ 36,748.41": "36748.41", "1.234": "1.234", "3": "3", "-5.00": "-5",
    "N/A": None, "€": None, "": None, "1,2,3": None,
}


def test_amounts(spark):
    got = apply(spark, V.norm_amount, AMOUNTS)
    assert got == [None if v is None else Decimal(v) for v in AMOUNTS.values()]


def test_rates(spark):
    rates = {"6.25%": "0.0625", "19 %": "0.19", "0.19": "0.19", "19": "0.19", "0": "0", "100%": "1", "abc": None, "19,5 %": "0.195"}
    assert apply(spark, V.norm_rate, rates) == [None if v is None else Decimal(v) for v in rates.values()]


DATES = {
    "2026-01-17": "2026-01-17", "06/06/2026": "2026-06-06", "04/03/2025": "2025-04-03", "04.03.2025": "2025-03-04",
    "Jan 17, 2026": "2026-01-17", "January 17, 2026": "2026-01-17", "17 Jan 2026": "2026-01-17", " 10.11.2025 ": "2025-11-10",
    "31.02.2026": None, "sometime in march": None, "": None, "2026-1-7": None,
}


def test_dates(spark):
    assert apply(spark, V.norm_date, DATES) == [None if v is None else dt.date.fromisoformat(v) for v in DATES.values()]


def test_text_and_squash(spark):
    assert apply(spark, V.norm_text, ["  Bohnbach   Ullrich Stiftung "]) == ["Bohnbach Ullrich Stiftung"]
    assert apply(spark, V.squash, ["B\naum Straße", "R ECHNU NG", None]) == ["baumstrasse", "rechnung", None]


def test_fences(spark):
    given = ['```json\n{"a": 1}\n```', "```\nx\n```", ' {"a": 1} ', "```json"]
    assert apply(spark, V.strip_fences, given)[:3] == ['{"a": 1}', "x", '{"a": 1}']


FRAGMENTED = {
    "B W S & C . Kg a": True, "B B AG": True, "R g": True, "Hamann AG & Co. KG": False, "J P Morgan": False,
    "Cox PLC": False, "3M": False, "": False, "Underwood Ltd": False,
}


def test_fragments(spark):
    assert apply(spark, evidence.looks_fragmented, FRAGMENTED) == list(FRAGMENTED.values())


def test_dates_on_a_page(spark):
    text = "Datum 25.12.2024, due Jan 17, 2026; 06/07/2026 or 2026-03-01, März 5, 2025, bad 99.99.2024 and Foo 12, 2024"
    got = sorted(apply(spark, evidence.dates_in_text, [text])[0])
    want = ["2024-12-25", "2025-03-05", "2026-01-17", "2026-03-01", "2026-06-07", "2026-07-06"]
    assert got == [dt.date.fromisoformat(d) for d in want]


def test_payment_terms(spark):
    terms = {"Zahlbar innerhalb von 30 Tagen": 30, "terms: NET 14 days": 14, "net45": 45, "planet 9": None, "": None}
    assert apply(spark, evidence.stated_payment_term, terms) == list(terms.values())


@pytest.mark.parametrize("n, want", [(0, 1.0), (1, 0.5), (3, 0.25), (20, 0.0476), (31, 0.0312)])
def test_closeness(spark, n, want):
    page = spark.createDataFrame([(dt.date(2026, 1, 1), [dt.date(2026, 1, 1) + dt.timedelta(days=n)])], "d date, ds array<date>")
    assert page.select(evidence.corroborate_date(F.col("d"), F.col("ds"))).first()[0] == want


def test_groundedness_equals_difflib(spark):
    """The split into containment and alignment gives the values of a plain per-row computation."""
    from difflib import SequenceMatcher

    def plain(value, text):
        n, h = ("".join(s.split()).casefold() for s in (value, text))
        if not n or not h:
            return 0.0
        if n in h:
            return 1.0
        blocks = SequenceMatcher(None, n, h, autojunk=False).get_matching_blocks()
        return round(min(1.0, sum(b.size for b in blocks if b.size >= 3) / len(n)), 4)

    euro = "R ECHNU NG\nB\naum GmbH\nRE-2024/9558\nZahlbar innerhalb von 30 Tagen"
    cases = [("Baum GmbH", euro), ("Rechnung", euro), ("Underwood Ltd", euro), ("Baum und Partner GmbH", euro), ("", euro), ("x", ""), ("Tagebuch", euro)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, v string, t string")
    got = [r[0] for r in df.orderBy("i").select(evidence.groundedness(F.col("v"), F.col("t"))).collect()]
    assert got == [plain(*c) for c in cases]
    assert any(0 < g < 1 for g in got)


def test_all_iso_dates_and_exact_amounts(spark):
    from datetime import date

    shown = ["20240105", "2024-W02-3", "2024W023", "2020-W53-7", "2021-W53-1", "2024-W02", "2024-01-05", "2024-W00-1", "20241301"]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(shown)], "i int, s string").orderBy("i").select(V.norm_date(F.col("s"))).collect()]
    want = []
    for s in shown:
        try:
            want.append(date.fromisoformat(s))
        except ValueError:
            want.append(None)
    assert got == want
    amounts = [("1.234567", "1.234567"), ("0.00004", "0.00004"), ("123456789012345678", "123456789012345678"), ("1,234,567.123456789", "1234567.123456789")]
    rows = spark.createDataFrame(amounts, "s string, d string").select(V.norm_amount(F.col("s")) == F.col("d").cast("decimal(38,12)")).collect()
    assert all(r[0] for r in rows)


def test_white_space_one_by_one_and_by_class(spark):
    """Words, trimming, single spaces and squashing agree with the class of white space on every kind of it."""
    import random

    from docsieve.functions import values
    from docsieve.operators import reading

    blanks, draw = "".join(values.BLANKS), random.Random(3)
    atoms = [*blanks, "  ", "\r\n", "a", "Σ", "ß", "É", "​", "😀", "x-1", "$", "€", "USD"]
    texts = ["".join(draw.choice(atoms) for _ in range(draw.randint(0, 9))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    s = F.col("s")
    seen = df.select("s", values.words_of(s), values.strip_text(s), values.norm_text(s), values.squash(s), reading.lines_of(s)).collect()
    cut_at = lambda t, these: "".join("\0" if c in these else c for c in t).split("\0")
    for t, words, stripped, single, squashed, lines in seen:
        want = [w for w in cut_at(t, blanks) if w]
        assert words == want and stripped == t.strip(blanks) and single == " ".join(want)
        assert squashed == "".join(want).lower().replace("ß", "ss")
        assert lines == [x for x in (part.strip(blanks) for part in cut_at(t, "\r\n")) if x]
