"""Queries over printed pages (B20-B30). The SQL twins know what was printed, so they check the reading itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.definition import load_definition, load_hints, load_settings
from docsieve.functions import values as V
from docsieve.operators import reading
from docsieve.plans import oracle_views as O
from docsieve.plans import views
from docsieve.plans.catalog import query

INVOICE = load_definition("invoice")
HINTS = load_hints("invoice")
TIERS = load_settings("reader_tiers")


def page_text():
    return F.col("text")


def _lines(spark, sf):
    joined = reading.rejoin_smallcaps(page_text())
    df = views.pages(spark, sf).withColumns({"lines": reading.lines_of(joined), "currency": reading.currency_of(page_text())})
    return df.withColumn("priced", reading.priced_lines(F.col("lines"), F.col("currency")))


@query(f"WITH {O.CLEAN} SELECT doc_id, currency FROM clean")
def printed_currency(spark, sf):
    return views.pages(spark, sf).select("doc_id", reading.currency_of(page_text()).alias("currency"))


@query(f"WITH {O.CLEAN} SELECT doc_id, invoice_number FROM clean")
def id_by_pattern(spark, sf):
    found = reading.find_id(page_text(), HINTS["id_fields"]["invoice_number"])
    return views.pages(spark, sf).select("doc_id", found.alias("invoice_number"))


_SHOWN = lambda d: (
    f"CASE layout WHEN 'euro' THEN strftime({d}, '%d.%m.%Y') WHEN 'classic' THEN strftime({d}, '%m/%d/%Y') ELSE strftime({d}, '%b %d, %Y') END"
)


@query(
    f"""WITH {O.CLEAN} SELECT doc_id, {_SHOWN('invoice_date')} AS first_date, {_SHOWN('due_date')} AS second_date,
        {_SHOWN('invoice_date')} AS third_date FROM clean"""
)
def nth_date(spark, sf):
    dates = reading.printed_dates(page_text())
    names = ("first_date", "second_date", "third_date")
    return views.pages(spark, sf).withColumn("dates", dates).select(
        "doc_id", *[reading.nth_date(F.col("dates"), i).alias(n) for i, n in enumerate(names)]
    )


@query(f"WITH {O.CLEAN} SELECT doc_id, CAST(tax_rate * 100 AS INT) || CASE layout WHEN 'euro' THEN ' %' ELSE '%' END AS rate FROM clean")
def printed_rate(spark, sf):
    return views.pages(spark, sf).select("doc_id", reading.find_rate(page_text()).alias("rate"))


@query(f"WITH {O.CLEAN} SELECT doc_id, CAST(subtotal AS DOUBLE) AS subtotal, CAST(tax AS DOUBLE) AS tax, CAST(total AS DOUBLE) AS total FROM clean")
def labelled_amount(spark, sf):
    labels = HINTS["labeled_amounts"]
    amount = lambda n: V.norm_amount(reading.labelled_amount(F.col("priced"), labels[n])).cast("double")
    return _lines(spark, sf).select("doc_id", *[amount(n).alias(n) for n in ("subtotal", "tax", "total")])


@query(f"WITH {O.PURCHASE} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'UNKNOWN' ELSE vendor END AS vendor FROM po")
def labelled_value(spark, sf):
    label = F.when(F.col("doc_id") % 5 == 0, "Vendor: ").when(F.col("doc_id") % 2 == 0, "Vendor:  ").otherwise("Lieferant: ")
    value = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("record.vendor"))
    page = F.concat_ws("\n", F.lit("PURCHASE ORDER"), F.col("record.buyer"), F.concat(label, value), F.col("record.po_number"))
    labels = ["Vendor:", "Lieferant:"]
    found = reading.labelled_value(reading.lines_of(page), labels)
    return views.purchase_orders(spark, sf).select("doc_id", found.alias("vendor"))


@query(
    f"""WITH {O.CLEAN} SELECT doc_id, vendor AS with_repair, CASE layout WHEN 'euro' THEN substr(vendor, 2) ELSE vendor END AS without_repair
        FROM clean"""
)
def heading_value(spark, sf):
    rules = HINTS["heading_fields"]["vendor"]
    return _lines(spark, sf).select(
        "doc_id",
        reading.heading_value(F.col("lines"), rules).alias("with_repair"),
        reading.heading_value(reading.lines_of(page_text()), rules).alias("without_repair"),
    )


_EU_ = O._EU


@query(
    f"""WITH {O.CLEAN} SELECT doc_id, len(line_items) AS n, array_to_string(list_transform(line_items, lambda r:
        r.description || CASE WHEN layout = 'euro' AND {_EU_('r.amount')} <> {_EU_('r.unit_price')} AND contains({_EU_('r.amount')}, {_EU_('r.unit_price')})
          THEN ' ' || CAST(r.quantity AS BIGINT) || ' ' || trim(replace({_EU_('r.amount')}, {_EU_('r.unit_price')}, '')) || ':1:'
          ELSE ':' || CAST(r.quantity AS BIGINT) || ':' END || CAST(r.unit_price AS DECIMAL(18,2)) || ':' || CAST(r.amount AS DECIMAL(18,2))), '|') AS items
        FROM clean"""
)
def table_rows(spark, sf):
    two = lambda a: V.norm_amount(a).cast("decimal(18,2)").cast("string")
    shown = lambda r: F.concat_ws(":", r["description"], r["quantity"], two(r["unit_price"]), two(r["amount"]))
    rows = reading.table_rows(F.col("priced"), HINTS["table"], F.col("currency"))
    return _lines(spark, sf).withColumn("rows", rows).select(
        "doc_id", F.size("rows").cast("bigint").alias("n"), F.array_join(F.transform("rows", shown), "|").alias("items")
    )


@query(f"WITH {O.CLEAN} SELECT doc_id, CAST(subtotal AS DOUBLE) AS subtotal, CAST(subtotal AS DOUBLE) AS total FROM clean")
def amount_fallbacks(spark, sf):
    """Pages whose subtotal and total lines are torn off: the table's sum stands in for both."""
    torn = F.regexp_replace(page_text(), "(?m)^(Subtotal|Zwischensumme|Total Due|Gesamtbetrag).*$", "")
    df = views.pages(spark, sf).withColumn("text", torn)
    raw = reading.extract_record(df, HINTS, TIERS["frontier"], list(INVOICE.fields))
    amount = lambda n: V.norm_amount(F.col("raw")[n]).cast("double").alias(n)
    return raw.select("doc_id", amount("subtotal"), amount("total"))


@query(f"WITH {O.PAGES} SELECT doc_id, contains(text, chr(10) || vendor || chr(10)) AS whole_before, true AS whole_after, CASE layout WHEN 'euro' THEN 1 ELSE 0 END AS joined FROM (SELECT *, chr(10) || text AS t FROM pages_) WHERE layout = 'euro' UNION ALL SELECT doc_id, true, true, 0 FROM pages_ WHERE layout <> 'euro'")
def rejoin_smallcaps(spark, sf):
    padded = F.concat(F.lit("\n"), page_text())
    line = F.concat(F.lit("\n"), F.col("expected.vendor"), F.lit("\n"))
    joined = reading.rejoin_smallcaps(padded)
    return views.pages(spark, sf).select(
        "doc_id",
        F.contains(padded, line).alias("whole_before"),
        F.contains(joined, line).alias("whole_after"),
        (F.length(padded) - F.length(joined)).alias("joined"),
    )


@query(
    f"""WITH {O.CLEAN} SELECT doc_id, vendor, invoice_number, strftime(invoice_date, '%Y-%m-%d') AS invoice_date,
        strftime(due_date, '%Y-%m-%d') AS due_date, currency, CAST(subtotal AS DOUBLE) AS subtotal, CAST(tax_rate AS DOUBLE) AS tax_rate,
        CAST(total AS DOUBLE) AS total, greatest(len(line_items), 1) AS n_items, CAST(subtotal AS DOUBLE) AS items_sum FROM clean"""
)
def extract_record(spark, sf):
    df = reading.extract_record(views.pages(spark, sf), HINTS, TIERS["frontier"], list(INVOICE.fields))
    rec = V.canonical_fields(F.col("raw"), INVOICE)
    total = F.aggregate(F.col("items"), F.lit(0).cast("decimal(28,4)"), lambda a, r: (a + r["amount"]).cast("decimal(28,4)"))
    return df.withColumn("items", rec["line_items"]).select(
        "doc_id",
        *[rec[n].alias(n) for n in ("vendor", "invoice_number", "currency")],
        *[F.date_format(rec[n], "yyyy-MM-dd").alias(n) for n in ("invoice_date", "due_date")],
        *[rec[n].cast("double").alias(n) for n in ("subtotal", "tax_rate", "total")],
        F.size("items").cast("bigint").alias("n_items"),
        total.cast("double").alias("items_sum"),
    )
