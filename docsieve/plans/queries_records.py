"""Queries over canonical values and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.definition import latest_definition as newest_versions
from docsieve.definition import load_definition, rule_field_attribution as attribution
from docsieve.functions import values as V
from docsieve.functions.tables import Prefixed, with_prefixed
from docsieve.operators import metering, rules, validation
from docsieve.plans import oracle_views as O
from docsieve.plans import views
from docsieve.plans.catalog import query

INVOICE = load_definition("invoice")
PURCHASE = load_definition("purchase_order")
DAY = lambda c: F.date_format(c, "yyyy-MM-dd")
DBL = lambda c: c.cast("double")

_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL_SQUASH = lambda v: f"replace(lower(regexp_replace({v}, '{_WS}+', '', 'g')), 'ß', 'ss')"


@query(f"SELECT doc_id, trim(regexp_replace(text, '{_WS}+', ' ', 'g')) AS clean FROM documents")
def norm_text(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", V.norm_text(F.col("text")).alias("clean"))


def _printed_totals(spark, sf):
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    us = F.format_number(price, 2)
    eu = F.translate(us, ",.", ".,")
    shown = (
        F.when(key % 7 == 0, F.concat(F.lit("$ "), us))
        .when(key % 7 == 1, F.concat(eu, F.lit(" €")))
        .when(key % 7 == 2, F.concat(F.lit("USD "), F.translate(us, ",", "")))
        .when(key % 7 == 3, F.format_number(F.floor(price), 0))
        .when(key % 7 == 4, F.lit("N/A"))
        .when(key % 7 == 5, F.concat(F.lit("£"), eu))
        .otherwise(F.lit("€"))
    )
    return views.table(spark, sf, "orders").select("o_orderkey", shown.alias("shown"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0,1,2,5) THEN o_totalprice
       WHEN o_orderkey % 7 = 3 THEN floor(o_totalprice) END AS amount, CAST(o_orderkey || '123456789012.00' || o_orderkey AS DECIMAL(38,12))::VARCHAR AS exact FROM orders"""
)
def norm_amount(spark, sf):
    key = F.col("o_orderkey").cast("string")
    wide = V.norm_amount(F.concat(key, F.lit(",123,456,789,012.00"), key))
    return _printed_totals(spark, sf).select("o_orderkey", DBL(V.norm_amount(F.col("shown"))).alias("amount"), wide.cast("string").alias("exact"))


@query(
    """SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_tax AS DECIMAL(12,8))) AS DOUBLE) AS rate
       FROM lineitem GROUP BY 1, 2"""
)
def norm_rate(spark, sf):
    percent = F.round(F.col("l_tax") * 100, 0).cast("int").cast("string")
    kind = F.col("l_linenumber") % 3
    shown = (
        F.when(kind == 0, F.concat(percent, F.lit(" %")))
        .when(kind == 1, F.concat(percent, F.lit(".00%")))
        .otherwise(F.col("l_tax").cast("string"))
    )
    return (
        views.table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.sum(V.norm_rate(shown)).cast("double").alias("rate"))
    )


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN NULL WHEN o_orderkey % 8 = 1 AND day(o_orderdate) > 28 THEN NULL
         WHEN o_orderkey % 8 = 1 THEN strftime(make_date(year(o_orderdate), 2, day(o_orderdate)), '%Y-%m-%d')
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders
       WHERE NOT (o_orderkey % 8 = 1 AND day(o_orderdate) = 29)
       UNION ALL
       SELECT o_orderkey, CASE WHEN year(o_orderdate) % 4 = 0 THEN year(o_orderdate) || '-02-29' END
       FROM orders WHERE o_orderkey % 8 = 1 AND day(o_orderdate) = 29"""
)
def norm_date(spark, sf):
    d, key = F.to_date("o_orderdate"), F.col("o_orderkey") % 8
    forms = ["M/d/yyyy", None, "dd.MM.yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy"]
    shown = F.lit("sometime in march")
    for i, form in enumerate(forms):
        if form:
            shown = F.when(key == i, F.date_format(d, form)).otherwise(shown)
    february = F.concat_ws(".", F.dayofmonth(d).cast("string"), F.lit("2"), F.year(d).cast("string"))
    shown = F.when(key == 1, february).otherwise(shown)
    return views.table(spark, sf, "orders").select("o_orderkey", DAY(V.norm_date(shown)).alias("day"))


def _raw_records(spark, sf):
    """Printed, not yet canonical, records: what an extractor hands over."""
    clean = views.clean_records(spark, sf)
    rec = F.col("record")
    euro = F.col("layout") == "euro"
    money = lambda a: F.when(euro, views._eu(a)).otherwise(views._us(a))
    day = lambda d: F.when(euro, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "MMM d, yyyy"))
    row = lambda r: F.struct(
        F.concat(F.lit(" "), r["description"], F.lit(" ")).alias("description"),
        r["quantity"].cast("bigint").cast("string").alias("quantity"),
        money(r["unit_price"]).alias("unit_price"),
        money(r["amount"]).alias("amount"),
    )
    raw = F.struct(
        F.regexp_replace(rec["vendor"], " ", "  ").alias("vendor"),
        rec["invoice_number"].alias("invoice_number"),
        day(rec["invoice_date"]).alias("invoice_date"),
        day(rec["due_date"]).alias("due_date"),
        rec["currency"].alias("currency"),
        money(rec["subtotal"]).alias("subtotal"),
        F.concat((rec["tax_rate"] * 100).cast("int").cast("string"), F.lit("%")).alias("tax_rate"),
        money(rec["tax"]).alias("tax"),
        money(rec["total"]).alias("total"),
        F.transform(rec["line_items"], row).alias("line_items"),
    )
    return clean.select("doc_id", raw.alias("raw"))


@query(
    f"""WITH {O.CLEAN} SELECT doc_id, vendor, strftime(invoice_date, '%Y-%m-%d') AS invoice_date,
        strftime(due_date, '%Y-%m-%d') AS due_date, CAST(subtotal AS DOUBLE) AS subtotal, CAST(tax_rate AS DOUBLE) AS tax_rate,
        CAST(tax AS DOUBLE) AS tax, CAST(total AS DOUBLE) AS total, len(line_items) AS n_items,
        array_to_string(list_transform(line_items, lambda r: r.description || ':' || CAST(CAST(r.quantity AS DECIMAL(37,12)) AS VARCHAR) || ':' || CAST(CAST(r.amount AS DECIMAL(37,12)) AS VARCHAR)), '|') AS items
        FROM clean"""
)
def normalize_record(spark, sf):
    r = F.col("record")
    out = _raw_records(spark, sf).withColumn("record", V.normalize_record(F.col("raw"), INVOICE))
    shown = F.transform(
        r["line_items"],
        lambda i: F.concat_ws(":", i["description"], i["quantity"].cast("string"), i["amount"].cast("string")),
    )
    return out.select(
        "doc_id",
        r["vendor"].alias("vendor"),
        DAY(r["invoice_date"]).alias("invoice_date"),
        DAY(r["due_date"]).alias("due_date"),
        *[DBL(r[n]).alias(n) for n in ("subtotal", "tax_rate", "tax", "total")],
        F.size(r["line_items"]).cast("bigint").alias("n_items"),
        F.array_join(shown, "|").alias("items"),
    )


_PLAIN = lambda e: f"regexp_replace(regexp_replace(CAST({e} AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


@query(
    f"""WITH {O.CLEAN} SELECT doc_id, to_json({{'vendor': vendor, 'invoice_number': invoice_number,
        'invoice_date': strftime(invoice_date, '%Y-%m-%d'), 'due_date': strftime(due_date, '%Y-%m-%d'), 'currency': currency,
        'subtotal': {_PLAIN('subtotal')}, 'tax_rate': {_PLAIN('tax_rate')}, 'tax': {_PLAIN('tax')}, 'total': {_PLAIN('total')},
        'line_items': list_transform(line_items, lambda r: {{'description': r.description, 'quantity': {_PLAIN('r.quantity')},
          'unit_price': {_PLAIN('r.unit_price')}, 'amount': {_PLAIN('r.amount')}}})}})::VARCHAR AS json FROM clean"""
)
def json_record(spark, sf):
    return views.clean_records(spark, sf).select("doc_id", V.json_record(F.col("record"), INVOICE).alias("json"))


@query(
    f"""WITH {O.CLEAN}, cells AS (
        SELECT doc_id, unnest(list_concat(
          [{{'name':'vendor','value':vendor}}, {{'name':'invoice_number','value':invoice_number}},
           {{'name':'invoice_date','value':strftime(invoice_date, '%Y-%m-%d')}}, {{'name':'due_date','value':strftime(due_date, '%Y-%m-%d')}},
           {{'name':'currency','value':currency}}, {{'name':'subtotal','value':{_PLAIN('subtotal')}}},
           {{'name':'tax_rate','value':{_PLAIN('tax_rate')}}}, {{'name':'tax','value':{_PLAIN('tax')}}},
           {{'name':'total','value':{_PLAIN('total')}}}, {{'name':'line_items.count','value':CAST(len(line_items) AS VARCHAR)}}],
          flatten(list_transform(line_items, lambda r, i: [
            {{'name':'line_items.' || (i-1) || '.description','value':r.description}},
            {{'name':'line_items.' || (i-1) || '.quantity','value':{_PLAIN('r.quantity')}}},
            {{'name':'line_items.' || (i-1) || '.unit_price','value':{_PLAIN('r.unit_price')}}},
            {{'name':'line_items.' || (i-1) || '.amount','value':{_PLAIN('r.amount')}}}])))) AS c FROM clean)
        SELECT doc_id, c.name AS name, c.value AS value FROM cells"""
)
def flatten_fields(spark, sf):
    cells = F.inline_outer(V.flatten_fields(F.col("record"), INVOICE))
    return views.clean_records(spark, sf).select("doc_id", cells)


def _payloads(spark, sf):
    """JSON answers, most of them valid; faults by order key."""
    key = F.col("doc_id")
    raw = _raw_records(spark, sf).withColumn("json", F.to_json("raw"))
    spoiled = (
        F.when(key % 15 == 0, F.lit("not json"))
        .when(key % 15 == 1, F.regexp_replace("json", '"currency":"[A-Z]+"', '"currency":"XXX"'))
        .when(key % 15 == 2, F.regexp_replace("json", '"vendor":"[^"]*"', '"vendor":""'))
        .when(key % 15 == 3, F.regexp_replace("json", '"vendor":"[^"]*",', ""))
        .when(key % 15 == 4, F.regexp_replace("json", '^\\{', '{"note":"x",'))
        .when(key % 15 == 5, F.regexp_replace("json", '"due_date":"[^"]*"', '"due_date":"31.02.2026"'))
        .when(key % 15 == 6, F.regexp_replace("json", '"total":"[^"]*"', '"total":12'))
        .when(key % 15 == 7, F.replace("json", F.lit('"line_items":[{'), F.lit('"line_items":[{"color":"red",')))
        .when(key % 15 == 8, F.regexp_replace("json", '"quantity":"[^"]*",', ""))
        .when(key % 15 == 9, F.regexp_replace("json", '"quantity":"[^"]*"', '"quantity":7'))
        .when(key % 15 == 10, F.replace("json", F.lit('"line_items":[{'), F.lit('"line_items":["stray",{')))
        .otherwise(F.col("json"))
    )
    return raw.select("doc_id", spoiled.alias("payload"))


@query(
    """SELECT o_orderkey AS doc_id, fault > 10 AS valid, CASE fault
         WHEN 0 THEN 'ValidationError: <root>: not a JSON object'
         WHEN 1 THEN 'ValidationError: currency: ''XXX'' is not one of the allowed values'
         WHEN 2 THEN 'ValidationError: vendor: '''' should be non-empty'
         WHEN 3 THEN 'ValidationError: <root>: ''vendor'' is a required property'
         WHEN 4 THEN 'ValidationError: <root>: additional properties are not allowed (''note'')'
         WHEN 5 THEN 'ValueError: due_date: unparseable date'
         WHEN 6 THEN 'ValidationError: total: not of type ''string'''
         WHEN 7 THEN 'ValidationError: line_items/0: additional properties are not allowed (''color'')'
         WHEN 8 THEN 'ValidationError: line_items/0: ''quantity'' is a required property'
         WHEN 9 THEN 'ValidationError: line_items/0/quantity: not of type ''string'''
         WHEN 10 THEN 'ValidationError: line_items/0: not of type ''object''' END AS error
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 15 > 6 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 11 ELSE o_orderkey % 15 END AS fault FROM orders)"""
)
def validate_payload(spark, sf):
    checked = validation.validate_payload(_payloads(spark, sf), INVOICE)
    return checked.select("doc_id", (F.size("errors") == 0).alias("valid"), F.get("errors", F.lit(0)).alias("error"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN trim(text, ' ' || chr(10) || chr(9) || chr(13)) ELSE trim(text, ' ' || chr(10) || chr(9) || chr(13)) END AS body FROM documents")
def strip_fences(spark, sf):
    text, kind = F.col("text"), F.col("doc_id") % 3
    fenced = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("  ```\n"), text, F.lit("```  ")))
        .otherwise(text)
    )
    return views.table(spark, sf, "documents").select("doc_id", V.strip_fences(fenced).alias("body"))


@query(f"SELECT doc_id, {SQL_SQUASH('text')} AS squashed FROM documents")
def squash(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", V.squash(F.col("text")).alias("squashed"))


@query(f"SELECT doc_id, substr(sha256(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')), 1, 16) AS key FROM documents")
def document_key(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", V.document_key(F.col("text")).alias("key"))


@query("SELECT doc_id, CAST(floor(length(text) / 4) + 1 AS BIGINT) AS tokens FROM documents")
def estimate_tokens(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", V.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"WITH {O.USAGE} SELECT event_id, tier, CAST(cost_usd AS DOUBLE) AS cost FROM priced")
def call_cost(spark, sf):
    priced = metering.with_cost(views.usage(spark, sf))
    return priced.select("event_id", F.col("model_tier").alias("tier"), DBL(F.col("cost_usd")).alias("cost"))


@query(
    f"""WITH {O.USAGE} SELECT event_id, CAST(CAST(round((input_tokens * CASE WHEN tier = 'frontier' THEN 5 ELSE 1 END
        + 8192 * CASE WHEN tier = 'frontier' THEN 25 ELSE 5 END) * CAST(0.000001 AS DECIMAL(7,6)), 6) AS DECIMAL(12,6)) AS DOUBLE) AS cost
        FROM usage"""
)
def worst_case_cost(spark, sf):
    priced = metering.with_worst_case_cost(views.usage(spark, sf))
    return priced.select("event_id", DBL(F.col("worst_case_usd")).alias("cost"))


@query(
    f"""SELECT doc_id, CAST(floor(({len(metering.system_prompt(INVOICE))} + {len(metering.user_prefix(INVOICE))} + length(text)) / 4) + 1 AS BIGINT)
        AS prompt_tokens FROM documents"""
)
def prompt_text(spark, sf):
    prompt = metering.prompt_text(F.col("text"), INVOICE)
    return views.table(spark, sf, "documents").select("doc_id", V.estimate_tokens(prompt).alias("prompt_tokens"))


@query(
    """SELECT doc_id, lang || '/incoming/' || sha256(text) || '.pdf' AS incoming, lang || '/parsed/' || doc_id || '.txt' AS parsed
       FROM documents"""
)
def object_key(spark, sf):
    incoming, parsed = V.object_keys(F.col("lang"), F.sha2("text", 256), F.col("doc_id"))
    return views.table(spark, sf, "documents").select("doc_id", incoming.alias("incoming"), parsed.alias("parsed"))


@query("SELECT doc_id, CASE WHEN length(text) < 100 THEN 'needs_ocr' ELSE 'parsed' END AS status, length(text) AS text_chars FROM documents")
def parse_gate(spark, sf):
    text = F.col("text")
    return views.table(spark, sf, "documents").select(
        "doc_id", V.parse_gate(text).alias("status"), F.length(text).cast("bigint").alias("text_chars")
    )


# --- rules ------------------------------------------------------------------------------------

_SUM = "coalesce(list_sum(list_transform(line_items, lambda r: r.amount)), 0)"
SQL_RULES = {
    "line_items_sum_to_subtotal": f"abs({_SUM} - subtotal) <= 0.01",
    "subtotal_plus_tax_equals_total": "abs(subtotal + tax - total) <= 0.01",
    "tax_matches_rate": "abs(subtotal * tax_rate - tax) <= 0.02",
    "invoice_date_parses": "invoice_date IS NOT NULL",
    "due_date_not_before_invoice_date": "coalesce(due_date >= invoice_date, false)",
}
SQL_BAD_ROWS = (
    "list_filter(list_transform(line_items, lambda r, k: CASE WHEN abs(CAST(r.quantity * r.unit_price AS DECIMAL(38,8)) - r.amount) > 0.01 "
    "THEN k - 1 END), lambda k: k IS NOT NULL)"
)


def _rule_query(rule_name):
    def run(spark, sf):
        rule = next(r for r in INVOICE.rules if r.name == rule_name)
        return views.faulty_records(spark, sf).select(
            "doc_id", rules.evaluate_rule(rule, F.col("record"), INVOICE).alias("passed")
        )

    return run


for _name, _rule in {
    "sum_equals": "line_items_sum_to_subtotal",
    "terms_equal": "subtotal_plus_tax_equals_total",
    "product_equals": "tax_matches_rate",
    "required": "invoice_date_parses",
}.items():
    query(f"WITH {O.faulty()} SELECT doc_id, {SQL_RULES[_rule]} AS passed FROM faulty", name=_name)(_rule_query(_rule))


@query(f"WITH {O.PURCHASE} SELECT doc_id, coalesce(delivery_date >= order_date, false) AS passed FROM po")
def date_order(spark, sf):
    rule = next(r for r in PURCHASE.rules if r.type == "date_order")
    passed = rules.evaluate_rule(rule, F.col("record"), PURCHASE)
    return views.purchase_orders(spark, sf).select("doc_id", passed.alias("passed"))


@query(
    rf"WITH {O.PURCHASE} SELECT doc_id, regexp_full_match(po_number, 'PO-\d{{4}}-\d{{5}}|BA-\d{{4}}/\d{{4}}') AS passed FROM po"
)
def regex_rule(spark, sf):
    rule = next(r for r in PURCHASE.rules if r.type == "regex")
    passed = rules.evaluate_rule(rule, F.col("record"), PURCHASE)
    return views.purchase_orders(spark, sf).select("doc_id", passed.alias("passed"))


@query(f"WITH {O.faulty()} SELECT doc_id, array_to_string({SQL_BAD_ROWS}, ',') AS bad FROM faulty")
def inconsistent_rows(spark, sf):
    bad = rules.inconsistent_rows(F.col("record"), INVOICE)["line_items"]
    return views.faulty_records(spark, sf).select("doc_id", F.array_join(bad.cast("array<string>"), ",").alias("bad"))


@query(
    f"""WITH {O.faulty()} SELECT doc_id, CAST({_SUM} - subtotal AS DOUBLE) AS items_miss, CAST(subtotal + tax - total AS DOUBLE) AS total_miss,
        CAST(subtotal * tax_rate - tax AS DOUBLE) AS tax_miss FROM faulty"""
)
def residuals(spark, sf):
    miss = rules.residuals(F.col("record"), INVOICE)
    return views.faulty_records(spark, sf).select(
        "doc_id",
        miss["line_items_sum_to_subtotal"].alias("items_miss"),
        miss["subtotal_plus_tax_equals_total"].alias("total_miss"),
        miss["tax_matches_rate"].alias("tax_miss"),
    )


@query(
    f"""WITH {O.CUSTOMERS},{O.ITEMS} SELECT o_orderkey AS doc_id, coalesce(i.subtotal, 0) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END = coalesce(i.subtotal, 0) AS sums_up,
        coalesce(b.bad, 0) AS bad_rows FROM orders LEFT JOIN items i ON o_orderkey = i.l_orderkey
        LEFT JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber % 3 = 0) AS bad FROM lines GROUP BY 1) b ON o_orderkey = b.l_orderkey"""
)
def long_form_rules(spark, sf):
    """Sum and row rules over line tables, without building one array per document."""
    part = views.table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(18,4)").alias("unit_price"))
    lines = views.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").cast("decimal(18,4)").alias("quantity"))
    exact = (F.col("quantity") * F.col("unit_price")).cast("decimal(18,4)")
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("doc_id"), "quantity", "unit_price", exact.alias("amount"), "l_linenumber"
    )
    sums = rows.groupBy("doc_id").agg(F.sum("amount").alias("total"))
    extra = F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    headers = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id")).join(sums, "doc_id", "left").select(
        "doc_id", (F.coalesce("total", F.lit(0)) + extra).cast("decimal(18,4)").alias("subtotal")
    )
    summed = rules.long_form_rules(headers, rows, INVOICE).select("doc_id", F.col("line_items_sum_to_subtotal").alias("sums_up"))
    broken = rows.withColumn("quantity", F.when(F.col("l_linenumber") % 3 != 0, F.col("quantity")))
    rowwise = rules.long_form_rules(headers, broken, INVOICE).select("doc_id", F.col("row_arithmetic_bad").alias("bad_rows"))
    return summed.join(rowwise, "doc_id")


# Twenty digits before the point and six behind it, a rate with eight places, and sums that miss by a millionth more than allowed.
_WIDE = """
wide AS (SELECT o_orderkey AS doc_id, CAST(o_orderkey || '1234567890123' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS HUGEINT) AS subtotal, 7000000 + o_orderkey % 1000000 AS rate FROM orders),
taxed AS (SELECT *, subtotal * rate AS fine, subtotal * rate // 100000000 + CASE o_orderkey_5 WHEN 0 THEN 20000 WHEN 1 THEN 20001 ELSE 0 END AS tax FROM (SELECT *, doc_id % 5 AS o_orderkey_5 FROM wide)),
summed AS (SELECT *, subtotal + tax + CASE WHEN doc_id % 7 = 0 THEN 10001 WHEN doc_id % 7 = 1 THEN 10000 ELSE 0 END AS total FROM taxed)"""


def _wide_records(spark, sf):
    key = F.col("o_orderkey")
    six = F.lpad((key % 1000000).cast("string"), 6, "0")
    subtotal = F.concat(key.cast("string"), F.lit("1234567890123."), six)
    wide = views.table(spark, sf, "orders").select(
        key.alias("doc_id"), subtotal.alias("subtotal"), F.concat(F.lit("7."), six, F.lit(" %")).alias("rate"),
        F.floor(subtotal.cast("decimal(26,6)") * F.concat(F.lit("0.07"), six).cast("decimal(8,8)"), F.lit(6)).alias("even"),
    )
    step = lambda n, rest, fine: F.when(F.col("doc_id") % n == rest, F.lit(fine).cast("decimal(7,6)"))
    tax = (F.col("even") + F.coalesce(step(5, 0, "0.02"), step(5, 1, "0.020001"), F.lit("0").cast("decimal(7,6)"))).cast("decimal(30,6)")
    total = F.col("subtotal").cast("decimal(30,6)") + F.col("tax") + F.coalesce(step(7, 0, "0.010001"), step(7, 1, "0.01"), F.lit("0").cast("decimal(7,6)"))
    wide = wide.withColumn("tax", tax).withColumn("total", total)
    row = F.struct(F.lit("line").alias("description"), F.lit("1").alias("quantity"), F.col("subtotal").alias("unit_price"), F.col("subtotal").alias("amount"))
    values = {"subtotal": F.col("subtotal"), "tax_rate": F.col("rate"), "tax": F.col("tax").cast("string"), "total": F.col("total").cast("string"), "line_items": F.array(row)}
    raw = F.struct(*[values.get(n, F.lit(None).cast("string")).alias(n) for n in INVOICE.fields])
    return wide.select("doc_id", V.normalize_record(raw, INVOICE).alias("record"))


@query(
    f"WITH {_WIDE} SELECT doc_id, CAST(CAST(subtotal AS VARCHAR)[:-7] || '.' || CAST(subtotal AS VARCHAR)[-6:] AS DECIMAL(37,12))::VARCHAR AS subtotal, "
    "CAST(rate * 0.00000001::DECIMAL(9,8) AS DECIMAL(22,12))::VARCHAR AS tax_rate, CAST(CAST(total AS VARCHAR)[:-7] || '.' || CAST(total AS VARCHAR)[-6:] AS DECIMAL(37,12))::VARCHAR AS total FROM summed"
)
def normalize_wide(spark, sf):
    """B5 on amounts of twenty digits and six places: nothing is rounded or lost."""
    r = F.col("record")
    return _wide_records(spark, sf).select("doc_id", *[r[n].cast("string").alias(n) for n in ("subtotal", "tax_rate", "total")])


@query(
    f"WITH {_WIDE} SELECT doc_id, abs(fine - tax * 100000000) <= 2000000000000 AS tax_holds, abs(subtotal + tax - total) <= 10000 AS total_holds, true AS rows_hold, "
    "CAST(fine - tax * 100000000 AS DOUBLE) / 100000000000000.0::DOUBLE AS tax_miss, CAST(subtotal + tax - total AS DOUBLE) / 1000000.0::DOUBLE AS total_miss FROM summed"
)
def rules_wide(spark, sf):
    """C1-C4 and C8 on the same records: a miss of one millionth more than the tolerance fails a rule."""
    r = F.col("record")
    holds, miss = rules.rule_outcomes(r, INVOICE), rules.rule_misses(r, INVOICE)
    return _wide_records(spark, sf).select(
        "doc_id", holds["tax_matches_rate"].alias("tax_holds"), holds["subtotal_plus_tax_equals_total"].alias("total_holds"),
        (holds["line_items_sum_to_subtotal"] & (F.size(rules.inconsistent_rows(r, INVOICE)["line_items"]) == 0)).alias("rows_hold"),
        *[miss[n].alias(a) for n, a in (("tax_matches_rate", "tax_miss"), ("subtotal_plus_tax_equals_total", "total_miss"))],
    )


_ALL_RULES = " AND ".join(f"({s})" for s in SQL_RULES.values())


@query(
    f"WITH {O.faulty()} SELECT doc_id, {', '.join(f'{s} AS {n}' for n, s in SQL_RULES.items())}, {_ALL_RULES} AS passed FROM faulty"
)
def evaluate_rules(spark, sf):
    df = with_prefixed(views.faulty_records(spark, sf), "rule", rules.rule_outcomes(F.col("record"), INVOICE))
    outcome = Prefixed("rule")
    passed = rules.validation_passed(outcome, INVOICE, F.col("record"))
    return df.select("doc_id", *[outcome[r.name].alias(r.name) for r in INVOICE.document_rules], passed.alias("passed"))


@query(
    f"WITH {O.faulty()}, failed AS ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS field, '{r.name}' AS rule FROM faulty WHERE NOT ({SQL_RULES[r.name]})"
        for r in INVOICE.document_rules
        for f in r.fields
    )
    + ") SELECT rule, field, count(*) AS n FROM failed GROUP BY 1, 2"
)
def rule_field_attribution(spark, sf):
    """C10 joined to outcomes: how often each field is implicated by a failing rule."""
    outcomes = rules.evaluate_rules(F.col("record"), INVOICE)
    failed = F.array_compact(
        F.array(*[F.when(~outcomes[r.name], F.lit(r.name)) for r in INVOICE.document_rules])
    )
    long = views.faulty_records(spark, sf).select(F.explode(failed).alias("rule"))
    counts = long.groupBy("rule").agg(F.count("*").alias("n"))
    return counts.join(attribution(spark, INVOICE), "rule").select("rule", "field", "n")


@query(f"WITH {O.DOCS} SELECT status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'archived' ELSE status END AS status FROM docs) WHERE status = 'archived' GROUP BY 1")
def status_domain_check(spark, sf):
    spoiled = views.document_rows(spark, sf).withColumn(
        "status", F.when(F.col("doc_id") % 5 == 0, "archived").otherwise(F.col("status"))
    )
    return rules.status_domain_check(spoiled)


@query(
    """SELECT 't' || (o_custkey % 10) AS tenant_id, 'd' || (o_custkey % 50) AS slug, max(o_orderkey) AS version
       FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2"""
)
def latest_definition(spark, sf):
    versions = views.table(spark, sf, "orders").select(
        F.concat(F.lit("t"), (F.col("o_custkey") % 10).cast("string")).alias("tenant_id"),
        F.concat(F.lit("d"), (F.col("o_custkey") % 50).cast("string")).alias("slug"),
        F.col("o_orderkey").alias("version"),
        (F.col("o_orderstatus") != "P").alias("is_active"),
    )
    return newest_versions(versions).select("tenant_id", "slug", "version")
