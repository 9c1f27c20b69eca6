"""Base views over the given tables: records, their printed text, usage, documents and streams.

They turn generic tables into the inputs the operators expect. Each one is a
plain DataFrame plan; its SQL twin for checking lives in `plans.oracle_views`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions.values import hash_draw
from docsieve.operators.corruption import ERROR_CLASSES, apply_corruption, plan_corruption

SEED = 1337
FAULT_RATE = 0.35
EPOCH = "2024-01-01 00:00:00"
NOW = "2024-02-15 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _dec(value: Column) -> Column:
    return value.cast("decimal(18,4)")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with the currency and layout family of their region."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf, "region").select("r_regionkey", "r_name")
    return (
        table(spark, sf, "customer")
        .select("c_custkey", "c_name", "c_nationkey")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_name", F.when(F.col("r_name") == "EUROPE", "EUR").otherwise("USD").alias("currency"))
    )


def order_items(spark: SparkSession, sf: str) -> DataFrame:
    """The table rows of each order, in a fully tie-broken order, with their sum and tax rate."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", _dec(F.col("p_retailprice")).alias("price"))
    quantity = _dec(F.col("l_quantity"))
    row = F.struct(
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        F.col("p_name").alias("description"),
        quantity.alias("quantity"),
        F.col("price").alias("unit_price"),
        _dec(quantity * F.col("price")).alias("amount"),
    )
    lines = (
        table(spark, sf, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    grouped = lines.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(row)).alias("sorted_rows"),
        F.sum(_dec(quantity * F.col("price"))).alias("sum_amount"),
        F.max("l_tax").alias("max_tax"),
    )
    columns = ("description", "quantity", "unit_price", "amount")
    items = F.transform("sorted_rows", lambda r: F.struct(*[r[c].alias(c) for c in columns]))
    return grouped.select(
        "l_orderkey",
        items.alias("line_items"),
        _dec(F.col("sum_amount")).alias("subtotal"),
        F.col("max_tax").cast("decimal(12,8)").alias("tax_rate"),
    )


_NO_ROWS = "array<struct<description:string,quantity:decimal(18,4),unit_price:decimal(18,4),amount:decimal(18,4)>>"


def clean_records(spark: SparkSession, sf: str) -> DataFrame:
    """One invoice per order, all rules satisfied: doc_id, doc_key, tenant_id, layout, record."""
    legal_form = F.get(F.array(*[F.lit(x) for x in ("AG", "KG", "Ltd", "GmbH")]), F.col("c_custkey") % 4)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    joined = (
        orders.join(customers(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
        .join(order_items(spark, sf), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .withColumns(
            {
                "line_items": F.coalesce("line_items", F.array().cast(_NO_ROWS)),
                "subtotal": F.coalesce("subtotal", F.lit(0).cast("decimal(18,4)")),
                "tax_rate": F.coalesce("tax_rate", F.lit(0).cast("decimal(12,8)")),
            }
        )
        .withColumn("tax", _dec(F.round(F.col("subtotal") * F.col("tax_rate"), 2)))
    )
    number = F.concat(
        F.lit("INV-"), F.year("day").cast("string"), F.lit("-"), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0")
    )
    record = F.struct(
        F.concat_ws(" ", "c_name", legal_form).alias("vendor"),
        number.alias("invoice_number"),
        F.col("day").alias("invoice_date"),
        F.date_add("day", 30).alias("due_date"),
        "currency",
        "subtotal",
        "tax_rate",
        "tax",
        _dec(F.col("subtotal") + F.col("tax")).alias("total"),
        "line_items",
    )
    layout = F.when(F.col("currency") == "EUR", "euro").when(F.col("o_orderkey") % 2 == 0, "classic").otherwise("modern")
    return joined.select(
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_orderkey").cast("string").alias("doc_key"),
        F.concat(F.lit("t"), (F.col("o_custkey") % 10).cast("string")).alias("tenant_id"),
        layout.alias("layout"),
        record.alias("record"),
    )


def faulty_records(spark: SparkSession, sf: str, classes: tuple[str, ...] = ERROR_CLASSES, text: bool = False) -> DataFrame:
    """Invoices with planned faults; `expected` keeps the clean record, `text` its printed page."""
    df = clean_records(spark, sf).withColumn("expected", F.col("record"))
    if text:
        df = df.withColumn("text", printed(F.col("record"), F.col("layout")))
    df = df.withColumn("error_class", plan_corruption(F.col("doc_key"), FAULT_RATE, SEED, classes))
    return apply_corruption(df, F.col("doc_key"), SEED)


def _us(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def _eu(amount: Column) -> Column:
    return F.concat(F.translate(F.format_number(amount, 2), ",.", ".,"), F.lit(" €"))


def printed(record: Column, layout: Column) -> Column:
    """The page a clean invoice is printed on, in one of three layouts."""
    euro, classic = layout == "euro", layout == "classic"
    money = lambda a: F.when(euro, _eu(a)).otherwise(_us(a))
    day = lambda d: (
        F.when(euro, F.date_format(d, "dd.MM.yyyy"))
        .when(classic, F.date_format(d, "MM/dd/yyyy"))
        .otherwise(F.date_format(d, "MMM dd, yyyy"))
    )
    percent = (record["tax_rate"] * 100).cast("int").cast("string")

    def row(r: Column, i: Column) -> Column:
        quantity = r["quantity"].cast("bigint").cast("string")
        prices = F.concat_ws(" ", money(r["unit_price"]), money(r["amount"]))
        return (
            F.when(euro, F.concat_ws(" ", (i + 1).cast("string"), r["description"], quantity, prices))
            .when(classic, F.concat_ws(" ", r["description"], quantity, prices))
            .otherwise(F.concat_ws(" ", quantity, r["description"], prices))
        )

    vendor = record["vendor"]
    head_euro = F.array(
        F.lit("RECHNUNG"),
        F.substring(vendor, 1, 1),
        F.substr(vendor, F.lit(2)),
        F.concat(F.lit("Rechnung Nr. "), record["invoice_number"]),
        F.concat(F.lit("Rechnungsdatum: "), day(record["invoice_date"])),
        F.concat(F.lit("Zahlbar innerhalb von 30 Tagen bis "), day(record["due_date"])),
        F.lit("Pos. Beschreibung Menge Preis Betrag"),
    )
    head_us = F.array(
        vendor,
        F.lit("INVOICE"),
        F.concat(F.lit("Invoice No: "), record["invoice_number"]),
        F.concat(F.lit("Invoice Date: "), day(record["invoice_date"])),
        F.concat(F.lit("Due Date: "), day(record["due_date"])),
        F.when(classic, "DESCRIPTION QTY PRICE AMOUNT").otherwise("QTY ITEM PRICE AMOUNT"),
    )
    foot_euro = F.array(
        F.concat(F.lit("Zwischensumme "), _eu(record["subtotal"])),
        F.concat(F.lit("MwSt "), percent, F.lit(" % "), _eu(record["tax"])),
        F.concat(F.lit("Gesamtbetrag "), _eu(record["total"])),
    )
    foot_us = F.array(
        F.concat(F.lit("Subtotal "), _us(record["subtotal"])),
        F.concat(F.lit("Sales Tax ("), percent, F.lit("%) "), _us(record["tax"])),
        F.concat(F.lit("Total Due "), _us(record["total"])),
    )
    lines = F.concat(
        F.when(euro, head_euro).otherwise(head_us),
        F.transform(record["line_items"], row),
        F.when(euro, foot_euro).otherwise(foot_us),
    )
    return F.array_join(lines, "\n")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Printed invoices: doc_id, doc_key, tenant_id, layout, expected, text."""
    clean = clean_records(spark, sf)
    return clean.withColumn("text", printed(F.col("record"), F.col("layout"))).withColumnRenamed("record", "expected")


def purchase_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Purchase-order records; a third of the numbers break the format, many deliveries precede the order."""
    first_ship = (
        table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(F.to_date("l_shipdate")).alias("shipped"))
    )
    key = F.col("o_orderkey")
    tail = F.lpad((key % 100000).cast("string"), 5, "0")
    year = F.year("day").cast("string")
    shipping = F.when(F.col("o_orderpriority").startswith("1"), 25).otherwise(10).cast("decimal(18,4)")
    items = order_items(spark, sf).select("l_orderkey", "line_items", "subtotal")
    joined = (
        table(spark, sf, "orders")
        .select("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
        .join(customers(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
        .join(items, key == items.l_orderkey, "left")
        .drop("l_orderkey")
        .join(first_ship, key == first_ship.l_orderkey, "left")
    )
    subtotal = F.coalesce("subtotal", F.lit(0).cast("decimal(18,4)"))
    record = F.struct(
        F.col("c_name").alias("buyer"),
        F.concat(F.lit("Supplier "), (key % 7).cast("string")).alias("vendor"),
        F.when(key % 3 == 0, F.concat(F.lit("PO/"), tail)).otherwise(F.concat_ws("-", F.lit("PO"), year, tail)).alias("po_number"),
        F.col("day").alias("order_date"),
        F.col("shipped").alias("delivery_date"),
        "currency",
        subtotal.alias("subtotal"),
        shipping.alias("shipping"),
        _dec(subtotal + shipping).alias("total"),
        F.coalesce("line_items", F.array().cast(_NO_ROWS)).alias("line_items"),
    )
    return joined.select(key.alias("doc_id"), record.alias("record"))


def clean_purchase_orders(spark: SparkSession, sf: str) -> DataFrame:
    """One purchase order per order, all rules satisfied, deliveries due after 14 days: the columns of `clean_records`."""
    key = F.col("o_orderkey")
    items = order_items(spark, sf).select("l_orderkey", "line_items", "subtotal")
    joined = (
        table(spark, sf, "orders")
        .select("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
        .join(customers(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
        .join(items, key == items.l_orderkey, "left")
        .withColumn("subtotal", F.coalesce("subtotal", F.lit(0).cast("decimal(18,4)")))
    )
    euro, year = F.col("currency") == "EUR", F.year("day").cast("string")
    digits = lambda n: F.lpad((key % 10**n).cast("string"), n, "0")
    number = F.when(euro, F.concat(F.lit("BA-"), year, F.lit("/"), digits(4))).otherwise(F.concat_ws("-", F.lit("PO"), year, digits(5)))
    shipping = F.when(F.col("o_orderpriority").startswith("1"), 25).otherwise(10).cast("decimal(18,4)")
    record = F.struct(
        F.concat_ws(" ", "c_name", F.lit("GmbH")).alias("buyer"),
        F.concat(F.lit("Supplier-"), digits(3), F.lit(" KG")).alias("vendor"),
        number.alias("po_number"),
        F.col("day").alias("order_date"),
        F.date_add("day", 14).alias("delivery_date"),
        "currency",
        "subtotal",
        shipping.alias("shipping"),
        _dec(F.col("subtotal") + shipping).alias("total"),
        F.coalesce("line_items", F.array().cast(_NO_ROWS)).alias("line_items"),
    )
    return joined.select(
        key.alias("doc_id"),
        key.cast("string").alias("doc_key"),
        F.concat(F.lit("t"), (F.col("o_custkey") % 10).cast("string")).alias("tenant_id"),
        F.when(euro, "euro").otherwise("standard").alias("layout"),
        record.alias("record"),
    )


def printed_order(record: Column, layout: Column) -> Column:
    """The page a clean purchase order is printed on, in one of two layouts."""
    euro = layout == "euro"
    money = lambda a: F.when(euro, _eu(a)).otherwise(_us(a))
    day = lambda d: F.when(euro, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))
    say = lambda german, english, value: F.concat(F.when(euro, german).otherwise(english), value)

    def row(r: Column, i: Column) -> Column:
        quantity, prices = r["quantity"].cast("bigint").cast("string"), F.concat_ws(" ", money(r["unit_price"]), money(r["amount"]))
        german = F.concat_ws(" ", (i + 1).cast("string"), r["description"], quantity, prices)
        return F.when(euro, german).otherwise(F.concat_ws(" ", quantity, r["description"], prices))

    buyer = record["buyer"]
    heading = F.when(euro, F.array(F.lit("BESTELLUNG"), F.substring(buyer, 1, 1), F.substr(buyer, F.lit(2)))).otherwise(
        F.array(buyer, F.lit("PURCHASE ORDER"))
    )
    body = F.array(
        say("Bestellnummer: ", "PO Number: ", record["po_number"]),
        say("Bestelldatum: ", "Order Date: ", day(record["order_date"])),
        say("Lieferung innerhalb von 14 Tagen bis ", "Delivery Date: ", day(record["delivery_date"])),
        say("Lieferant: ", "Vendor: ", record["vendor"]),
        F.when(euro, "Pos. Beschreibung Menge Preis Betrag").otherwise("QTY ITEM PRICE AMOUNT"),
    )
    foot = F.array(
        say("Zwischensumme ", "Subtotal ", money(record["subtotal"])),
        say("Versandkosten ", "Freight ", money(record["shipping"])),
        say("Gesamtbetrag ", "Order Total ", money(record["total"])),
    )
    return F.array_join(F.concat(heading, body, F.transform(record["line_items"], row), foot), "\n")


def purchase_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Printed purchase orders: the columns of `pages`."""
    clean = clean_purchase_orders(spark, sf)
    return clean.withColumn("text", printed_order(F.col("record"), F.col("layout"))).withColumnRenamed("record", "expected")


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """Metered calls from events: tenant, document, definition, model, purpose and tokens."""
    error = F.col("event_type") == "error"
    return table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("t"), (F.col("user_id") % 10).cast("string")).alias("tenant_id"),
        F.col("user_id").alias("document_id"),
        F.when(F.col("event_id") % 3 == 0, "invoice").when(F.col("event_id") % 3 == 1, "purchase_order").alias("slug"),
        F.when(error, "mock:mock-extractor-v1").otherwise("mock:mock-extractor-small-v1").alias("model"),
        F.when(error, "escalation").otherwise("extraction").alias("purpose"),
        F.floor(F.col("value") * 10).cast("bigint").alias("input_tokens"),
        F.floor(F.col("value") * 3).cast("bigint").alias("output_tokens"),
        F.col("ts").alias("created_at"),
    )


def document_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Stored documents: tenant = language, status from a hash, arrival one per minute."""
    doc = F.col("doc_id")
    draw = hash_draw(SEED, "status", doc.cast("string"))
    statuses = ("received", "parsing", "parsed", "extracting", "approved", "needs_review", "failed", "budget_exceeded")
    start = F.lit(EPOCH).cast("timestamp_ntz")
    minutes = doc.cast("int")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.col("lang").alias("tenant_id"),
        F.col("source").alias("doc_type"),
        "text",
        "n_chars",
        F.sha2("text", 256).alias("sha256"),
        F.when(F.col("n_chars") < 100, "needs_ocr")
        .otherwise(F.get(F.array(*[F.lit(s) for s in statuses]), draw % 8))
        .alias("status"),
        (start + F.make_dt_interval(mins=minutes)).alias("received_at"),
        (start + F.make_dt_interval(mins=minutes, secs=draw % 3600)).alias("updated_at"),
        (draw % 8).cast("int").alias("reap_count"),
    )
