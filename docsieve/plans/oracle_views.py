"""SQL twins of `plans.views`, for checking results on another engine."""

from __future__ import annotations


def draw(purpose: str, key: str, seed: int = 1337) -> str:
    return f"CAST('0x' || substr(sha256('{seed}:{purpose}:' || {key}), 1, 8) AS BIGINT)"


CUSTOMERS = """
cust AS (
  SELECT c_custkey, c_name, CASE WHEN r_name = 'EUROPE' THEN 'EUR' ELSE 'USD' END AS currency
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

ITEMS = """
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax, p_name AS description,
         CAST(l_quantity AS DECIMAL(18,4)) AS quantity, CAST(p_retailprice AS DECIMAL(18,4)) AS unit_price,
         CAST(CAST(l_quantity AS DECIMAL(18,4)) * CAST(p_retailprice AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey
), items AS (
  SELECT l_orderkey,
         list({'description': description, 'quantity': quantity, 'unit_price': unit_price, 'amount': amount}
              ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line_items,
         CAST(sum(amount) AS DECIMAL(18,4)) AS subtotal, CAST(max(l_tax) AS DECIMAL(12,8)) AS tax_rate
  FROM lines GROUP BY l_orderkey
)"""

CLEAN = f"""{CUSTOMERS},{ITEMS},
joined AS (
  SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS doc_key, 't' || (o_custkey % 10) AS tenant_id,
         c_name || ' ' || ['AG', 'KG', 'Ltd', 'GmbH'][CAST(c_custkey % 4 AS INT) + 1] AS vendor,
         'INV-' || year(o_orderdate) || '-' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS invoice_number,
         CAST(o_orderdate AS DATE) AS invoice_date, CAST(o_orderdate AS DATE) + 30 AS due_date, currency,
         coalesce(subtotal, CAST(0 AS DECIMAL(18,4))) AS subtotal, coalesce(tax_rate, CAST(0 AS DECIMAL(12,8))) AS tax_rate,
         coalesce(line_items, []) AS line_items,
         CASE WHEN currency = 'EUR' THEN 'euro' WHEN o_orderkey % 2 = 0 THEN 'classic' ELSE 'modern' END AS layout
  FROM orders JOIN cust ON o_custkey = c_custkey LEFT JOIN items ON o_orderkey = l_orderkey
), clean AS MATERIALIZED (
  SELECT *, CAST(round(subtotal * tax_rate, 2) AS DECIMAL(18,4)) AS tax,
         CAST(subtotal + CAST(round(subtotal * tax_rate, 2) AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS total
  FROM joined
)"""

_LEGAL = "('ag','kg','gmbh','ohg','plc','ltd','inc','llc','e.v.','e.g.','co.','&')"
_IMPOSTORS = (
    "['Birkenfeld Spedition GmbH','Lindqvist Optik Ltd','Oakhurst Machine Works PLC',"
    "'Rowe & Adeyemi AG','Kestrel Verpackung KG','Sandpiper Tools Co.']"
)
ALL_CLASSES = ("arithmetic_drift", "wrong_vendor", "truncated_vendor", "transposed_line_amounts", "shifted_date")


def faulty(classes: tuple[str, ...] = ALL_CLASSES) -> str:
    """`faulty`: clean columns with the planned fault applied, plus the clean values as x_*."""
    names = "[" + ",".join(f"'{c}'" for c in classes) + "]"
    return f"""{CLEAN},
planned AS (
  SELECT *, CASE WHEN {draw('plan', 'doc_key')} < {int(0.35 * 2**32)}
            THEN {names}[CAST({draw('class', 'doc_key')} % {len(classes)} AS INT) + 1] END AS error_class,
         len(line_items) AS n,
         {draw('first', 'doc_key')} % greatest(len(line_items), 1) AS i,
         greatest(round(total * CAST(CAST({draw('size', 'doc_key')} % 451 + 50 AS DECIMAL(6,0)) * 0.0001 AS DECIMAL(6,4)), 2),
                  CAST(1 AS DECIMAL(18,4))) AS step
  FROM clean
), placed AS (
  SELECT *, (i + 1 + {draw('second', 'doc_key')} % greatest(n - 1, 1)) % greatest(n, 1) AS j FROM planned
), faulty AS MATERIALIZED (
  SELECT doc_id, doc_key, tenant_id, layout, error_class, invoice_number, due_date, currency, subtotal, tax_rate, tax,
    vendor AS x_vendor, invoice_date AS x_invoice_date, total AS x_total, line_items AS x_line_items,
    CASE WHEN error_class = 'arithmetic_drift' THEN
      CAST(CASE WHEN {draw('sign', 'doc_key')} % 2 = 0 THEN total + step ELSE total - step END AS DECIMAL(18,4))
      ELSE total END AS total,
    CASE WHEN error_class = 'wrong_vendor' THEN {_IMPOSTORS}[CAST({draw('vendor', 'doc_key')} % 6 AS INT) + 1]
         WHEN error_class = 'truncated_vendor' THEN array_to_string(list_transform(string_split(vendor, ' '),
              lambda t: CASE WHEN lower(t) IN {_LEGAL} THEN t ELSE substr(t, 1, 1) END), ' ')
         ELSE vendor END AS vendor,
    CASE WHEN error_class = 'shifted_date' THEN invoice_date - CAST({draw('days', 'doc_key')} % 18 + 3 AS INT)
         ELSE invoice_date END AS invoice_date,
    CASE WHEN error_class = 'transposed_line_amounts' AND n >= 2 THEN
           list_transform(range(n), lambda k: {{'description': line_items[k+1].description, 'quantity': line_items[k+1].quantity,
             'unit_price': line_items[k+1].unit_price,
             'amount': CASE WHEN k = i THEN line_items[j+1].amount WHEN k = j THEN line_items[i+1].amount
                            ELSE line_items[k+1].amount END}})
         WHEN error_class = 'transposed_line_amounts' THEN
           list_transform(line_items, lambda r: {{'description': r.description, 'quantity': r.unit_price,
             'unit_price': r.quantity, 'amount': r.amount}})
         ELSE line_items END AS line_items
  FROM placed
)"""


_US = lambda x: f"('$' || format('{{:,.2f}}', CAST({x} AS DOUBLE)))"
_EU = lambda x: f"(translate(format('{{:,.2f}}', CAST({x} AS DOUBLE)), ',.', '.,') || ' €')"
_DAY = lambda d: (
    f"CASE layout WHEN 'euro' THEN strftime({d}, '%d.%m.%Y') WHEN 'classic' THEN strftime({d}, '%m/%d/%Y') "
    f"ELSE strftime({d}, '%b %d, %Y') END"
)

PRINTED = f"""
  array_to_string(
    CASE WHEN layout = 'euro' THEN
      list_concat(['RECHNUNG', substr(x_vendor, 1, 1), substr(x_vendor, 2), 'Rechnung Nr. ' || invoice_number,
       'Rechnungsdatum: ' || {_DAY('x_invoice_date')}, 'Zahlbar innerhalb von 30 Tagen bis ' || {_DAY('due_date')},
       'Pos. Beschreibung Menge Preis Betrag'],
      list_transform(x_line_items, lambda r, p: p || ' ' || r.description || ' ' || CAST(r.quantity AS BIGINT) || ' '
         || {_EU('r.unit_price')} || ' ' || {_EU('r.amount')}),
      ['Zwischensumme ' || {_EU('subtotal')}, 'MwSt ' || CAST(tax_rate * 100 AS INT) || ' % ' || {_EU('tax')},
       'Gesamtbetrag ' || {_EU('x_total')}])
    ELSE
      list_concat([x_vendor, 'INVOICE', 'Invoice No: ' || invoice_number, 'Invoice Date: ' || {_DAY('x_invoice_date')},
       'Due Date: ' || {_DAY('due_date')},
       CASE WHEN layout = 'classic' THEN 'DESCRIPTION QTY PRICE AMOUNT' ELSE 'QTY ITEM PRICE AMOUNT' END],
      list_transform(x_line_items, lambda r: CASE WHEN layout = 'classic'
         THEN r.description || ' ' || CAST(r.quantity AS BIGINT) ELSE CAST(r.quantity AS BIGINT) || ' ' || r.description END
         || ' ' || {_US('r.unit_price')} || ' ' || {_US('r.amount')}),
      ['Subtotal ' || {_US('subtotal')}, 'Sales Tax (' || CAST(tax_rate * 100 AS INT) || '%) ' || {_US('tax')},
       'Total Due ' || {_US('x_total')}])
    END, chr(10))"""


def faulty_text(classes: tuple[str, ...] = ALL_CLASSES) -> str:
    """`ft`: faulty records beside the page of their clean version."""
    return f"{faulty(classes)}, ft AS MATERIALIZED (SELECT *, {PRINTED} AS text FROM faulty)"


PAGES = f"""{CLEAN}, pages_ AS MATERIALIZED (
  SELECT *, {PRINTED} AS text FROM (SELECT *, vendor AS x_vendor, invoice_date AS x_invoice_date, total AS x_total,
                                           line_items AS x_line_items FROM clean))"""

PURCHASE = f"""{CUSTOMERS},{ITEMS},
po AS (
  SELECT o_orderkey AS doc_id, c_name AS buyer, 'Supplier ' || (o_orderkey % 7) AS vendor,
         CASE WHEN o_orderkey % 3 = 0 THEN 'PO/' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0')
              ELSE 'PO-' || year(o_orderdate) || '-' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') END AS po_number,
         CAST(o_orderdate AS DATE) AS order_date, shipped AS delivery_date, currency,
         coalesce(subtotal, CAST(0 AS DECIMAL(18,4))) AS subtotal,
         CAST(CASE WHEN o_orderpriority LIKE '1%' THEN 25 ELSE 10 END AS DECIMAL(18,4)) AS shipping,
         coalesce(line_items, []) AS line_items
  FROM orders JOIN cust ON o_custkey = c_custkey LEFT JOIN items ON o_orderkey = items.l_orderkey
  LEFT JOIN (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS shipped FROM lineitem GROUP BY 1) s ON o_orderkey = s.l_orderkey
)"""

_PO_DAY = lambda d: f"CASE layout WHEN 'euro' THEN strftime({d}, '%d.%m.%Y') ELSE strftime({d}, '%m/%d/%Y') END"

#: `po_pages`: clean purchase orders beside their printed pages; needs CUSTOMERS and ITEMS.
PO_PAGES = f"""po_clean AS (
  SELECT o_orderkey AS doc_id, CASE WHEN currency = 'EUR' THEN 'euro' ELSE 'standard' END AS layout, c_name || ' GmbH' AS buyer,
         'Supplier-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || ' KG' AS vendor,
         CASE WHEN currency = 'EUR' THEN 'BA-' || year(o_orderdate) || '/' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')
              ELSE 'PO-' || year(o_orderdate) || '-' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') END AS po_number,
         CAST(o_orderdate AS DATE) AS order_date, CAST(o_orderdate AS DATE) + 14 AS delivery_date,
         coalesce(subtotal, CAST(0 AS DECIMAL(18,4))) AS subtotal, coalesce(line_items, []) AS line_items,
         CAST(CASE WHEN o_orderpriority LIKE '1%' THEN 25 ELSE 10 END AS DECIMAL(18,4)) AS shipping
  FROM orders JOIN cust ON o_custkey = c_custkey LEFT JOIN items ON o_orderkey = l_orderkey
), po_pages AS MATERIALIZED (
  SELECT *, array_to_string(CASE WHEN layout = 'euro' THEN
      list_concat(['BESTELLUNG', substr(buyer, 1, 1), substr(buyer, 2), 'Bestellnummer: ' || po_number, 'Bestelldatum: ' || {_PO_DAY('order_date')},
        'Lieferung innerhalb von 14 Tagen bis ' || {_PO_DAY('delivery_date')}, 'Lieferant: ' || vendor, 'Pos. Beschreibung Menge Preis Betrag'],
        list_transform(line_items, lambda r, p: p || ' ' || r.description || ' ' || CAST(r.quantity AS BIGINT) || ' ' || {_EU('r.unit_price')} || ' ' || {_EU('r.amount')}),
        ['Zwischensumme ' || {_EU('subtotal')}, 'Versandkosten ' || {_EU('shipping')}, 'Gesamtbetrag ' || {_EU('subtotal + shipping')}])
    ELSE
      list_concat([buyer, 'PURCHASE ORDER', 'PO Number: ' || po_number, 'Order Date: ' || {_PO_DAY('order_date')},
        'Delivery Date: ' || {_PO_DAY('delivery_date')}, 'Vendor: ' || vendor, 'QTY ITEM PRICE AMOUNT'],
        list_transform(line_items, lambda r: CAST(r.quantity AS BIGINT) || ' ' || r.description || ' ' || {_US('r.unit_price')} || ' ' || {_US('r.amount')}),
        ['Subtotal ' || {_US('subtotal')}, 'Freight ' || {_US('shipping')}, 'Order Total ' || {_US('subtotal + shipping')}])
    END, chr(10)) AS text FROM po_clean
)"""

USAGE = """
usage AS (
  SELECT event_id, 't' || (user_id % 10) AS tenant_id, user_id AS document_id,
         CASE event_id % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'purchase_order' END AS slug,
         CASE WHEN event_type = 'error' THEN 'mock:mock-extractor-v1' ELSE 'mock:mock-extractor-small-v1' END AS model,
         CASE WHEN event_type = 'error' THEN 'escalation' ELSE 'extraction' END AS purpose,
         CASE WHEN event_type = 'error' THEN 'frontier' ELSE 'small' END AS tier,
         CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value * 3) AS BIGINT) AS output_tokens,
         ts AS created_at
  FROM events
), priced AS (
  SELECT *, CAST(round((input_tokens * CASE WHEN tier = 'frontier' THEN 5 ELSE 1 END
                 + output_tokens * CASE WHEN tier = 'frontier' THEN 25 ELSE 5 END) * CAST(0.000001 AS DECIMAL(7,6)), 6)
              AS DECIMAL(12,6)) AS cost_usd
  FROM usage
)"""

DOCS = f"""
docs AS (
  SELECT doc_id, lang AS tenant_id, source AS doc_type, text, n_chars, sha256(text) AS sha256,
         CASE WHEN n_chars < 100 THEN 'needs_ocr' ELSE
           ['received','parsing','parsed','extracting','approved','needs_review','failed','budget_exceeded']
           [CAST({draw('status', 'CAST(doc_id AS VARCHAR)')} % 8 AS INT) + 1] END AS status,
         to_timestamp(1704067200 + doc_id * 60) AT TIME ZONE 'UTC' AS received_at,
         to_timestamp(1704067200 + doc_id * 60 + {draw('status', 'CAST(doc_id AS VARCHAR)')} % 3600) AT TIME ZONE 'UTC' AS updated_at,
         CAST({draw('status', 'CAST(doc_id AS VARCHAR)')} % 8 AS INT) AS reap_count
  FROM documents
)"""
