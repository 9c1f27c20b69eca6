"""Queries over corruption, calibration, evaluation and experiments (O, P, E9, G6-G14, H2-H5, J)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.definition import FEATURES, confidence_model_for, load_confidence_model, load_definition, load_hints, load_settings
from docsieve.functions.tables import literal_table, with_prefixed
from docsieve.operators import calibrate, corruption, evaluate, evidence, scoring
from docsieve.plans import oracle_views as O
from docsieve.plans import queries_drift as drift_queries
from docsieve.plans import views
from docsieve.plans.catalog import query
from docsieve.plans.queries_evidence import FIELDS, SQL_ROUTED, SQL_SIGNALS, _sql_features, routed
from docsieve.session import cut

INVOICE = load_definition("invoice")
MODEL = load_confidence_model()
TIERS = load_settings("reader_tiers")
DBL = lambda c: F.col(c).cast("double")


@query(f"WITH {O.faulty()} SELECT doc_id, error_class FROM faulty")
def plan_corruption(spark, sf):
    planned = corruption.plan_corruption(F.col("doc_key"), views.FAULT_RATE, views.SEED)
    return views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("doc_key")).select("doc_id", planned.alias("error_class"))


@query(
    f"""WITH {O.faulty()} SELECT doc_id, vendor, strftime(invoice_date, '%Y-%m-%d') AS invoice_date, CAST(total AS DOUBLE) AS total,
        array_to_string(list_transform(line_items, lambda r: CAST(r.quantity AS VARCHAR) || 'x' || CAST(r.unit_price AS VARCHAR) || '=' || CAST(r.amount AS VARCHAR)), '|') AS items FROM faulty"""
)
def apply_corruption(spark, sf):
    r = F.col("record")
    shown = F.transform(r["line_items"], lambda i: F.concat(i["quantity"].cast("string"), F.lit("x"), i["unit_price"].cast("string"), F.lit("="), i["amount"].cast("string")))
    return views.faulty_records(spark, sf).select(
        "doc_id", r["vendor"].alias("vendor"), F.date_format(r["invoice_date"], "yyyy-MM-dd").alias("invoice_date"), r["total"].cast("double").alias("total"), F.array_join(shown, "|").alias("items")
    )


def scored_fields(spark, sf):
    """Long (doc, field): p of the shipped model, y = field is right, layout and fault class."""
    df = routed(spark, sf)
    df = with_prefixed(df, "ok", evaluate.compare(F.col("record"), F.col("expected"), INVOICE))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), scoring.P[f].alias("p"), F.col(f"ok_{f}").cast("int").alias("y")) for f in FIELDS])
    return df.select("doc_id", "layout", F.coalesce("error_class", F.lit("none")).alias("error_class"), F.inline_outer(rows))


_WRONG = {"vendor": "respelled", "total": "error_class = 'arithmetic_drift'", "invoice_date": "error_class = 'shifted_date'", "line_items": "error_class = 'transposed_line_amounts' AND spoiled"}
SQL_SCORED = f"""{SQL_ROUTED}, spoil AS (SELECT doc_id, line_items <> x_line_items AS spoiled, vendor <> x_vendor AS respelled FROM faulty),
scored AS MATERIALIZED ({' UNION ALL '.join(f"SELECT routed.doc_id, layout, coalesce(error_class, 'none') AS error_class, '{f}' AS field, p_{f} AS p, CASE WHEN coalesce({_WRONG.get(f, 'false')}, false) THEN 0 ELSE 1 END AS y FROM routed JOIN spoil ON routed.doc_id = spoil.doc_id" for f in FIELDS)})"""


@query(f"WITH {SQL_SCORED} SELECT error_class, field, count(*) AS n, CAST(sum(y) AS BIGINT) AS correct FROM scored GROUP BY 1, 2")
def calibration_rows(spark, sf):
    """O3 summarised: features joined to correctness and fault class, counted per class and field."""
    df = cut(with_prefixed(routed(spark, sf), "ok", evaluate.compare(F.col("record"), F.col("expected"), INVOICE)).select(
        "doc_id", "error_class", *[f"ok_{f}" for f in FIELDS], scoring.field_confidences(INVOICE).alias("_p")))
    features = df.select("doc_id", F.inline_outer("_p"))
    wrong = evaluate.field_results(df, INVOICE, ["doc_id"]).where(~F.col("correct")).select("doc_id", "field", F.lit(0).alias("correct"))
    classes = df.select("doc_id", F.coalesce("error_class", F.lit("none")).alias("error_class"))
    rows = calibrate.calibration_rows(features, wrong, classes)
    return rows.groupBy("error_class", "field").agg(F.count("*").alias("n"), F.sum("correct").cast("bigint").alias("correct"))


_SQL_CURVE = f"""{SQL_SCORED}, bins AS (SELECT CAST(i AS INT) AS i, count(p) AS n, coalesce(sum(y), 0) AS r FROM range(201) g(i) LEFT JOIN scored ON p >= i * 0.005::DOUBLE AND (i = 200 OR p < (i + 1) * 0.005::DOUBLE) GROUP BY 1),
cum AS (SELECT i, sum(n) OVER (ORDER BY i DESC) AS approved, sum(r) OVER (ORDER BY i DESC) AS correct, sum(n) OVER () AS total FROM bins),
curve AS (SELECT i * 0.005::DOUBLE AS threshold, CAST(approved AS DOUBLE) / CAST(total AS DOUBLE) AS rate, CASE WHEN approved > 0 THEN CAST(correct AS DOUBLE) / CAST(approved AS DOUBLE) ELSE 1.0::DOUBLE END AS precision FROM cum)"""


@query(f"WITH {_SQL_CURVE} SELECT threshold, round(rate, 9) AS rate, round(precision, 9) AS precision FROM curve")
def sweep(spark, sf):
    return calibrate.sweep(scored_fields(spark, sf)).select("threshold", F.round("rate", 9).alias("rate"), F.round("precision", 9).alias("precision"))


def _sql_points(targets: str) -> str:
    return f"""{_SQL_CURVE}, t AS (SELECT unnest({targets}) AS target), rows AS (SELECT * FROM curve CROSS JOIN t),
    w AS (SELECT *, max(rate) FILTER (WHERE precision >= target AND rate >= 0.05) OVER (PARTITION BY target) AS widest FROM rows),
    pick AS (SELECT target, widest IS NOT NULL AS met, threshold, rate, precision, row_number() OVER (PARTITION BY target ORDER BY precision DESC, rate DESC, threshold) AS rn FROM w
      WHERE rate >= 0.05 AND (widest IS NULL OR (precision >= target AND rate >= widest - 0.02)))
    SELECT target, met, threshold, round(rate, 9) AS rate, round(precision, 9) AS precision FROM pick WHERE rn = 1"""


def _rounded(df):
    return df.withColumns({"rate": F.round("rate", 9), "precision": F.round("precision", 9)})


@query(f"WITH {_sql_points('[0.99::DOUBLE]')}")
def operating_point(spark, sf):
    return _rounded(calibrate.operating_point(calibrate.sweep(scored_fields(spark, sf))))


@query(f"WITH {_sql_points('[0.995::DOUBLE, 0.99::DOUBLE, 0.985::DOUBLE, 0.98::DOUBLE, 0.97::DOUBLE, 0.95::DOUBLE]')}")
def frontier(spark, sf):
    return _rounded(calibrate.frontier(calibrate.sweep(scored_fields(spark, sf))))


@query(f"WITH {SQL_SCORED}, b AS (SELECT *, CAST(least(CASE WHEN floor(p * 10) * 0.1::DOUBLE > p THEN floor(p * 10) - 1 WHEN (floor(p * 10) + 1) * 0.1::DOUBLE <= p THEN floor(p * 10) + 1 ELSE floor(p * 10) END, 9) AS INT) AS bin FROM scored) SELECT bin, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y, count(*) AS n FROM b GROUP BY 1")
def reliability_bins(spark, sf):
    return calibrate.reliability_bins(scored_fields(spark, sf)).select("bin", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"), "n")


_BREAK = lambda key: f"SELECT '{key}' AS by, {key} AS name, count(*) AS n, round(avg(CASE WHEN p >= {MODEL.threshold} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS approve_rate, round(coalesce(avg(y) FILTER (WHERE p >= {MODEL.threshold}), -1), 6) AS precision, round(1 - count(*) FILTER (WHERE p >= {MODEL.threshold} AND y = 0) / greatest(count(*) FILTER (WHERE y = 0), 1), 6) AS recall FROM scored GROUP BY {key}"


@query(f"WITH {SQL_SCORED} {_BREAK('layout')} UNION ALL {_BREAK('error_class')}")
def breakdown(spark, sf):
    scores = cut(scored_fields(spark, sf))
    one = lambda key: calibrate.breakdown(scores, key, MODEL.threshold).select(
        F.lit(key).alias("by"), F.col(key).alias("name"), "n", F.round("approve_rate", 6).alias("approve_rate"),
        F.round(F.nanvl("precision", F.lit(-1.0)), 6).alias("precision"), F.round("recall_of_errors", 6).alias("recall"),
    )
    return one("layout").unionByName(one("error_class"))


@query(f"WITH {SQL_SCORED} SELECT error_class, field, count(*) AS n FROM scored WHERE p >= {MODEL.threshold} AND y = 0 GROUP BY 1, 2")
def surviving_errors(spark, sf):
    return calibrate.surviving_errors(scored_fields(spark, sf), MODEL.threshold)


def training_rows(spark, sf):
    """Flat feature columns with correctness, all fault classes."""
    df = evidence.with_signals(views.faulty_records(spark, sf, text=True), INVOICE)
    df = with_prefixed(df, "ok", evaluate.compare(F.col("record"), F.col("expected"), INVOICE))
    df = with_prefixed(df, "x", {f: F.array(*scoring.features_for(f, INVOICE)) for f in FIELDS})
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"x_{f}").alias("x"), F.col(f"ok_{f}").cast("int").alias("correct")) for f in FIELDS])
    long = df.select("doc_id", F.inline_outer(rows))
    return cut(long.select("doc_id", "field", "correct", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(FEATURES)]))


def _sql_newton(steps: int = 40) -> str:
    """The fit as a recursive query: one row per Newton step; its system is solved by eliminating one unknown after another, and no weight moves by more than 1."""
    n = len(FEATURES) + 1
    union = " UNION ALL ".join(
        f"SELECT doc_id, '{f}' AS field, CASE WHEN coalesce({_WRONG.get(f, 'false')}, false) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS y, "
        + ", ".join(f"{x}::DOUBLE AS x{i}" for i, x in enumerate(_sql_features(f)))
        + " FROM sp"
        for f in FIELDS
    )
    z = ", ".join(f"(x{i} - (SELECT m{i} FROM mom)) / (SELECT s{i} FROM mom)" for i in range(n - 1))
    p = "1.0::DOUBLE / (1.0::DOUBLE + exp(-list_dot_product(w, z)))"
    entry = lambda i, j: f"sum(c * q * (1 - q) * z[{i}] * z[{j}])" + (" + 1.0::DOUBLE" if i == j < n else "")
    row = lambda i: "[" + ", ".join([*[entry(i, j) for j in range(1, n + 1)], f"sum(c * (q - y) * z[{i}])" + (f" + any_value(w)[{i}]" if i < n else "")]) + "]"
    # the system, then the numbers of the unknowns in the shape of a system
    parts = ", ".join(f"[[{k}.0::DOUBLE]]" for k in range(1, n + 1))
    pivot = "list_transform(m[CAST(k[1][1] AS INT)], lambda v: v / m[CAST(k[1][1] AS INT)][CAST(k[1][1] AS INT)])"
    gone = f"list_transform(m, lambda r, i: CASE WHEN i = k[1][1] THEN {pivot} ELSE list_transform(r, lambda v, j: v - r[CAST(k[1][1] AS INT)] * ({pivot})[j]) END)"
    return f"""WITH {SQL_SIGNALS}, sp AS MATERIALIZED (SELECT sig.*, spoiled, respelled FROM sig JOIN (SELECT doc_id, line_items <> x_line_items AS spoiled, vendor <> x_vendor AS respelled FROM faulty) USING (doc_id)),
    x AS MATERIALIZED ({union}),
    mom AS MATERIALIZED (SELECT count(*) AS n, {', '.join(f'avg(x{i}) AS m{i}, stddev_pop(x{i}) + 1e-9::DOUBLE AS s{i}' for i in range(n - 1))} FROM x),
    d AS MATERIALIZED (SELECT [{z}, 1.0::DOUBLE] AS z, y, CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY 1, 2),
    newton(k, w) AS (SELECT 0, list_transform(range({n}), lambda i: 0.0::DOUBLE) UNION ALL
      SELECT k + 1, list_transform(w, lambda v, i: v - solved[i][{n + 1}] / greatest(1.0::DOUBLE, list_max(list_transform(solved, lambda r: abs(r[{n + 1}]))))) FROM
      (SELECT k, w, list_reduce([system, {parts}], lambda m, k: {gone}) AS solved FROM
       (SELECT k, w, [{', '.join(row(i) for i in range(1, n + 1))}] AS system FROM (SELECT k, w, z, y, c, {p} AS q FROM newton CROSS JOIN d WHERE k < {steps}) GROUP BY k, w))),
    fit AS (SELECT w FROM newton WHERE k = {steps})"""


_FIT_ROWS = " UNION ALL ".join(
    f"SELECT {i} AS pos, '{f}' AS feature, w[{i + 1}] AS weight, m{i} AS mean, s{i} AS std FROM fit CROSS JOIN mom" for i, f in enumerate(FEATURES)
)
_ROUND6 = lambda *names: ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in names)


@query(
    f"""{_sql_newton()} SELECT feature, {_ROUND6('weight', 'mean', 'std')} FROM
    ({_FIT_ROWS} UNION ALL SELECT {len(FEATURES)}, 'bias', w[{len(FEATURES) + 1}], 0.0::DOUBLE, 1.0::DOUBLE FROM fit)"""
)
def fit_logistic(spark, sf):
    """Fitted weights per feature, to six places (a weight of nothing is plain zero)."""
    fit = calibrate.fit_logistic(training_rows(spark, sf))
    rows = zip([*FEATURES, "bias"], [*fit["weights"], fit["bias"]], [*fit["mean"], 0.0], [*fit["std"], 1.0])
    table = literal_table(spark, ["feature", "weight", "mean", "std"], [(n, *map(float, values)) for n, *values in rows])
    return table.select("feature", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("weight", "mean", "std")])


_FIT_CURVE = _sql_points("[0.99::DOUBLE]").replace(f"{SQL_SCORED}, ", "", 1)
_FIT_SCORED = f"""scored AS MATERIALIZED (SELECT CAST(y AS INT) AS y, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(w[{len(FEATURES) + 1}] + {' + '.join(f'w[{i + 1}] * ((x{i} - m{i}) / s{i})' for i in range(len(FEATURES)))}))) AS p
    FROM x CROSS JOIN fit CROSS JOIN mom)"""


@query(
    f"""{_sql_newton()}, {_FIT_SCORED}, point AS ({'WITH ' + _FIT_CURVE}) SELECT 2 AS schema_version, 'logistic' AS model, 'invoice' AS slug, 1 AS pipeline_version,
    feature, {_ROUND6('weight', 'mean', 'std')}, round(w[{len(FEATURES) + 1}], 6) AS bias, n AS train_rows, threshold, target AS target_precision, met AS target_met,
    round(precision, 6) AS measured_precision, round(rate, 6) AS auto_approve_rate FROM ({_FIT_ROWS}) CROSS JOIN fit CROSS JOIN (SELECT n FROM mom) CROSS JOIN point"""
)
def model_artifact(spark, sf):
    """The artifact, read back from its JSON: one row per feature with what holds for the whole model; figures to six places."""
    rows = training_rows(spark, sf)
    fit = calibrate.fit_logistic(rows)
    scores = calibrate.predict(rows, fit).select("p", F.col("correct").alias("y"))
    point = calibrate.operating_point(calibrate.sweep(scores))
    shape = (
        "schema_version int, model string, features array<string>, weights array<double>, bias double, standardization struct<mean array<double>, std array<double>>, "
        "calibrated_for struct<pipeline_slug string, pipeline_version int>, provenance struct<train_rows bigint>, "
        "operating_point struct<threshold double, target_precision double, target_met boolean, measured_precision double, auto_approve_rate double>"
    )
    body = calibrate.model_artifact(spark, fit, point, "invoice", 1).select(F.from_json("json", shape).alias("a")).select("a.*")
    one = F.arrays_zip(F.col("features").alias("feature"), F.col("weights").alias("weight"), F.col("standardization.mean").alias("mean"), F.col("standardization.std").alias("std"))
    rounded = lambda c, name: (F.round(c, 6) + F.lit(0.0)).alias(name)
    at = F.col("operating_point")
    return body.withColumn("f", F.explode(one)).select(
        "schema_version", "model", F.col("calibrated_for.pipeline_slug").alias("slug"), F.col("calibrated_for.pipeline_version").alias("pipeline_version"),
        F.col("f.feature").alias("feature"), *[rounded(F.col(f"f.{c}"), c) for c in ("weight", "mean", "std")], F.round("bias", 6).alias("bias"),
        F.col("provenance.train_rows").alias("train_rows"), at["threshold"].alias("threshold"), at["target_precision"].alias("target_precision"),
        at["target_met"].alias("target_met"), rounded(at["measured_precision"], "measured_precision"), rounded(at["auto_approve_rate"], "auto_approve_rate"),
    )


# --- evaluation -------------------------------------------------------------------------------


def _scanned(pages):
    """Every tenth page is a scan without text."""
    return pages.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.lit("scan")).otherwise(F.col("text")))


def assessed(spark, sf, definition=INVOICE, pages=views.pages):
    hints, model = load_hints(definition.slug), confidence_model_for(definition)
    return evaluate.read_both_tiers(_scanned(pages(spark, sf)), definition, hints, TIERS, model)


_EU_ = O._EU
_QUIRK = f"len(list_filter(line_items, lambda r: layout = 'euro' AND {_EU_('r.amount')} <> {_EU_('r.unit_price')} AND contains({_EU_('r.amount')}, {_EU_('r.unit_price')}))) > 0 AS quirk"


def _sql_read(pages: str, seen: str, heading: str) -> str:
    """`<seen>`: what both tiers make of printed pages; the small one loses the first letter of a German heading."""
    return f"""{seen}_ AS MATERIALIZED (SELECT doc_id, layout, {heading} AS heading, len(line_items) AS n, doc_id % 10 = 0 AS needs_ocr, length(text) AS chars, {_QUIRK} FROM {pages}),
  {seen} AS (SELECT *, CASE WHEN needs_ocr THEN NULL WHEN n = 0 OR quirk THEN 'needs_review' END AS reason,
  CAST(floor((CASE WHEN needs_ocr THEN 4 ELSE chars END) / 4) + 1 + 256 * 5 AS DOUBLE) / 1000000 AS c_small, CAST((floor((CASE WHEN needs_ocr THEN 4 ELSE chars END) / 4) + 1) * 5 + 256 * 25 AS DOUBLE) / 1000000 AS c_front FROM {seen}_)"""


_READ = f"{O.PAGES}, {_sql_read('pages_', 'costed', 'vendor')}"


@query(f"WITH {_READ} SELECT doc_id, reason, reason IS NOT NULL AS escalated, CASE WHEN reason IS NULL THEN 1 ELSE 2 END AS calls, CASE WHEN reason IS NULL AND layout = 'euro' THEN substr(heading, 2) ELSE heading END AS vendor, round(c_small + CASE WHEN reason IS NULL THEN 0 ELSE c_front END, 6) AS cost FROM costed WHERE NOT needs_ocr")
def two_tier_select(spark, sf):
    both = cut(assessed(spark, sf)).where(~F.col("needs_ocr"))
    first = both.select("doc_id", "trigger", F.col("rec_small").alias("record"), F.col("cost_small").alias("cost_usd"))
    second = both.where(F.col("trigger").isNotNull()).select("doc_id", F.col("rec_frontier").alias("record"), F.col("cost_frontier").alias("cost_usd"))
    out = scoring.two_tier_select(first, second, "doc_id")
    return out.select("doc_id", F.col("trigger").alias("reason"), "escalated", "calls", "record.vendor", F.round(DBL("cost_usd"), 6).alias("cost"))


PURCHASE = load_definition("purchase_order")
#: Document types with the pages they are evaluated on.
STUDIED = ((INVOICE, views.pages), (PURCHASE, views.purchase_pages))


def evaluated(spark, sf):
    """One row per (document type, document, mode); both modes come out of one pass over the pages of a type."""
    parts = [evaluate.judge_modes(assessed(spark, sf, definition, pages), definition) for definition, pages in STUDIED]
    return reduce(DataFrame.unionByName, parts)


_NAMES = lambda definition: "[" + ", ".join(f"'{f}'" for f in definition.fields) + "]"
_CELLS = f"""{_READ}, {O.PO_PAGES}, {_sql_read('po_pages', 'po_costed', 'buyer')},
types AS (SELECT 'invoice' AS doc_type, 'vendor' AS headed, * FROM costed UNION ALL SELECT 'purchase_order', 'buyer', * FROM po_costed),
modes AS (SELECT *, 'single' AS mode FROM types UNION ALL SELECT *, 'routed' FROM types),
cells AS MATERIALIZED (SELECT doc_type, doc_id, layout, mode, headed, unnest(CASE doc_type WHEN 'invoice' THEN {_NAMES(INVOICE)} ELSE {_NAMES(PURCHASE)} END) AS field,
  n > 0 AND NOT quirk AS items_ok, NOT (mode = 'routed' AND reason IS NULL AND layout = 'euro') AS heading_ok FROM modes WHERE NOT needs_ocr),
ok AS (SELECT *, CASE field WHEN 'line_items' THEN items_ok WHEN headed THEN heading_ok ELSE true END AS correct FROM cells)"""


@query(f"WITH {_CELLS} SELECT doc_type, mode, field, CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS correct, count(*) AS n FROM ok GROUP BY 1, 2, 3")
def evaluate_documents(spark, sf):
    """Both passes over all digital pages of both types, correct fields counted per mode."""
    long = evaluate.judged_fields(evaluated(spark, sf), ["doc_type", "mode"])
    return long.groupBy("doc_type", "mode", "field").agg(F.count_if("correct").alias("correct"), F.count("*").alias("n"))


@query(f"WITH {_CELLS} SELECT doc_type, mode, coalesce(field, 'all') AS field, coalesce(layout, 'all') AS layout, count(*) AS cells, round(100.0::DOUBLE * count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy FROM ok GROUP BY GROUPING SETS ((doc_type, mode, field, layout), (doc_type, mode, field), (doc_type, mode, layout), (doc_type, mode))")
def accuracy_matrix(spark, sf):
    long = evaluate.judged_fields(evaluated(spark, sf), ["doc_type", "mode", "layout"])
    return evaluate.accuracy_matrix(long, ["doc_type", "mode"]).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {_CELLS}, c AS (SELECT doc_type, avg(c_front) AS single_cost, avg(round(c_small + CASE WHEN reason IS NULL THEN 0 ELSE c_front END, 6)) AS routed_cost, count(*) FILTER (WHERE reason IS NOT NULL) AS escalated, count(*) AS documents FROM types WHERE NOT needs_ocr GROUP BY 1), a AS (SELECT doc_type, round(100.0::DOUBLE * count(*) FILTER (WHERE correct) / count(*), 6) AS routed_accuracy FROM ok WHERE mode = 'routed' GROUP BY 1) SELECT doc_type, round(single_cost, 8) AS single_cost, round(routed_cost, 8) AS routed_cost, escalated, documents, round((1 - routed_cost / single_cost) * 100, 4) AS saving, routed_accuracy FROM c JOIN a USING (doc_type)")
def cost_note(spark, sf):
    rows = evaluated(spark, sf)
    right = F.size(F.filter("judged", lambda j: j["correct"]))
    note = evaluate.cost_note(rows.withColumns({"correct": right, "total": F.size("judged")}), ["doc_type"])
    return note.select("doc_type", F.round("single_cost", 8).alias("single_cost"), F.round("routed_cost", 8).alias("routed_cost"), "escalated", "documents", F.round("saving_percent", 4).alias("saving"), F.round("routed_accuracy", 6).alias("routed_accuracy"))


_FLOORS = ", ".join(
    f"('{slug}', '{mode}', '{field}', {floor}::DOUBLE)" for slug, spec in load_settings("eval_thresholds").items()
    for mode, field, floor in [("single", "all", spec["min_overall"]), ("routed", "all", spec["min_overall_routed"]), *[("single", f, v) for f, v in spec["min_fields"].items()]]
)


@query(
    f"""WITH {_CELLS}, acc AS (SELECT doc_type, mode, coalesce(field, 'all') AS field, 100.0::DOUBLE * count(*) FILTER (WHERE correct) / count(*) AS accuracy FROM ok GROUP BY GROUPING SETS ((doc_type, mode, field), (doc_type, mode))),
    floors(doc_type, mode, field, floor) AS (VALUES {_FLOORS})
    SELECT doc_type, mode, field, round(accuracy, 6) AS accuracy, floor, accuracy >= floor AS passed FROM floors JOIN acc USING (doc_type, mode, field)"""
)
def gate_checks(spark, sf):
    """The floors of both types, measured."""
    long = evaluate.judged_fields(evaluated(spark, sf), ["doc_type", "mode", "layout"])
    overall = evaluate.accuracy_matrix(long, ["doc_type", "mode"]).where(F.col("layout") == "all").drop("layout", "cells")
    return evaluate.gate_checks(cut(overall)).withColumn("accuracy", F.round("accuracy", 6))


def _labels(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("doc_type"))


_GOLD = "gold AS (SELECT * FROM (SELECT doc_id, lang AS doc_type, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE rn <= least(100, greatest(1, n // 3)))"


@query(f"WITH {_GOLD} SELECT doc_type, doc_id FROM gold")
def golden_split(spark, sf):
    return evaluate.golden_split(_labels(spark, sf)).select("doc_type", "doc_id")


@query(f"WITH {_GOLD} SELECT l.doc_id, CASE WHEN g.doc_id IS NULL THEN 'train' ELSE 'holdout' END AS part FROM labels l LEFT JOIN gold g ON l.doc_id = g.doc_id")
def train_holdout(spark, sf):
    golden = evaluate.golden_split(_labels(spark, sf))
    train, holdout = evaluate.train_holdout(views.table(spark, sf, "labels").select("doc_id"), golden)
    return train.withColumn("part", F.lit("train")).unionByName(holdout.withColumn("part", F.lit("holdout")))


# --- experiments ------------------------------------------------------------------------------


def steps(spark, sf):
    """A stream per tenant: events up to the 20th are stable, the rest drifted."""
    e = views.table(spark, sf, "events")
    i, value = F.col("event_id"), F.col("value")
    approved = value >= 60
    base = e.select(
        F.concat(F.lit("t"), (F.col("user_id") % 10).cast("string")).alias("stream"), "event_id", "ts",
        approved.alias("approved"), F.lit(10).cast("bigint").alias("fields_total"),
        (F.lit(10) - F.when(i % 4 == 0, 1).otherwise(0) - F.when((i % 3 == 0) & (F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")), 2).otherwise(0)).cast("bigint").alias("fields_correct"),
        F.when(i % 23 != 0, F.round(value / 500, 4)).alias("doc_confidence"),
        (i % 7 != 0).alias("validation_passed"), (F.col("event_type") == "error").alias("escalated"),
        F.round(value / 10000, 6).alias("cost_usd"), (value > 400).alias("flagged"),
    ).withColumn("all_correct", F.col("fields_correct") == F.col("fields_total"))
    edge = F.lit("2024-01-20").cast("timestamp_ntz")
    return evaluate.concat_streams(base.where(F.col("ts") < edge), base.where(F.col("ts") >= edge), ["stream"], ["ts", "event_id"])


_STEPS = """steps AS MATERIALIZED (SELECT *, fields_correct = 10 AS all_correct, row_number() OVER (PARTITION BY stream ORDER BY ts, event_id) - 1 AS idx FROM (
  SELECT 't' || (user_id % 10) AS stream, event_id, ts, value >= 60 AS approved, 10 - CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END - CASE WHEN event_id % 3 = 0 AND ts >= TIMESTAMP '2024-01-20' THEN 2 ELSE 0 END AS fields_correct,
  CASE WHEN event_id % 23 <> 0 THEN round(value / 500, 4) END AS doc_confidence, event_id % 7 <> 0 AS passed, event_type = 'error' AS escalated, round(value / 10000, 6) AS cost_usd, value > 400 AS flagged,
  CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'stable' ELSE 'drifted' END AS phase FROM events))"""
_ROLL = f"""{_STEPS}, ap AS (SELECT *, row_number() OVER w AS k, sum(fields_correct) OVER (w ROWS 49 PRECEDING) AS c FROM steps WHERE approved WINDOW w AS (PARTITION BY stream ORDER BY idx)),
prec AS (SELECT stream, idx, CAST(c AS DOUBLE) / 500 AS precision FROM ap WHERE k >= 50)"""


@query(f"WITH {_STEPS} SELECT event_id, phase, idx AS index FROM steps")
def concat_streams(spark, sf):
    return steps(spark, sf).select("event_id", "phase", "index")


@query(f"WITH {_ROLL} SELECT stream, idx AS index, precision FROM prec")
def rolling_precision(spark, sf):
    return evaluate.rolling_precision(steps(spark, sf), ["stream"], 50)


@query(f"WITH {_STEPS}, r AS (SELECT stream, idx, row_number() OVER w AS k, sum(approved::INT) OVER (w ROWS 49 PRECEDING) AS a FROM steps WINDOW w AS (PARTITION BY stream ORDER BY idx)) SELECT stream, idx AS index, CAST(a AS DOUBLE) / 50 AS rate FROM r WHERE k >= 50")
def rolling_approve_rate(spark, sf):
    return evaluate.rolling_approve_rate(steps(spark, sf), ["stream"], 50)


_MARKS = "marks AS (SELECT stream, min(idx) FILTER (WHERE phase = 'drifted') AS swap_at, min(idx) FILTER (WHERE flagged) AS detected_at FROM steps GROUP BY 1)"


@query(f"WITH {_STEPS}, {_MARKS} SELECT stream, swap_at, detected_at, CASE WHEN swap_at > 0 AND detected_at > 0 THEN detected_at - swap_at + 1 END AS lag FROM marks")
def stream_marks(spark, sf):
    return evaluate.stream_marks(steps(spark, sf), ["stream"])


@query(f"WITH {_ROLL}, {_MARKS} SELECT stream, min(idx) FILTER (WHERE precision < 0.95) AS first_breach, min(idx) FILTER (WHERE precision < 0.95 AND idx >= swap_at) AS breach_after_swap FROM prec JOIN marks USING (stream) GROUP BY 1")
def first_breach(spark, sf):
    s = cut(steps(spark, sf))
    return evaluate.first_breach(evaluate.rolling_precision(s, ["stream"], 50), evaluate.stream_marks(s, ["stream"]), ["stream"], 0.95)


@query(
    f"""WITH {_STEPS} SELECT stream, phase, count(*) AS n, round(avg(approved::INT), 6) AS approve_rate, round(sum(fields_correct) FILTER (WHERE approved) / (10.0::DOUBLE * count(*) FILTER (WHERE approved)), 6) AS approved_precision,
        round(avg(all_correct::INT) FILTER (WHERE approved), 6) AS approved_doc_precision, round(sum(fields_correct) / (10.0::DOUBLE * count(*)), 6) AS field_accuracy, round(avg(doc_confidence), 6) AS mean_confidence,
        round(avg(escalated::INT), 6) AS escalation_rate, round(avg((NOT passed)::INT), 6) AS validation_failure_rate, round(avg(cost_usd), 8) AS cost_per_doc FROM steps GROUP BY 1, 2"""
)
def phase_summary(spark, sf):
    out = evaluate.phase_summary(steps(spark, sf), ["stream"])
    digits = {c: 8 if c == "cost_per_doc" else 6 for c in out.columns if c not in ("stream", "phase", "n")}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(f"WITH {drift_queries._SIGNALS}, p AS (SELECT *, CASE WHEN doc_id % 1000 < 600 THEN 'stable' ELSE 'drifted' END AS phase FROM scored) SELECT signal, phase, count(*) AS n, round(avg(z), 4) + 0.0 AS mean_z, count(*) FILTER (WHERE breach) AS breaches, round(arg_max(z, abs(z)), 4) AS largest_z FROM p GROUP BY 1, 2")
def signal_behaviour(spark, sf):
    phase = F.when(F.col("doc_id") % 1000 < 600, "stable").otherwise("drifted")
    out = evaluate.signal_behaviour(drift_queries.plan(spark, sf).scored.withColumn("phase", phase))
    return out.withColumns({"mean_z": F.round("mean_z", 4) + F.lit(0.0), "largest_z": F.round("largest_z", 4)})
