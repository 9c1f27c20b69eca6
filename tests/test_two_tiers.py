"""Pages that both tiers read alike are read once, and printed once."""

from pyspark.sql import functions as F

from docsieve.definition import confidence_model_for, load_definition, load_hints, load_settings
from docsieve.functions.values import canonical_fields
from docsieve.operators import evaluate, reading
from docsieve.plans import queries_study as study
from docsieve.plans import views

INVOICE, HINTS, TIERS = load_definition("invoice"), load_hints("invoice"), load_settings("reader_tiers")


def test_reads_anew(spark):
    texts = {
        "plain": "Acme Ltd\nINVOICE\nSubtotal $1.00\nSales Tax (0%) $0.00\nTotal Due $1.00",
        "small capitals": "RECHNUNG\nA\ncme KG\nZwischensumme 1,00 €\nGesamtbetrag 1,00 €",
        "no total": "Acme Ltd\nINVOICE\nSubtotal $1.00",
        "no text": None,
    }
    df = reading.extract_record(spark.createDataFrame(list(texts.items()), "name string, text string"), HINTS, TIERS["small"], list(INVOICE.fields))
    both = df.select("name", reading.reads_anew(TIERS["small"], TIERS["frontier"], HINTS).alias("x"), reading.reads_anew(TIERS["small"], TIERS["small"], HINTS).alias("y"))
    got = {r.name: (r.x, r.y) for r in both.collect()}
    assert got == {"plain": (False, False), "small capitals": (True, False), "no total": (True, False), "no text": (True, False)}


def test_second_reading_is_that_of_the_strong_tier(spark, sf):
    pages = study._scanned(views.pages(spark, sf)).where("doc_id % 7 = 0")
    lost = F.regexp_replace("text", "(Total Due|Zwischensumme) ", "")
    pages = pages.withColumn("text", F.when(F.col("doc_id") % 3 == 0, lost).otherwise(F.col("text")))
    both = evaluate.read_both_tiers(pages, INVOICE, HINTS, TIERS, confidence_model_for(INVOICE)).select("doc_id", "reread", "rec_frontier")
    plain = reading.extract_record(pages, HINTS, TIERS["frontier"], list(INVOICE.fields))
    parts = [c.alias(n) for n, c in canonical_fields(F.col("raw"), INVOICE).items()]
    want = {r.doc_id: r.rec for r in plain.select("doc_id", F.struct(*parts).alias("rec")).collect()}
    got = both.collect()
    assert {r.doc_id: r.rec_frontier for r in got} == want
    assert {r.reread for r in got} == {True, False}


def test_no_filter_prints_the_pages_again(spark, sf):
    """Before, the filter on digital pages was pushed below the printing and held all of it once more."""
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    plan = study.evaluate_documents(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "format_number" in plan
    assert not any("format_number" in line for line in plan.split("\n") if line.lstrip(" :+-").startswith("Filter"))
