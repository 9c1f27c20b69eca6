"""Rules against SQL, and the classifier on held-out rows."""

import zlib

from pyspark.sql import functions as F

from docsieve.llm import quality_classifier, quality_rules
from tests.oracle_check import compare, duck


def test_rules_equal_sql(spark, sf):
    ok, note = compare(quality_rules.op7_quality_rules(spark, sf), duck(sf), quality_rules.ORACLES["op7_quality_rules"])
    assert ok, note


def test_a_bad_host_loses_documents_with_a_fault_and_keeps_clean_ones(spark):
    clean = " ".join("word" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(40))
    marked = clean + " ####### |"
    rows = [(i, "bad", marked) for i in range(30)] + [(100, "bad", clean)] + [(200 + i, "good", clean) for i in range(30)] + [(300, "good", marked)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert not any(kept[i] for i in range(30)) and kept[100] and all(kept[200 + i] for i in range(30)) and kept[300]


def test_rules_on_odd_rows(odd, none):
    rows = quality_rules.judge(odd).collect()
    assert len(rows) == odd.count() and quality_rules.judge(none).count() == 0
    assert all(r.base_failed and not r.kept for r in rows if r.n_words == 0)


def test_scores_separate_held_out_labels(spark, sf):
    got = quality_classifier.op2_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_classifier_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (4, 0), (99, 1)], "doc_id long, quality int")
    rows = quality_classifier.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.classify(none, labels).count() == 0
    assert {r.score for r in quality_classifier.classify(odd, labels.where("false")).collect()} == {0.5}


def test_the_sample_is_the_rows_with_the_smallest_hashes(spark):
    rows = spark.range(5000).withColumn("h", F.xxhash64("id")).cache()
    every = sorted(r.h for r in rows.collect())
    for size in (1, 100, 4999, 5000, 9000):
        assert [r.h for r in quality_classifier.smallest(rows, "h", size).collect()] == every[:size]
    clumped = spark.range(50).withColumn("h", F.col("id") + (1 << 62))
    assert [r.id for r in quality_classifier.smallest(clumped, "h", 7).collect()] == list(range(7))
    assert quality_classifier.smallest(rows.limit(0), "h", 7).count() == 0


def test_repeated_rows_of_an_id_count_once_in_the_fit(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    first = docs.orderBy("doc_id").limit(1)
    more = docs.unionByName(first.join(spark.range(100).drop("id")))
    scores = lambda df: {r.doc_id: r.score for r in quality_classifier.classify(df, labels).collect()}
    assert scores(docs) == scores(more)
