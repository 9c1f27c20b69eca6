"""The pipeline on the smallest data against plain computations, and its stages on odd rows."""

import re

import corpus_pipeline
from docsieve.llm import personal_data, quality_rules
from tests.llm.test_leaks_and_urls import words
from tests.llm.test_near_duplicates import components, shingle_set
from tests.llm.test_tokens import LIBRARY
from tests.oracle_check import duck


def test_stages_equal_plain_steps(spark, sf, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r[0] for r in duck(sf).execute(f"WITH {quality_rules.FACTS_SQL} SELECT doc_id FROM judged WHERE kept").fetchall()}
    out = corpus_pipeline.quality_rules(spark, docs, sf)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept
    ids = sorted(kept)
    roots = components([shingle_set(rows[i]) for i in ids], 80)
    kept = {ids[r] for r in roots}
    out = corpus_pipeline.near_duplicates(spark, out, sf)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept
    items = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())]
    out = corpus_pipeline.decontamination(spark, out, sf)
    got = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns and got <= kept
    for i in kept:
        w = words(rows[i])
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        share = max(len(g & own) / len(g) for g in items)
        assert (i in got) == (share < 0.5) or 0.3 < share < 0.9
    out = corpus_pipeline.personal_data(spark, out, sf)
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert out.columns == docs.columns and set(texts) == got
    for i, (text, n) in texts.items():
        spans = personal_data.base_spans(rows[i])
        assert not [s for s in personal_data.base_spans(text) if text[s[0] : s[1]] in {rows[i][a:b] for a, b, _ in spans}]
        assert n == len(text) and (text == rows[i] or re.search("<(EMAIL|IP|CARD|PHONE)>", text))
    assert {r.doc_id: r.ids for r in corpus_pipeline.pieces(spark, out, sf).collect()} == {i: LIBRARY.encode(t) for i, (t, _) in texts.items()}


def test_stages_on_odd_rows(spark, sf, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
        if name != "pieces":
            assert stage(spark, odd, sf).columns == odd.columns
    unique = corpus_pipeline.near_duplicates(spark, odd, sf).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, bool(r.text)) for r in unique) == sorted(
        [(False, i, bool(t)) for i, t in ((1, 1), (4, 0), (5, 0), (6, 1), (7, 1), (9, 1), (11, 1), (-12, 1))] + [(True, 0, True), (True, 0, False)]
    )
    assert corpus_pipeline.decontamination(spark, odd, sf).count() == odd.count()
    assert corpus_pipeline.personal_data(spark, odd, sf).count() == odd.count()
