"""Decontamination against all pairs of passages and items, and the filter cascade against SQL."""

import re

import numpy as np
from pyspark.sql import functions as F

from docsieve.llm import bloom, decontaminate, url_filters
from tests.oracle_check import compare, duck


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def test_every_item_inside_a_document_is_found(spark, docs, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    runs = {r.item_id: {tuple(w[i : i + 5]) for w in [words(r.text)] for i in range(len(w) - 4)} for r in items.collect()}
    want, none = set(), set()
    for r in docs.collect():
        w = words(r.text)
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for item, grams in runs.items():
            share = len(grams & own) / len(grams)
            (want if share >= 0.9 else none if share < 0.3 else set()).add((r.doc_id, item))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert want and want <= got and not got & none


def test_block_bounds_lose_nothing():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary, 12)) + ". " + " ".join(rng.choice(vocabulary, 6))) for i in range(50)]
    lists = decontaminate.text_words([t for _, t in items])
    frequency = {}
    for w in lists:
        for t in np.unique(w).tolist():
            frequency[t] = frequency.get(t, 0) + 1
    index = decontaminate.Index(items, frequency, len(items), 18.0, 0.6)
    query = index.lookup(np.unique(np.concatenate(lists[:4])))
    query = query[query >= 0]
    full = np.bincount(np.concatenate([index.item[index.first[t] : index.first[t + 1]] for t in query]), np.concatenate([index.weight[index.first[t] : index.first[t + 1]] for t in query]), len(items))
    bounds = index.bounds(query, np.zeros(len(query), np.int64), 1)[0]
    assert all(full[b * decontaminate.BLOCK : (b + 1) * decontaminate.BLOCK].max() <= bounds[b] + 1e-9 for b in range(index.blocks))
    assert set(np.flatnonzero(full >= 1)) >= {0, 1, 2, 3}
    for b in range(index.blocks):
        assert np.allclose(index.scores(query, b)[: len(items) - b * decontaminate.BLOCK], full[b * decontaminate.BLOCK : (b + 1) * decontaminate.BLOCK])


def test_leaks_on_odd_rows(spark, odd, odd_rows, none, sf):
    items = spark.createDataFrame([(1, odd_rows[0][1]), (2, None), (3, ""), (4, "too short"), (5, odd_rows[0][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, items).collect()}
    assert got == {(d, i) for d in (1, 2, 3, 10) for i in (1, 5)}
    assert decontaminate.leaks(none, items).count() == decontaminate.leaks(odd, items.where("false")).count() == 0


def test_near_and_cut_copies_are_found(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    around, rows, want = " ".join(f"around{i}" for i in range(50)), [], set()
    for r in items.collect():
        w, sentences = r.text.split(), re.split(r"(?<=[.!?])\s+", r.text.strip())
        first = len(w) - len(sentences[-1].split()) if len(sentences) > 1 else len(w) // 2
        edits = [w[:j] + more + w[j + 1 :] for j in range(first, len(w)) for more in (["other"], [])] + [w[: len(w) - len(w) // 10]]
        want |= {(len(rows) + i, r.item_id) for i in range(len(edits))}
        rows += [(len(rows) + i, f"{around} {' '.join(e)} {around}") for i, e in enumerate(edits)]
        rows.append((len(rows), f"{around} {' '.join(w[: len(w) // 2])} {around}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, items).collect()} == want


def test_items_of_all_lengths_are_found_within_small_tables(spark, monkeypatch):
    """Very long items beside short ones, each in its own length class; tables of a few cells."""
    monkeypatch.setattr(decontaminate, "CELLS", 40)
    monkeypatch.setattr(decontaminate, "POSTINGS", 50)
    text = lambda n, k: " ".join(f"w{(i * i + 31 * k + i) % 4999}x{k}" for i in range(n))
    items = [(k, text(n, k)) for k, n in enumerate([20, 64, 65, 130, 700, 3000, 25, 40])]
    rows = [(k, "before it " * 50 + t + " behind it" * 90) for k, t in items] + [(100, "before it " * 2000), (101, items[5][1] + " " + items[0][1] + " " + items[3][1])]
    docs, listed = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, listed).collect()}
    assert found == {(k, k) for k, _ in items} | {(101, 5), (101, 0), (101, 3)}


def test_scripts_without_spaces_and_short_items(spark):
    chinese = "下列哪一座城市是中华人民共和国的首都，并且在二零零八年举办了夏季奥运会？答案是北京，它位于华北平原的北部。"
    thai = "เมืองหลวงของประเทศไทยคือเมืองใดและตั้งอยู่ริมแม่น้ำสายใด"
    items = [(1, chinese), (2, thai), (3, "What is seven times eight?"), (4, "𠀀字 ok"), (5, "。！"), (6, "Überraschung, naïve!")]
    around = " ".join(f"around{i}" for i in range(100))
    texts = {
        (10, 1): f"{around} 前文{chinese}后文 {around}", (11, 1): chinese.replace("首都", "首府").replace("，", ", "), (12, 2): f"ก่อน{thai}หลัง", (13, 3): f"{around} (what is SEVEN, times eight) {around}",
        (14, 4): "前𠀀字ok", (16, None): "what is seven or times eight", (17, None): chinese[::-1] + thai[::-1], (18, None): "字𠀀 ok。！", (19, 6): "x Überraschung naïve",
    }
    frame = spark.createDataFrame([(d, t) for (d, _), t in texts.items()], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, i in texts if i}
    lists = decontaminate.text_words(["a日本b，c", "", "é語", "x"])
    assert [len(w) for w in lists] == [5, 0, 2, 1] and lists[0][1] == decontaminate.text_words(["日"])[0][0]


def test_verdicts_equal_sql(spark, sf):
    ok, note = compare(url_filters.op4_url_filters(spark, sf), duck(sf), url_filters.ORACLES["op4_url_filters"])
    assert ok, note


def test_cascade_is_exact_and_agrees_with_the_join(spark):
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 700, F.lit(".net/p"), F.col("id") % 11).alias("url"), (F.col("id") % 13 == 0).alias("bad"))
    want = {(r.page_id, r.verdict) for r in url_filters.judge(pages, F.col("bad"), max_bytes=0).collect()}
    assert {(r.page_id, r.verdict) for r in url_filters.judge(pages, F.col("bad")).collect()} == want
    assert {v for _, v in want} == {"allow", "block"}


def test_odd_urls(spark):
    urls = [None, "", "nothing", "HTTP://Sub.Example.ORG/es/x?y", "http://example.org/en/12", "x://a.com", "http://a.COM/de/#f", "http://xorg/", "://org/", "http://u.com/fr/://b"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate([*urls, *urls])], "page_id long, url string, listed int")
    rows = sorted(url_filters.judge(pages, F.lit(False)).collect())
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows[: len(urls)]] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("sub.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"),
        ("a.com", "", None, "allow"), ("a.com", "/de/", "com/de/", "block"), ("xorg", "/", None, "allow"), ("org", "/", "org/", "allow"), ("u.com", "/fr/://b", "com/fr/", "allow"),
    ]
    assert url_filters.judge(pages.where("false"), F.lit(True)).count() == 0


def test_filters_hold_all_their_keys(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"))
    size, hashes = bloom.bits_for(3000, 0.01)
    held = bloom.build(keys, 0, size, hashes)
    h1, h2 = (np.array(c, np.int64) for c in zip(*keys.collect()))
    assert held.hit(h1, h2).all() and held.hit(h2, h1).mean() < 0.03
