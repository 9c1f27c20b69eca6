"""Classes and components against all pairs."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from docsieve.llm import near_duplicates as N

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def components(sets, percent):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_all_pairs(docs, percent):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    sets = [shingle_set(r.text) for r in rows]
    want = {r.doc_id: (rows[c].doc_id, len(s)) for r, c, s in zip(rows, components(sets, percent), sets)}
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in N.find(docs, percent=percent).collect()}
    assert got == want


def test_chains_of_near_copies_reach_their_smallest_document(spark):
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):  # each differs a little from the one before; the ends of the chain have little in common
        words = list(base)
        for k in range(i):
            words[10 * k] = f"x{k}"
        rows.append((1000 - i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in N.find(docs, percent=85).collect()} == {961}


def test_odd_rows(odd, none):
    rows = N.find(odd).collect()
    assert len(rows) == odd.count() and N.find(none).count() == 0
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].component_id == by[2].component_id == by[3].component_id == by[10].component_id == 1
    assert by[7].component_id == by[8].component_id == 7 and by[7].n_shingles == 1
    assert all(by[i].n_shingles == 0 and by[i].component_id == i for i in (4, 5, 6))
    assert {r.component_id for r in rows if r.doc_id is None} == {None}


def test_agreement_of_signatures_estimates_similarity():
    a = " ".join(f"w{i}" for i in range(2000))
    b = " ".join(f"w{i}" for i in range(100, 2100))
    x, y = shingle_set(a), shingle_set(b)
    hashes, counts = N.shingles(pa.array([a, b]))
    sign = N.signatures(hashes, counts, 512)
    assert abs(np.mean(sign[0] == sign[1]) - len(x & y) / len(x | y)) < 0.05
