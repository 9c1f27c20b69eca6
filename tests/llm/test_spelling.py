"""Words, near words and forms against plain loops."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docsieve.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    words = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def near(words):
    """Pairs through all edits of each word; no index."""
    letters = sorted(set("".join(words)))
    out = {}
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        out[w] = {e for e in edits if e != w and e in words}
    return out


def plain(rows):
    words = plain_words(rows)
    links = near(words)
    forms = {}
    for w, n in words.items():
        best = min(links[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 10 * n else None

    def root(w):
        return root(forms[w]) if forms[w] else w

    return {(w, forms[w], root(w), n, len(links[w]), words.get(forms[w])) for w, n in words.items()}


def got(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_query_equals_all_edits(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = plain(rows)
    assert got(S.op12_spelling_variants(spark, sf)) == want and any(f for _, f, *_ in want)


@pytest.mark.parametrize("alphabet", ["ab", "aáÿbc", "abcdefghijklmnopqrstuvwxyz"])
def test_near_pairs_equal_all_edits(spark, alphabet):
    """Few letters make bigrams that repeat within a word and tie in the order."""
    dice, words = random.Random(len(alphabet)), set()
    while len(words) < 400:
        w = dice.choice(sorted(words)) if words and dice.random() < 0.6 else "".join(dice.choice(alphabet) for _ in range(dice.randint(7, 12)))
        i = dice.randrange(len(w))
        w = dice.choice([w[:i] + w[i + 1 :], w[:i] + dice.choice(alphabet) + w[i + 1 :], w[:i] + dice.choice(alphabet) + w[i:]])
        if len(w) >= 7:
            words.add(w)
    found = {(r.a, r.b) for r in S.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert found == {(min(a, b), max(a, b)) for a, more in near(words).items() for b in more}


def test_pivots_are_the_rarest_disjoint_pair():
    dice = np.random.default_rng(3)
    rank = np.argsort(dice.random((500, 9)), axis=1)
    weight = rank * 3 + 1
    chosen, bound = S.pivots(rank, weight)
    for i in range(500):
        first = sorted(np.argsort(rank[i])[:3].tolist())
        best = min(weight[i, a] + weight[i, b] for a in first for b in first if b - a >= 2)
        a, b = chosen[i]
        assert {a, b} <= set(first) and b - a >= 2 and weight[i, a] + weight[i, b] == best and bound[i] == 2


def test_chains_ties_and_odd_rows(spark, odd, odd_rows, none):
    text = " ".join(["abcdefgh"] * 3000 + ["abcdefgx"] * 250 + ["abcdefyx"] * 25 + ["abcdezyx"] * 2 + ["qqqqqqqq"] * 20 + ["qqqqqqqr"] * 2 + ["qqqqqqqs"] * 20 + ["ÀÉÎÕÜßàé"] * 2 + ["short"] * 9)
    rows = [(i, text) for i in range(40)] + [(None, text), (7, None), (8, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert got(S.group_variants(frame)) == want
    assert {r: f for r, f, *_ in want}["abcdezyx"] == "abcdefyx"
    assert got(S.group_variants(odd)) == plain(odd_rows)
    assert S.group_variants(none).count() == 0
