"""Fingerprints by a plain loop over bits, links by all pairs."""

import random
import re

import numpy as np
import xxhash
import pyarrow as pa

from docsieve.llm import simhash as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=3):
    """Smallest position of each print's component."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits).tolist():
            a, b = find(i), find(i + 1 + j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def near_prints(n, seed):
    """Prints in chains and balls of few differing bits, some of them around one common value."""
    dice, out = random.Random(seed), []
    while len(out) < n:
        x = dice.choice(out) if out and dice.random() < 0.7 else dice.getrandbits(64)
        for _ in range(dice.choice([1, 2, 3, 4])):
            x ^= 1 << dice.randrange(64)
        out.append(x)
    return sorted(set(out))


def test_query_equals_all_pairs(spark, sf, docs):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [plain(r.text) for r in rows]
    want = {r.doc_id: (f"{p:016x}", rows[c].doc_id) for r, p, c in zip(rows, prints, components(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in S.op13_simhash(spark, sf).collect()} == want


def test_cells_dealt_anew_lose_no_link(spark, monkeypatch):
    """With tiny cells all levels are used."""
    monkeypatch.setattr(S, "CELL", 3)
    prints = near_prints(600, 5)
    frame = spark.createDataFrame([(S.signed(p),) for p in prints], "fp long")
    cells = [(r.mask, r.value, r.fp % 2**64) for r in S.dealt(frame, 3).collect()]
    assert len({bin(m % 2**64).count("1") for m, _, _ in cells}) > 2
    groups = {}
    for m, v, p in cells:
        assert (p & m % 2**64) == v % 2**64
        groups.setdefault((m, v), []).append(p)
    met = {(a, b) for g in groups.values() for a in g for b in g if a < b and (a ^ b).bit_count() <= 3}
    assert met == {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 3}


def test_index_finds_all_links_of_its_cells():
    prints = np.array(near_prints(3000, 8), np.uint64)
    cell = (prints % np.uint64(3)).astype(np.int64)
    index = S.GrayIndex(prints, cell)
    assert len(index.levels) > 3
    got = {tuple(sorted((int(index.prints[i]), int(index.prints[j])))) for x, y in index.links(3) for i, j in zip(x, y)}
    want = {(int(a), int(b)) for a in prints for b in prints[(prints > a) & (prints % np.uint64(3) == a % np.uint64(3)) & (np.bitwise_count(prints ^ a) <= 3)]}
    assert got == want


def test_links_over_several_blocks(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 50)
    monkeypatch.setattr(S, "FRONTIER", 200)
    prints = np.array(near_prints(500, 2), np.uint64)
    mask = np.full(len(prints), 255, np.int64)
    value = (prints & np.uint64(255)).view(np.int64)
    order = np.argsort(value, kind="stable")
    batches = [pa.RecordBatch.from_arrays([pa.array(x[order][s : s + 7]) for x in (mask, value, prints.view(np.int64))], ["mask", "value", "fp"]) for s in range(0, len(prints), 7)]
    label = {int(p): int(p) for p in prints.view(np.int64)}
    at = {p: i for i, p in enumerate(label)}
    edges = [(r["a"], r["b"]) for out in S.linker(3)(iter(batches)) for r in out.to_pylist()]
    got = S.joined(np.arange(len(label)), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    want = np.arange(len(label))
    for v in np.unique(value):
        rows = np.flatnonzero(value == v)
        inside = components([int(p) for p in prints[rows]])
        want[rows] = rows[inside]
    assert got.tolist() == want.tolist()


def test_odd_rows(odd, none, odd_rows):
    got = S.find(odd).collect()
    assert len(got) == len(odd_rows) and S.find(none).count() == 0
    texts = {i: t for i, t in odd_rows if i is not None}
    assert all(r.fp % 2**64 == plain(texts[r.doc_id]) for r in got if r.doc_id is not None)
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == by[6] == 4 and by[7] == by[8] == 7


def test_segments_of_long_texts(monkeypatch):
    text = "  ".join(f"Wörd{i * i % 97}" for i in range(5000)) + " tail"
    want = plain(text)
    monkeypatch.setattr(S, "SEGMENT", 100)
    monkeypatch.setattr(S, "HASHES", 64)
    assert S.fingerprints([text, None, "a b", "x" * 1000]).tolist() == [want, 0, plain("a b"), plain("x" * 1000)]


def test_groups_with_many_copies_are_looked_up_apart(spark, monkeypatch):
    monkeypatch.setattr(S, "MANY", 5)
    rows = [(i, "one two three four" if i % 2 else f"word{i} other{i} third{i} last") for i in range(40)]
    got = {r.doc_id: r.component_id for r in S.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 1 if i % 2 else i for i in range(40)}
