"""The trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from docsieve.llm import conversation_trie as C

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v, key=lambda x: (x[0], C_id(x[1])))] for c, v in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, len(path) == d))
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def subtree(p):
        todo, leaves, saved = [p], 0, 0
        while todo:
            q = todo.pop()
            leaves += q not in children
            saved += (len(members[q]) - 1) * len(q[-1][1].encode()) if q else 0
            todo += children.get(q, [])
        return leaves, saved

    low = {p: min(c for c, _ in m) for p, m in members.items()}
    return sorted(
        (low[p], len(p), low[p[:-1]] if p else None, len(m), len(children.get(p, [])), *subtree(p), hashlib.sha256(",".join(str(c) for c in sorted(c for c, e in m if e)).encode()).hexdigest())
        for p, m in members.items()
    )


def C_id(turn):
    return hashlib.sha256((str(len(turn[0])) + ":" + turn[0] + turn[1]).encode()).digest()[:16]


def got(frame):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in frame.collect())


def by_key(rows):
    return sorted(rows, key=lambda r: tuple(-1 if x is None else x for x in r[:7]) + (r[7],))


@pytest.mark.parametrize("range_turns", [200_000, 40])
def test_nodes_equal_a_dictionary_of_prefixes(spark, monkeypatch, range_turns):
    """Ranges of few turns part many paths, so shared nodes are merged."""
    monkeypatch.setattr(C, "RANGE_TURNS", range_turns)
    dice = random.Random(4)
    rows = []
    for c in [*range(-7, 160), 10**12]:
        if c % 35 == 0:  # families without their first conversation
            continue
        for t in range(dice.choice([1, 2, 3, 5, 9, 30])):
            rows.append((c, t, dice.choice(["user", "assistant"]) if dice.random() < 0.3 else "user", "hello" if t == 0 and dice.random() < 0.6 else dice.choice("abcß")))
    want = plain(rows)
    frame = C.trie(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert by_key(got(frame)) == by_key(want)
    assert sum(r[3] for r in want if r[1] == 0) == len({r[0] for r in rows})


def test_nulls_ties_repeats_long_texts_and_clashing_names(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 0, "assistant", "b"), (None, 1, "user", "x"), (2, 5, "user", "é" * 300_000), (3, 0, "", ""),
        *[(c, 0, "user", "same") for c in range(20, 60)],
        *[(77, t, "user", str(t % 3)) for t in range(150)],
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 AS node", "8 AS n", "9 AS key", "1 AS salt", "'x' AS ends")
    assert by_key(got(C.trie(frame))) == by_key(plain(rows))
    assert C.trie(frame.where("false")).count() == 0


def test_tree_nodes_grow_and_keep_their_children():
    dice, tree = random.Random(1), C.RadixTree()
    keys = {bytes(dice.randrange(256) for _ in range(16)) * dice.choice([1, 2]) for _ in range(3000)} | {b"", b"a" * 16, b"a" * 32, b"a" * 31 + b"b"}
    for k in dice.sample(sorted(keys), len(keys)):
        tree.insert(k, k)
    rooms, found, todo = set(), [], [(b"", tree.root)]
    while todo:
        before, node = todo.pop()
        rooms.add(node.room)
        if node.value is not None:
            assert node.value == before + node.path
            found.append(node.value)
        kids = list(node.items())
        assert [b for b, _ in kids] == sorted(b for b, _ in kids) and all(node.child(b) is c for b, c in kids)
        todo += [(before + node.path + bytes([b]), c) for b, c in kids]
    assert sorted(found) == sorted(keys) and rooms == {4, 16, 48, 256} or rooms == {4, 16, 256}


def test_query_equals_the_plain_trie(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_key(got(C.op11_conversation_trie(spark, sf))) == by_key(plain(rows))
