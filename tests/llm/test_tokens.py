"""Token counts and ids against the library."""

import base64
import random

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from docsieve.llm import sentencepieces, token_counts

PATH = token_counts.default_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
VOCABULARY = sentencepieces.Vocabulary(open(PATH, "rb").read())
ODD = ["", None, " ", "   ", "a ", " a", "a  b", "\n \n", "\u2581a\u2581 b", "<s> <0x0A>", "日本 語", " " * 37 + "x" + " " * 40, "x" * 3000, "🙂  🙂", "\x00", "def f(x):\n    return x + 1  # sum\n"]


def encoded(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    out = list(sentencepieces.encoder(VOCABULARY)([batch]))
    return [x for b in out for x in b.column("ids").to_pylist()], [x for b in out for x in b.column("round_trip").to_pylist()]


def test_ids_equal_the_library():
    ids, same = encoded(ODD)
    assert ids == [LIBRARY.encode(t or "") for t in ODD] and all(same)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdehilnorstu  ABC.,\n_-1é日", max_size=80), min_size=1, max_size=8))
def test_ids_equal_the_library_on_any_text(texts):
    ids, same = encoded(texts)
    assert ids == [LIBRARY.encode(t) for t in texts] and all(same)


def test_documents(docs, odd, none):
    want = {r.doc_id: r.text for r in docs.collect()}
    for r in sentencepieces.encode(docs).collect():
        assert r.ids == LIBRARY.encode(want[r.doc_id]) and r.round_trip and r.n_tokens == len(r.ids)
    for r in token_counts.count_tokens(docs, limit=500).collect():
        n = len(LIBRARY.encode(want[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(want[r.doc_id].encode()), n > 500)
    assert sentencepieces.encode(odd).count() == token_counts.count_tokens(odd).count() == odd.count()
    assert sorted(r.n_tokens for r in sentencepieces.encode(odd).collect()) == sorted(r.n_tokens for r in token_counts.count_tokens(odd).collect())
    assert sentencepieces.encode(none).count() == token_counts.count_tokens(none).count() == 0


def test_long_words_equal_the_library():
    """Texts without spaces: cut, dealt into segments, and runs whose segments do not fall in."""
    rng = random.Random(7)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9000))
    glued = "".join(rng.choice(["the", "house", "international", "straße", "слово", "день", "🙂"]) for _ in range(4000))
    han = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(20_000))
    thai = "".join(chr(rng.randrange(0xE01, 0xE3A)) for _ in range(9000))
    blob = base64.b64encode(rng.randbytes(60_000)).decode()
    runs = ["=" * 9001, "abc" + "=" * 9000, "  " + "-" * 5000 + "x" + "_" * 5003 + " ", "ab" * 4000, "é" * 3000, "acgt" * 30 + "".join(rng.choice("acgt") for _ in range(9000))]
    texts = [letters, glued, han, thai, blob, rng.randbytes(9000).hex(), *runs, f"a {letters} b {han}  {letters}"]
    ids, same = encoded(texts)
    assert ids == [LIBRARY.encode(t) for t in texts] and all(same)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["the", "ing", "=", "==", "é", "ab", "house", "日", "x", "_"]), min_size=200, max_size=500), st.integers(1, 400))
def test_segments_agree_on_any_long_word(parts, times):
    text = "".join(parts) + parts[0] * times
    assert encoded([text])[0] == [LIBRARY.encode(text)]
