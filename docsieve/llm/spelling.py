"""Operator 12: spelling variants of words, joined on pivotal grams.

Words are near if one inserted, deleted or replaced character turns one into the other. Steps:

1. Words are counted in tasks and summed. The bigrams of all words are counted; they are ordered from rare to common.
2. A word's prefix are its three rarest bigrams (all of a kind that ties with the third). Among the first three, two that share
   no character are its pivots; of the possible pairs dynamic programming takes the rarest.
3. One edit spoils at most one of two disjoint bigrams. So of two near words, the one whose prefix ends earlier
   in the order has a pivot that the other one's prefix holds as well.
4. The edit lies on one side of that pivot, so the other side is equal, and the pivot's position counted from there. Of the side
   with the edit, the first or the second half is equal. Pivots are joined with prefixes on gram, position,
   equal side, equal half and length, which leaves few candidates; each is verified by its edit distance.

The count of distinct bigrams is bounded by the alphabet (90 letters, 8,100 bigrams); only that table
reaches the driver. A word has at most some 2,000 near words of its length, so no group is unbounded.

Edge cases: null, empty and wordless texts have no words; a null doc_id counts as empty in the hash; repeated
rows count each; ties for the form go to the smallest word in code-point order; an empty table gives no rows; texts of
any length are read whole; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import arrays
from docsieve.llm.registry import table
from docsieve.session import cut

#: Characters of a word, at least; the slips that are put in by hash; how much commoner a form has to be.
LENGTH, SLIP, TIMES = 7, 31, 10
#: Distinct words that a task holds while it counts.
HELD = 200_000
#: Words whose keys are made at a time.
WORDS = 20_000

#: Letters a to z and U+00C0 to U+00FF, in UTF-8.
LETTERS = rb"(?:[a-z]|\xc3[\x80-\xbf])"


def counter(length: int, slip: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words of at least `length` characters and how often a task met them."""
    run_of = re.compile(LETTERS + b"{%d,}" % length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in arrays.slices(batches, "text"):
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                start = zlib.crc32(f"{'' if name is None else name}:".encode())
                for word, n in Counter(run_of.findall((text or "").encode("utf-8", "replace").lower())).items():
                    h = zlib.crc32(word, start)
                    if h % slip == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        if len(letters) <= length:
                            continue
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    held[word] += n
                if len(held) > HELD:
                    yield batch_of()
        if held:
            yield batch_of()

    return run


def words_of(docs: DataFrame, least: int = 2, length: int = LENGTH, slip: int = SLIP) -> DataFrame:
    """word and n, for words with at least `least` occurrences."""
    counts = docs.select("doc_id", "text").mapInArrow(counter(length, slip), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def matrices(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and code points of the words, one matrix for each length."""
    texts = words.to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer("".join(texts[i] for i in at).encode("utf-32-le"), np.uint32).reshape(-1, size).astype(np.int64)


def grams(letters: np.ndarray) -> np.ndarray:
    """The bigrams of each row as numbers."""
    return letters[:, :-1] << 21 | letters[:, 1:]


def gram_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigrams and their number, summed over a batch."""
    for batch in batches:
        found = [grams(m).ravel() for _, m in matrices(batch.column("word"))]
        if found:
            values, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["gram", "n"])


class Order:
    """Bigrams from rare to common; equal ones by their number."""

    def __init__(self, found: np.ndarray, n: np.ndarray):
        order = np.lexsort((found, n))
        self.grams = np.sort(found)
        self.rank = np.empty(len(found), np.int64)
        self.rank[np.searchsorted(self.grams, found[order])] = np.arange(len(found))
        self.weight = np.empty(len(found), np.int64)
        self.weight[np.searchsorted(self.grams, found)] = n

    def of(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and count of each bigram."""
        at = np.searchsorted(self.grams, values)
        return self.rank[at], self.weight[at]


def pivots(rank: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of two disjoint bigrams among each row's three first in order, with the least sum of counts; and the rank of the third."""
    n = np.arange(len(rank))
    first = np.argsort(rank, axis=1, kind="stable")[:, :3]
    bound = rank[n, first[:, 2]]
    place = np.sort(first, axis=1)
    cost = weight[n[:, None], place]
    far = np.iinfo(np.int64).max // 4
    # for each place as the right pivot: the cheapest one to its left that shares no character with it
    chosen, total = np.zeros((len(rank), 2), np.int64), np.full(len(rank), far)
    for right in (1, 2):
        one, least = np.zeros(len(rank), np.int64), np.full(len(rank), far)
        for left in range(right):
            better = (place[:, right] - place[:, left] >= 2) & (cost[:, left] < least)
            one[better], least[better] = place[better, left], cost[better, left]
        better = (least < far) & (least + cost[:, right] < total)
        chosen[better] = np.stack([one[better], place[better, right]], axis=1)
        total[better] = (least + cost[:, right])[better]
    return chosen, bound


class Sides:
    """Hashes of all parts of the rows of a matrix of letters."""

    def __init__(self, letters: np.ndarray):
        size = letters.shape[1]
        self.power, self.inverse = arrays.powers(size + 1)
        self.total = np.zeros((len(letters), size + 1), np.uint64)
        np.cumsum(arrays.mix(letters.astype(np.uint64) + np.uint64(1)) * self.power[:size], axis=1, out=self.total[:, 1:])

    def part(self, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return arrays.mix((self.total[row, end] - self.total[row, start]) * self.inverse[start] + (end - start).astype(np.uint64))


def keys(sides: Sides, row: np.ndarray, at: np.ndarray, size: int, other: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and join key for the bigrams (row, at) of words of `size` letters, to meet words of `other` letters.

    For each side that may be equal, and each half of the other side: that side with the bigram, the half, and the
    length of the word in whose prefix the bigram is looked up. The halves are measured in that word.
    """
    rows, out = [], []
    for number, equal_left in ((1, True), (2, False)):
        # the side with the edit: [start, end) here, `theirs` letters long in the other word
        start = at + 2 if equal_left else np.zeros_like(at)
        end = np.full_like(at, size) if equal_left else at
        theirs = end - start + (other - size)
        same = sides.part(row, np.zeros_like(at), at + 2) if equal_left else sides.part(row, at, np.full_like(at, size))
        half = theirs // 2
        for which, (s, e) in enumerate(((start, start + half), (end - (theirs - half), end))):
            fits = (theirs >= 0) & (s >= start) & (e <= end)
            key = same[fits] + arrays.mix(sides.part(row[fits], s[fits], e[fits]) + np.uint64(number * 2 + which)) * np.uint64(2 * other + 1)
            rows.append(row[fits])
            out.append(arrays.mix(key))
    return np.concatenate(rows), np.concatenate(out)


def key_maker(order: Order, of_pivots: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """key, word and bound: of a word's pivots for each length that a near word may have, or of its prefix for its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, WORDS):
                column = whole.column("word").slice(at, WORDS)
                for rows, letters in matrices(column):
                    size = letters.shape[1]
                    rank, weight = order.of(grams(letters))
                    chosen, bound = pivots(rank, weight)
                    sides = Sides(letters)
                    if of_pivots:
                        row, place, others = np.repeat(np.arange(len(rows)), 2), chosen.ravel(), (size - 1, size, size + 1)
                    else:
                        row, place = np.nonzero(rank <= bound[:, None])
                        others = (size,)
                    found = [keys(sides, row, place, size, other) for other in others]
                    of, key = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), column.take(pa.array(rows[of])), pa.array(bound[of].astype(np.int32))], ["key", "word", "bound"])

    return run


def gram_order(words: DataFrame) -> Order:
    counts = words.select("word").mapInArrow(gram_counter, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return Order(counts["gram"].to_numpy(), counts["n"].to_numpy())


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of near words once: a < b."""
    order = gram_order(words)
    narrow = words.select("word")
    left = narrow.mapInArrow(key_maker(order, True), "key long, word string, bound int").select("key", F.col("word").alias("a"), F.col("bound").alias("low"))
    right = narrow.mapInArrow(key_maker(order, False), "key long, word string, bound int").select("key", F.col("word").alias("b"), F.col("bound").alias("high"))
    met = left.join(right, "key").where((F.col("low") <= F.col("high")) & (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def rooted(forms: DataFrame) -> DataFrame:
    """word and root for words with a form, by doubling: a form is ten times as common as its word, so a chain has under 19 links."""
    steps = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return steps
        steps = moved.select("word", "root")


def group_variants(docs: DataFrame, times: int = TIMES, least: int = 2, length: int = LENGTH, slip: int = SLIP) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the documents; see the module. Words need three bigrams, so lengths below 4 are refused."""
    if length < 4:
        raise ValueError("words need at least 4 characters")
    words = cut(words_of(docs, least, length, slip))
    pairs = cut(near_pairs(words))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("other")), "b")
    best = known.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other")).alias("less"), "b")).alias("best"))
    judged = words.join(best.withColumnRenamed("a", "word"), "word", "left").withColumn("enough", -F.col("best.less") >= times * F.col("n"))
    judged = cut(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("enough"), F.col("best.b")).alias("form"), F.when(F.col("enough"), -F.col("best.less")).alias("form_n"),
    ))
    roots = rooted(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents with their forms and roots."""
    return group_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}

#: Near words share what is left after deleting a letter at the same place (a replaced letter), or one is the other without a letter.
ORACLES = {"op12_spelling_variants": """
WITH RECURSIVE step AS (
  SELECT i, 0 AS k, i::UBIGINT AS r FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::UBIGINT) ELSE r // 2 END FROM step WHERE k < 8
), remainders AS (SELECT list(r ORDER BY i) AS rem FROM step WHERE k = 8),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents) WHERE length(run) >= 7
), kinds AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda h: ('0x' || h)::UBIGINT)),
    lambda c, b: xor(c // 256, rem[(xor(c % 256, b) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS h
  FROM kinds, remainders
), spelled AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT DISTINCT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, 400) t(i) WHERE i <= length(word)),
near AS (
  SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word
), ranked AS (
  SELECT p.a AS word, count(*) OVER (PARTITION BY p.a) AS n_near, p.b, w.n AS other, row_number() OVER (PARTITION BY p.a ORDER BY w.n DESC, encode(p.b)) AS at
  FROM near p JOIN words w ON w.word = p.b
), judged AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other >= 10 * w.n THEN r.b END AS form, CASE WHEN r.other >= 10 * w.n THEN r.other END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.at = 1
), chains AS (
  SELECT word, word AS root, form AS further FROM judged
  UNION ALL SELECT c.word, j.word, j.form FROM chains c JOIN judged j ON j.word = c.further
)
SELECT j.word, j.form, c.root, j.n::BIGINT AS n, j.n_near::BIGINT AS n_near, j.form_n::BIGINT AS form_n
FROM judged j JOIN chains c ON c.word = j.word AND c.further IS NULL
"""}
