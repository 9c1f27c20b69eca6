"""Operator 3: SentencePiece encoding and decoding with a suffix array of the batch.

The model is a byte-pair vocabulary; ids equal those of the library. A text is cut before
each run of spaces, where no piece can cross, and equal words of a task are encoded once. The new words
of a batch are concatenated and their suffixes sorted; every piece of the
vocabulary is looked up by binary search and gives a range of occurrences. The
occurrences are edges from their start to their end, sorted by position and relaxed from
left to right: an edge is taken if the piece and the one that ends at its start stay
apart, that is if byte-pair merging of the two together yields just these two. For
byte-pair merging each position has one such edge at most, so the relaxation
finds the same pieces as merging does. Whether two pieces stay apart is
found by undoing their merges in reverse order, and remembered.

A word of more than 512 bytes (a text in a script without spaces, encoded data) is cut between characters that no piece
holds side by side, and equal parts are encoded once. A part that stays long is dealt into overlapping segments that advance together;
those that do not fall in with their predecessor, mostly in long runs of one sign, are relaxed once more, an occurrence at a time.

Characters outside the vocabulary become byte pieces and keep their neighbours apart. Runs of
several spaces have the least rank and are merged last, from the left.

Edge cases: null and empty texts have no ids; the character U+2581 reads as a
space, as in the library; repeated rows are encoded each; an empty table gives no
rows; further columns are ignored. A piece that could cross a space is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import arrays
from docsieve.llm.registry import table
from docsieve.llm.token_counts import SPACE, default_model, parts

BREAK = 0xFF
NORMAL, BYTE = 1, 6
#: Words, and pairs of pieces, that a task remembers; beyond that it starts anew.
REMEMBERED = 1 << 19
REMEMBERED_PAIRS = 1 << 21
#: Bytes of new words that are indexed at a time; the edges take some two hundred times as much.
INDEXED_BYTES = 64 << 10
#: Ids that a task remembers.
REMEMBERED_IDS = 1 << 23
#: Bytes from which a word is cut, of a segment of a run that cannot be cut, and of its start before its own begin.
LONG, SEGMENT, OVERLAP = 512, 384, 192
#: Characters that are looked at together when a word is cut.
CUT = 1 << 16
#: What ends at a place: nothing; nothing yet, because a word starts there.
NONE, FIRST = -3, -2
#: Bytes of text that are encoded together.
SLICE_BYTES = 512 << 10


def merged(piece: str, rank: dict[str, int]) -> list[str] | None:
    """The last two parts from which merging builds a piece; itself for a character, null if merging never builds it."""
    symbols = list(piece)
    if len(symbols) == 1:
        return symbols
    while True:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            r = rank.get(symbols[i] + symbols[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return None
        if len(symbols) == 2:
            return symbols
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


class Vocabulary:
    """The pieces by merging order: characters first, then merges from the first to the last."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.normalizer_spec.precompiled_charsmap or not proto.normalizer_spec.add_dummy_prefix or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only byte-pair models with byte fallback and without normalisation are supported")
        kinds = [p.type for p in proto.pieces]
        names = [p.piece for p in proto.pieces]
        self.size = len(names)
        self.byte_id = np.zeros(256, np.int32)
        for i, name in enumerate(names):
            if kinds[i] == BYTE:
                self.byte_id[int(name[3:5], 16)] = i
            elif kinds[i] == NORMAL and SPACE in name.lstrip(SPACE):
                raise ValueError(f"piece {name!r} crosses the start of a word")
        self.runs = {len(n): i for i, n in enumerate(names) if kinds[i] == NORMAL and set(n) == {SPACE}}
        normal = sorted((i for i in range(len(names)) if kinds[i] == NORMAL and not (set(names[i]) == {SPACE} and len(names[i]) > 1)), key=lambda i: (len(names[i]) > 1, -proto.pieces[i].score))
        rank = {names[i]: n for n, i in enumerate(normal) if len(names[i]) > 1}
        built = [(i, merged(names[i], rank)) for i in normal]
        built = [(i, m) for i, m in built if m]
        number = {names[i]: n for n, (i, _) in enumerate(built)}
        self.id = np.array([i for i, _ in built], np.int32)
        self.space = number.get(SPACE, -1)
        self.left = np.array([number[m[0]] for _, m in built])
        self.right = np.array([number[m[-1]] for _, m in built])
        pairs = sorted((number[n[:k]] * len(built) + number[n[k:]], number[n]) for n in number for k in range(1, len(n)) if n[:k] in number and n[k:] in number)
        self.pair, self.pair_to = (np.array(v, np.int64) for v in zip(*pairs))
        raw = [names[i].replace(SPACE, " ").encode() for i, _ in built]
        self.length = np.array([len(r) for r in raw])
        self.depth = -(-int(self.length.max()) // 8)
        low, high = (np.frombuffer(b"".join(r.ljust(8 * self.depth, fill) for r in raw), ">u8").astype(np.uint64).reshape(-1, self.depth) for fill in (b"\0", b"\xff"))
        self.low, self.high = low, high
        texts = [bytes([int(n[3:5], 16)]) if k == BYTE else n.replace(SPACE, " ").encode() if k == NORMAL else b"" for n, k in zip(names, kinds)]
        self.texts = pa.array(texts, pa.large_binary())
        marks = [np.frombuffer(names[i].replace(SPACE, " ").encode("utf-32-le"), np.uint32).astype(np.int64) for i, _ in built]
        self.neighbours = np.unique(np.concatenate([(m[:-1] << 21) | m[1:] for m in marks]))
        self.keys, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []

    def combined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.id) + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_to[at], np.iinfo(np.int64).max)

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the two pieces together leaves them as they are: undo the later merge of the two until neither is left."""
        out = np.zeros(len(a), bool)
        rows, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(rows):
            go = self.combined(a, b) >= limit
            rows, a, b, limit = rows[go], a[go], b[go], limit[go]
            whole_a, whole_b = self.right[a] == a, self.left[b] == b
            done = whole_a & whole_b
            out[rows[done]] = True
            rows, a, b, whole_a, whole_b = rows[~done], a[~done], b[~done], whole_a[~done], whole_b[~done]
            first = (~whole_a) & ((a > b) | whole_b)
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`stay_apart` with memory; a negative piece stays apart from all."""
        out = np.ones(len(a), bool)
        inner = np.flatnonzero((a >= 0) & (b >= 0))
        keys, where = np.unique(a[inner] * len(self.id) + b[inner], return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        apart = np.zeros(len(keys), bool)
        apart[known] = self.apart[at[known]] if len(self.keys) else []
        if not known.all():
            apart[~known] = self.stay_apart(*np.divmod(keys[~known], len(self.id)))
            self.fresh.append((keys[~known], apart[~known]))
        out[inner] = apart[where]
        return out

    def remember(self) -> None:
        """Merge what was found since the last call into the memory."""
        if self.fresh:
            keys, apart = (np.concatenate(v) for v in zip((self.keys, self.apart), *self.fresh))
            self.keys, first = np.unique(keys, return_index=True)
            self.apart, self.fresh = apart[first], []
        if len(self.keys) > REMEMBERED_PAIRS:
            self.keys, self.apart = self.keys[:0], self.apart[:0]

    def cut(self, word: bytes) -> list[bytes]:
        """The word, cut between characters that stand side by side in no piece: no merge crosses such a place."""
        text, places, done = word.decode(), [0], 0
        for i in range(0, len(text), CUT):
            # one character more, for the pair that crosses
            marks = np.frombuffer(text[i : i + CUT + 1].encode("utf-32-le"), np.uint32).astype(np.int64)
            pair = (marks[:-1] << 21) | marks[1:]
            at = np.minimum(np.searchsorted(self.neighbours, pair), len(self.neighbours) - 1)
            ends = done + np.cumsum(np.select([marks < 0x80, marks < 0x800, marks < 0x10000], [1, 2, 3], 4))
            places.extend(ends[:-1][self.neighbours[at] != pair].tolist())
            done = int(ends[min(CUT, len(ends)) - 1])
        places.append(len(word))
        return [word[s:e] for s, e in zip(places, places[1:])]

    def space_run(self, n: int) -> list[int]:
        """Ids of a run of n single spaces, merged from the left."""
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.runs:
                stack[-2:] = [stack[-2] + stack[-1]]
        return [self.runs[k] for k in stack]


def suffixes(data: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions sorted by the 8 * depth bytes that follow, and these bytes as big-endian numbers in that order."""
    padded = np.concatenate([data, np.full(8 * depth, BREAK, np.uint8)]).astype(np.uint64)
    head = np.zeros(len(data) + 8 * (depth - 1), np.uint64)
    for k in range(8):
        head = (head << np.uint64(8)) | padded[k : k + len(head)]
    keys = [head[8 * d : 8 * d + len(data)] for d in range(depth)]
    # the first eight bytes tell most suffixes apart; only the others are compared further
    order = np.argsort(keys[0], kind="stable")
    same = keys[0][order[1:]] == keys[0][order[:-1]]
    tied = order[np.append(same, False) | np.append(False, same)]
    order[np.append(same, False) | np.append(False, same)] = tied[np.lexsort([k[tied] for k in keys[::-1]])]
    return order, [k[order] for k in keys]


def bisect(values: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of each wanted value in its own sorted range."""
    low, high = low.copy(), high.copy()
    while True:
        open_ranges = low < high
        if not open_ranges.any():
            return low
        middle = (low + high) // 2
        value = values[np.minimum(middle, len(values) - 1)]
        right = open_ranges & ((value <= wanted) if after else (value < wanted))
        low = np.where(right, middle + 1, low)
        high = np.where(open_ranges & ~right, middle, high)


def occurrences(vocabulary: Vocabulary, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and piece of every occurrence of every piece."""
    order, keys = suffixes(data, vocabulary.depth)
    n = len(vocabulary.id)
    low, high = np.searchsorted(keys[0], vocabulary.low[:, 0], "left"), np.searchsorted(keys[0], vocabulary.high[:, 0], "right")
    for d, key in enumerate(keys[1:], 1):
        # pieces of more than 8 d bytes, in what is left of their range
        inner = np.flatnonzero((vocabulary.length > 8 * d) & (low < high))
        left, right = low[inner], high[inner]
        low[inner] = bisect(key, vocabulary.low[inner, d], left, right, False)
        high[inner] = bisect(key, vocabulary.high[inner, d], left, right, True)
    count = np.maximum(high - low, 0)
    piece = np.repeat(np.arange(n), count)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    return order[at], piece


def encode_words(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, and where each word's ids start; a word starts with its space. Long words are cut first."""
    if all(len(w) <= LONG for w in words):
        return encode_short(vocabulary, words)
    number: dict[bytes, int] = {}
    use, count = [], []
    for w in words:
        chunks = vocabulary.cut(w) if len(w) > LONG else [w]
        use.extend(number.setdefault(c, len(number)) for c in chunks)
        count.append(len(chunks))
    chunks = np.fromiter(map(len, number), np.int64, len(number))
    short, long = np.flatnonzero(chunks <= LONG), np.flatnonzero(chunks > LONG)
    names = list(number)
    flat, offsets = encode_short(vocabulary, [names[i] for i in short])
    chains = [encode_chain(vocabulary, names[i]) for i in long]
    ids = np.concatenate([flat, *chains])
    ends = np.concatenate([offsets, offsets[-1] + np.cumsum([len(c) for c in chains], dtype=np.int64)])
    begin, size = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    begin[np.concatenate([short, long])], size[np.concatenate([short, long])] = ends[:-1], np.diff(ends)
    use = np.array(use)
    taken = size[use]
    first = np.cumsum(taken) - taken
    out = ids[np.arange(taken.sum()) - np.repeat(first - begin[use], taken)]
    total = np.concatenate([[0], np.cumsum(taken)])
    return out, total[np.cumsum([0, *count])]


def encode_short(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """`encode_words` of words that advance together, group by group."""
    ends = np.cumsum([0, *map(len, words)])
    flat, offsets, at = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
    while at < len(words):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + INDEXED_BYTES, "right")) - 1)
        ids, total = encode_group(vocabulary, words[at:stop])
        flat.append(ids)
        offsets.append(total[1:] + offsets[-1][-1])
        at = stop
    return np.concatenate(flat), np.concatenate(offsets)


def widths(data: np.ndarray) -> np.ndarray:
    """Bytes of the character that starts at each place."""
    return np.select([data < 0x80, data < 0xE0, data < 0xF0], [1, 2, 3], 4)


def edges(vocabulary: Vocabulary, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, piece and length of all occurrences; a character without a piece leads to byte pieces and is marked by -1."""
    at, piece = occurrences(vocabulary, data)
    size, width = vocabulary.length[piece], widths(data)
    lead = ((data & 0xC0) != 0x80) & (data != BREAK)
    covered = np.zeros(len(data), bool)
    covered[at[size == width[at]]] = True
    other = np.flatnonzero(lead & ~covered)
    return np.concatenate([at, other]), np.concatenate([piece, np.full(len(other), -1)]), np.concatenate([size, width[other]])


def relaxed(vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each place the piece that ends there and its length, all words from left to right at once; and all occurrences."""
    at, piece, size = edges(vocabulary, data)
    step = at - starts[np.searchsorted(ends, at)]
    order = np.argsort(step, kind="stable")
    at, piece, size, step = at[order], piece[order], size[order], step[order]
    last, back = np.full(len(data) + 1, NONE), np.zeros(len(data) + 1, np.int64)
    last[starts] = FIRST
    for group in np.split(np.arange(len(at)), np.flatnonzero(np.diff(step)) + 1):
        before = last[at[group]]
        group = group[before != NONE]
        taken = group[vocabulary.allowed(last[at[group]], piece[group])]
        # a word's end shares its place with nothing: it is the break behind the word
        last[at[taken] + size[taken]], back[at[taken] + size[taken]] = piece[taken], size[taken]
    vocabulary.remember()
    if (last[ends] == NONE).any():
        raise ValueError("a word cannot be encoded")
    return last, back, (at, piece, size)


def spelled(vocabulary: Vocabulary, data: np.ndarray, place: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces at their places in order, and how many each has: a character without a piece has one for each byte."""
    count = np.where(token >= 0, 1, widths(data)[place])
    out = np.repeat(np.where(token >= 0, vocabulary.id[token], 0), count).astype(np.int32)
    byte = np.repeat(token < 0, count)
    offset = np.arange(len(out)) - np.repeat(np.cumsum(count) - count, count)
    out[byte] = vocabulary.byte_id[data[(np.repeat(place, count) + offset)[byte]]]
    return out, count


def encode_group(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """`encode_words` of words that are indexed together."""
    data = np.frombuffer(b"\xff".join(words) + b"\xff", np.uint8)
    ends = np.flatnonzero(data == BREAK)
    starts = np.concatenate([[0], ends[:-1] + 1])
    last, back, _ = relaxed(vocabulary, data, starts, ends)
    steps, place, row = [], ends.copy(), np.arange(len(words))
    while len(row):
        steps.append((row, place - back[place], last[place]))
        place = place - back[place]
        going = place > starts[row]
        row, place = row[going], place[going]
    row, place, token = (np.concatenate(v) for v in zip(*steps))
    order = np.argsort(place)
    row, place, token = row[order], place[order], token[order]
    out, count = spelled(vocabulary, data, place, token)
    total = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bincount(row, count, len(words)).astype(np.int64), out=total[1:])
    return out, total


def encode_chain(vocabulary: Vocabulary, chunk: bytes) -> np.ndarray:
    """Ids of a long run of characters that pieces could cross anywhere.

    Segments of it advance together, each from a little before its own begin. What ends at a place depends only on what
    ends at the places one longest piece before it; so where a segment agrees with its predecessor over that stretch, it
    is right from there on. Where it does not, it is relaxed once more, alone, from its predecessor's end.
    """
    data = np.frombuffer(chunk + b"\xff", np.uint8)
    n, reach = len(chunk), int(vocabulary.length.max())
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    at_lead = lambda wanted: lead[np.searchsorted(lead, wanted, "right") - 1]
    bounds = np.append(at_lead(np.arange(0, n, SEGMENT)), n)
    begin = at_lead(np.maximum(0, bounds[:-1] - max(OVERLAP, 2 * reach)))
    last, back = np.full(n + 1, NONE), np.zeros(n + 1, np.int64)
    last[0] = FIRST
    together = max(1, INDEXED_BYTES // (SEGMENT + OVERLAP))
    known: dict[tuple[int, int], bool] = {}
    for k in range(0, len(begin), together):
        lows, highs = begin[k : k + together], bounds[k + 1 : k + 1 + together]
        group = np.frombuffer(b"".join(chunk[s:e] + b"\xff" for s, e in zip(lows.tolist(), highs.tolist())), np.uint8)
        ends = np.cumsum(highs - lows + 1) - 1
        starts = ends - (highs - lows)
        own_last, own_back, found = relaxed(vocabulary, group, starts, ends)
        found = tuple(v[np.argsort(found[0], kind="stable")] for v in found)
        for start, low, edge, high in zip(starts.tolist(), lows.tolist(), bounds[k : k + together].tolist(), highs.tolist()):
            own = lambda place: start + place - low
            seen = slice(max(low, edge + 1 - reach), edge + 1)
            here = slice(own(seen.start), own(seen.stop))
            if edge == 0 or (np.array_equal(own_last[here], last[seen]) and np.array_equal(own_back[here], back[seen])):
                last[edge + 1 : high + 1], back[edge + 1 : high + 1] = own_last[own(edge + 1) : own(high + 1)], own_back[own(edge + 1) : own(high + 1)]
            else:
                mine = slice(*np.searchsorted(found[0], [here.start, own(high)]))
                at, piece, size = (v[mine] for v in found)
                after = at + size > own(edge)
                relax_on(vocabulary, (at[after] - start + low, piece[after], size[after]), edge, seen.start, last, back, known)
        vocabulary.remember()
    tokens, steps, place = [], back.tolist(), n
    while place > 0:
        tokens.append(place)
        place -= steps[place]
    ends = np.array(tokens[::-1])
    return spelled(vocabulary, data, ends - back[ends], last[ends])[0]


def relax_on(vocabulary: Vocabulary, found_edges: tuple[np.ndarray, np.ndarray, np.ndarray], edge: int, low: int, last: np.ndarray, back: np.ndarray, known: dict[tuple[int, int], bool]) -> None:
    """Fill the places after `edge` from those before, an occurrence at a time; pairs of pieces are looked up once."""
    at, piece, size = found_edges
    found = dict(enumerate(last[low : edge + 1].tolist(), low))
    for s, p, w in zip(at.tolist(), piece.tolist(), size.tolist()):
        a = found.get(s, NONE)
        if a == NONE:
            continue
        ok = known.get((a, p))
        if ok is None:
            ok = known[a, p] = bool(vocabulary.allowed(np.array([a]), np.array([p]))[0])
        if ok:
            found[s + w] = p
            last[s + w], back[s + w] = p, w


class Encoder:
    """Ids of parts (extra spaces and a word), remembered by hash."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts; the spaces before a word's own space are merged last."""
        v = self.vocabulary
        bare = [r.lstrip(b" ") for r in raw]
        ids, offsets = encode_words(v, [b" " + b for b in bare if b])
        if all(len(b) == len(r) and b for r, b in zip(raw, bare)):
            return ids, offsets
        out, n = [], 0
        for r, b in zip(raw, bare):
            own = ids[offsets[n] : offsets[n + 1]].tolist() if b else []
            n += bool(b)
            extra = len(r) - len(b) + (not b)
            if extra and own and own[0] == v.id[v.space]:
                extra, own = extra + 1, own[1:]
            out.append(v.space_run(extra) + own)
        return np.array([i for o in out for i in o], np.int32), np.cumsum([0, *map(len, out)])

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts, one after another, and the number of each part's ids."""
        if len(self.keys) > REMEMBERED or len(self.flat) > REMEMBERED_IDS:
            self.forget()
        keys, first, where = np.unique(arrays.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            raw = data.tobytes()
            flat, offsets = self.learn([raw[s:e] for s, e in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist())])
            merged_keys = np.concatenate([self.keys, keys[fresh]])
            merged_at = np.concatenate([self.at, len(self.offsets) - 1 + np.arange(len(fresh))])
            self.flat, self.offsets = np.concatenate([self.flat, flat]), np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
            order = np.argsort(merged_keys)
            self.keys, self.at = merged_keys[order], merged_at[order]
        slot = self.at[np.searchsorted(self.keys, keys)][where]
        count = self.offsets[slot + 1] - self.offsets[slot]
        begin = np.cumsum(count) - count
        return self.flat[np.arange(count.sum()) - np.repeat(begin - self.offsets[slot], count)], count


def decode(vocabulary: Vocabulary, ids: pa.ListArray) -> pa.Array:
    """The text of each list of ids: pieces joined, without the space that encoding puts in front."""
    pieces = pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), vocabulary.texts.take(ids.values))
    whole = pc.binary_join(pieces, pa.scalar(b"", pa.large_binary()))
    return pc.utf8_slice_codeunits(whole.cast(pa.large_string()), 1)


def encoder(vocabulary: Vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The other columns with ids, their number, and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(vocabulary)
        for batch in arrays.slices(batches, "text", SLICE_BYTES):
            text = pc.replace_substring(pc.fill_null(batch.column("text"), ""), SPACE, " ")
            data, offsets = arrays.text_bytes(text)
            starts, ends, owner = parts(data, offsets)
            ids, count = own.of(data, starts, ends)
            total = np.zeros(batch.num_rows + 1, np.int32)
            total[1:] = np.cumsum(np.bincount(owner, count, batch.num_rows))
            lists = pa.ListArray.from_arrays(pa.array(total), pa.array(ids))
            same = pc.equal(decode(vocabulary, lists), text.cast(pa.large_string()))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [lists, pa.array(np.diff(total).astype(np.int64)), same], [*names, "ids", "n_tokens", "round_trip"])
            arrays.release()
        # the worker goes on to other tasks
        own.forget()
        vocabulary.keys, vocabulary.apart = vocabulary.keys[:0], vocabulary.apart[:0]
        arrays.release()

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model_path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of each row."""
    with open(model_path or default_model(), "rb") as file:
        vocabulary = Vocabulary(file.read())
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encoder(vocabulary), f"doc_id {kind}, ids array<int>, n_tokens long, round_trip boolean")


def op3_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents."""
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op3_sentencepieces": op3_sentencepieces}
ORACLES: dict[str, str] = {}
