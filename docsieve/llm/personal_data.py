"""Operator 5: personal data by patterns and by a character-level BiLSTM-CRF trained on labelled spans.

Base spans (email, ip, card, phone) come from fixed patterns. The tagger adds spans that
have their shape but fail a rule: numbers of cards that miss the checksum, phone
numbers without a country code, unusual separators.

Every kind holds a digit or an `@` by definition, so a stretch of text without either
cannot hold a span. One pass over the whole texts finds the base spans and keeps the zones around
digits and `@`; nothing else needs decoding. The tagger is trained on at most `sample`
windows of these zones, those with the smallest hash, labelled by shape; further spans of all
kinds and formats, and plain numbers, are written into the windows, so that small
corpora teach all kinds. Zones are decoded in windows that overlap by half. Spans of
different windows that touch are united, then conflicts are settled over the whole
text: base spans first, then the spans of the greatest summed probability.

Edge cases: null and empty texts have no spans and the hash of nothing; repeated
rows get equal results; an empty table gives no rows; further columns are ignored.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import arrays
from docsieve.llm.registry import table
from docsieve.llm.tagger import Tagger
from docsieve.session import cut

KINDS = ["email", "ip", "card", "phone"]
#: Fixed patterns of the base kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Stretches that can hold an email.
AROUND_AT = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]*@[A-Za-z0-9._%+@-]*")
TRIGGER = re.compile(r"[0-9@]+")
WINDOW, STRIDE = 64, 32
#: Windows that the tagger is trained on, at most, and its size.
SAMPLE, HIDDEN, EPOCHS = 1000, 20, 7
SURE = 0.8


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str, checksum: bool = True) -> list[tuple[int, int, str]]:
    """Spans of the base kinds; without `checksum`, of any number as long as a card's."""
    found = []
    if "@" in text:
        for around in AROUND_AT.finditer(text):
            found += [(around.start() + m.start(), around.start() + m.end(), "email") for m in EMAIL.finditer(around.group())]
    if TRIGGER.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = digits_of(m.group())
            if 14 <= len(digits) <= 19 and (not checksum or luhn(digits)):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(digits_of(m.group())) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def zones(text: str) -> list[tuple[int, str]]:
    """Start and characters of the stretches around digits and `@`, half a window to either side."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        start, end = max(0, m.start() - STRIDE), min(len(text), m.end() + STRIDE)
        if out and start <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([start, end])
    return [(s, text[s:e]) for s, e in out]


def window_starts(length: int) -> list[int]:
    return list(range(0, max(1, length - WINDOW + STRIDE), STRIDE))


#: Characters that are symbols of their own; others are told apart as digit, lower, upper, white space, beyond ASCII and the rest.
OWN = "@.-+() _%/:=,#\"'*|&$!"
PAD = len(OWN)


def symbols() -> np.ndarray:
    codes = np.full(0x81, PAD + 5, np.int64)
    for c in range(0x80):
        ch = chr(c)
        codes[c] = OWN.index(ch) if ch in OWN else PAD + 1 if ch.isdigit() else PAD + 2 if ch.islower() else PAD + 3 if ch.isupper() else PAD + 4 if ch.isspace() else PAD + 6
    return codes


SYMBOLS = symbols()
N_SYMBOLS = PAD + 7


def encode(windows: list[str]) -> np.ndarray:
    """Symbol numbers as (time, batch), filled up with PAD."""
    out = np.full((WINDOW, len(windows)), PAD, np.int64)
    for i, text in enumerate(windows):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[: len(points), i] = SYMBOLS[np.minimum(points, len(SYMBOLS) - 1)]
    return out


def made_up(rng: np.random.Generator) -> tuple[str, str | None]:
    """A span in one of many formats with its kind, or a plain number."""
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9)))
    pick = int(rng.integers(0, 22))
    sep = str(rng.choice([" ", "-", "."]))
    if pick < 4:
        return [f"{word()}.{number(2)}@{word()}.{word()}.com", f"{word()}@{word()}.org", f"{word()}_{word()}+{number(1)}@{word()}.co.uk", f"{word()} @ {word()}.com"][pick], "email"
    if pick < 6:
        return ".".join(str(x) for x in rng.integers(0, 256, 4)), "ip"
    if pick < 10:
        return [number(16), sep.join(number(4) for _ in range(4)), number(15), f"{number(4)} {number(6)} {number(5)}"][pick - 6], "card"
    if pick < 16:
        return [f"+1 ({number(3)}) {number(3)}-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}",
                f"+{number(2)}{sep}{number(3)}{sep}{number(4)}{sep}{number(3)}", f"{number(3)}.{number(3)}.{number(4)}", f"+{number(11)}"][pick - 10], "phone"
    plain = [f"{rng.integers(1900, 2100)}", f"{number(1)}.{number(2)}", f"{number(1)},{number(3)}", f"20{number(2)}-0{rng.integers(1, 10)}-1{number(1)}",
             "".join(f"{x:x}" for x in rng.integers(0, 16, 40)), f"{number(1)}.{number(1)}.{number(1)}"]
    return plain[pick - 16], None


def labelled(windows: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags: each window as it is, and twice with a made-up span in place of a word."""
    rng = np.random.default_rng(seed)
    texts, tags = [], []

    def add(text: str, spans: list[tuple[int, int, str]]) -> None:
        row = np.zeros(WINDOW, np.int64)
        for start, end, kind in spans:
            if start < WINDOW:
                row[start : min(end, WINDOW)] = 2 + 2 * KINDS.index(kind)
                row[start] -= 1
        texts.append(text[:WINDOW])
        tags.append(row)

    for text in windows:
        add(text, base_spans(text, checksum=False))
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
        for _ in range(2 if words else 0):
            word = words[int(rng.integers(0, len(words)))]
            value, kind = made_up(rng)
            changed = text[: word.start()] + value + text[word.end() :]
            stretch = (word.start(), word.start() + len(value))
            rest = [s for s in base_spans(changed, checksum=False) if s[1] <= stretch[0] or s[0] >= stretch[1]]
            add(changed, rest + ([(*stretch, kind)] if kind else []))
    return encode(texts), np.array(tags, np.int64).reshape(-1, WINDOW).T


def plausible(kind: str, text: str) -> bool:
    digits = len(digits_of(text))
    return {"email": "@" in text and "." in text, "ip": text.count(".") >= 3 and digits >= 4, "card": 12 <= digits <= 19, "phone": 7 <= digits <= 15}[kind]


def tagged_spans(tagger: Tagger, parts: list[list[tuple[int, str]]]) -> list[list[tuple[int, int, str, float]]]:
    """For each text, spans (start, end, kind, summed probability) of its zones; touching spans of one kind are united."""
    windows = [(n, start + at, zone[at : at + WINDOW]) for n, found in enumerate(parts) for start, zone in found for at in window_starts(len(zone))]
    raw: list[list[tuple[int, int, str, float]]] = [[] for _ in parts]
    for i in range(0, len(windows), 256):
        some = windows[i : i + 256]
        tags, sure = tagger.decode(encode([w[2] for w in some]))
        for j, (n, offset, text) in enumerate(some):
            row, t = tags[: len(text), j], 0
            while t < len(text):
                if not row[t]:
                    t += 1
                    continue
                kind, start = (row[t] - 1) // 2, t
                t += 1
                while t < len(text) and row[t] == 2 + 2 * kind:
                    t += 1
                raw[n].append((offset + start, offset + t, KINDS[kind], float(sure[start:t, j].mean())))
    out = []
    for spans in raw:
        united: list[list] = []
        for start, end, kind, sure in sorted(spans, key=lambda s: (s[2], s[0])):
            if united and united[-1][2] == kind and start < united[-1][1]:
                united[-1][1], united[-1][3] = max(end, united[-1][1]), max(sure, united[-1][3])
            else:
                united.append([start, end, kind, sure])
        out.append([(s, e, k, p) for s, e, k, p in united])
    return out


def settled(base: list[tuple[int, int, str]], found: list[tuple[int, int, str, float]], parts: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    """The base spans and those tagged spans that overlap neither them nor a stronger one."""
    taken, out = [(s, e) for s, e, _ in base], []
    for start, end, kind, sure in sorted(found, key=lambda f: (-f[3] * (f[1] - f[0]), f[0], f[2])):
        text = next(z[start - s : end - s] for s, z in parts if s <= start and end <= s + len(z))
        lead, tail = len(text) - len(text.lstrip(" .,;:-")), len(text) - len(text.rstrip(" .,;:-"))
        start, end, text = start + lead, end - tail, text.strip(" .,;:-")
        if sure >= SURE and plausible(kind, text) and all(end <= s or e <= start for s, e in taken):
            taken.append((start, end))
            out.append((start, end, kind))
    return base + out


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
ZONE = pa.list_(pa.struct([("start", pa.int64()), ("text", pa.string())]))


def collector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other columns with base spans and zones."""
    for batch in batches:
        for part in arrays.slices([batch], "text"):
            bases, found = [], []
            for value in part.column("text").to_pylist():
                value = value or ""
                bases.append([{"start": s, "end": e, "kind": k} for s, e, k in base_spans(value)])
                found.append([{"start": s, "text": t} for s, t in zones(value)])
            names = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(bases, SPAN), pa.array(found, ZONE)], [*names, "base", "zones"])


def zone_maker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Zones alone."""
    for batch in batches:
        found = [[{"start": s, "text": t} for s, t in zones(value or "")] for value in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, ZONE)], ["zones"])


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named after the first."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def finder(tagger: Tagger) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces base and zones by all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases = [[(b["start"], b["end"], b["kind"]) for b in row] for row in batch.column("base").to_pylist()]
            parts = [[(z["start"], z["text"]) for z in row] for row in batch.column("zones").to_pylist()]
            spans = [settled(b, f, p) for b, f, p in zip(bases, tagged_spans(tagger, parts), parts)]
            names = [n for n in batch.schema.names if n != "zones"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in sorted(row)] for row in spans], SPAN)], [*names, "spans"],
            )

    return run


def trained(found: DataFrame, sample: int) -> Tagger:
    """A tagger fitted on the windows with the smallest hashes."""
    parts = found.select(F.explode("zones").alias("z")).select(F.substring("z.text", 1, WINDOW).alias("text")).distinct()
    windows = [r["text"] for r in parts.orderBy(F.xxhash64("text"), "text").limit(sample).collect()]
    tagger = Tagger(N_SYMBOLS, len(KINDS), HIDDEN)
    if windows:
        tagger.train(*labelled(windows), epochs=max(EPOCHS, min(40, EPOCHS * 300 // len(windows))))
    return tagger


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, base and all spans (start, end, kind) of each row."""
    kind = docs.schema[key].dataType.simpleString()
    span, zone = "array<struct<start: long, end: long, kind: string>>", "array<struct<start: long, text: string>>"
    found = cut(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(collector, f"doc_id {kind}, base {span}, zones {zone}"))
    return found.mapInArrow(finder(trained(found, sample)), f"doc_id {kind}, base {span}, spans {span}")


def digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[[(s["start"], s["end"], s["kind"]) for s in row] for row in batch.column(n).to_pylist()] for n in ("base", "spans")]
        counts = [[sum(k == kind for _, _, k in row) for row in rows[0]] for kind in KINDS]
        hashes = [hashlib.sha256(joined(row).encode()).hexdigest() for row in rows[0]]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array([joined(row) for row in rows[1]], pa.string())],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = find(table(spark, sf_dir, "documents"))
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(digester, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


QUERIES = {"op5_personal_data": op5_personal_data}
ORACLES: dict[str, str] = {}
