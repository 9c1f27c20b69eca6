"""Canonical values (B1-B6, B9-B12) as Column expressions. NULL means "could not be read"."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.definition import MONEY, RATE, Definition, FieldSpec

# Month names a date may be printed with.
MONTH_NUMBERS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7,
    "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}

# Fixed value: the characters that count as white space, spelled out because that is faster than a Unicode class.
WHITE = "\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The class again: visible ASCII is turned away by one comparison, which nearly all characters are.
BLANK = f"[[^!-~]&&[{WHITE}]]"
SPACES = f"{BLANK}+"
#: Runs of white space that are not one plain space.
_UNEVEN = f"(?: {BLANK}|[[^ -~]&&[{WHITE}]]){BLANK}*"
#: The same characters one by one, as `btrim` takes them.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SIGNS = f"[[^!-#%-~]&&[$€£{WHITE}]]+"
_CODES = ("USD", "EUR", "GBP")
_CURRENCY = "|".join((_SIGNS, *_CODES))


def bind(value: Column, use) -> Column:
    """`use(value)` with the value computed once, also inside lambdas, where Spark shares no subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(value: Column) -> Column:
    """The words between white space. Spark compiles a splitting pattern anew for each row unless it is one plain character."""
    return F.filter(F.split(F.regexp_replace(value, f"[[^ -~]&&[{WHITE}]]", " "), " "), lambda t: t != "")


def norm_text(value: Column) -> Column:
    """B1: runs of white space, no-break and thin spaces become one space."""
    return F.trim(F.regexp_replace(value, _UNEVEN, " "))


def _plain_number(bare: Column) -> Column:
    no_comma = F.replace(bare, F.lit(","), F.lit(""))
    return (
        F.when(~F.contains(bare, F.lit(",")), bare)
        .when(bare.rlike(",.*\\.[^,]*$"), no_comma)
        .when(F.contains(bare, F.lit(".")), F.translate(bare, ",.", "."))
        .when(bare.rlike("^[+-]?[0-9]{1,3}(,[0-9]{3})+$"), no_comma)
        .otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    )


EXACT = "decimal(38,12)"


def norm_amount(value: Column) -> Column:
    """B2: a printed amount in US or continental notation as an exact decimal; the later mark is the decimal one.

    26 digits before the point and 12 behind it are kept; canonical records keep 25 before the point.
    """
    coded = reduce(lambda a, code: a | F.contains(value, F.lit(code)), _CODES, F.lit(False))
    bare = F.when(coded, F.regexp_replace(value, _CURRENCY, "")).otherwise(F.regexp_replace(value, _SIGNS, ""))
    return bind(bare, _plain_number).try_cast(EXACT)


def norm_rate(value: Column) -> Column:
    """A fraction; a percent sign or a value above one means percent."""
    bare = F.regexp_replace(value, f"USD|EUR|GBP|[$€£%{WHITE}]+", "")
    percent = F.contains(value, F.lit("%"))
    hundredth = lambda n: (n / F.lit(100).cast("decimal(3,0)")).cast(RATE)
    return bind(
        bind(bare, _plain_number).try_cast(RATE), lambda n: F.when(percent | (n > 1), hundredth(n)).otherwise(n)
    )


def _month_number(name: Column) -> Column:
    pairs = [F.lit(x) for name_, n in MONTH_NUMBERS.items() for x in (name_, str(n))]
    return F.try_element_at(F.create_map(*pairs), F.lower(name))


_WEEK = "^(\\d{4})-?W(\\d{2})(?:-?([1-7]))?$"


def _week_date(text: Column) -> Column:
    """The day of an ISO week date as yyyy-MM-dd, NULL for a week that its year does not have."""
    year, week = (F.regexp_extract(text, _WEEK, i).cast("int") for i in (1, 2))
    day = F.coalesce(F.nullif(F.regexp_extract(text, _WEEK, 3), F.lit("")).cast("int"), F.lit(1))
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    found = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (week - 1) * 7 + day - 1)
    return F.when((week >= 1) & (F.date_part(F.lit("YEAROFWEEK"), found) == year), F.date_format(found, "yyyy-MM-dd"))


def _iso(text: Column) -> Column:
    slash, dot = "^(\\d{1,2})/(\\d{1,2})/(\\d{4})$", "^(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})$"
    month_first, day_first = "^([A-Za-z]+) (\\d{1,2}), (\\d{4})$", "^(\\d{1,2}) ([A-Za-z]+) (\\d{4})$"
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    return (
        F.when(text.rlike("^\\d{4}-\\d{2}-\\d{2}$"), text)
        .when(text.rlike("^\\d{8}$"), F.regexp_replace(text, "^(....)(..)(..)$", "$1-$2-$3"))
        .when(text.rlike(_WEEK), _week_date(text))
        .when(text.rlike(slash), F.regexp_replace(text, slash, "$3-$1-$2"))
        .when(text.rlike(dot), F.regexp_replace(text, dot, "$3-$2-$1"))
        .when(text.rlike(month_first), F.concat(part(month_first, 3), F.lit("-"), _month_number(part(month_first, 1)), F.lit("-"), part(month_first, 2)))
        .when(text.rlike(day_first), F.concat(part(day_first, 3), F.lit("-"), _month_number(part(day_first, 2)), F.lit("-"), part(day_first, 1)))
    )


def norm_date(value: Column) -> Column:
    """Any ISO date (basic and week dates too), m/d/yyyy, d.m.yyyy or an English month name; impossible dates give NULL.

    The shape decides how to read the value, so no parse is tried that must fail.
    """
    return bind(norm_text(value), _iso).try_cast("date")


def norm_by_kind(value: Column, kind: str) -> Column:
    money = lambda v: norm_amount(v).try_cast(MONEY)
    readers = {"date": norm_date, "money": money, "quantity": money, "rate": norm_rate}
    return readers.get(kind, norm_text)(value)


def _norm_field(value: Column, spec: FieldSpec) -> Column:
    if spec.kind != "table":
        return norm_by_kind(value, spec.kind)
    return F.transform(
        value,
        lambda row: F.struct(*[norm_by_kind(row[c.name], c.kind).alias(c.name) for c in spec.columns.values()]),
    )


def canonical_fields(raw: Column, definition: Definition) -> dict[str, Column]:
    """Every field of a raw record (all strings) as its canonical type."""
    return {n: _norm_field(raw[n], s) for n, s in definition.fields.items()}


def normalize_record(raw: Column, definition: Definition) -> Column:
    """B5 as one struct."""
    return F.struct(*[c.alias(n) for n, c in canonical_fields(raw, definition).items()])


def _plain(value: Column, kind: str) -> Column:
    """The text of a canonical value without trailing zeros, as it is stored and compared."""
    if kind == "date":
        return F.date_format(value, "yyyy-MM-dd")
    if kind in ("money", "quantity", "rate"):
        return F.regexp_replace(F.regexp_replace(value.cast("string"), "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    return value.cast("string")


def _plain_row(spec: FieldSpec):
    return lambda row: F.struct(*[_plain(row[c.name], c.kind).alias(c.name) for c in spec.columns.values()])


def json_record(record: Column, definition: Definition) -> Column:
    """Decimals and dates as text, nested rows included."""
    parts = [
        (F.transform(record[n], _plain_row(s)) if s.kind == "table" else _plain(record[n], s.kind)).alias(n)
        for n, s in definition.fields.items()
    ]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def _entry(name: Column, value: Column, kind: str = "text") -> Column:
    return F.struct(name.alias("name"), F.coalesce(_plain(value, kind), F.lit("None")).alias("value"))


def _cell_entries(table: str, spec: FieldSpec):
    def cells(row: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"{table}."), i.cast("string"))
        return F.array(
            *[_entry(F.concat(at, F.lit(f".{c.name}")), row[c.name], c.kind) for c in spec.columns.values()]
        )

    return cells


def flatten_fields(record: Column, definition: Definition) -> Column:
    """Array of (name, value): scalars, `{table}.count`, `{table}.{row}.{column}`; NULL prints `None`."""
    pieces = [
        F.array(*[_entry(F.lit(n), record[n], s.kind) for n, s in definition.fields.items() if s.kind != "table"])
    ]
    for name in definition.table_fields:
        rows = F.coalesce(record[name], F.array())
        pieces.append(F.array(_entry(F.lit(f"{name}.count"), F.size(rows))))
        pieces.append(F.flatten(F.transform(rows, _cell_entries(name, definition.fields[name]))))
    return F.concat(*pieces)


def _cell_names(table: str, spec: FieldSpec):
    def names(row: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"{table}."), i.cast("string"))
        return F.array(*[F.concat(at, F.lit(f".{c.name}")) for c in spec.columns.values()])

    return names


def cell_names(record: Column, definition: Definition) -> Column:
    """The names of `flatten_fields` in the same order, for readers that need no values."""
    pieces = [F.array(*[F.lit(n) for n, s in definition.fields.items() if s.kind != "table"])]
    for name in definition.table_fields:
        rows = F.coalesce(record[name], F.array())
        pieces.append(F.array(F.lit(f"{name}.count")))
        pieces.append(F.flatten(F.transform(rows, _cell_names(name, definition.fields[name]))))
    return F.concat(*pieces)


def strip_fences(value: Column) -> Column:
    """Drop a Markdown code fence and an optional leading `json`."""
    trimmed = F.regexp_replace(value, "^\\s+|\\s+$", "")
    body = F.regexp_replace(F.regexp_replace(trimmed, "^[^\n]*\n", ""), "```$", "")
    inner = F.regexp_replace(F.regexp_replace(body, "^json", ""), "^\\s+|\\s+$", "")
    return F.when(F.startswith(trimmed, F.lit("```")), inner).otherwise(trimmed)


def squash(value: Column) -> Column:
    """Every white-space character deleted, case folded (`ß` included)."""
    nothing = F.lit("")
    dense = F.replace(F.replace(value, F.lit(" "), nothing), F.lit("\n"), nothing)
    return F.replace(F.lower(F.regexp_replace(dense, SPACES, "")), F.lit("ß"), F.lit("ss"))


def strip_text(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def document_key(text: Column) -> Column:
    """Identity of a document by its stripped text."""
    return F.substring(F.sha2(strip_text(text), 256), 1, 16)


def estimate_tokens(*texts: Column) -> Column:
    """Characters / 4, plus one."""
    total = sum((F.length(t) for t in texts[1:]), F.length(texts[0]))
    return (F.floor(total / F.lit(4)) + 1).cast("bigint")


def object_keys(tenant: Column, sha: Column, document_id: Column) -> tuple[Column, Column]:
    """Where the upload and its parsed text are stored."""
    incoming = F.concat(tenant, F.lit("/incoming/"), sha, F.lit(".pdf"))
    parsed = F.concat(tenant, F.lit("/parsed/"), document_id.cast("string"), F.lit(".txt"))
    return incoming, parsed


def parse_gate(text: Column, min_chars: int = 100) -> Column:
    """Too little text means the page needs OCR."""
    return F.when(F.length(text) < min_chars, F.lit("needs_ocr")).otherwise(F.lit("parsed"))


def hash_draw(seed: int, purpose: str, key: Column) -> Column:
    """A 32-bit number drawn from (seed, purpose, key); the same on every engine and in every partition."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:{purpose}:"), key), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
