"""Evidence signals (D1-D10): what the document's own text says about an extracted record."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.definition import Definition
from docsieve.functions.tables import with_prefixed
from docsieve.functions.values import bind, squash, strip_text, words_of
from docsieve.operators import rules

# Thresholds and word lists of the evidence signals.
GROUNDED_AT = 0.85
DATE_CORROBORATED_AT = 0.9
MIN_RUN = 3
MIN_MEAN_TOKEN = 2.0
SINGLES_MIN_TOKENS = 4
SINGLES_SHARE = 0.4
MONTHS = {
    "jan": 1, "january": 1, "januar": 1,
    "feb": 2, "february": 2, "februar": 2,
    "mar": 3, "march": 3, "mär": 3, "maerz": 3, "märz": 3,
    "apr": 4, "april": 4,
    "may": 5, "mai": 5,
    "jun": 6, "june": 6, "juni": 6,
    "jul": 7, "july": 7, "juli": 7,
    "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10, "okt": 10, "oktober": 10,
    "nov": 11, "november": 11,
    "dec": 12, "december": 12, "dez": 12, "dezember": 12,
}
# A pattern begins with what few characters are; the word boundary before it is asked for afterwards.
NUMERIC_DATE = "\\d(?<=\\b\\d)\\d?\\s*([./])\\s*\\d{1,2}\\s*\\1\\s*\\d{4}\\b"
_LETTER = "[A-Za-zÄÖÜäöü]"
MONTH_NAME_DATE = f"(?U){_LETTER}(?<![A-Za-z]{_LETTER})(?<=\\b{_LETTER}){_LETTER}{{2,8}}+\\.?\\s+\\d{{1,2}},?\\s+\\d{{4}}\\b"
#: The same dates from their day on, which few pages have; the name is looked for behind it (group 1) over at most `_GAP` blanks.
_GAP = 8
_DAY_YEAR = "(?U)\\d(?<=\\s\\d)(?=\\d?,?\\s+\\d{4}\\b)"
DAY_OF_MONTH_NAME = f"{_DAY_YEAR}(?<=\\b(?<![A-Za-z])({_LETTER}{{3,9}}+\\.?)\\s{{1,{_GAP}}}\\d)\\d?,?\\s+\\d{{4}}\\b"
ISO_DATE = "\\d(?<=\\b\\d)\\d{3}-\\d{2}-\\d{2}\\b"
TERM_PATTERNS = ("(?i)innerhalb\\s+von\\s+(\\d{1,3})\\s+Tagen", "(?i)n(?<=\\bn)et\\s*(\\d{1,3})\\b")


def _fuzzy_scores():
    """Alignment of the values that are not literally on the page; NULL rows pass through untouched.

    Everything lives inside this function, so executors need no copy of the package.
    """
    shortest = MIN_RUN

    def aligned(values: list, page: str) -> list:
        # the page is indexed once, however many values are looked for
        matcher = SequenceMatcher(None, autojunk=False)
        matcher.set_seq2(page)
        scores = []
        for value in values:
            if value is None:
                scores.append(None)
                continue
            matcher.set_seq1(value)
            found = sum(block.size for block in matcher.get_matching_blocks() if block.size >= shortest)
            scores.append(round(min(1.0, found / len(value)), 4))
        return scores

    def score(needles: pd.Series, haystacks: pd.Series) -> pd.Series:
        rows = (None if values is None or page is None else aligned(values, page) for values, page in zip(needles, haystacks))
        return pd.Series(list(rows), dtype="object")

    return F.pandas_udf(score, T.ArrayType(T.DoubleType()))


def missing_needles(needles: Column, haystack: Column) -> Column:
    """The squashed values that are not literally in the squashed text; the others become NULL."""
    return F.transform(needles, lambda n: F.when((n != "") & (haystack != "") & ~F.contains(haystack, n), n))


def grounded_scores(needles: Column, missed: Column, haystack: Column) -> Column:
    """D1 for an array of squashed values against one squashed text.

    Containment is decided in the JVM. Only the values that miss travel to the
    Arrow worker; a document whose values are all on the page sends NULLs.
    """
    any_missed = F.exists(missed, lambda n: n.isNotNull())
    fuzzy = _fuzzy_scores()(F.when(any_missed, missed), F.when(any_missed, haystack))

    def score(n: Column, aligned: Column) -> Column:
        empty = n.isNull() | (n == "") | haystack.isNull() | (haystack == "")
        return F.when(empty, F.lit(0.0)).otherwise(F.coalesce(aligned, F.lit(1.0)))

    return F.zip_with(needles, F.coalesce(fuzzy, F.array().cast("array<double>")), score)


def groundedness(value: Column, text: Column) -> Column:
    """D1 for one value of one document."""
    needles, haystack = F.array(squash(value)), squash(text)
    return F.get(grounded_scores(needles, missing_needles(needles, haystack), haystack), F.lit(0))


def _squashed(form: str) -> str:
    return "".join(form.split()).casefold()


def enum_grounding(value: Column, squashed_text: Column, forms: dict[str, tuple[str, ...]]) -> Column:
    """D3: does any printed form of the value occur; NULL when the value is outside the declared set."""
    pairs = [part for k, v in forms.items() for part in (F.lit(k), F.array(*[F.lit(_squashed(f)) for f in v]))]
    printed = F.try_element_at(F.create_map(*pairs), value)
    hit = F.exists(printed, lambda form: F.contains(squashed_text, form))
    return F.when(printed.isNotNull(), F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0)))


def dates_in_text(text: Column) -> Column:
    """The distinct dates the text may print, ambiguous numeric forms read both ways."""
    month_of = F.create_map(*[F.lit(part) for item in MONTHS.items() for part in item])

    def as_date(y: Column, m: Column, d: Column) -> Column:
        return F.concat(y, F.lit("-"), m, F.lit("-"), d).try_cast("date")

    def both(printed: Column) -> Column:
        part = lambda parts, i: F.get(parts, F.lit(i))
        readings = lambda p: F.array(as_date(part(p, 2), part(p, 0), part(p, 1)), as_date(part(p, 2), part(p, 1), part(p, 0)))
        return bind(F.split(F.replace(F.regexp_replace(printed, "\\s+", ""), F.lit("/"), F.lit(".")), "\\."), readings)

    def named(printed: Column) -> Column:
        month = lambda words: F.try_element_at(month_of, F.lower(F.get(words, F.lit(0)))).cast("string")
        read = lambda words: as_date(F.get(words, F.lit(2)), month(words), F.get(words, F.lit(1)))
        return bind(words_of(F.translate(printed, ".,", "  ")), read)

    found = lambda pattern, group=0: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # a page is searched for a kind of date only where a cheap look finds the part that few pages have
    where = lambda sign, dates: F.when(text.rlike(sign), dates).otherwise(F.array().cast("array<date>"))
    after_name = F.zip_with(found(DAY_OF_MONTH_NAME, 1), found(DAY_OF_MONTH_NAME), lambda name, rest: named(F.concat_ws(" ", name, rest)))
    wide = F.transform(found(MONTH_NAME_DATE), named)
    numeric = F.flatten(F.transform(found(NUMERIC_DATE), both))
    by_name = where(_DAY_YEAR, F.when(text.rlike(f"(?U)\\s{{{_GAP + 1}}}"), wide).otherwise(after_name))
    iso = where("-\\d{2}-\\d{2}", F.transform(found(ISO_DATE), lambda d: d.try_cast("date")))
    return F.array_except(F.concat(numeric, by_name, iso), F.array(F.lit(None).cast("date")))


def _closeness(days: Column) -> Column:
    return F.bround(F.lit(1.0) / (F.lit(1.0) + days), 4)


def corroborate_date(value: Column, dates: Column) -> Column:
    """1 / (1 + days to the nearest printed date); a page without dates has no opinion."""
    nearest = F.array_min(F.transform(dates, lambda d: F.abs(F.datediff(value, d))))
    return F.when(F.size(dates) == 0, F.lit(1.0)).otherwise(F.coalesce(_closeness(nearest), F.lit(0.0)))


def stated_payment_term(text: Column) -> Column:
    """The payment term in days, the German phrase first."""
    hits = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in TERM_PATTERNS]
    return F.coalesce(*hits).cast("int")


def corroborate_payment_term(earlier: Column, later: Column, term: Column) -> Column:
    """Closeness of the extracted interval to the stated term; NULL when no term is stated."""
    return _closeness(F.abs(F.datediff(later, earlier) - term))


def looks_fragmented(value: Column) -> Column:
    """A name that reads as split or truncated character runs."""

    def fragmented(tokens: Column) -> Column:
        n = F.size(tokens)
        chars = F.length(F.array_join(tokens, ""))
        singles = F.size(F.filter(tokens, lambda t: t.rlike("^[\\p{L}\\p{N}]$")))
        stubby = chars / n < MIN_MEAN_TOKEN
        scattered = (n >= SINGLES_MIN_TOKENS) & (singles / n >= SINGLES_SHARE)
        return F.when(n >= 2, stubby | scattered)

    return F.coalesce(bind(words_of(value), fragmented), F.lit(False))


def shape_flags(value: Column) -> tuple[Column, Column]:
    """D9 for text: token count, and whether the value is implausibly short."""
    text = F.coalesce(value, F.lit(""))
    return F.size(words_of(text)), F.length(strip_text(text)) < 2


def nonpositive(value: Column) -> Column:
    """D9 for amounts: missing, zero or negative."""
    return F.coalesce(value <= 0, F.lit(True))


def money_scale(record: Column, definition: Definition) -> Column:
    """The largest absolute money value, 1.0 when there is none."""
    sizes = [F.abs(record[n]).cast("double") for n in definition.money_fields]
    largest = F.greatest(*sizes) if len(sizes) > 1 else reduce(lambda a, _: a, sizes)
    return F.coalesce(largest, F.lit(1.0))


def table_needles(record: Column, definition: Definition, table: str) -> Column:
    columns = definition.text_columns(table)
    rows = F.coalesce(record[table], F.array())
    return F.flatten(F.transform(rows, lambda r: F.array(*[squash(r[c]) for c in columns])))


def with_signals(
    df: DataFrame, definition: Definition, record: str = "record", text: str | None = "text", attempts: str | None = None
) -> DataFrame:
    """Add `rule_*`, `residual_*` and `ev_*` columns: every raw input to scoring.

    Squashed text, printed dates and needles become columns of their own first,
    so that the scorers read them instead of recomputing them per field. A residual
    counts only where its rule failed; it is 0.0, and not worked out, where the rule holds.
    """
    rec = F.col(record)
    out = df.withColumn("attempts", F.col(attempts) if attempts else F.lit(1))
    out = with_prefixed(out, "rule", rules.rule_outcomes(rec, definition))
    missed = {n: F.when(F.col(f"rule_{n}"), F.lit(0.0)).otherwise(c) for n, c in rules.rule_misses(rec, definition).items()}
    out = with_prefixed(out, "residual", missed)
    parts: dict[str, Column] = {"scale": money_scale(rec, definition)}
    for name in definition.text_fields:
        tokens, short = shape_flags(rec[name])
        parts[f"{name}_tokens"], parts[f"{name}_short"] = tokens, short
        parts[f"{name}_fragmented"] = looks_fragmented(rec[name])
    for name in definition.positive_fields:
        parts[f"{name}_nonpositive"] = nonpositive(rec[name])
    for table in definition.table_fields:
        parts[f"{table}_count"] = F.size(F.coalesce(rec[table], F.array()))
    for table, bad in rules.inconsistent_rows(rec, definition).items():
        parts[f"{table}_bad_rows"] = bad
    if text is None:
        return with_prefixed(out, "ev", parts)

    body = F.col(text)
    scalar_needles = F.array(*[squash(F.coalesce(rec[n], F.lit(""))) for n in definition.text_fields])
    out = out.withColumns(
        {
            "_squashed": squash(body),
            "_dates": dates_in_text(body),
            "_term": stated_payment_term(body),
            "_needles": F.concat(
                scalar_needles, *[table_needles(rec, definition, t) for t in definition.table_fields]
            ),
        }
    )
    needles, haystack = F.col("_needles"), F.col("_squashed")
    out = out.withColumn("_missed", missing_needles(needles, haystack))
    out = out.withColumn("_grounded", grounded_scores(needles, F.col("_missed"), haystack))
    at = 1
    for name in definition.text_fields:
        parts[f"{name}_grounded"] = F.try_element_at("_grounded", F.lit(at))
        at += 1
    start = F.lit(at)
    for table in definition.table_fields:
        cells = F.size(F.coalesce(rec[table], F.array())) * len(definition.text_columns(table))
        scores = F.slice("_grounded", start, cells)
        mean = bind(scores, lambda x: F.aggregate(x, F.lit(0.0), lambda a, s: a + s) / F.size(x))
        parts[f"{table}_grounded_min"] = F.coalesce(F.array_min(scores), F.lit(1.0))
        parts[f"{table}_grounded_mean"] = F.when(cells > 0, F.bround(mean, 4)).otherwise(F.lit(1.0))
        start = start + cells
    for name in definition.grounded_enums:
        forms = definition.fields[name].surface_forms
        parts[f"{name}_grounded"] = enum_grounding(rec[name], F.col("_squashed"), forms)
    parts["text_dates_found"] = F.size("_dates")
    for name in definition.date_fields:
        parts[f"{name}_corroborated"] = corroborate_date(rec[name], F.col("_dates"))
    terms = [
        corroborate_payment_term(rec[r.params["earlier"]], rec[r.params["later"]], F.col("_term"))
        for r in definition.date_order_rules
    ]
    worst = F.least(*terms) if len(terms) > 1 else (terms[0] if terms else F.lit(None).cast("double"))
    parts["payment_term"] = worst
    out = with_prefixed(out, "ev", parts)
    return out.drop("_squashed", "_dates", "_term", "_needles", "_missed", "_grounded")
