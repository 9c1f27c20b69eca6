"""Operator 4: url filters by rules, then by a cascade of Bloom filters over listed keys.

A url is taken apart into host and path. The longest fitting rule decides; all other urls
are blocked if their key (host and path) is listed.

Listed keys are held in a cascade: the first filter encodes the listed keys, the second
the corpus keys that the first one takes in by mistake, the third the listed
keys that the second one takes in, and so on until no mistake is left. Over the corpus's
complete key universe membership is exact, and no page is joined with the list. The first
filter is sized so that its mistakes are about as many as the listed keys.

The cascade is built by Spark: keys become bit positions in the tasks, words of bits are
combined by a grouped bitwise or. It is sent to the tasks only up to
`max_bytes`; a longer list is applied by a left join on the key instead,
with the same result.

Edge cases: a null url, or one without `://`, has empty host and path, fits no rule and is never
listed; repeated urls get equal verdicts; an empty list allows all; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import bloom
from docsieve.llm.registry import table
from docsieve.session import cut

#: verdict, host, start of the path
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Mistakes of every filter but the first.
LATER_RATE = 1 / 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule_host, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(start)
        name, verdict = F.when(fits, rule_host + start).otherwise(name), F.when(fits, action).otherwise(verdict)
    return name, verdict


def key_hashes(host: Column, path: Column) -> list[Column]:
    return [F.xxhash64(host, path).alias("h1"), F.xxhash64(F.lit("second"), path, host).alias("h2")]


def build_cascade(universe: DataFrame, max_bytes: int) -> list[bloom.Filter] | None:
    """The filters over distinct keys (h1, h2, listed); none if nothing is listed, null if they are larger than `max_bytes`."""
    sides = [cut(universe.where(flag).select("h1", "h2")) for flag in (F.col("listed"), ~F.col("listed"))]
    counts = [side.count() for side in sides]
    levels: list[bloom.Filter] = []
    if not counts[0]:
        return levels
    rate = min(0.5, math.sqrt(0.5) * counts[0] / max(1, counts[1]))
    used = 0
    while True:
        own, other = len(levels) % 2, 1 - len(levels) % 2
        size, hashes = bloom.bits_for(counts[own], rate)
        used += size // 8
        if used > max_bytes:
            return None
        levels.append(bloom.build(sides[own], len(levels), size, hashes))
        sides[other] = cut(sides[other].mapInArrow(bloom.keeper(levels[-1]), "h1 long, h2 long"))
        counts[other] = sides[other].count()
        if not counts[other]:
            return levels
        rate = LATER_RATE


def is_listed(levels: list[bloom.Filter], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Membership of keys of the universe: the first filter that refuses a key tells its side."""
    out = np.full(len(h1), len(levels) % 2 == 1)
    open_rows = np.arange(len(h1))
    for level in levels:
        hit = level.hit(h1[open_rows], h2[open_rows])
        out[open_rows[~hit]] = level.number % 2 == 1
        open_rows = open_rows[hit]
    return out


def marker(levels: list[bloom.Filter]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n not in ("h1", "h2")]
            marks = pa.array(is_listed(levels, *bloom.columns(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [marks], [*names, "listed"])

    return run


def judge(pages: DataFrame, listed: Column, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] | None = None, max_bytes: int = bloom.MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict of each page; `listed` marks the pages whose keys make up the list."""
    kind = pages.schema[key].dataType.simpleString()
    host, path = host_and_path(F.col(url))
    taken = cut(pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(listed, F.lit(False)).alias("listed")))
    keyed = taken.select("page_id", "host", "path", *key_hashes(F.col("host"), F.col("path")))
    universe = cut(taken.select(*key_hashes(F.col("host"), F.col("path")), (F.col("listed") & (F.col("host") != "")).alias("listed")).groupBy("h1", "h2").agg(F.bool_or("listed").alias("listed")))
    levels = build_cascade(universe, max_bytes)
    if levels is None:
        marked = keyed.join(universe.where("listed"), ["h1", "h2"], "left").select("page_id", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed"))
    else:
        marked = keyed.mapInArrow(marker(levels), f"page_id {kind}, host string, path string, listed boolean")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), RULES if rules is None else rules)
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def junk(html: str = "html") -> Column:
    """Markup of which a twentieth is signs of no meaning."""
    return 20 * (F.length(html) - F.length(F.translate(F.col(html), "#*$%|", ""))) > F.length(html)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; listed are the keys of pages with junk markup."""
    return judge(table(spark, sf_dir, "pages"), junk())


QUERIES = {"op4_url_filters": op4_url_filters}
ORACLES = {"op4_url_filters": """
WITH cut AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, coalesce(20 * (length(html) - length(translate(html, '#*$%|', ''))) > length(html), false) AS junk,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), rules(action, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fitting AS (
  SELECT host, path, max_by(h || p, length(h || p)) AS rule, max_by(action, length(h || p)) AS action
  FROM (SELECT DISTINCT host, path FROM parts), rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path
), listed AS (SELECT DISTINCT host, path, true AS l FROM parts WHERE junk AND host <> '')
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN l THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fitting USING (host, path) LEFT JOIN listed USING (host, path)
"""}
