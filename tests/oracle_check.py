"""Run registered queries next to their SQL twins: `python tests/oracle_check.py [name-prefix ...]`."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _key(value):
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_key(v) for v in value) + "]"
    if isinstance(value, float):
        return repr(value + 0.0)
    return repr(value)


def compare(df, con, sql: str) -> tuple[bool, str]:
    cols = sorted(df.columns)
    start = time.time()
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    spark_s, start = time.time() - start, time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in order) for r in cur.fetchall()]
    g = sorted(tuple(_key(v) for v in r) for r in got)
    w = sorted(tuple(_key(v) for v in r) for r in want)
    if len(g) != len(w):
        return False, f"rows {len(g)} vs {len(w)}"
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(g)} rows differ, e.g.\n   cols   {cols}\n   spark  {bad[0][0]}\n   oracle {bad[0][1]}"
    return True, f"{len(g)} rows, spark {spark_s:.1f}s, sql {time.time() - start:.1f}s"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from docsieve.session import build_session

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                          "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            if name in oracles:
                ok, note = compare(run(spark, sf), con, oracles[name])
            else:
                ok, note = True, f"{run(spark, sf).count()} rows, no oracle"
        except Exception as exc:  # noqa: BLE001 - the report is the point
            ok, note = False, f"{type(exc).__name__}: {" | ".join(str(exc).split(chr(10))[-4:] if "PythonException" in type(exc).__name__ else [str(exc)])[:700]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - start:6.2f}s  {note}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
