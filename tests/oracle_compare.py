"""Run registered queries and compare them with their SQL in DuckDB.

    python tests/oracle_compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT:
            return "NULL"
        if isinstance(v, float):
            return "NULL" if v != v else repr(v)
        if hasattr(v, "item"):
            return cell(v.item())
        if isinstance(v, int) and not isinstance(v, bool):
            return repr(v)
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: df[c].dtype.kind for c in sorted(df.columns)}


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    got = fn(spark, sf_dir).toPandas()
    took = time.time() - start
    if sql is None:
        return None, f"rows={len(got)} (no sql)", took
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}", took
    a, b = canonical(got), canonical(want)
    if a != b:
        sa, sb = set(a), set(b)
        return False, f"rows {len(a)} vs {len(b)}; spark-only {sorted(sa - sb)[:3]}; sql-only {sorted(sb - sa)[:3]}", took
    if len(got) and kinds(got) != kinds(want):
        return False, f"types {kinds(got)} vs {kinds(want)}", took
    return True, f"rows={len(a)}", took


def main() -> int:
    from lintlake.plans import catalogue
    from lintlake.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = catalogue()
    bad = empty = 0
    for name, fn in queries.items():
        if args and not any(name.startswith(p) for p in args):
            continue
        try:
            ok, note, took = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as exc:  # report and go on with the next query
            ok, note, took = False, f"{type(exc).__name__}: {str(exc)[:600]}", 0.0
        bad += ok is False
        empty += note.startswith("rows=0")
        mark = {True: "ok  ", False: "FAIL", None: "    "}[ok]
        print(f"{mark} {took:6.2f}s {name}: {note}", flush=True)
    print(f"failed={bad} empty={empty}")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
