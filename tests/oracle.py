"""Compare registered queries with their SQL: ``python -m tests.oracle [sf_dir] [name ..]``."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    took = time.time() - t0
    if sql is None:
        return len(rows) > 0, f"rows={len(rows)} {took:.1f}s (no SQL)"
    cur = con.execute(sql)
    desc = cur.description
    theirs = cur.fetchall()
    cols = sorted(df.columns)
    their_names = [d[0] for d in desc]
    if cols != sorted(their_names):
        return False, f"columns {cols} != {sorted(their_names)}"
    for d in desc:
        mine = dict(df.dtypes)[d[0]]
        if TYPES.get(mine, mine) != str(d[1]):
            return False, f"type of {d[0]}: {mine} != {d[1]}"
    at = {n: i for i, n in enumerate(their_names)}
    a = Counter(tuple(_norm(r[c]) for c in cols) for r in rows)
    b = Counter(tuple(_norm(r[at[c]]) for c in cols) for r in theirs)
    if a != b:
        extra, lack = list((a - b).items())[:3], list((b - a).items())[:3]
        return False, f"rows {len(rows)} vs {len(theirs)}; columns {cols}\n   ours only {extra}\n   SQL only  {lack}"
    return len(rows) > 0, f"rows={len(rows)} {took:.1f}s"


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from opsmetrics.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    names = argv[1:] or list(entry.queries())
    sqls = entry.oracle_sql()
    for name in names:
        try:
            ok, text = compare(spark, con, name, entry.queries()[name], sqls.get(name), sf_dir)
        except Exception as problem:
            ok, text = False, f"{type(problem).__name__}: {str(problem)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, text, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
