"""Compare registered queries with their SQL: python check.py [--sf DIR] [--hot N] [name ...]."""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

from chronoplane.plans import Tables, load, presented
from chronoplane.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def kind(type_name: str) -> str:
    t = type_name.lower()
    if t.startswith(("bigint", "int", "long", "hugeint", "smallint", "tinyint")):
        return "int"
    if t.startswith(("double", "float", "decimal")):
        return "float"
    if t.startswith(("string", "varchar")):
        return "str"
    return "time" if t.startswith(("timestamp", "date")) else t


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}".replace("-0.000000", "0.000000")
    return str(v)


def compare(df, con, sql):
    start = time.time()
    rows = [tuple(x) for x in df.collect()]
    took = time.time() - start
    if sql is None:
        return took, len(rows), "rows only" if rows else "NO ROWS"
    rel = con.sql(sql)
    names = list(rel.columns)
    if sorted(names) != sorted(df.columns):
        return took, len(rows), f"columns {sorted(df.columns)} vs {sorted(names)}"
    kinds_sql = {c: kind(str(t)) for c, t in zip(names, rel.types)}
    kinds_df = {c: kind(t) for c, t in df.dtypes}
    if kinds_sql != kinds_df:
        return took, len(rows), f"types { {c: (kinds_df[c], kinds_sql[c]) for c in names if kinds_df[c] != kinds_sql[c]} }"
    order = sorted(names)
    other = rel.fetchall()
    a = sorted(tuple(norm(x[df.columns.index(c)]) for c in order) for x in rows)
    b = sorted(tuple(norm(x[names.index(c)]) for c in order) for x in other)
    if a == b:
        return took, len(rows), "ok" if rows else "ok (EMPTY)"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return took, len(rows), f"MISMATCH {len(a)} vs {len(b)} rows, {len(bad)} differ, {order}, e.g. {bad[:2]}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--hot", type=int, default=1_000_000)
    args = ap.parse_args()
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    failed = 0
    for name, q in load().items():
        if args.names and name not in args.names:
            continue
        start = time.time()
        try:
            took, n, verdict = compare(presented(q.build(Tables(spark, args.sf, args.hot))), con, q.sql)
        except Exception as e:
            took, n, verdict = time.time() - start, 0, f"ERROR {type(e).__name__}: {str(e)[:600]}"
        failed += not verdict.startswith(("ok", "rows only"))
        print(f"{name:32s} {n:7d} rows {took:6.2f}s  {verdict}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
