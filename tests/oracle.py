"""Compares queries with their SQL: `python -m tests.oracle SF [NAME...]`."""

from __future__ import annotations

import glob
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path("/root/testdata")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {Path(p).stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, bytearray):
        return bytes(v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differs(spark, name, query, sql, folder) -> str | None:
    df = query(spark, folder)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(folder).execute(sql)
    cols = [x[0] for x in cur.description]
    theirs = rows(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return f"{len(mine)} and {len(theirs)} rows; only here {list(a - b)[:2]}, only there {list(b - a)[:2]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from quarryset.runtime import session

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    folder = str(ROOT / sys.argv[1])
    q, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or q:
        t = time.time()
        try:
            why = differs(spark, name, q[name], sql[name], folder) if name in sql else f"rows only: {q[name](spark, folder).count()}"
        except Exception as e:
            why = f"{type(e).__name__}: {str(e)[:300]}"
        if why:
            bad += not why.startswith("rows only")
            print(f"{name}: {why} ({time.time() - t:.1f} s)", flush=True)
    print(f"{len(sys.argv[2:] or q)} queries, {bad} differ")
