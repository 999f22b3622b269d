"""Compare a registered query with its SQL, as multisets of rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter


def views(d: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(glob.glob(f"{d}/*.parquet")):
        q = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW \"{os.path.basename(p)[:-8]}\" AS SELECT * FROM '{q}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if v.__class__.__name__ == "Decimal":
        return round(float(v), 6)
    return v


def rows(cols, data) -> Counter:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, con, d: str, query, sql: str) -> tuple[bool, str]:
    df = query(spark, d)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} against {sorted(cols)}"
    if got != want:
        return False, f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
    return True, f"{sum(got.values())} rows"
