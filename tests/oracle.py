"""Runs a query and its SQL on the same tables and tells what differs."""

import math
from decimal import Decimal

import duckdb


def views(folder):
    import pathlib

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in pathlib.Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def differs(spark, con, folder, query, sql):
    df = query(spark, folder)
    got = table(df.columns, df.collect())
    cur = con.execute(sql)
    want = table([c[0] for c in cur.description], cur.fetchall())
    if got == want:
        return None, len(want[1])
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}", 0
    a, b = [x for x in got[1] if x not in set(want[1])], [x for x in want[1] if x not in set(got[1])]
    return f"{len(got[1])} rows and {len(want[1])}; only here {a[:3]}; only in SQL {b[:3]}", 0
