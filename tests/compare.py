"""Runs a query and its SQL on the same tables and compares the rows."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def sql_rows(sql: str, sf_dir: str, tables: dict | None = None):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return names, out.fetchall()


def differences(df, sql: str, sf_dir: str) -> str:
    names, want = sql_rows(sql, sf_dir)
    got = df.collect()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    a = Counter(tuple(plain(r.asDict(True)[c]) for c in order) for r in got)
    b = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in want)
    if a == b:
        return ""
    return f"{len(got)} and {len(want)} rows, {order}; only here: {list((a - b).items())[:3]}; only in SQL: {list((b - a).items())[:3]}"
