"""Runs queries by Spark and their SQL by DuckDB on the same tables and compares the rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "as_tuple"):
        return int(x) if x == int(x) else float(x)
    return x


def differences(df, sql: str, c: duckdb.DuckDBPyConnection) -> str:
    """What differs, or an empty string. Columns are taken in the order of their names."""
    out = c.execute(sql)
    names = [d[0] for d in out.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    theirs = Counter(tuple(plain(r[names.index(n)]) for n in order) for r in out.fetchall())
    ours = Counter(tuple(plain(r[n]) for n in order) for r in df.collect())
    if ours != theirs:
        return f"{sum(ours.values())} rows against {sum(theirs.values())}; only here {list((ours - theirs))[:2]}; only there {list((theirs - ours))[:2]}"
    return ""
