"""Compares registered queries with their DuckDB statements."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) and glob.glob(f"{path}/*.parquet") else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def differences(df, con, sql: str) -> str:
    """Empty if both give the same columns and the same rows."""
    names = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    order = [x[0] for x in cur.description]
    if sorted(order) != names:
        return f"columns {names} and {sorted(order)}"
    at = [order.index(c) for c in names]
    other = sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if mine == other:
        return ""
    odd = [x for x in zip(mine, other) if x[0] != x[1]][:2]
    return f"{len(mine)} and {len(other)} rows; {odd}"
