"""Runs a query in Spark and its SQL in DuckDB over the same Parquet tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


def difference(df, sf_dir: str, sql: str) -> str:
    """Empty if rows and column names agree; else what differs."""
    names, want = sql_rows(sf_dir, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    order = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    exp = Counter(tuple(_plain(r[i]) for i in at) for r in want)
    if got != exp:
        return f"{sum(got.values())} and {sum(exp.values())} rows; only in Spark {list((got - exp).items())[:3]}; only in SQL {list((exp - got).items())[:3]}"
    return ""
