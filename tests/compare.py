"""Compare a Spark query with its SQL on one scale folder."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")[:26] if hasattr(v, "hour") else v.isoformat()
    return str(v)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=lambda t: tuple((x is None, x or "") for x in t))


def difference(columns: list[str], data, con, sql: str) -> str | None:
    """None when both agree, else what differs."""
    cur = con.execute(sql)
    sql_cols = [d[0] for d in cur.description]
    want = rows(sql_cols, cur.fetchall())
    got = rows(columns, data)
    if sorted(sql_cols) != sorted(columns):
        return f"columns {sorted(columns)} != {sorted(sql_cols)}"
    if len(got) != len(want):
        a, b = set(got), set(want)
        return f"rows {len(got)} != {len(want)}; only spark {list(a - b)[:2]}; only sql {list(b - a)[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}"
    return None
