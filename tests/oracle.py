"""Runs a query's SQL in DuckDB and compares it with the DataFrame, without regard to order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sql: str, d: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def same(df, sql: str, d: str) -> str | None:
    """None if equal, else what differs."""
    cols, rows = expected(sql, d)
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    order = sorted(cols)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in rows), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    if got == want:
        return None
    a, b = [x for x in got if x not in want[:5000]][:3], [x for x in want if x not in got[:5000]][:3]
    return f"{len(got)} and {len(want)} rows; only here {a}; only in SQL {b}"
