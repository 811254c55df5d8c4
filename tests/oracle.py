"""Compare a query with its SQL: column names, row counts, and values regardless of order."""

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 6) + 0.0
    return v


def rows(names, data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def difference(con, df, sql: str) -> str:
    """What differs; empty if nothing does."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, have = rows(names, got.fetchall()), rows(df.columns, df.collect())
    if len(want) != len(have):
        return f"{len(have)} rows, SQL has {len(want)}"
    wrong = [(a, b) for a, b in zip(have, want) if repr(a) != repr(b)]
    return f"{len(wrong)} of {len(have)} rows, such as {wrong[:3]}" if wrong else ""
