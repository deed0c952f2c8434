"""Side-by-side run of queries and their SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, list):
        return tuple(map(_value, x))
    if hasattr(x, "asDict"):
        return tuple(map(_value, x))
    return x


def as_bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> tuple[int, list, list]:
    """Rows of the query, and some rows only it or only the SQL has."""
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    theirs = as_bag(names, cursor.fetchall())
    ours = as_bag(df.columns, df.collect())
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    return sum(ours.values()), list((ours - theirs).items())[:5], list((theirs - ours).items())[:5]
