"""Runs a query and its SQL side by side and reports the first difference."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _key(row):
    return tuple((v is None, "" if v is None else (f"{v:.6f}" if isinstance(v, float) else str(v))) for v in row)


def rows_of(frame, columns):
    return sorted((tuple(_plain(r[c]) for c in columns) for r in frame), key=_key)


def difference(spark_df, con, sql) -> str | None:
    """None when both give the same columns, types family and rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    theirs = [dict(zip(names, r)) for r in result.fetchall()]
    columns = sorted(spark_df.columns)
    if columns != sorted(names):
        return f"columns {columns} != {sorted(names)}"
    mine = [r.asDict() for r in spark_df.collect()]
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    for a, b in zip(rows_of(mine, columns), rows_of(theirs, columns)):
        for c, x, y in zip(columns, a, b):
            if type(x) is not type(y):
                return f"{c}: {x!r} != {y!r} ({kinds[c]}) in {a} / {b}"
            same = math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) else x == y
            if not same:
                return f"{c}: {x!r} != {y!r} in {a} / {b}"
    return None
