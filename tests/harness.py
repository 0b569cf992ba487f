"""Runs a registered query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = os.path.join(folder, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None:
        return None
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, int):
        return value
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    cells = [tuple(plain(r[i]) for i in order) for r in rows]
    return names, sorted(cells, key=repr)


def compare(spark, name, build, sql, folder):
    """Returns (row count, problem or None)."""
    df = build(spark, folder)
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(mine[1]), None
    con = duck(folder)
    cursor = con.execute(sql)
    theirs = table([d[0] for d in cursor.description], cursor.fetchall())
    con.close()
    if mine[0] != theirs[0]:
        return len(mine[1]), f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return len(mine[1]), f"rows {len(mine[1])} != {len(theirs[1])}"
    wrong = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    if wrong:
        return len(mine[1]), f"{len(wrong)} rows differ, first:\n  {wrong[0][0]}\n  {wrong[0][1]}"
    return len(mine[1]), None
