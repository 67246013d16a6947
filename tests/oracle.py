"""Compares registered queries with their SQL, as sorted rows by column name."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else int(x) if x == int(x) else round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def differences(df, con, sql: str) -> str:
    """What differs between a DataFrame and a query; empty if nothing does."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    theirs = rows_of([d[0] for d in got.description], got.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = ({repr(r) for r in x} for x in (mine[1], theirs[1]))
        return f"{len(mine[1])} and {len(theirs[1])} rows; only here {sorted(a - b)[:2]}; only in SQL {sorted(b - a)[:2]}"
    return ""
