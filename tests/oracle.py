"""Run a registered query and its SQL check on the same tables and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = pathlib.Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, decimal.Decimal):
        raise AssertionError(f"decimal value {v}")
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    raise AssertionError(f"unexpected value type {type(v)}")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple((type(plain(r[i])).__name__, plain(r[i])) for i in order) for r in data]


def difference(spark, con, query, sql, sf_dir):
    """None when equal, else a short text on the first differences."""
    df = query(spark, sf_dir)
    mine = df.collect()
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    theirs = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(mine) != len(theirs):
        return f"row count {len(mine)} != {len(theirs)}"
    a = sorted(rows(df.columns, mine), key=repr)
    b = sorted(rows(names, theirs), key=repr)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return None if not bad else f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}"
