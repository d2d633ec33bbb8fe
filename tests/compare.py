"""Spark rows against DuckDB rows, order and column order aside."""

import datetime
import decimal
import math
from pathlib import Path

FOLDER = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def connection():
    import duckdb

    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def same(df, con, sql):
    cur = con.execute(sql)
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    want = sorted((tuple(plain(v) for _, v in sorted(zip(cols, r))) for r in cur.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in sorted(cols)) for r in df.collect()), key=key)
    assert got == want
