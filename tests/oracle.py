"""Registered queries against their SQL in DuckDB."""

import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return x


def in_duckdb(sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def same(df, sql, folder):
    """Asserts that the rows are equal, in any order, and the columns' names."""
    names, rows = in_duckdb(sql, folder)
    assert sorted(df.columns) == sorted(names)
    want = Counter(tuple(_plain(x) for x in r) for r in rows)
    got = Counter(tuple(_plain(x) for x in r) for r in df.select(*names).collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return len(rows)
