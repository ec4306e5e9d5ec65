"""Running a query and its SQL over the same tables, and comparing the rows."""

from __future__ import annotations

import math
import os

import duckdb

from frameloom.sources.mapped import GIVEN

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else float(f"{float(v):.9g}")
    return str(v)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(spark, query, sql: str, sf: str = SF) -> None:
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connection(sf).execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = rows_of(names, cur.fetchall())
    assert len(got) == len(want)
    assert got == want
