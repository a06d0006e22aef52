"""Runs a query's SQL on DuckDB and compares it with Spark's rows, whatever their order."""

from __future__ import annotations

import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.isoformat() if hasattr(value, "isoformat") else value


def compare(query, sql: str, spark, sf_dir: str, con: duckdb.DuckDBPyConnection) -> int:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    assert len(set(names)) == len(names)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    rows = con.sql(sql)
    assert sorted(rows.columns) == names
    at = [rows.columns.index(c) for c in names]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in rows.fetchall()), key=repr)
    assert got == expected
    return len(got)
