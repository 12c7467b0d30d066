"""Rows of Spark and of DuckDB as comparable values."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    return v


def rows(names: list[str], records) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in records), key=repr)


def same(df, con, sql: str) -> None:
    got = rows(df.columns, df.collect())
    result = con.sql(sql)
    assert sorted(df.columns) == sorted(result.columns)
    assert got == rows(result.columns, result.fetchall())
