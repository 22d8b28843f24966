"""Compares a Spark result with DuckDB's, whatever the order of rows."""

from __future__ import annotations

import math
import os

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 6)
    return v if isinstance(v, (bool, int, str)) else str(v)


def rows_of(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr)


def same_as_sql(spark, folder: str, query, sql: str) -> None:
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    got, wanted = query(spark, folder).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows_of(got) == rows_of(wanted)
