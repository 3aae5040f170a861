"""Comparison of a query with its SQL in DuckDB over the same folder."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pandas as pd


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        t = pd.Timestamp(v)
        return str(t if t.tzinfo is None else t.tz_convert(None))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, folder, query, sql):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = query(spark, str(folder))
    rel = con.sql(sql)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())
