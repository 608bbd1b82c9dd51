"""Side-by-side run of the queries and their SQL counterparts."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def cell(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.date().isoformat() if value.time() == datetime.time() else value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value if value is None else str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(body, key=repr)


def differences(spark, con, build, sql, sf_dir):
    """Empty when both sides give the same columns and rows."""
    df = build(spark, sf_dir)
    left = table_of(df.columns, [tuple(r) for r in df.collect()])
    answer = con.execute(sql)
    right = table_of([d[0] for d in answer.description], answer.fetchall())
    if left[0] != right[0]:
        return [f"columns {left[0]} against {right[0]}"], len(left[1])
    if len(left[1]) != len(right[1]):
        return [f"{len(left[1])} rows against {len(right[1])}"], len(left[1])
    return [
        f"{a} against {b}" for a, b in zip(left[1], right[1], strict=True) if a != b
    ], len(left[1])
