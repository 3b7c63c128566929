"""Order-insensitive comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}/*.parquet'" if os.path.isdir(p) else f"create view {t} as select * from '{p}'")
    return c


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(columns, data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))


def compare(spark_df, con, sql) -> str:
    """'' if both give the same rows, else what differs."""
    got_cols, got = spark_df.columns, spark_df.collect()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {got_cols} and {want_cols}"
    a, b = rows(got_cols, got), rows(want_cols, want)
    if len(a) != len(b):
        return f"{len(a)} rows, expected {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else ""
