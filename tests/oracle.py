"""Runs registered queries next to the SQL that states their result and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = pathlib.Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else float(f"{value:.12g}")
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r)
    )


def compare(df, con, sql: str) -> str | None:
    """None when both agree, else what differs."""
    spark_rows = df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got, want = rows_of(df.columns, spark_rows), rows_of(names, cursor.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(got, want):
        if g != w or [type(a) for a in g] != [type(b) for b in w]:
            return f"{dict(zip(sorted(names), g))} != {dict(zip(sorted(names), w))}"
    return None
