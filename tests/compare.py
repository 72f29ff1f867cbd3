"""Comparison of a Spark result with the same query in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        if pathlib.Path(f"{sf_dir}/{name}.parquet").exists():
            connection.execute(
                f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def rows_of_spark(df):
    names = sorted(df.columns)
    rows = [tuple(_plain(row[name]) for name in names) for row in df.collect()]
    return names, sorted(rows, key=repr)


def rows_of_sql(connection, sql):
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    names = sorted(columns)
    order = [columns.index(name) for name in names]
    rows = [tuple(_plain(row[i]) for i in order) for row in cursor.fetchall()]
    return names, sorted(rows, key=repr)


def difference(df, connection, sql) -> str | None:
    """None if both results hold the same columns and rows, else a short description."""
    names, left = rows_of_spark(df)
    other_names, right = rows_of_sql(connection, sql)
    if names != other_names:
        return f"columns differ: {names} / {other_names}"
    if len(left) != len(right):
        return f"row counts differ: {len(left)} / {len(right)}\n{left[:3]}\n{right[:3]}"
    for a, b in zip(left, right):
        if a != b:
            return f"rows differ:\n{a}\n{b}"
    return None
