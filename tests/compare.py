"""Compare a Spark result with the SQL result as multisets of rows, columns sorted by name."""

from __future__ import annotations

import datetime
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return int(value) if value.is_integer() else round(value, 9)
    if isinstance(value, bool):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def multiset(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark_frame, connection, sql: str) -> str:
    """Empty when both agree."""
    ours = multiset(spark_frame.columns, [tuple(r) for r in spark_frame.collect()])
    cursor = connection.execute(sql)
    theirs = multiset([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns differ: {ours[0]} / {theirs[0]}"
    if ours[1] == theirs[1]:
        return ""
    left, right = ours[1] - theirs[1], theirs[1] - ours[1]
    return (
        f"{sum(left.values())} rows only in Spark, {sum(right.values())} only in SQL; "
        f"{ours[0]}\n  spark {list(left)[:3]}\n  sql   {list(right)[:3]}"
    )
