"""Run a query and its SQL on the same files and compare all rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(frame, connection, sql: str | None) -> tuple[int, str | None]:
    """Number of rows found, and what differs from the SQL result, if anything."""
    got = sorted_rows(frame.columns, frame.collect())
    if sql is None:
        return len(got), None
    result = connection.execute(sql)
    columns = [column[0] for column in result.description]
    if sorted(columns) != sorted(frame.columns):
        return len(got), f"columns {sorted(frame.columns)} != {sorted(columns)}"
    want = sorted_rows(columns, result.fetchall())
    if got == want:
        return len(got), None
    pairs = [(a, b) for a, b in zip(got, want) if a != b][:2]
    return len(got), f"{len(got)} vs {len(want)} rows of {sorted(columns)}; first {pairs}"
