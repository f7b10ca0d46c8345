"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        return (2, repr(value + 0.0))
    if isinstance(value, datetime.datetime):
        return (3, value.isoformat())
    return (4, str(value))


def _normal(rows):
    return sorted([tuple(_key(value) for value in row) for row in rows])


def differences(frame, connection, sql: str) -> list[str]:
    """What differs between the two results; empty if they are the same."""
    names = sorted(frame.columns)
    result = connection.execute(sql)
    oracle_types = {column[0]: str(column[1]) for column in result.description}
    if names != sorted(oracle_types):
        return [f"columns {names} != {sorted(oracle_types)}"]
    place = {name: i for i, name in enumerate(oracle_types)}
    expected = [[row[place[name]] for name in names] for row in result.fetchall()]
    actual = [[row[name] for name in names] for row in frame.collect()]
    found = []
    kinds = dict(frame.dtypes)
    for name in names:
        if KINDS.get(oracle_types[name], oracle_types[name]) != kinds[name]:
            found.append(f"type of {name}: {kinds[name]} != {oracle_types[name]}")
    if len(actual) != len(expected):
        found.append(f"rows {len(actual)} != {len(expected)}")
    left, right = _normal(actual), _normal(expected)
    if left != right:
        ours, theirs = set(left), set(right)
        extra = [row for row in left if row not in theirs][:2]
        missing = [row for row in right if row not in ours][:2]
        found.append(f"{names}: only spark {extra}, only sql {missing}")
    return found
