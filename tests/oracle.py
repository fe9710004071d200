"""Compare a registered query with its plain SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if hasattr(value, "__float__") and not isinstance(value, (int, bool)):
        return float(value)
    return value


def _sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both give the same columns and rows, else the first difference."""
    found = con.execute(sql)
    expected_columns = [c[0] for c in found.description]
    expected = _sorted_rows(expected_columns, found.fetchall())
    actual = _sorted_rows(df.columns, df.collect())
    if sorted(expected_columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(expected_columns)}"
    if len(expected) != len(actual):
        return f"{len(actual)} rows, expected {len(expected)}"
    for got, want in zip(actual, expected):
        if got != want:
            return f"row {got} != {want} of columns {sorted(df.columns)}"
    return None
