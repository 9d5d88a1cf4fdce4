"""Run a catalogue query and its oracle on the same files and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def _table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: tuple((v is None, v or "") for v in r))


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    columns, rows = _table(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    expected_columns, expected = _table([d[0] for d in result.description], result.fetchall())
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if rows == expected:
        return None
    extra = [r for r in rows if r not in set(expected)][:3]
    absent = [r for r in expected if r not in set(rows)][:3]
    return f"{len(rows)} rows, expected {len(expected)}; only ours {extra}; only theirs {absent}"
