"""Compares a Spark query with its SQL on DuckDB, order-insensitively."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connection(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(directory).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int,)):
        return float(value) if abs(value) < 2**53 else value
    if isinstance(value, float):
        return f"nan {id(object())}" if math.isnan(value) else float(f"{value:.12g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, canonical(v)) for k, v in value.items()))
    if type(value).__name__ == "Decimal":
        return canonical(float(value))
    if hasattr(value, "asDict"):
        return canonical(value.asDict())
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr(tuple(canonical(r[i]) for i in order)) for r in rows))


def compare(df, con, sql: str) -> tuple[list[str], int]:
    """Differences (empty if equal) and the number of Spark rows."""
    rel = con.sql(sql)
    want_cols, want = list(rel.columns), rel.fetchall()
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    if sorted(want_cols) != sorted(got_cols):
        return [f"columns {sorted(got_cols)} against {sorted(want_cols)}"], len(got)
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if a == b:
        return [], len(a)
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return [f"{len(a)} rows against {len(b)}", *[f"spark {x}" for x in only_a], *[f"duckdb {x}" for x in only_b]], len(a)
