"""Compare a registered Spark query with its DuckDB oracle (order-insensitive)."""

from __future__ import annotations

import math

import duckdb

from trickle.sources.tables import TABLES, table_path


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 4) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=repr)


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    """(ok, message): column names, row count and values must agree."""
    s_cols = sorted(spark_df.columns)
    s_rows = [r.asDict() for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = sorted(rel.columns)
    if s_cols != d_cols:
        return False, f"columns differ: spark={s_cols} duckdb={d_cols}"
    d_rows = [dict(zip(rel.columns, t)) for t in rel.fetchall()]
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duckdb={len(d_rows)}"
    a, b = rows_of(s_rows, s_cols), rows_of(d_rows, d_cols)
    for x, y in zip(a, b):
        if x != y:
            return False, f"first differing row: spark={x} duckdb={y}"
    return True, f"{len(s_rows)} rows"
