"""Spark's rows of a query beside DuckDB's rows of its SQL, as sorted lists of comparable values."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A connection with the tables of a folder as views."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path / '*.parquet' if path.is_dir() else path}'")
    return con


def value(x):
    """Equal for values that both engines mean alike."""
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5)
    return x


def rows(columns: list[str], found) -> list[tuple[str, ...]]:
    """Rows with columns by name, sorted."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(value(row[i])) for i in order) for row in found)


def both(spark, con, query, sql: str, sf_dir: str):
    """(columns, rows) of Spark and of DuckDB."""
    df = query(spark, sf_dir)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return (sorted(df.columns), rows(df.columns, df.collect())), (sorted(names), rows(names, got.fetchall()))
