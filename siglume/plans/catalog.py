"""Registers queries and their DuckDB SQL under one name."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return add


def rounded(df, *skip: str, places: int = 6):
    """Doubles rounded, so that the order of additions can't show."""
    from pyspark.sql import functions as F

    return df.select(*[F.round(c, places).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])
