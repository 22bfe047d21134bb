"""Where queries are registered, with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .base import Base
from .sql import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None, *parts: str, also: str = ""):
    """Registers a function of Base under its name. also: further common table expressions after the named parts."""

    def add(f: Callable[[Base], DataFrame]) -> Callable[[Base], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Base(spark, sf_dir))
        if oracle is not None:
            SQL[f.__name__] = (f"{sql('', *parts).rstrip()}, {also}\n{oracle}" if parts else f"WITH {also}\n{oracle}") if also else sql(oracle, *parts)
        return f

    return add


def tree_sql(rows: str, by: str = "", levels: int = 4) -> str:
    """SELECT of the digest that search.tree_digest gives for a SELECT of (by, key, h)."""
    group = f"{by}, " if by else ""
    for level in range(levels):
        last = level + 1 == levels
        key, name = ("", "digest") if last else ("key >> 10 AS key, ", "h")
        groups = ("GROUP BY 1" if by else "") if last else f"GROUP BY {'1, 2' if by else '1'}"
        rows = f"SELECT {group}{key}sha256(string_agg(h, '' ORDER BY t.key, h)) AS {name} FROM ({rows}) t {groups}"
    return rows
