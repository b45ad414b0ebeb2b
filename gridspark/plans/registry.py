"""Registered queries: every operator on tables derived from the driver tables, with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.plans.adapters import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **views: str) -> Callable[[Query], Query]:
    """Register a query under its operator's name; ``views`` are helper tables of its SQL."""
    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql, **views)
        return fn
    return wrap


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round result columns; a negative zero becomes zero."""
    return df.withColumns({c: _plain(F.round(c, digits)) for c in columns})


def _plain(x: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def r(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"(case when round({expr}, {digits}) = 0 then cast(0 as double) else round({expr}, {digits}) end)"
