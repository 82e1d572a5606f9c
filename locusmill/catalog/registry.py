"""The registry and small helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with SQL giving the same rows when there is one."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def rnd(x: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero, for value comparison."""
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def lcg_offset(k: Column, size: Column | int, *key: Column) -> Column:
    """Reproducible shift offset: a linear form of the shift number and of what names the moving set, modulo the space."""
    total = k.cast("long") * 7368787 + 104729
    for i, c in enumerate(key):
        text = c.cast("string")
        total = total + (F.ascii(F.right(text, F.lit(1))) * 7919 + F.length(text) * 613) * (2 * i + 1)
    return total % (F.lit(size) if isinstance(size, int) else size)


def lcg_sql(k: str, size: str, *key: str) -> str:
    """``lcg_offset`` in SQL."""
    terms = [
        f"(ascii(right(cast({c} as varchar), 1)) * 7919 + length(cast({c} as varchar)) * 613) * {2 * i + 1}"
        for i, c in enumerate(key)
    ]
    return f"(({' + '.join([f'{k} * 7368787', '104729', *terms])}) % {size})"
