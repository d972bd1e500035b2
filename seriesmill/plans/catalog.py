"""Registry of the runnable queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(c: Column | str) -> Column:
    """Six decimals by the same arithmetic as ``r6_sql``, so both engines agree."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def r6_sql(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5::double) / 1e6"


def stamp(c: Column | str) -> Column:
    """Timestamps leave as text: engines differ in their time-zone types."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def stamp_sql(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def load_all() -> None:
    from seriesmill.plans import (  # noqa: F401
        queries_dataset,
        queries_evaluation,
        queries_history,
        queries_ingest,
        queries_models,
        queries_names,
        queries_reconcile,
        queries_series,
    )
