"""Query registry: name -> (plan, check SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Query(NamedTuple):
    plan: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``plan(spark, sf_dir)`` under ``name`` with its check SQL."""

    def register(plan):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(plan, sql)
        return plan

    return register


def r6(c: Column | str) -> Column:
    """Six decimals, so both engines agree whatever their summation order."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})
