"""Registry of the named queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierlab.plans.oracle_tables import sql as with_tables
from carrierlab.session import configure

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function name, with its check SQL if any."""

    def register(plan: Plan) -> Plan:
        def configured(spark: SparkSession, folder: str) -> DataFrame:
            return plan(configure(spark), folder)

        QUERIES[plan.__name__] = Query(plan.__name__, configured, with_tables(sql) if sql else None)
        return plan

    return register


def rounded(col: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Rounded double: sums differ in their last bits with the order of rows."""
    expr = F.col(col) if isinstance(col, str) else col
    return F.round(expr.cast("double"), digits).alias(name or (col if isinstance(col, str) else "value"))
