"""Reading, checkpoints and the registry of the queries in this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carrierlab.session import checkpointed, configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under a name, with its check SQL if any."""

    def register(plan):
        QUERIES[name] = lambda spark, folder: plan(configure(spark), folder)
        if sql:
            ORACLES[name] = sql
        return plan

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


__all__ = ["ORACLES", "QUERIES", "checkpointed", "query", "table"]
