"""Writers. Every result is written by the executors, as part files."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def persist_table(df: DataFrame, path: str, overwrite: bool = True, partition_by=()) -> DataFrame:
    """Write an intermediate as Parquet and return it read back.

    Reading back cuts the lineage, and a lost executor costs one file scan.
    """
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt to ranges of an order and sorted there: written as files, they are in order over all of them."""
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def flat_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON-like text, so that text formats accept them."""
    out = []
    for field in df.schema.fields:
        col: Column = F.col(f"`{field.name}`")
        if field.dataType.typeName() in ("array", "struct", "map"):
            col = F.to_json(col)
        out.append(col.alias(field.name))
    return df.select(*out)


def write_tsv(df: DataFrame, path: str, compression: str | None = None, header: bool = True,
              overwrite: bool = False) -> None:
    """Tab-separated, unquoted, ``NA`` for null."""
    flat_columns(df).write.mode("overwrite" if overwrite else "errorifexists").options(
        sep="\t", header=str(header).lower(), nullValue="NA", emptyValue="", quote="",
        compression=compression or "none",
    ).csv(path)


def run_directory(prefix: str, now: datetime | None = None) -> str:
    """``prefix`` with the run's UTC time, one folder per run."""
    return prefix + (now or datetime.now(timezone.utc)).strftime("%Y-%m-%d_%H.%M.%S")


def write_csv_run(df: DataFrame, prefix: str, now: datetime | None = None) -> str:
    """Quoted CSV with a byte-order mark before each header, in a run folder."""
    path = run_directory(prefix, now)
    flat = flat_columns(df)
    first = flat.columns[0]
    flat.withColumnRenamed(first, "﻿" + first).write.mode("errorifexists").options(
        header="true", nullValue="NA", emptyValue="").csv(path)
    return path
