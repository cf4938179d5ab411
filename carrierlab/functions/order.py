"""Positions and running sums in an order, for groups of any size.

No task holds a whole group: rows are dealt to ranges of the order and sorted
there, and the position of a row (or another running sum) is the one in its range
plus the sums of the group's earlier ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carrierlab.session import checkpointed

PART_BITS = 33  # of monotonically_increasing_id: the place in the partition
ROWS_A_RANGE = 1 << 20


def in_ranges(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Rows in order of groups and ``order``, with ``_place`` in it and the number ``_part`` of their range.

    The number of ranges comes from the number of rows. The sorted rows are
    written to the checkpoint folder once.
    """
    keys = [*[F.col(f"`{g}`") for g in groups], *order]
    n = 1 + df.count() // ROWS_A_RANGE
    return checkpointed(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)).withColumn(
        "_place", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_place", PART_BITS))


def running(placed: DataFrame, groups: Sequence[str], sums: Mapping[str, Column], totals: Mapping[str, str] | None = None
            ) -> DataFrame:
    """Adds sums up to and with each row of :func:`in_ranges`, inside its group; ``totals`` names the groups' whole sums.

    A range is summed by itself; the sums of a group's ranges, a row for each
    range it touches, are added up and given back.
    """
    groups, totals = list(groups), dict(totals or {})
    placed = placed.withColumns({f"_v_{k}": v for k, v in sums.items()})
    runs = placed.groupBy(*[F.col(f"`{g}`") for g in groups], "_part").agg(
        *[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    whole = Window.partitionBy(*[F.col(f"`{g}`") for g in groups])
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.struct(F.col("_part").alias("p"), *[F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(groups)]).alias("_run"),
        *[F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums],
        *[F.sum(f"_s_{k}").over(whole).alias(f"_t_{k}") for k in totals])
    inside = Window.partitionBy("_part", *[F.col(f"`{g}`") for g in groups]).orderBy("_place").rowsBetween(
        Window.unboundedPreceding, 0)
    own = F.struct(F.col("_part").alias("p"), *[F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(groups)])
    out = placed.withColumns({f"_i_{k}": F.sum(f"_v_{k}").over(inside) for k in sums})
    out = out.join(runs, own.eqNullSafe(runs["_run"])).withColumns(
        {k: F.col(f"_i_{k}") + F.col(f"_b_{k}") for k in sums} | {name: F.col(f"_t_{k}") for k, name in totals.items()})
    return out.drop("_run", *[f"_{x}_{k}" for x in "vibt" for k in sums])


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Adds ``name``: 1, 2, ... inside each group by ``order``; null groups are groups.

    ``order`` should name rows apart; rows it leaves tied come in any order.
    """
    return running(in_ranges(df, group, order), group, {name: F.lit(1)}).select(
        *[F.col(f"`{c}`") for c in df.columns], name)


def numbered_lines(spark, path, first: int = 1) -> DataFrame:
    """(file, line, value): the lines of text part files with their number over all files, in order of name."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_place"))
    runs = lines.groupBy("file", "_start").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_size"))
    # One row for each piece of a file that a task reads.
    earlier = Window.orderBy("file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    shift = runs.select("file", "_start", (
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first") + first).alias("_shift"))
    return lines.join(shift, ["file", "_start"]).select("file", (F.col("_place") + F.col("_shift")).alias("line"), "value")
