"""Range joins: positions against intervals.

An interval is listed under every fixed-size bin it touches, so a range join
becomes an equality join on (contig, bin) with the exact bounds as a residual
condition. The number of rows added depends on interval length only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN_SIZE = 1_000_000


def binned_intervals(
    intervals: DataFrame, contig: str, start: str, end: str, bin_size: float = BIN_SIZE
) -> DataFrame:
    """Intervals (start-inclusive, end-exclusive) with one row per touched bin."""
    first = F.floor(F.col(start) / bin_size)
    last = F.floor(F.col(end) / bin_size)
    return intervals.where(F.col(start) < F.col(end)).withColumn(
        "_bin", F.explode(F.sequence(first, last))
    ).withColumn("_bin_contig", F.col(contig))


def _bin_of(pos: str, bin_size: float) -> Column:
    return F.floor(F.col(pos) / bin_size)


def within_any_interval(
    df: DataFrame, intervals: DataFrame, contig: str = "contig", pos: str = "pos",
    start: str = "start", end: str = "end", interval_contig: str = "contig",
    bin_size: float = BIN_SIZE,
) -> DataFrame:
    """Rows whose position lies in at least one interval (range semi-join)."""
    cover = binned_intervals(
        intervals.select(F.col(interval_contig).alias("_c"),
                         F.col(start).alias("_start"), F.col(end).alias("_end")).distinct(),
        "_c", "_start", "_end", bin_size,
    ).select("_bin_contig", "_bin", "_start", "_end")
    keyed = df.withColumn("_pos_bin", _bin_of(pos, bin_size))
    hit = (
        (keyed[contig] == F.col("_bin_contig"))
        & (keyed["_pos_bin"] == F.col("_bin"))
        & (keyed[pos] >= F.col("_start"))
        & (keyed[pos] < F.col("_end"))
    )
    return keyed.join(cover, hit, "left_semi").drop("_pos_bin")


def remap_blocks(
    df: DataFrame, blocks: DataFrame, contig: str = "contig", pos: str = "pos",
    bin_size: float = BIN_SIZE,
) -> DataFrame:
    """Convert positions through an alignment-block table.

    Blocks have ``src_contig, src_start, src_end, dst_contig, dst_start,
    strand`` (source bounds start-inclusive, end-exclusive) and do not overlap
    on the source side. Adds ``new_contig``, ``new_pos`` and
    ``is_negative_strand``; all null where no block covers the position.
    """
    cover = binned_intervals(blocks, "src_contig", "src_start", "src_end", bin_size)
    keyed = df.withColumn("_pos_bin", _bin_of(pos, bin_size))
    hit = (
        (keyed[contig] == F.col("src_contig"))
        & (keyed["_pos_bin"] == F.col("_bin"))
        & (keyed[pos] >= F.col("src_start"))
        & (keyed[pos] < F.col("src_end"))
    )
    forward = F.col("dst_start") + (F.col(pos) - F.col("src_start"))
    backward = F.col("dst_start") + (F.col("src_end") - 1 - F.col(pos))
    return keyed.join(cover, hit, "left").select(
        *[keyed[c] for c in df.columns],
        F.col("dst_contig").alias("new_contig"),
        F.when(F.col("strand") == "-", backward).when(F.col("strand") == "+", forward)
        .alias("new_pos"),
        (F.col("strand") == "-").alias("is_negative_strand"),
    )
