"""Order statistics over a whole table without a single-task window.

A global ``ntile``, an empirical CDF or an exact quantile needs a total order.
Rows are dealt to ranges of that order, as many as their number asks for; every
range is ordered in its own task, and what lies before a range, a table with one
row per range, is added back. Rows that share a value are told apart by the tie,
so a value with very many rows spreads over ranges as others do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierlab.functions.order import in_ranges, running
from carrierlab.session import checkpointed


def global_rank(
    df: DataFrame, order: str, tie: str, rank: str = "rank", total: str = "n_total",
) -> DataFrame:
    """Add the 1-based rank by (order, tie) and the row count.

    ``order`` is not null; ``tie`` makes the order total.
    """
    ranked = running(in_ranges(df, [], [order, tie]), [], {rank: F.lit(1)}, {rank: total})
    return ranked.select(*df.columns, rank, total)


def tile(rank: str | Column, total: str | Column, n: int) -> Column:
    """SQL ``ntile(n)`` from rank and row count: the first groups are larger."""
    rank = F.col(rank) if isinstance(rank, str) else rank
    total = F.col(total) if isinstance(total, str) else total
    size = F.floor(total / n)
    larger = total - size * n
    in_larger = larger * (size + 1)
    return F.when(
        rank <= in_larger, F.floor((rank - 1) / (size + 1)) + 1
    ).otherwise(
        larger + F.floor((rank - in_larger - 1) / F.greatest(size, F.lit(1))) + 1
    ).cast("int")


def with_tiles(df: DataFrame, order: str, tie: str, tiles: Mapping[str, int]) -> DataFrame:
    """Add several ``ntile`` columns from one ordering pass."""
    ranked = global_rank(df, order, tie, "_rank", "_total")
    return ranked.withColumns(
        {name: tile("_rank", "_total", n) for name, n in tiles.items()}
    ).drop("_rank", "_total")


def cumulative_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Per group and distinct value: rows with the value, rows up to it, all rows.

    Columns: groups, value, ``n``, ``n_up_to``, ``n_group``. Equal values are
    counted together before anything is ordered; ``df`` is read once.
    """
    groups = list(groups)
    counted = checkpointed(df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n")))
    return running(in_ranges(counted, groups, [value]), groups, {"n_up_to": F.col("n")}, {"n_up_to": "n_group"}).select(
        *groups, value, "n", "n_up_to", "n_group")


def empirical_cdf(df: DataFrame, groups: Sequence[str], value: str, out: str = "ecdf") -> DataFrame:
    """Step heights of the empirical distribution, one row per distinct value."""
    return cumulative_counts(df, groups, value).select(
        *groups, value, (F.col("n_up_to") / F.col("n_group")).alias(out)
    )


def group_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact interpolated quantiles per group, from ordered counts.

    Unlike the built-in ``percentile`` no task ever holds the values of a
    group: the two order statistics around each position are picked by a
    partial ``min``.
    """
    counted = cumulative_counts(df, groups, value)
    picks, results = [F.max("n_group").alias("n")], []
    for name, p in probs.items():
        position = (F.col("n_group") - 1) * F.lit(p)
        for side, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picks.append(F.min(F.when(F.col("n_up_to") > at, F.col(value))).alias(f"_{name}_{side}"))
        picks.append(F.max(position - F.floor(position)).alias(f"_{name}_frac"))
        results.append(
            (F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo"))
             * F.col(f"_{name}_frac")).alias(name)
        )
    return counted.groupBy(*groups).agg(*picks).select(*groups, "n", *results)
