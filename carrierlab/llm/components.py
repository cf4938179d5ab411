"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierlab.llm.tables import checkpointed

LINKS = 1 << 16  # of a partition


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over (a, b) links.

    Alternates large-star and small-star steps until the links form stars
    around the smallest node of each component. A step is one aggregation and
    one join by node; each round is written to the checkpoint folder, so a
    lost executor costs at most that round. A round has a partition for each
    ``LINKS`` links, or as many as the last one left, if that is fewer; a table
    of one partition is joined by broadcast, and its rounds have no shuffles. Nodes without links are not listed.
    """
    edges = checkpointed(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _fingerprint(edges)
    while True:
        parts = -(-state[0] // LINKS) or 1
        small = F.broadcast if parts == 1 else lambda x: x
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(parts)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(small(least), "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # Of a's links, the one to its least node stays, the others go from there.
        edges = large.join(small(least), "a").select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(
            F.col("a")).alias("a"), F.col("m").alias("b"))
        edges = checkpointed(edges.where("a <> b").distinct())
        now = _fingerprint(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.select(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("a", "b")).alias("x"),
        F.sum(F.shiftright(F.xxhash64("b", "a"), 24)).alias("s"),
    ).first()
    return tuple(row)
