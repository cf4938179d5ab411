"""Packing by length: buckets with least padding, then batches within a budget.

1. Each text is read once for its number of tokens; the counts are kept.
2. Lengths are gathered in a global histogram, each by itself. On request those
   from ``exact_below`` on are merged into 64 classes for each doubling.
3. A dynamic programme over the histogram chooses the bucket boundaries (the
   largest length of a class) for which padding every text to its bucket's
   boundary adds the fewest tokens: the optimum, unless lengths were merged.
   Starts of buckets move one way only, so its steps grow with buckets x
   distinct lengths x their logarithm.
4. Inside a bucket, texts are dealt to shards of bounded size by their id, and
   each shard fills batches of ``budget // boundary`` texts in order of id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carrierlab.llm.tables import checkpointed

TOKEN = "[^ \\t\\n\\x0B\\f\\r]+"
BUCKETS, BUDGET, SHARD_ROWS = 8, 4096, 100_000


def token_count(text: str) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def length_class(n: str, exact_below: int = 128) -> Column:
    """The length itself below ``exact_below`` and below 128, else its leading seven bits."""
    shift = f"CASE WHEN {n} < {int(exact_below)} THEN 0 ELSE greatest(length(bin({n})) - 7, 0) END"
    return F.expr(f"shiftleft(shiftright({n}, {shift}), {shift})")


def best_boundaries(tops: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` boundaries out of ``tops`` (ascending) with least padding.

    Among equal sums the last bucket starts as early as it can. The best start
    of a last bucket never falls as its end grows, so each end is looked for
    between those of its neighbours: n log n steps a bucket.
    """
    number, total = np.cumsum(counts), np.cumsum(totals)
    cost = tops * number - total
    choices = []
    for _ in range(1, min(buckets, len(tops))):
        new, choice = cost.copy(), np.full(len(tops), -1)
        open_ = [(1, len(tops) - 1, 0, len(tops) - 2)]
        while open_:
            low, high, first, last = open_.pop()
            if low > high:
                continue
            j = (low + high) // 2
            end = min(last, j - 1) + 1
            sums = cost[first:end] + tops[j] * (number[j] - number[first:end]) - (total[j] - total[first:end])
            k = first + int(np.argmin(sums))
            if sums[k - first] < new[j]:
                new[j], choice[j] = sums[k - first], k
            open_ += [(low, j - 1, first, k), (j + 1, high, k, last)]
        choices.append(choice)
        cost = new
    j, out = len(tops) - 1, [int(tops[-1])]
    for choice in reversed(choices):
        if choice[j] >= 0:
            j = int(choice[j])
            out.append(int(tops[j]))
    return out[::-1]


def pack_by_length(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
                   budget: int = BUDGET, shard_rows: int = SHARD_ROWS, exact_below: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, bucket, padded, shard, batch, slot.

    ``padded`` is the bucket's boundary; a batch is (bucket, shard, batch) and
    holds at most ``budget`` padded tokens, or one text that is longer. Null
    and empty texts have no tokens and go to the first bucket. Rows with equal
    ids share a shard and keep separate slots; a null id is dealt like 0.
    Extra columns are ignored; an empty table gives an empty result. Starts
    Spark jobs while the plan is built.
    """
    counted = checkpointed(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                       token_count(text_col).alias("n_tokens")))
    kept = F.col("n_tokens") if exact_below is None else length_class("n_tokens", exact_below)
    histogram = counted.groupBy(kept.alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("total"), F.max("n_tokens").alias("top"),
    ).orderBy("class").collect()  # a row for each length that occurs, or class
    bounds, sizes = [0], [0]
    if histogram:
        tops, counts, totals = (np.array([r[c] for r in histogram], dtype=np.int64) for c in ("top", "n", "total"))
        bounds = best_boundaries(tops, counts, totals, buckets)
        sizes = np.bincount(np.searchsorted(bounds, tops), weights=counts).astype(np.int64).tolist()
    bucket, padded, shards = F.lit(len(bounds) - 1), F.lit(bounds[-1]), F.lit(max(1, -(-sizes[-1] // shard_rows)))
    for k in reversed(range(len(bounds) - 1)):
        inside = F.col("n_tokens") <= bounds[k]
        bucket = F.when(inside, k).otherwise(bucket)
        padded = F.when(inside, bounds[k]).otherwise(padded)
        shards = F.when(inside, max(1, -(-sizes[k] // shard_rows))).otherwise(shards)
    placed = counted.select(
        "doc_id", "n_tokens", bucket.cast("int").alias("bucket"), padded.cast("long").alias("padded"),
        F.pmod(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(1_000_003)) * 7_919, shards.cast("long")).alias("shard"))
    order = Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")
    room = F.greatest(F.floor(F.lit(budget) / F.greatest("padded", F.lit(1))), F.lit(1))
    return placed.withColumn("at", F.row_number().over(order) - 1).select(
        "doc_id", "n_tokens", "bucket", "padded", "shard",
        F.floor(F.col("at") / room).cast("long").alias("batch"), (F.col("at") % room).cast("long").alias("slot"))


# The dynamic programme as one recursive query: a step adds a bucket. Paths
# keep the boundaries; ties take the earliest start of the last bucket.
ORACLE = f"""
WITH RECURSIVE counted AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n_tokens
  FROM documents),
grouped AS (
  SELECT n_tokens AS top, count(*) AS n, sum(n_tokens) AS total FROM counted GROUP BY n_tokens),
h AS (
  SELECT row_number() OVER (ORDER BY top) AS i, top, CAST(sum(n) OVER (ORDER BY top) AS BIGINT) AS number,
    CAST(sum(total) OVER (ORDER BY top) AS BIGINT) AS total FROM grouped),
steps AS (
  SELECT 1 AS k, i, top * number - total AS cost, CAST(top AS VARCHAR) AS path FROM h
  UNION ALL
  SELECT k, i, cost, path FROM (
    SELECT s.k + 1 AS k, b.i AS i,
      CASE WHEN s.i = b.i THEN s.cost
        ELSE s.cost + b.top * (b.number - a.number) - (b.total - a.total) END AS cost,
      CASE WHEN s.i = b.i THEN s.path ELSE s.path || ',' || CAST(b.top AS VARCHAR) END AS path,
      row_number() OVER (PARTITION BY b.i ORDER BY
        CASE WHEN s.i = b.i THEN s.cost ELSE s.cost + b.top * (b.number - a.number) - (b.total - a.total) END,
        CASE WHEN s.i = b.i THEN 0 ELSE 1 END, s.i) AS choice
    FROM steps s JOIN h a ON a.i = s.i JOIN h b ON b.i >= s.i
    WHERE s.k < {BUCKETS}) t
  WHERE choice = 1),
bounds AS (
  SELECT CAST(unnest(string_split(path, ',')) AS BIGINT) AS top FROM (
    SELECT path FROM steps WHERE k = {BUCKETS} AND i = (SELECT max(i) FROM h)) p),
numbered AS (
  SELECT CAST(row_number() OVER (ORDER BY top) - 1 AS INTEGER) AS bucket, top,
    coalesce(lag(top) OVER (ORDER BY top), -1) AS below FROM bounds),
placed AS (
  SELECT c.doc_id, c.n_tokens, b.bucket, b.top AS padded, count(*) OVER (PARTITION BY b.bucket) AS size
  FROM counted c JOIN numbered b ON c.n_tokens <= b.top AND c.n_tokens > b.below),
dealt AS (
  SELECT *, (doc_id % 1000003 * 7919) % greatest((size + {SHARD_ROWS} - 1) // {SHARD_ROWS}, 1) AS shard FROM placed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bucket, shard ORDER BY doc_id, n_tokens) - 1 AS place,
    greatest({BUDGET} // greatest(padded, 1), 1) AS room FROM dealt)
SELECT doc_id, n_tokens, bucket, padded, CAST(shard AS BIGINT) AS shard, CAST(place // room AS BIGINT) AS batch,
  CAST(place % room AS BIGINT) AS slot FROM ranked
"""
