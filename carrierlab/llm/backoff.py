"""Stupid-backoff scores of documents under n-gram counts of the corpus.

Everything is counted over all documents. n-grams are 64-bit hashes of words.

1. A task takes texts in blocks and keeps, for each block, its documents and
   its distinct n-grams; n-grams are dealt to parts by hash, and each part gets
   the block's n-grams once, with their counts in the block. A frequent n-gram
   so costs one entry a block, not one an occurrence.
2. Each part is a share of the count tables: it adds the counts of its n-grams
   over all blocks and sends every block the totals it asked for, in its order.
3. A block joins the totals to its n-grams, scores every position and sums
   the scores for each document.

S(w | context) is count(context w) / count(context) for the longest context
whose n-gram was seen at least ``min_count`` times, with a factor ``alpha`` for
each word of context given up; a single word has count / all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierlab.llm import text as tx
from carrierlab.llm.tables import checkpointed

ORDER, MIN_COUNT, ALPHA = 3, 2, 0.4
BLOCK_WORDS, PART_GRAMS = 5 << 20, 1 << 20
RANGE_BITS = 4


def pack(values: np.ndarray) -> bytes:
    """Integers by byte planes, each compressed by itself: leading zero bytes cost nothing."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return b"".join(map(zstandard.ZstdCompressor(level=1).compress, planes))


def unpack(raw, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read(), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).reshape(-1)


def gram_hashes(words: np.ndarray, bounds: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length k: positions of the last words, and hashes, of the k-grams inside texts."""
    begin = np.repeat(bounds[:-1], np.diff(bounds))
    out, h = [(np.arange(len(words), dtype=np.int32), tx.mix(words, 11))], words
    for k in range(2, order + 1):
        at = np.arange(k - 1, len(words), dtype=np.int32)
        h = tx.mix(h[: len(at)] * tx.ODD + words[k - 1:])
        inside = at - (k - 1) >= begin[k - 1:]
        out.append((at[inside], tx.mix(h[inside], 11 + k)))
    return out


def by_range(hashes: list[np.ndarray], bits: int) -> Iterator[list[np.ndarray]]:
    """For each range of the top bits of a hash: where each list has it. Ranges hold whole parts, in order."""
    bits = min(bits, RANGE_BITS)
    tops = [(h >> np.uint64(64 - bits)).astype(np.uint8) if bits else np.zeros(len(h), dtype=np.uint8) for h in hashes]
    for r in range(1 << bits):
        yield [np.flatnonzero(t == r) for t in tops]


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                   min_count: int = MIN_COUNT, alpha: float = ALPHA) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_longest, n_shortest, log_score, mean_log_score.

    ``n_longest`` positions were scored by an n-gram of ``order`` words,
    ``n_shortest`` by the word alone. Null and wordless texts have no words, a
    log score of 0 and a null mean. Repeated rows count as often as they occur
    and each gets its score. Extra columns are ignored; an empty table gives an
    empty result. Starts Spark jobs while the plan is built.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        ids, hashes, counts, held = [], [], [], 0

        def block():
            words = np.concatenate(hashes)
            # The most frequent word is number 0: small numbers take few bytes.
            known, local, seen = np.unique(words, return_inverse=True, return_counts=True)
            common = np.argsort(-seen, kind="stable")
            place = np.empty_like(common)
            place[common] = np.arange(len(common))
            known, local = known[common], place[local]
            return pa.RecordBatch.from_arrays([
                pa.array([task << 32 | number]), pa.array([sum(ids, [])], type=pa.list_(pa.int64())),
                pa.array([pack(np.concatenate(counts).astype(np.int64))]), pa.array([pack(known)]),
                pa.array([pack(local.astype(np.uint32))]), pa.array([len(words)])],
                names=["block", "ids", "counts", "known", "local", "words"])

        for rows, data, offsets in tx.slices(batches, "text"):
            words, bounds = tx.words(data, offsets)
            ids.append(rows.column("doc_id").to_pylist())
            hashes.append(words)
            counts.append(np.diff(bounds))
            held += len(words)
            if held >= BLOCK_WORDS:
                yield block()
                number += 1
                ids, hashes, counts, held = [], [], [], 0
        if ids:
            yield block()

    blocks = checkpointed(docs.mapInArrow(
        gather, "block long, ids array<long>, counts binary, known binary, local binary, words long"))
    total = blocks.agg(F.sum("words")).first()[0] or 0
    bits = max(0, (order * total // PART_GRAMS).bit_length())

    def grams_of(batch, i):
        words = unpack(batch.column("known")[i].as_buffer(), np.uint64)[
            unpack(batch.column("local")[i].as_buffer(), np.uint32)]
        bounds = np.concatenate([[0], np.cumsum(unpack(batch.column("counts")[i].as_buffer(), np.int64))])
        return gram_hashes(words, bounds, order), bounds

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = [h for _, h in grams_of(batch, i)[0]]
                for takes in by_range(hashes, bits):
                    known, seen = np.unique(
                        np.concatenate([h[t] for h, t in zip(hashes, takes)]), return_counts=True)
                    part = (known >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(known), np.int64)
                    starts = np.flatnonzero(np.diff(part, prepend=-1))
                    ends = np.append(starts[1:], len(part))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(part[starts]), pa.array(np.full(len(starts), batch.column("block")[i].as_py())),
                        pa.array([pack(np.diff(known[s:e], prepend=np.uint64(0))) for s, e in zip(starts, ends)],
                                 type=pa.binary()),
                        pa.array([pack(seen[s:e].astype(np.uint32)) for s, e in zip(starts, ends)], type=pa.binary()),
                    ], names=["part", "block", "grams", "seen"])

    def count(table):
        lists = [np.cumsum(unpack(g.as_buffer(), np.uint64), dtype=np.uint64) for g in table.column("grams")]
        seen = np.concatenate([unpack(c.as_buffer(), np.uint32) for c in table.column("seen")])
        _, at = np.unique(np.concatenate(lists), return_inverse=True)
        totals = np.bincount(at, weights=seen).astype(np.int64)[at]
        ends = np.cumsum([len(x) for x in lists])
        return pa.table({
            "block": table.column("block"), "part": table.column("part"),
            "totals": pa.array([pack(totals[e - len(x): e]) for e, x in zip(ends, lists)], type=pa.binary())})

    counted = blocks.mapInArrow(ask, "part long, block long, grams binary, seen binary").groupBy("part").applyInArrow(
        count, "block long, part long, totals binary").withColumnRenamed("block", "owner")

    def score(block, totals):
        totals = totals.sort_by("part")
        per = np.concatenate([unpack(t.as_buffer(), np.int64) for t in totals.column("totals")] or [np.zeros(0, np.int64)])
        ids, sums, words, longest, shortest = [], [], [], [], []
        for i in range(block.num_rows):
            grams, bounds = grams_of(block, i)
            n = int(bounds[-1])
            hashes, low = [h for _, h in grams], 0
            for takes in by_range(hashes, bits):
                known, at = np.unique(np.concatenate([h[t] for h, t in zip(hashes, takes)]), return_inverse=True)
                own = per[low: low + len(known)][at]
                low += len(known)
                # The counts take the place of the hashes, which are not looked at again.
                for h, t, x in zip(hashes, takes, np.split(own, np.cumsum([len(t) for t in takes])[:-1])):
                    h[t] = x
            counts = [h.view(np.int64) for h in hashes]
            used = np.ones(n, dtype=np.int8)
            shorter = counts[0]
            value = np.log(shorter / max(total, 1)) if n else np.zeros(0)
            for k in range(2, order + 1):
                longer = np.zeros(n, dtype=np.int64)
                longer[grams[k - 1][0]] = counts[k - 1]
                counts[k - 1] = grams[k - 1] = hashes[k - 1] = None
                take = np.flatnonzero(longer >= min_count)
                value[take] = np.log(longer[take] / shorter[take - 1])
                used[take] = k
                shorter = longer
            most = np.full(n, order, dtype=np.int8)
            for k in range(order - 1, 0, -1):  # the first words of a text have shorter contexts
                first = bounds[:-1][np.diff(bounds) >= k] + k - 1
                most[first] = k
            value += np.log(alpha) * (most - used)
            owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
            m = len(bounds) - 1
            ids += block.column("ids")[i].as_py()
            sums.append(np.bincount(owner, weights=value, minlength=m).astype(float))
            words.append(np.diff(bounds))
            longest.append(np.bincount(owner[used == order], minlength=m))
            shortest.append(np.bincount(owner[used == 1], minlength=m))
        return pa.table({
            "doc_id": pa.array(ids, type=pa.int64()), "n_words": np.concatenate(words),
            "n_longest": np.concatenate(longest), "n_shortest": np.concatenate(shortest),
            "log_score": np.concatenate(sums)})

    scored = blocks.groupBy("block").cogroup(counted.groupBy("owner")).applyInArrow(
        score, "doc_id long, n_words long, n_longest long, n_shortest long, log_score double")
    return scored.withColumn("mean_log_score", F.when(
        F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))).withColumn(
        "log_score", F.round("log_score", 3))


ORACLE = f"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ \t\n\x0B\f\r]+') AS w
  FROM documents),
words AS (
  SELECT doc_id, r, unnest(generate_series(1, len(w))) AS i,
    unnest(w) AS c
  FROM split WHERE len(w) > 0),
grams AS (
  SELECT doc_id, r, i, c, lag(c) OVER (PARTITION BY r ORDER BY i) AS b,
    lag(c, 2) OVER (PARTITION BY r ORDER BY i) AS a FROM words),
one AS (SELECT c, count(*) AS n FROM grams GROUP BY c),
two AS (SELECT b, c, count(*) AS n FROM grams WHERE b IS NOT NULL GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS n FROM grams WHERE a IS NOT NULL GROUP BY a, b, c),
scored AS (
  SELECT g.doc_id, g.r,
    CASE WHEN t3.n >= {MIN_COUNT} THEN 3 WHEN t2.n >= {MIN_COUNT} THEN 2 ELSE 1 END AS used,
    CASE WHEN t3.n >= {MIN_COUNT} THEN ln(t3.n / c2.n) WHEN t2.n >= {MIN_COUNT} THEN ln(t2.n / c1.n)
      ELSE ln(t1.n / (SELECT count(*) FROM words)) END AS value, least(g.i - 1, 2) + 1 AS most
  FROM grams g JOIN one t1 ON t1.c = g.c LEFT JOIN two t2 ON t2.b = g.b AND t2.c = g.c
  LEFT JOIN three t3 ON t3.a = g.a AND t3.b = g.b AND t3.c = g.c
  LEFT JOIN one c1 ON c1.c = g.b LEFT JOIN two c2 ON c2.b = g.a AND c2.c = g.b)
SELECT s.doc_id, CAST(count(x.used) AS BIGINT) AS n_words,
  CAST(count(*) FILTER (WHERE x.used = 3) AS BIGINT) AS n_longest,
  CAST(count(*) FILTER (WHERE x.used = 1) AS BIGINT) AS n_shortest,
  round(coalesce(sum(x.value + ln({ALPHA}) * (x.most - x.used)), 0), 3) AS log_score,
  round(sum(x.value + ln({ALPHA}) * (x.most - x.used)) / nullif(count(x.used), 0), 6) AS mean_log_score
FROM split s LEFT JOIN scored x ON x.r = s.r GROUP BY s.doc_id, s.r
"""
