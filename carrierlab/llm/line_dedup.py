"""Line dedup: an exact set-similarity join between the lines of a corpus.

A line's tokens are its distinct words. A line is removed when an earlier line
(by document id, then line number) has the same tokens, or tokens with a
Jaccard similarity of the threshold or more.

1. One pass counts words in a table of fixed size and lists each document's
   distinct token sets by 128-bit key; the least id that has a key owns it.
2. Tokens are ordered rare first; a set's prefix is sent to its tokens, once.
   There, sorted by size, sets are held against those behind them as far as the
   length filter reaches. A set stays a candidate if some other set passes the
   positional filter and a filter on parity bits (a lower bound of the Hamming
   distance) as well. No pair is listed. Candidates go by half of their key, and
   tokens by 32 bits, which can only add some.
3. Candidates' words are read once more where the candidate occurs first; those
   that share a token meet under the least key of the token, with whole sets and
   positions. A semi-join verifies Jaccard against earlier sets.
4. Removed lines are taken out of the texts.

A task that has sent a set does not send it again, so copies cost little. The
sets of a token with more than a fixed number of them pass on uncompared; such a
token, or leader, is cut into parts: a set stays in one part, and the sets it is
held against go to all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierlab.llm import text as tx
from carrierlab.llm.runs import runs
from carrierlab.llm.tables import checkpointed

NUMERATOR, DENOMINATOR = 85, 100
SEEN, SLOTS, SPREAD = 1 << 20, 1 << 23, 2654435761
PART_PREFIXES, PART_SETS = 20_000, 2_000
WIDE = (1 << 16) - 1  # sets of so many words or more pass the filters on size and place
PREFIX = ("token", "key", "size", "at", "odd")
PREFIX_TYPES = "token int, key long, size int, at int, odd long"
LISTING = "doc_id long, keys array<long>, others array<long>, lines array<int>, counts array<int>"


def line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each line begins, and first line of each text (and the end)."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    first = np.searchsorted(breaks, offsets[:-1]) + np.arange(len(offsets) - 1)
    return starts, np.append(first, len(starts))


def line_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line of each word, hash of each word, and first line of each text (and the end)."""
    starts, first = line_starts(data, offsets)
    begin, end = tx.word_spans(data, offsets)
    return np.searchsorted(starts, begin, side="right") - 1, tx.span_hashes(tx.LOWER[data], begin, end), first


def _sets(data, offsets):
    line, hashes, first = line_words(data, offsets)
    owner, tokens = tx.distinct_sorted(line, hashes)
    n = int(first[-1])
    return owner, tokens, first, n, np.bincount(owner, minlength=n), tx.set_keys(owner, tokens, n, 1)


def _second(owner: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    """The other half of the sets' keys."""
    return tx.set_keys(owner, tokens, n, 2)


def _listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, with the keys and lines of its sets; the last row of a task has its counts of words by slot."""
    counts = np.zeros(tx.BUCKETS, dtype=np.int64)
    names = ["doc_id", "keys", "others", "lines", "counts"]
    for rows, data, offsets in tx.slices(batches, "text"):
        owner, tokens, first, n, size, keys = _sets(data, offsets)
        counts += np.bincount(tx.bucket(tokens), minlength=tx.BUCKETS)
        used = np.flatnonzero(size)
        bounds = pa.array(np.searchsorted(used, first).astype(np.int32))
        line = used - first[np.searchsorted(first, used, side="right") - 1]
        yield pa.RecordBatch.from_arrays([
            rows.column("doc_id"), *(pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (
                keys[used], _second(owner, tokens, n)[used], line.astype(np.int32))),
            pa.nulls(rows.num_rows, pa.list_(pa.int32()))], names=names)
    # Only the order of tokens goes by the counts, so a count may stop at the largest int.
    counts = pa.array(np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32))
    yield pa.RecordBatch.from_arrays([
        pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.list_(t)) for t in (pa.int64(), pa.int64(), pa.int32())),
        pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), counts)], names=names)


class _Once:
    """Which keys this task has not sent yet; forgets when full."""

    def __init__(self):
        self.seen: set[int] = set()

    def fresh(self, keys: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=bool)
        for i, k in enumerate(keys.tolist()):
            if size[i] and k not in self.seen:
                out[i] = True
                self.seen.add(k)
        if len(self.seen) > SEEN:
            self.seen.clear()
        return out


def _prefix_rows(batches, classes: np.ndarray, numerator: int, denominator: int):
    """(tokens, key, size, place, parity bits) of the prefixes, a batch at a time; a set's once a task."""
    once = _Once()
    for _, data, offsets in tx.slices(batches, "text"):
        line, hashes, first = line_words(data, offsets)
        n = int(first[-1])
        # Sorted once, by rank; equal words have equal ranks.
        ranks = tx.ranked(hashes, classes)
        order = tx.order_of(line, ranks)
        owner, tokens, hashes = line[order], ranks[order], hashes[order]
        new = np.ones(len(owner), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1])
        owner, tokens, hashes = owner[new], tokens[new], hashes[new]
        size, keys = np.bincount(owner, minlength=n), tx.set_keys(owner, hashes, n, 1)
        odd = tx.parity(owner, hashes, n, 1)[0]
        at = np.arange(len(owner)) - np.searchsorted(owner, np.arange(n))[owner]
        prefix = size - (numerator * size + denominator - 1) // denominator + 1
        keep = once.fresh(keys, size)[owner] & (at < prefix[owner])
        own = owner[keep]
        yield (tx.mix(tokens[keep]) >> np.uint64(32)).astype(np.uint32).view(np.int32), keys[own], size[own], at[keep], odd[own]


def _prefixes(classes: np.ndarray, numerator: int, denominator: int):
    """Prefix rows: each token of a set's prefix, with the set's size and its place in one number, the key and parity bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, key, size, at, odd in _prefix_rows(batches, classes, numerator, denominator):
            yield pa.RecordBatch.from_arrays([
                pa.array((tokens.astype(np.int64) << 32) | (np.minimum(size, WIDE) << 16) | np.minimum(at, WIDE)),
                pa.array(key), pa.array(odd)], names=["sized", "key", "odd"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sized = batch.column("sized").to_numpy()
        token, size, at = (x.astype(np.int32) for x in (sized >> 32, (sized >> 16) & WIDE, sized & WIDE))
        yield pa.RecordBatch.from_arrays([
            pa.array(token), batch.column("key"), pa.array(size), pa.array(at), batch.column("odd")], names=list(PREFIX))


def _near(size, at, odd, key, a, b, numerator: int, denominator: int) -> np.ndarray:
    """Which pairs (a, b) of prefix rows pass the positional filter and the filter on parity bits."""
    both = size[a] + size[b]
    need = (numerator * both + numerator + denominator - 1) // (numerator + denominator)
    differ = np.bitwise_count((odd[a] ^ odd[b]).view(np.uint64)).astype(np.int64)
    near = (np.minimum(size[a] - at[a], size[b] - at[b]) >= need) & (differ <= both - 2 * need)
    return (key[a] != key[b]) & (near | (np.maximum(size[a], size[b]) >= WIDE))


def _runs(numerator: int, denominator: int, most: int):
    """Rows (leader, key) of the sets that have a near one at their token; rows come sorted by token and size.

    The leader is the least such key of the token. Rows of a token with more
    than ``most`` are handed on as they are, without a leader.
    """
    def handed_on(rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(rows[0]), pa.int64()), *(pa.array(r) for r in rows)], names=["leader", *PREFIX])

    def matched(rows: list[np.ndarray]) -> pa.RecordBatch:
        token, key, size, at, odd = rows
        size, at = size.astype(np.int64), at.astype(np.int64)
        hit = np.zeros(len(token), dtype=bool)
        i, step = np.arange(len(token) - 1), 1
        while len(i):
            j = i + step
            # Sorted by size: a row that is out of reach has only such rows behind it.
            reach = (token[j] == token[i]) & (size[i] * denominator >= size[j] * numerator)
            i, j = i[reach], j[reach]
            near = _near(size, at, odd, key, i, j, numerator, denominator)
            hit[i[near]] = hit[j[near]] = True
            step += 1
            i = i[i + step < len(token)]
        token, key = token[hit], key[hit]
        order = np.lexsort((key, token))
        token, key = token[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])[: len(token)])
        leader = np.repeat(key[first], np.diff(np.append(first, len(token))))
        none = [pa.nulls(len(key), t) for t in (pa.int32(), pa.int32(), pa.int64())]
        return pa.RecordBatch.from_arrays(
            [pa.array(leader), pa.nulls(len(key), pa.int32()), pa.array(key), *none], names=["leader", *PREFIX])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, large in runs(_unpacked(batches), PREFIX, most):
            yield handed_on(rows) if large else matched(rows)

    return run


def _slot_counts(rows: DataFrame) -> np.ndarray:
    """Sum of ``seen`` by slot, over a table of fixed size."""
    seen = rows.groupBy("slot").agg(F.sum("seen").alias("seen")).toPandas()
    counts = np.zeros(tx.BUCKETS, dtype=np.int64)
    counts[seen["slot"].to_numpy(dtype=np.int64)] = seen["seen"].to_numpy(dtype=np.int64)
    return counts


def _met(usual: DataFrame | None, hot: DataFrame | None, group: str, condition: Column, keep: list[str]) -> DataFrame:
    """``keep`` of the rows that meet a row of their group (columns ``o_...``) under the condition.

    ``hot`` has groups that are cut into ``parts``; either may be missing.
    """
    def join(rows: DataFrame, others: DataFrame, on: Column) -> DataFrame:
        return rows.join(others.toDF(*[f"o_{c}" for c in others.columns]), on & condition, "left_semi").select(*keep)

    same = F.col(group) == F.col(f"o_{group}")
    out = None if usual is None else join(usual, usual, same)
    if hot is not None:
        cut = join(
            hot.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")),
            hot.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))),
            same & (F.col("part") == F.col("o_part")))
        out = cut if out is None else out.unionByName(cut)
    return out


def _set(slots: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (slots[slot >> 3] >> (slot & 7)) & 1 == 1


def _whole(slots: np.ndarray):
    """Rows (owner, line, key, other, tokens) of the lines whose place may be wanted; no other line's words are read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tx.slices(batches, "text"):
            starts, first = line_starts(data, offsets)
            doc = np.repeat(np.arange(rows.num_rows), np.diff(first))
            number, ids = np.arange(len(starts)) - first[doc], rows.column("doc_id").to_numpy()[doc]
            use = np.flatnonzero(_set(slots, ((ids & (SLOTS - 1)) + number * SPREAD) & (SLOTS - 1)))
            lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
                None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]).take(pa.array(use))
            bounds, text = (np.frombuffer(x, dtype=t) if x is not None and x.size else np.zeros(1, dtype=t)[:m] for x, t, m in zip(
                lines.buffers()[1:], (np.int64, np.uint8), (1, 0)))
            begin, end = tx.word_spans(text, bounds)
            n = len(use)
            owner, tokens = tx.distinct_sorted(
                np.searchsorted(bounds[:n], begin, side="right") - 1, tx.span_hashes(tx.LOWER[text], begin, end))
            size = np.bincount(owner, minlength=n)
            at = np.flatnonzero(size)
            sizes = np.concatenate([[0], np.cumsum(size[at])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[use][at]), pa.array(number[use][at].astype(np.int32)),
                pa.array(tx.set_keys(owner, tokens, n, 1)[at]), pa.array(_second(owner, tokens, n)[at]),
                pa.ListArray.from_arrays(pa.array(sizes), pa.array(tokens.view(np.int64)))],
                names=["owner", "line", "key", "other", "tokens"])

    return run


def _bits(rows: DataFrame, slot: Column) -> np.ndarray:
    """A bit for each of 2^23 slots that holds a row: 1 MB, whatever their number."""
    slot = slot.bitwiseAND(F.lit(SLOTS - 1)) + 1
    rows = rows.select(F.bitmap_bucket_number(slot).alias("n"), F.bitmap_bit_position(slot).alias("p")).groupBy(
        "n").agg(F.bitmap_construct_agg("p").alias("bits")).toPandas()
    out = np.zeros(SLOTS // 8, dtype=np.uint8)
    for number, bits in zip(rows["n"], rows["bits"]):
        out[(number - 1) * 4096: number * 4096] = np.frombuffer(bits, dtype=np.uint8)
    return out


def _place_bits(places: DataFrame) -> np.ndarray:
    return _bits(places, F.col("owner").bitwiseAND(F.lit(SLOTS - 1)) + F.col("line").cast("long") * SPREAD)


def _may_hold(values: DataFrame, column: str):
    """A test that every value of the column passes, and few others: what it rejects need not meet them."""
    slots = _bits(values, F.col(column))

    @F.pandas_udf("boolean")
    def test(x: pd.Series) -> pd.Series:
        return pd.Series(_set(slots, x.to_numpy() & (SLOTS - 1)))

    return test


def _need(a: Column, b: Column, numerator: int, denominator: int) -> Column:
    """Least overlap of two sets of these sizes that reaches the threshold."""
    return F.floor((numerator * (a + b) + (numerator + denominator - 1)) / (numerator + denominator))


def removed_lines(docs: DataFrame, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """(doc_id, line) of the lines to remove; ``docs`` has doc_id and text."""
    listed = checkpointed(docs.mapInArrow(_listing, LISTING))
    classes = tx.rarity_class(_slot_counts(
        listed.where("counts IS NOT NULL").selectExpr("posexplode(counts) AS (slot, seen)").where("seen > 0")))
    lines = listed.where("counts IS NULL").selectExpr(
        "doc_id", "inline(arrays_zip(keys, others, lines)) AS (key, other, line)")

    need = _need(F.col("size"), F.col("o_size"), numerator, denominator)
    near_size = ((F.col("size") * denominator >= F.col("o_size") * numerator)
                 & (F.col("o_size") * denominator >= F.col("size") * numerator))
    prefixes = docs.mapInArrow(_prefixes(classes, numerator, denominator), "sized long, key long, odd long")
    # Token, size and place are one number: sorting by it is cheaper, and the row is smaller.
    met = checkpointed(prefixes.repartition(F.shiftright("sized", 32)).sortWithinPartitions("sized").mapInArrow(
        _runs(numerator, denominator, PART_PREFIXES), f"leader long, {PREFIX_TYPES}"))
    led = met.where("leader IS NOT NULL").select("leader", "key")
    hot = met.where("leader IS NULL").drop("leader")
    frequent = hot.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / PART_PREFIXES).cast("int").alias("parts"))
    if not frequent.isEmpty():
        matched = checkpointed(_met(None, hot.join(frequent, "token"), "token", (
            (F.col("key") != F.col("o_key")) & near_size & ((F.greatest("size", "o_size") >= WIDE) | (
                (F.least(F.col("size") - F.col("at"), F.col("o_size") - F.col("o_at")) >= need)
                & (F.bit_count(F.col("odd").bitwiseXOR(F.col("o_odd"))) <= F.col("size") + F.col("o_size") - 2 * need)))),
            ["token", "key"]))
        led = led.unionByName(matched.join(
            matched.groupBy("token").agg(F.min("key").alias("leader")), "token").select("leader", "key"))
    groups = checkpointed(led.distinct())
    keys = groups.select("key").distinct()
    # Where a key occurs first: aggregated before it meets anything, so a frequent line is no hot key.
    def first(lines: DataFrame) -> DataFrame:
        return lines.groupBy("key", "other").agg(F.min(F.struct("doc_id", "line")).alias("x")).select(
            "key", "other", F.col("x.doc_id").alias("owner"), F.col("x.line").alias("line"))

    wanted = checkpointed(first(lines.where(_may_hold(keys, "key")("key"))).join(keys, "key"))
    sets = docs.mapInArrow(
        _whole(_place_bits(wanted)), "owner long, line int, key long, other long, tokens array<long>").join(
        groups.join(wanted, "key"), ["owner", "line", "key", "other"]).withColumn("size", F.size("tokens"))
    large = checkpointed(groups.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / PART_SETS).cast("int").alias("parts")).where(
        "parts > 1"))
    usual, hot = sets, None
    if not large.isEmpty():
        sets = checkpointed(sets)
        usual, hot = sets.join(large, "leader", "left_anti"), sets.join(large, "leader")
    common = F.size(F.array_intersect("tokens", "o_tokens"))
    close = _met(usual.repartition("leader"), hot, "leader", (
        ((F.col("o_owner") < F.col("owner")) | (F.col("o_owner") == F.col("owner")) & (F.col("o_line") < F.col("line")))
        & ((F.col("key") != F.col("o_key")) | (F.col("other") != F.col("o_other")))
        & near_size & (common * denominator >= numerator * (F.col("size") + F.col("o_size") - common))),
        ["key", "other"]).distinct()
    # Of a set's occurrences only the first stays, and that only if no earlier set is close.
    stays = first(lines).join(close, ["key", "other"], "left_anti").select(F.col("owner").alias("doc_id"), "line", "key")
    return lines.select("doc_id", "line", "key").join(stays, ["doc_id", "line", "key"], "left_anti").select("doc_id", "line")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numerator: int = NUMERATOR,
                denominator: int = DENOMINATOR) -> DataFrame:
    """``docs`` with removed lines taken out of the text, and n_lines, n_removed, emptied.

    Lines end at line feeds. Lines without words are never removed. ``emptied``
    tells that a text had words and lost them all. Null texts stay null; a row
    without id is left as it is and removes nothing. Rows that share an id are
    one document and lose the same line numbers. Columns called n_lines,
    n_removed or emptied are replaced; all others pass through; an empty table
    gives an empty result. Starts Spark jobs while the plan is built.
    """
    docs = docs.drop(*[c for c in ("n_lines", "n_removed", "emptied") if c not in (id_col, text_col)])
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lost = checkpointed(removed_lines(plain.where("doc_id IS NOT NULL AND text IS NOT NULL"), numerator, denominator))
    # Bits of the removed lines, 64 to a word, so that telling whether a line stays takes one look.
    words = lost.groupBy("doc_id", F.shiftright("line", 6).alias("word")).agg(F.bit_or(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.col("line") % 64)).alias("bits"))
    gone = words.groupBy(F.col("doc_id").alias("gone_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("by_word"),
        F.max("word").alias("last"), F.sum(F.bit_count("bits")).cast("int").alias("gone_count")).select(
        "gone_id", "gone_count", F.transform(F.sequence(F.lit(0), "last"), lambda w: F.coalesce(
            F.try_element_at("by_word", w), F.lit(0).cast("long"))).alias("gone_bits"))
    # Texts that certainly lose no line are not sent to meet those lines.
    may_lose = _may_hold(lost, "doc_id")(F.coalesce(docs[id_col].cast("long"), F.lit(0).cast("long")))
    joined = docs.where(may_lose).join(gone, docs[id_col].cast("long") == gone["gone_id"], "left").unionByName(
        docs.where(~may_lose).select("*", *(F.lit(None).cast(t).alias(c) for c, t in gone.dtypes)))
    split = F.split(F.col(text_col), "\n")
    stays = lambda i: F.call_function("shiftright", F.coalesce(F.get("gone_bits", F.shiftright(i, 6)), F.lit(
        0).cast("long")), i % 64).bitwiseAND(F.lit(1)) == 0
    left = F.array_join(F.filter(split, lambda x, i: stays(i)), "\n")
    has_words = F.col(text_col).rlike("[^ \\t\\n\\x0B\\f\\r]")
    return joined.withColumn("n_lines", F.coalesce(F.size(split), F.lit(0))).withColumn(
        "n_removed", F.coalesce("gone_count", F.lit(0))).withColumn(
        "had_words__", F.coalesce(has_words, F.lit(False))).withColumn(
        text_col, F.when(F.col("gone_bits").isNull(), F.col(text_col)).otherwise(left)).withColumn(
        "emptied", F.col("had_words__") & ~has_words).drop("gone_id", "gone_bits", "gone_count", "had_words__")
