"""Document fingerprints: one-permutation MinHash with packed low-order bits.

DataFrame functions only. A text's distinct five-word shingles are hashed once;
the top bits of a hash name one of 256 bins, and a bin keeps its least hash. An
empty bin borrows from the first non-empty bin of its own fixed probe order,
which is the same for every text (optimal densification: a random start and an
odd stride, so that each probe order visits every bin). Four low
bits for each bin are packed, 16 bins to a 64-bit integer. Two unlike bins agree by
chance once in 16, which the likeness takes out.

Everything of a text stays in its row; nothing is exploded or shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS, LOW_BITS, WORDS = 256, 4, 5
LONGS = BINS * LOW_BITS // 64
SHIFT = 63 - (BINS.bit_length() - 1)
# Probe order of each bin: a start and an odd stride drawn by hashing its number.
DRAWS = [hashlib.sha256(b"bin %d" % b).digest() for b in range(BINS)]
STARTS, STRIDES = [d[0] for d in DRAWS], [d[1] | 1 for d in DRAWS]
INVERSES = [pow(s, -1, BINS) for s in STRIDES]
FIRST_PROBES = [[(s + j * t) % BINS for s, t in zip(STARTS, STRIDES)] for j in range(16)]
RANGE_ROWS, MAX_RANGES = 1000, 1000


def shingle_hashes(text: Column, n: int = WORDS) -> Column:
    """63-bit hashes of the word shingles, repeats included; fewer than n words give one."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lowered, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def folded(h: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(h) - n),
            lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + k) for k in range(n)]), 1))
        return F.when(F.size(h) >= n, many).when(
            F.size(h) > 0, F.array(F.shiftrightunsigned(F.xxhash64(h), 1))).otherwise(
            F.array().cast("array<bigint>"))

    return _let(hashes, folded)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def packed(hashes: Column) -> Column:
    """Array of 16 integers: four low bits of each of 256 bins; zeros for no shingles."""
    # The largest value of each bin is added, so that the first value of each
    # bin stands at the bin's place; where it is that value, the bin is empty.
    ends = F.lit([((b + 1) << SHIFT) - 1 for b in range(BINS)]).cast("array<bigint>")
    least = _let(F.sort_array(F.concat(hashes, ends)), lambda h: F.filter(h, lambda x, i: (i == 0) | (
        F.shiftright(x, SHIFT) != F.shiftright(F.get(h, i - 1), SHIFT))))
    bins = _let(least, lambda v: F.transform(v, lambda x, b: F.when(x != F.get(ends, b), x)))

    def filled(v: Column) -> Column:
        return _let(F.filter(v, lambda x: x.isNotNull()), lambda known: F.transform(v, lambda x, b: _low(F.coalesce(
            x, *[F.get(v, F.get(F.lit(order), b)) for order in FIRST_PROBES], far(b, known)), b)))

    def far(b: Column, known: Column) -> Column:
        # The probe at which another bin is met is (bin - start) / stride modulo the bins.
        start, inverse = F.get(F.lit(STARTS), b), F.get(F.lit(INVERSES), b)
        nearest = F.array_min(F.transform(known, lambda x, i: (
            (F.shiftright(x, SHIFT).cast("int") - start) * inverse).bitwiseAND(F.lit(BINS - 1)) * BINS + i))
        return F.get(known, nearest.bitwiseAND(F.lit(BINS - 1)))

    none = F.array_repeat(F.lit(0).cast("long"), LONGS)
    return F.when(F.size(hashes) == 0, none).otherwise(
        _let(_let(bins, filled), lambda v: F.array(*[_pack(v, k) for k in range(LONGS)])))


def _low(value: Column, b: Column) -> Column:
    """Low bits for bin b. Hashed with b, so that bins with one value do not all agree by one chance."""
    return F.xxhash64(value, b).bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("long"))


def _pack(values: Column, k: int) -> Column:
    per = 64 // LOW_BITS
    out: Column = F.lit(0).cast("long")
    for t in range(per):
        out = out.bitwiseOR(F.shiftleft(F.get(values, F.lit(k * per + t)), LOW_BITS * t))
    return out


def fingerprint(text: Column) -> Column:
    return packed(shingle_hashes(text))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing bins, less what chance gives, from 0 to 1."""
    differing: Column = F.lit(0)
    for k in range(LONGS):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 1.0 / (1 << LOW_BITS)
    return F.greatest(F.lit(0.0), ((BINS - differing) / BINS - chance) / (1 - chance))


def as_text(longs: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(F.get(longs, F.lit(k)))), 16, "0") for k in range(LONGS)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text, fingerprint (array of 16 integers).

    Null counts as empty; texts without words share the fingerprint of zeros.
    Extra columns are ignored.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")
                       ).withColumn("fingerprint", fingerprint(F.col("text")))


def with_next(rows: DataFrame, range_rows: int = RANGE_ROWS, max_ranges: int = MAX_RANGES) -> DataFrame:
    """Adds ``next_text`` and ``next_fingerprint``: of the next row by doc_id, of the first for the last.

    Rows are cut into ranges that begin at ids of the table (quantiles), about
    ``range_rows`` rows each, so that no task sees the whole order. The row
    that begins a range is also sent to the end of the range before it, which
    costs one row a range. Equal ids are ordered by text; null ids come first.
    An empty table stays empty; a single row is its own next. Runs one small
    job on the ids while the plan is built.
    """
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63))))
    ids = rows.select("at")
    cuts = min(max_ranges, -(-ids.count() // range_rows))
    heads = [ids.agg(F.min("at")).first()[0]]
    if cuts > 1:
        share = [k / cuts for k in range(1, cuts)]
        found = ids.agg(F.percentile_approx("at", share, max(10_000, 20 * cuts))).first()[0]
        heads = sorted({*heads, *found})
    edges = F.array(*[F.lit(h) for h in heads if h is not None]).cast("array<bigint>")
    part = F.size(F.filter(edges, lambda e: e <= F.col("at"))) - 1
    before = F.pmod(part - 1, F.lit(len(heads)))
    own = F.struct(part.alias("part"), F.lit(False).alias("guest"))
    rows = rows.select("*", F.inline(F.when(F.array_contains(edges, F.col("at")), F.array(
        own, F.struct(before.alias("part"), F.lit(True).alias("guest")))).otherwise(F.array(own))))
    # Plain columns and one lead: one exchange and one sort of the texts.
    order = Window.partitionBy("part").orderBy("guest", "at", "text")
    return (rows.withColumn("following", F.lead(F.struct("text", "fingerprint")).over(order)).where("NOT guest")
            .withColumn("next_text", F.col("following.text")).withColumn("next_fingerprint", F.col("following.fingerprint"))
            .drop("part", "guest", "at", "following"))


def edited_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next text.

    The edited text has the last half of the code points (rounded down)
    replaced by the first as many of the next text, or all of it. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    rows = with_next(fingerprints(docs, id_col, text_col))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.select(
        "doc_id", "fingerprint", "next_fingerprint", F.length("text").cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), F.length("text") - half),
                 F.substring("next_text", F.lit(1), half)).alias("edited"),
    ).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fingerprint")).alias("fingerprint"),
        as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
