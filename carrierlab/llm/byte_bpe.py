"""Byte-level BPE over whole texts, however long.

A text is cut into chunks that overlap. Each chunk is pre-tokenised by itself.
The pattern looks only ahead, so two pre-tokenisations that have one boundary
in common agree from there on; a chunk hands over to the next at the first
boundary both have in their overlap. The last match in a chunk may be cut
short and is not trusted. Pieces between hand-overs are encoded one by one and
put together in order. Where an overlap has no common boundary, the text is
encoded as one piece from the last hand-over before it. Texts of one chunk need
no hand-over and are encoded where they are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK_CHARS, OVERLAP_CHARS = 1 << 16, 1 << 12
SLICE_ROWS = 64


def encoder(path: str, pattern: str):
    """Encoding object of a rank file; without special tokens."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def hand_over(text: str, start: int, pattern) -> int | None:
    """First position at or after ``start`` where the pre-tokens from 0 and from ``start`` both end or begin."""
    mine = [m.end() for m in pattern.finditer(text)][:-1]
    mine = {b for b in mine if b >= start}
    if start in mine:
        return start
    theirs = [start + m.end() for m in pattern.finditer(text[start:])][:-1]
    return next((b for b in theirs if b in mine), None)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int).

    Strings of special tokens are ordinary text. Null and empty texts give no
    ids. Nulls and repeats of the id pass through; extra columns are ignored;
    an empty table gives an empty result. The rank file must be readable on
    the executors.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path, pattern)
        for part in slices(batches):
            ids = [made.encode_ordinary(x) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(ids, type=pa.list_(pa.int32()))], names=["doc_id", "ids"])

    short = docs.where(F.length("text") <= chunk).mapInArrow(whole, "doc_id long, ids array<int>")
    return short.unionByName(_encode_long(docs.where(F.length("text") > chunk), path, pattern, chunk, overlap))


def _encode_long(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Texts of several chunks; equal rows are encoded once and repeated."""
    rows = docs.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "row", F.struct("doc_id", F.sha2("text", 256).alias("sha")))
    last = F.floor((F.length("text") - 1) / chunk)
    chunks = rows.select("row", "copies", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("no")).select(
        "row", "copies", "no",
        F.substring("text", (F.col("no") * chunk + 1).cast("int"), F.lit(chunk + overlap)).alias("text"),
    ).repartition("row", "no")  # the chunks of one text go to many tasks

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        known = regex.compile(pattern)
        for part in slices(batches):
            at = [hand_over(t, chunk, known) if len(t) > chunk else None for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("no"), pa.array(at, type=pa.int32())], names=["row", "no", "meets"])

    met = chunks.mapInArrow(meet, "row struct<doc_id: long, sha: string>, no long, meets int")
    # Chunk no begins where the one before hands over; after a miss nothing
    # is trusted, and the chunk before the first miss takes the rest.
    order = Window.partitionBy("row").orderBy("no")
    spans = (
        met.withColumn("final", F.lead("no").over(order).isNull())
        .withColumn("missed", F.max(F.expr("NOT final AND meets IS NULL")).over(
            order.rowsBetween(Window.unboundedPreceding, -1)))
        .where("missed IS NULL OR NOT missed")
        .withColumn("begin", F.coalesce(F.lag("meets").over(order) - chunk, F.lit(0)))
        .select("row", "no", "begin", F.when(~F.col("final"), F.col("meets")).alias("end"),
                F.expr("NOT final AND meets IS NULL").alias("rest")))
    cut = chunks.join(spans.where("NOT rest"), ["row", "no"]).select(
        "row", "copies", "no",
        F.when(F.col("end").isNull(), F.expr("substring(text, begin + 1)"))
        .otherwise(F.expr("substring(text, begin + 1, end - begin)")).alias("piece"))
    rest = rows.join(spans.where("rest"), "row").select(
        "row", "copies", "no", F.expr(f"substring(text, int(no * {chunk}) + begin + 1)").alias("piece"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path, pattern)
        for part in slices(batches):
            ids = [made.encode_ordinary(x) for x in part.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("copies"), part.column("no"), pa.array(ids, type=pa.list_(pa.int32()))],
                names=["row", "copies", "no", "ids"])

    encoded = cut.unionByName(rest).mapInArrow(
        pieces, "row struct<doc_id: long, sha: string>, copies long, no long, ids array<int>")
    return encoded.groupBy("row", "copies").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"),
    ).select("row.doc_id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``bytes``: the raw bytes of the ids, put together in order.

    Needs doc_id and ids; a null id list gives null bytes. Bytes need not be
    UTF-8 where ids were cut.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path, pattern)
        for part in slices(batches):
            raw = [None if x is None else made.decode_bytes(x) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("ids"), pa.array(raw, type=pa.binary())],
                names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, bytes binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian 32-bit ids) and decoded_sha256 of decoded rows."""
    import hashlib

    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = [np.asarray(x.values, dtype="<u4") for x in part.column("ids")]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([len(x) for x in ids], type=pa.int64()),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], type=pa.string()),
                pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in part.column("bytes")], type=pa.string()),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
