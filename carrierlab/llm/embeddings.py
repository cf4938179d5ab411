"""Near-duplicate vectors by cross-polytope hashing.

1. Equal vectors of one label become one class with its number of copies.
2. Each of ``tables`` hash tables rotates a vector twice by random signs and
   fast Hadamard transforms and takes the axis it lies nearest to, with its
   sign; two such axes are a bucket. A vector is entered in its best buckets
   (multiprobe): pairs of the first and second axis.
3. A bucket, always within one label, is cut into blocks of bounded size; each
   pair of blocks is compared in one task in double precision. A pair that
   meets in several buckets counts in the first of them only, so each pair is
   counted once and no list of pairs is kept: a task returns the number of
   links of each vector and a forest of links that connects the same vectors.
4. Forest links give components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierlab.llm.components import connected_components
from carrierlab.llm.tables import checkpointed

TABLES, PROBES, BLOCK = 8, 3, 512
GROUP_ROWS, SMALL, PAIRS = 4096, 64, 1 << 15


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    signs = np.random.default_rng(seed).integers(0, 2, (3, x.shape[1])) * 2.0 - 1
    for s in signs:
        x = hadamard(x * s)
    return x


def polytope(x: np.ndarray, seed: int, best: int = 2) -> np.ndarray:
    """For each row the ``best`` nearest vertices of the cross-polytope: axis * 2 + sign."""
    y = rotated(x, seed)
    axis = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :best]
    return axis * 2 + (np.take_along_axis(y, axis, 1) < 0)


def bucket_codes(x: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables, probes) bucket numbers; probe 0 is a vector's own bucket."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    out = np.empty((len(x), tables, probes), dtype=np.int64)
    for t in range(tables):
        a, b = polytope(x, seed + 2 * t), polytope(x, seed + 2 * t + 1)
        near = [(a[:, 0], b[:, 0]), (a[:, 0], b[:, 1]), (a[:, 1], b[:, 0]), (a[:, 1], b[:, 1])][:probes]
        for p, (u, v) in enumerate(near):
            out[:, t, p] = u * (2 * width) + v
    return out


def _small_pairs(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs inside the runs of at most SMALL rows, in portions."""
    small = ends - starts <= SMALL
    first = np.concatenate([np.arange(s, e) for s, e in zip(starts[small], ends[small])] or [np.empty(0, np.int64)])
    after = np.repeat(ends[small], (ends - starts)[small]) - first - 1
    for low in range(0, len(first), PAIRS // SMALL):
        f, n = first[low: low + PAIRS // SMALL], after[low: low + PAIRS // SMALL]
        u = np.repeat(f, n)
        yield u, u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.98, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK,
                    seed: int = 11) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Only vectors of one label, not null, are compared. A null or zero vector,
    or one with null or non-finite components, links with nothing; nor do
    vectors of different lengths link. Linked pairs have a cosine of
    ``threshold`` or more in double precision; pairs that share no bucket are
    missed (recall is tested). Rows that share an id are one node. Extra
    columns are ignored; an empty table gives an empty result. Starts Spark
    jobs while the plan is built.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    # Minus zero equals zero.
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0), F.lit(False))
    # Scaled by the largest component, so that no square leaves the range of a double.
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = rows.withColumn("v", F.when(fine, F.get(F.transform(
        F.array(largest), lambda m: F.transform("v", lambda x: x / m)), F.lit(0))))
    rows = rows.withColumn("class", F.when(F.col("v").isNotNull(), F.struct(
        "label", F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ",")).alias("hash"))))
    classes = checkpointed(
        rows.where("class IS NOT NULL").groupBy("class").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column("v")])
            for width in np.unique(lengths):
                take = np.flatnonzero(lengths == width)
                part = batch.take(pa.array(take))
                x = np.array(part.column("v").flatten()).reshape(len(take), width)
                codes = bucket_codes(x, tables, probes, seed)
                n, each = len(take), tables * probes
                again = pa.array(np.repeat(np.arange(n), each))
                rep = part.column("rep").take(again)
                yield pa.RecordBatch.from_arrays([
                    part.column("label").take(again), pa.array(np.full(n * each, width, dtype=np.int32)),
                    pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), n)),
                    pa.array(codes.reshape(-1)), rep],
                    names=["label", "width", "tab", "code", "rep"])

    keyed = classes.select(F.col("class.label").alias("label"), "rep", "copies", "v")
    entered = keyed.select("label", "rep", "v").mapInArrow(
        enter, "label string, width int, tab int, code long, rep long").distinct()
    bucket = ["label", "width", "tab", "code"]
    sizes = entered.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn(
        "blocks", F.ceil(F.col("n") / block).cast("int"))
    placed = entered.join(sizes, bucket).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # Each vector goes to the pairs of blocks that hold its own block. A pair
    # of blocks is a unit of work; whole small buckets share a task's group.
    groups = max(1, classes.count() * tables * probes // GROUP_ROWS)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    placed = placed.withColumn("unit", F.xxhash64(*bucket, "i", "j")).select(
        "label", "width", "tab", "code", "rep", "own", "i", "j", "unit",
        F.when(F.col("blocks") > 1, F.col("unit")).otherwise(F.pmod("unit", F.lit(groups))).alias("part"))
    placed = placed.join(keyed, ["label", "rep"])

    def compare(key, table):
        width = key[1].as_py()
        table = table.combine_chunks().sort_by("unit")
        rep, copies, unit, own, i, j = (
            table.column(c).to_numpy() for c in ("rep", "copies", "unit", "own", "i", "j"))
        x = np.array(table.column("v").combine_chunks().flatten()).reshape(len(rep), width)
        norm = np.sqrt((x * x).sum(axis=1))
        starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        ends = np.append(starts[1:], len(unit))
        a, b = [], []
        for u, v in _small_pairs(starts, ends):
            near = np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v]) >= threshold
            a.append(u[near])
            b.append(v[near])
        for s, e in zip(starts, ends):
            if e - s > SMALL:
                left, right = s + np.flatnonzero(own[s:e] == i[s]), s + np.flatnonzero(own[s:e] == j[s])
                near = (x[left] @ x[right].T) / np.outer(norm[left], norm[right]) >= threshold
                if i[s] == j[s]:
                    near = np.triu(near, 1)
                u, v = np.nonzero(near)
                a.append(left[u])
                b.append(right[v])
        a, b = np.concatenate([*a, np.empty(0, dtype=np.int64)]), np.concatenate([*b, np.empty(0, dtype=np.int64)])
        different = rep[a] != rep[b]
        a, b = a[different].astype(np.int64), b[different].astype(np.int64)
        if len(a):
            # Only the first bucket that both are in counts the pair.
            used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            codes = bucket_codes(x[used], tables, probes, seed)
            keep = []
            for low in range(0, len(a), PAIRS):
                p, q = at[: len(a)][low: low + PAIRS], at[len(a):][low: low + PAIRS]
                numbers = np.arange(tables)[None, :, None] << 40 | codes[p]
                meet = (codes[p][:, :, :, None] == codes[q][:, :, None, :]).any(axis=3)
                keep.append(np.where(meet, numbers, np.iinfo(np.int64).max).min(axis=(1, 2)))
            here = table.column("tab").to_numpy().astype(np.int64) << 40 | table.column("code").to_numpy()
            first = np.concatenate(keep) == here[a]
            a, b = a[first], b[first]
        links = np.bincount(a, weights=copies[b], minlength=len(rep)) + np.bincount(
            b, weights=copies[a], minlength=len(rep))
        root = np.arange(len(rep))
        while True:  # least position over links, with shortcuts
            before = root.copy()
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
            root = root[root]
            if (root == before).all():
                break
        linked = np.flatnonzero(links)
        return pa.table({"rep": rep[linked], "links": links[linked].astype(np.int64), "to": rep[root[linked]]})

    found = checkpointed(placed.groupBy("part", "width").applyInArrow(compare, "rep long, links long, to long"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (classes.select("class", "rep", "copies").join(counted, "rep", "left")
             .join(components.withColumnRenamed("node", "rep"), "rep", "left"))
    return rows.select("vec_id", "class").join(known, "class", "left").select(
        "vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
        F.coalesce("component", "rep", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
