"""Ordinal quality classifier: a cumulative-link regression on graded ratings.

Grades are ordered: 0 toxic, 1 of low quality, 2 good. A text's score is the
sum of the weights of its distinct hashed tokens (runs of letters and digits,
runs of other signs); the weights are shared by all grades, and ordered
thresholds cut the score: P(grade <= j) = sigmoid(threshold_j - score).

The model is fitted on a bounded sample: the ``sample`` rated documents with the
least hash of their id, one text for each. Every document is scored where it is read; the model
(a vector of fixed length) goes to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierlab.llm import text as tx

DIMENSIONS, FORMS = 1 << 18, 64
SAMPLE, EPOCHS, RATE, DECAY, BATCH = 16384, 12, 0.3, 1e-5, 128
MIN_DOCS = 8
KEEP_TAIL = 0.4


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def cumulative(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= j) for each row and threshold j."""
        return 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, hashed token), sorted."""
    low = tx.LOWER[data]
    kind = np.where(tx.SPACE[data], 0, np.where(
        (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)), 1, 2)).astype(np.int8)
    change = np.ones(len(kind) + 1, dtype=bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    bounds = np.flatnonzero(change)
    starts, ends = bounds[:-1], bounds[1:]
    word = kind[starts] != 0
    starts, ends = starts[word], ends[word]
    hashes = tx.span_hashes(low, starts, ends) % np.uint64(DIMENSIONS - FORMS)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    # Forms: how often a token follows itself, by powers of two.
    same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner[1:][same], minlength=len(offsets) - 1)
    form = np.uint64(DIMENSIONS - FORMS) + np.floor(np.log2(repeats + 1)).astype(np.uint64) % np.uint64(FORMS)
    some = np.flatnonzero(np.bincount(owner, minlength=len(offsets) - 1))
    return tx.distinct_sorted(np.concatenate([owner, some]), np.concatenate([hashes, form[some]]))


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, epochs: int = EPOCHS, rate: float = RATE,
        decay: float = DECAY, seed: int = 5) -> Model:
    """Adaptive gradient descent on the cumulative-link likelihood.

    Tokens of fewer than MIN_DOCS sampled documents keep the weight 0, so that
    single documents are not learned by heart. Thresholds are a first value and positive steps, so they stay in order.
    No rows give weights of zero and thresholds at even odds.
    """
    seen = np.bincount(np.concatenate([*rows, np.zeros(0, np.int32)]), minlength=DIMENSIONS)
    rows = [r[seen[r] >= MIN_DOCS] for r in rows]
    weights, squares = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-8)
    if len(rows):
        below = np.clip([(grades <= j).mean() for j in range(levels - 1)], 0.01, 0.99)
        below = np.maximum.accumulate(below + np.arange(levels - 1) * 1e-3)
        below = np.log(below / (1 - below))
    else:
        below = np.zeros(levels - 1) + np.arange(levels - 1) * 1e-3 - 1e-3 * (levels - 1)
    raw = np.concatenate([below[:1], np.log(np.maximum(np.diff(below), 1e-3))])
    raw_squares = np.full(levels - 1, 1e-8)
    random = np.random.default_rng(seed)
    for _ in range(epochs if len(rows) else 0):
        order = random.permutation(len(rows))
        for low in range(0, len(order), BATCH):
            batch = order[low: low + BATCH]
            size = np.array([len(rows[i]) for i in batch])
            at = np.concatenate([rows[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), size)
            score = np.bincount(row, weights=weights[at], minlength=len(batch))
            steps = np.concatenate([raw[:1], np.exp(raw[1:])])
            theta = np.cumsum(steps)
            cdf = 1 / (1 + np.exp(np.clip(score[:, None] - theta, -60, 60)))
            cdf = np.concatenate([np.zeros((len(batch), 1)), cdf, np.ones((len(batch), 1))], axis=1)
            y = grades[batch]
            i = np.arange(len(batch))
            upper, lower = cdf[i, y + 1], cdf[i, y]
            chance = np.maximum(upper - lower, 1e-12)
            slope_u, slope_l = upper * (1 - upper) / chance, lower * (1 - lower) / chance
            grad = slope_u - slope_l  # of -log likelihood by the score
            g = np.bincount(at, weights=grad[row], minlength=DIMENSIONS) / len(batch) + decay * weights
            squares += g * g
            weights -= rate * g / np.sqrt(squares + 1e-4)
            by_theta = np.zeros(levels - 1)
            np.add.at(by_theta, y[y < levels - 1], -slope_u[y < levels - 1] / len(batch))
            np.add.at(by_theta, y[y > 0] - 1, slope_l[y > 0] / len(batch))
            tail = np.cumsum(by_theta[::-1])[::-1]
            g = np.concatenate([tail[:1], tail[1:] * steps[1:]])
            raw_squares += g * g
            raw -= 0.1 * g / np.sqrt(raw_squares + 1e-4)
    return Model(weights, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) out of quality and toxic; the lowest grade of repeated ratings; nulls are no rating."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)).alias("grade"))


def train(docs: DataFrame, grades: DataFrame, levels: int = 3, sample: int = SAMPLE) -> Model:
    """Model fitted on at most ``sample`` rated documents, chosen by the hash of their id.

    Of rows that share an id the text of least hash is taken, before anything goes to the driver.
    """
    chosen = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in tx.slices(batches, "text"):
            owner, slot = features(data, offsets)
            bounds = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(slot.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), lists],
                                             names=["doc_id", "grade", "slots"])

    least = F.min(F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("hash"), "text"))
    single = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(
        least.alias("least")).select("doc_id", "grade", "least.text")
    rows = single.mapInArrow(extract, "doc_id long, grade int, slots array<int>").toArrow().sort_by("doc_id")
    slots = [np.asarray(x.values) for x in rows.column("slots")]
    return fit(slots, rows.column("grade").to_numpy().astype(np.int64), levels)


def classify(docs: DataFrame, model: Model, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, expected_grade, tail, kept.

    ``tail`` is P(the highest grade); a document is kept when it is at least
    ``keep_tail``. Null and empty texts have no tokens and get the score 0.
    Ids may repeat or be null; extra columns are ignored; an empty table gives
    an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in tx.slices(batches, "text"):
            owner, slot = features(data, offsets)
            # Without any token bincount gives whole numbers.
            score = np.bincount(owner, weights=model.weights[slot.astype(np.int64)], minlength=part.num_rows).astype(float)
            above = 1 - model.cumulative(score)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(score.round(6)), pa.array(above.sum(axis=1).round(6)),
                pa.array(above[:, -1].round(6)), pa.array(above[:, -1] >= keep_tail),
            ], names=["doc_id", "score", "expected_grade", "tail", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, expected_grade double, tail double, kept boolean")
