"""Whitening of vectors along the leading eigenvectors of their covariance.

Entries become whole numbers, so sums, centred entries times n and deviations
are exact. The fit list holds each distinct vector once. Its covariance V is
never formed: block Jacobi-Davidson asks only for products V t, each one pass of
the tasks over the fit list (``n * x - S`` is taken before anything is
multiplied).

1. Rayleigh-Ritz in the search space gives pairs (theta, u), largest first.
2. Pairs whose residual is at double precision are locked.
3. For each other pair the correction equation
   (I - Q Q')(V - theta I)(I - Q Q') t = -r, Q the locked vectors and u, is
   solved roughly by MINRES. All equations step together, so one pass serves
   the whole block.
4. The corrections, orthogonal to the search space, extend it; a space that has
   grown too wide restarts from its best Ritz vectors.

The driver holds a few dozen vectors as long as one row, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierlab.llm.tables import checkpointed

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
INNER, OUTER, BLOCK = 6, 200, 1 << 14
LONG = 1 << 63


@dataclass
class Model:
    n: int
    sums: np.ndarray  # per dimension, objects (whole numbers of any size)
    trace: float
    values: np.ndarray
    vectors: np.ndarray  # a column for each component
    identity_error: float
    passes: int


def _rows(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Whole-number vectors of a list column, a bounded block at a time."""
    for low in range(0, len(column), BLOCK):
        part = column.slice(low, BLOCK)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), width)


def _centred(x: np.ndarray, middle: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """x - S/n, where S = n * middle + rest; exact until the division while it fits a long."""
    away = x - middle
    if len(x) and int(np.abs(away).max()) < (LONG - n) // n:
        return (n * away - rest) / n
    return away - rest / n


def _deviation(x: np.ndarray, middle: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; null beyond a long."""
    away = x - middle
    most = int(np.abs(away).max(initial=0)) * n + n
    if most * most * max(x.shape[1], 1) < LONG:
        y = n * away - rest
        return (y * y).sum(axis=1).tolist()
    out = []
    for row in away.tolist():
        total = sum((n * a - int(r)) ** 2 for a, r in zip(row, rest))
        out.append(total if total < LONG else None)
    return out


def prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): rows that can be used, entries as whole numbers."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit((LONG >> 8) / SCALE))))
    rows = rows.select("vec_id", F.transform(v, lambda c: F.floor(c * SCALE) + F.lit(SHIFT)).alias("x"))
    # One length can be fitted: the commonest, the longest of equally common ones.
    width = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.where(F.size("x") == (width.width if width else 0))


def _jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], width: int, count: int,
                     inner: int = INNER, outer: int = OUTER, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenpairs of a symmetric operator known by its products."""
    random = np.random.default_rng(seed)
    limit = min(width, 4 * count)
    space, _ = np.linalg.qr(random.standard_normal((width, min(width, count + 2))))
    image = product(space)
    locked, locked_values = np.zeros((width, 0)), np.zeros(0)
    for _ in range(outer):
        # Rayleigh-Ritz; the space, orthogonal to the locked vectors, turns into Ritz vectors.
        small = space.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        space, image = space @ y, image @ y
        want = min(count - locked.shape[1], len(theta))
        residual = image[:, :want] - space[:, :want] * theta[:want]
        residual -= locked @ (locked.T @ residual)
        top = max(np.concatenate([locked_values, theta, [np.finfo(float).tiny]]))
        fine = np.linalg.norm(residual, axis=0) <= 8 * np.finfo(float).eps * max(width, 16) * top
        # Lock from the largest on, so that none is passed over.
        done = int(np.argmin(np.append(fine, False)))
        locked = np.concatenate([locked, space[:, :done]], axis=1)
        locked_values = np.concatenate([locked_values, theta[:done]])
        if locked.shape[1] == min(count, width):
            order = np.argsort(-locked_values, kind="stable")
            return locked_values[order], locked[:, order]
        space, image, theta, residual = space[:, done:], image[:, done:], theta[done:], residual[:, done:]
        block = residual.shape[1]
        if limit < width and space.shape[1] + block > limit:
            keep = 2 * (count - locked.shape[1]) + 2
            space, image = space[:, :keep], image[:, :keep]
        room = width - locked.shape[1] - space.shape[1]
        fresh = np.zeros((width, 0))
        if room and block:
            fresh = _corrections(product, theta[:block], space[:, :block], residual, locked, inner)
        if room:  # where corrections vanish, the residuals or a random direction extend the space
            fresh = np.concatenate([fresh, residual, random.standard_normal((width, 2))], axis=1)
            fresh = _orthogonal(fresh, np.concatenate([locked, space], axis=1), min(room, max(block, 1)))
        if fresh.shape[1]:
            space, image = np.concatenate([space, fresh], axis=1), np.concatenate([image, product(fresh)], axis=1)
        else:  # all directions are in the space: renew its products, to take rounding out
            space, _ = np.linalg.qr(space - locked @ (locked.T @ space))
            image = product(space)
    raise RuntimeError(f"eigenvectors not at double precision after {outer} rounds")


def _orthogonal(fresh: np.ndarray, base: np.ndarray, most: int) -> np.ndarray:
    """Orthonormal columns out of ``fresh``, orthogonal to ``base``; those that vanish go."""
    out = np.zeros((len(fresh), 0))
    for column in fresh.T:
        if out.shape[1] >= most:
            break
        before = np.linalg.norm(column)
        if not before > 0:
            continue
        column = column / before
        for _ in range(3):
            column = column - base @ (base.T @ column)
            column = column - out @ (out.T @ column)
            norm = np.linalg.norm(column)
            if norm < 1e-10:
                break
            column = column / norm
        else:
            out = np.concatenate([out, column[:, None]], axis=1)
    return out


def _corrections(product, values, ritz, residual, locked, steps: int) -> np.ndarray:
    """MINRES on the projected correction equations of all pairs, one product a step for the block."""

    def project(t):
        t = t - locked @ (locked.T @ t)
        return t - ritz * np.einsum("ij,ij->j", ritz, t)

    b = project(-residual)
    beta = np.linalg.norm(b, axis=0)
    live = np.where(beta > 0, beta, 1.0)
    v_old, v = np.zeros_like(b), b / live
    x, w_old, w = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    eta, beta_now = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        p = project(product(v) - v * values) - v_old * beta_now
        alpha = np.einsum("ij,ij->j", v, p)
        p = p - v * alpha
        beta_next = np.linalg.norm(p, axis=0)
        gamma = c * alpha - c_old * s * beta_now
        rho = np.sqrt(gamma ** 2 + beta_next ** 2)
        rho = np.where(rho > 0, rho, 1.0)
        second, third = s * alpha + c_old * c * beta_now, s_old * beta_now
        c_old, s_old = c, s
        c, s = gamma / rho, beta_next / rho
        w_old, w = w, (v - w_old * third - w * second) / rho
        x = x + w * (c * eta)
        eta = -s * eta
        v_old, v = v, p / np.where(beta_next > 0, beta_next, 1.0)
        beta_now = beta_next
        if not (np.abs(eta) > 1e-3 * beta).any():
            break
    return project(np.where(np.isfinite(x), x, 0.0))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model | None:
    """Model of the distinct vectors of ``rows`` (vec_id, x); None where there are none."""
    listed = checkpointed(rows.select("x").distinct())
    first = listed.select(F.size("x").alias("width")).first()
    if first is None:
        return None
    width = first.width

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, dtype=object)
        for batch in batches:
            for x in _rows(batch.column(0), width):
                n += len(x)
                # Halves, so that a block's sum fits a long.
                total += ((x >> 32).sum(axis=0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int64()), pa.array([[str(t) for t in total]], pa.list_(pa.string()))],
                names=["n", "s"])

    added = listed.mapInArrow(totals, "n long, s array<string>").select("n", F.posexplode("s").alias("i", "s")).groupBy(
        "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).orderBy("i").collect()
    n, sums = int(added[0].n), np.array([int(r.s) for r in added], dtype=object)
    middle = np.array([int(t) // n for t in sums], dtype=np.int64)
    rest = np.array([int(t) - n * int(m) for t, m in zip(sums, middle)], dtype=np.int64)
    passes = [0]

    def gathered(work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """Sum over the fit list of an array that ``work`` makes of a block of centred rows."""
        passes[0] += 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for x in _rows(batch.column(0), width):
                    part = work(_centred(x, middle, rest, n))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(size, dtype=np.int32)), pa.array(total.reshape(-1))], names=["i", "v"])

        summed = listed.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(size)
        out[summed.column("i").to_numpy()] = summed.column("v").to_numpy()
        return out

    def product(t: np.ndarray) -> np.ndarray:
        return gathered(lambda y: y.T @ (y @ t), t.size).reshape(t.shape) / n

    trace = float(gathered(lambda y: np.array([(y * y).sum()]), 1)[0]) / n
    if not trace > 0:
        return Model(n, sums, 0.0, np.zeros(0), np.zeros((width, 0)), 0.0, passes[0])
    values, vectors = _jacobi_davidson(product, width, min(components, width))
    real = values > values[0] * 1e-12
    values, vectors = values[real], vectors[:, real]
    k = len(values)
    whitened = gathered(lambda y: (lambda z: z.T @ z)(y @ vectors / np.sqrt(values)), k * k).reshape(k, k) / n
    return Model(n, sums, trace, values, vectors, float(np.abs(whitened - np.eye(k)).max()), passes[0])


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row of ``vectors`` and component: vec_id, component,
    n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries, or
    entries beyond 5e14, are left out; so are vectors of another length than
    the commonest (of equally common lengths the longest). Repeated rows weigh
    once in the fit and are all returned; ids may be null or repeat. Directions
    without spread (below 1e-12 of the largest eigenvalue) are no components,
    so equal vectors alone, like an empty table, give no rows. ``deviation`` is
    null where it does not fit a long. Extra columns are ignored. Starts Spark
    jobs while the plan is built; raises RuntimeError if eigenvectors do not
    reach double precision.
    """
    rows = prepared(vectors, id_col, vector_col)
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    model = fit(rows, components)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    n, k, width = model.n, len(model.values), len(model.sums)
    middle = np.array([int(t) // n for t in model.sums], dtype=np.int64)
    rest = np.array([int(t) - n * int(m) for t, m in zip(model.sums, middle)], dtype=np.int64)
    onto, explained, error = model.vectors / np.sqrt(model.values), model.values / model.trace, model.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for x in _rows(batch.column("x"), width):
                m = len(x)
                again = pa.array(np.repeat(np.arange(low, low + m), k))
                low += m
                deviation = pa.array(_deviation(x, middle, rest, n), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)), deviation.take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array((_centred(x, middle, rest, n) @ onto).reshape(-1)), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
