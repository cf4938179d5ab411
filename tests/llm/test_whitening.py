"""Whitening against a dense eigendecomposition, and on nulls, repeats and degenerate tables."""

import math

import numpy as np
import pytest

from carrierlab.llm import whitening


def brute(rows, components=16):
    """{vec_id: (deviation, row of whitened, up to sign)}, explained, n."""
    x = {i: [math.floor(64 * c) + 1000000 for c in v] for i, v in rows}
    listed = sorted({tuple(v) for v in x.values()})
    n, total = len(listed), [sum(c) for c in zip(*listed)]
    y = np.array([[n * c - s for c, s in zip(v, total)] for v in listed], dtype=float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, v in x.items():
        d = [n * c - s for c, s in zip(v, total)]
        out[i] = (sum(e * e for e in d), np.array(d, dtype=float) / n @ vectors / np.sqrt(values))
    return out, values / np.trace(y.T @ y / n), n


def test_against_dense_eigenvectors(spark):
    rng = np.random.default_rng(4)
    spread = np.linspace(3, 0.5, 24)
    rows = [(i, [float(c) for c in rng.standard_normal(24) * spread]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(50)]  # copies weigh once
    bad = [(2000, None), (2001, []), (2002, [None] * 24), (2003, [float("nan")] * 24), (2004, [float("inf")] * 24),
           (2005, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad],
                                  "vec_id long, embedding array<double>, n int, component int")
    want, explained, n = brute(rows)
    got = whitening.whiten(frame).collect()
    assert len(got) == len(rows) * 16 and {r.n for r in got} == {n}
    signs = {}
    for r in got:
        deviation, row = want[r.vec_id]
        assert r.deviation == deviation
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
        k = r.component - 1
        if abs(row[k]) > 0.1:
            assert signs.setdefault(k, np.sign(row[k] * r.whitened)) == np.sign(row[k] * r.whitened)
        assert abs(r.whitened) == pytest.approx(abs(row[k]), abs=1e-8)


def test_jacobi_davidson_restarts_and_repeated_eigenvalues():
    rng = np.random.default_rng(2)
    for width, spectrum in ((200, rng.random(200) + 0.1), (90, np.r_[np.ones(20), np.zeros(70)]), (40, np.ones(40)),
                            (3, np.array([2.0, 0, 0]))):
        q, _ = np.linalg.qr(rng.standard_normal((width, width)))
        a = (q * spectrum) @ q.T
        values, vectors = whitening._jacobi_davidson(lambda t, a=a: a @ t, width, min(16, width))
        best = np.sort(spectrum)[::-1][: len(values)]
        assert np.abs(values - best).max() < 1e-12
        assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-11
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    # Rank one: one component.
    got = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (None, [1.0, 1.0])], schema))
    got = {r.vec_id: r for r in got.collect()}
    assert set(got) == {1, 2, None} and {r.component for r in got.values()} == {1}
    assert got[1].whitened == -got[2].whitened == pytest.approx(-got[None].whitened) and abs(got[1].whitened) == pytest.approx(1)
    # Beyond a long the deviation is null.
    wide = spark.createDataFrame([(1, [0.0, 4e14]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(wide).collect()} == {None}
