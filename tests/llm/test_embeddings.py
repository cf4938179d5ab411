"""Near-duplicate vectors: components of any size, and pairs close to the threshold."""

import numpy as np

from carrierlab.llm import embeddings

SCHEMA = "vec_id long, embedding array<double>, label int"


def test_components_of_any_size(spark):
    rows = [(0, [1e200, 0.0, 1.0]), (1, [2e200, 0.0, 1.0]), (2, [0.0, 1e-200, 1e-200]), (3, [0.0, 2e-200, 2e-200]),
            (4, [0.0, -5e-324, 0.0]), (5, [0.0, -1.7e308, 0.0]), (6, [1.0, 2.0, 3.0]), (7, [2.0, 4.0, 6.0]),
            (8, [0.0, float("inf"), 0.0]), (9, None), (10, [0.0, 0.0, 0.0])]
    got = {r.vec_id: r for r in embeddings.near_duplicates(
        spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).collect()}
    assert [got[i].component_id for i in range(8)] == [0, 0, 2, 2, 4, 4, 6, 6]
    assert [got[i].n_links for i in range(11)] == [1] * 8 + [0] * 3


def test_pairs_near_the_threshold(spark):
    """Of pairs with a cosine from 0.98 to 0.99 at least nine in ten are found, below it none."""
    rng = np.random.default_rng(12)
    rows, near = [], []
    for k in range(500):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        cosine = rng.uniform(0.97, 0.99)
        near.append(cosine >= 0.98 + 1e-9)
        rows += [(2 * k, a.tolist(), 0), (2 * k + 1, ((cosine * a + np.sqrt(1 - cosine ** 2) * b) * 3).tolist(), 0)]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = np.array([got[2 * k] > 0 for k in range(500)])
    near = np.array(near)
    assert found[near].mean() >= 0.9 and not found[~near].any()


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
