"""Grouped regression against numpy, group by group."""

import numpy as np
import pytest

from carrierlab.operators.models import fit_glm, fit_groups


def rows_of(rng, n, width, logit):
    x = rng.standard_normal((n, width)) * rng.uniform(0.1, 50, width) + rng.uniform(-30, 30, width)
    eta = (x - x.mean(0)) / x.std(0) @ rng.uniform(-0.7, 0.7, width)
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float) if logit else eta * 3 + rng.standard_normal(n) + 7
    return x, y


def newton(x, y):
    b = np.zeros(x.shape[1])
    for _ in range(60):
        m = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (m * (1 - m))[:, None]).T @ x, x.T @ (y - m))
    m = 1 / (1 + np.exp(-x @ b))
    return b, np.sqrt(np.diag(np.linalg.inv((x * (m * (1 - m))[:, None]).T @ x)))


def test_groups_of_both_kinds(spark):
    rng = np.random.default_rng(5)
    widths = {("a", None): (2, False), ("a", 1): (4, False), ("b", None): (3, True), ("b", 2): (4, True)}
    data, want = [], {}
    for (g, k), (width, logit) in widths.items():
        x, y = rows_of(rng, 400, width, logit)
        data += [(g, k, float(v), [*map(float, r), *[0.0] * (4 - width)]) for r, v in zip(x, y)]
        full = np.column_stack([np.ones(len(y)), x])
        if logit:
            want[g, k] = newton(full, y)
        else:
            b, *_ = np.linalg.lstsq(full, y, rcond=None)
            s2 = ((y - full @ b) ** 2).sum() / (len(y) - width - 1)
            want[g, k] = b, np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * s2)
    data += [("a", None, None, [1.0] * 4), ("a", None, 5.0, [1.0, None, 0.0, 0.0])]  # left out
    # A separable logit and terms that cannot be told apart.
    data += [("sep", None, float(i > 5), [float(i), 0.0, 0.0, 0.0]) for i in range(12)]
    data += [("same", None, float(i % 7), [float(i), 2.0 * i, 0.0, 0.0]) for i in range(12)]
    rows = spark.createDataFrame(data, "g string, k int, y double, x array<double>").repartition(5)
    names = [(g, k, logit, [f"v{i}" for i in range(w)]) for (g, k), (w, logit) in widths.items()]
    names += [("sep", None, True, ["v0"]), ("same", None, False, ["v0", "v1"]), ("none", None, False, ["v0"])]
    got = {}
    for r in fit_groups(rows, ["g", "k"], spark.createDataFrame(names, "g string, k int, logit boolean, variables array<string>")).collect():
        got.setdefault((r.g, r.k), []).append(r)
    for key, (b, se) in want.items():
        assert [r.variable for r in got[key]] == ["(Intercept)", *[f"v{i}" for i in range(len(b) - 1)]]
        assert [r.estimate for r in got[key]] == pytest.approx(b, rel=1e-7, abs=1e-9)
        assert [r.std_error for r in got[key]] == pytest.approx(se, rel=1e-7)
        assert all(r.converged and r.n == 400 and 0 <= r.p_value <= 1 for r in got[key])
    assert not any(r.converged for key in (("sep", None), ("same", None), ("none", None)) for r in got[key])
    assert {r.estimate for r in got["same", None]} == {None} and got["none", None][0].n == 0


def test_single_model(spark):
    x, y = rows_of(np.random.default_rng(1), 200, 2, False)
    frame = spark.createDataFrame([(float(v), *map(float, r)) for r, v in zip(x, y)], "y double, a double, `b c` double")
    out = fit_glm(frame, "y", ["a", "b c"])
    assert out.columns == ["variable", "estimate", "std_error", "statistic", "p_value"]
    full = np.column_stack([np.ones(len(y)), x])
    assert [r.estimate for r in out.collect()] == pytest.approx(np.linalg.lstsq(full, y, rcond=None)[0])
    assert fit_glm(frame.limit(0), "y", ["a"]).count() == 2


def test_score_models_read_carriers_once(spark):
    """Ranking, the list of models and their passes read what was joined once, not the carriers again."""
    from pyspark.sql import functions as F

    from carrierlab.operators.scores import all_score_models, score_frames

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(4)
    pheno = spark.createDataFrame(
        [(i, "A", *map(float, rng.normal(100, 20, 5)), int(i % 2), 0, 50 + i % 7, 1 + i % 2) for i in range(300)],
        "subject long, cohort string, ldl_mgdl double, hdl_mgdl double, tg_mgdl double, bmi double, _x double, t2d int, "
        "lipidmeds int, age int, sex int")
    scores = pheno.select("subject", F.xxhash64("subject").cast("double").alias("score"))
    names = "subject long, cohort string, variant string, gene string, trait string, level string, evidence string, af double, ac int"
    carriers = spark.createDataFrame(
        [(i, "A", "v", "GCK", "MODY", "Pathogenic", "LOF", 0.1, 1) for i in range(0, 300, 5)], names).mapInArrow(counted, names)
    frames = score_frames(pheno, scores, carriers, None, age_cutoff=40, covariates=("age", "sex"))
    found = all_score_models(frames, covariates=("age", "sex"))
    assert found.where("condition = 'MODY' AND model = 'carriers' AND variable = 'prs'").first().n == 60
    assert 60 <= read.value <= 120
