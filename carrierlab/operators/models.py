"""Regression coefficient tables, of many models at once.

Each task adds up the cross products of its rows for every group (a model of a
setting, say); the sums, a small matrix a group, are added over tasks and solved.
A logit repeats this with new weights until no coefficient moves, for all groups
in the same passes. Coefficient vectors alone reach the driver.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierlab.functions.stats import normal_two_sided_p, t_two_sided_p
from carrierlab.session import checkpointed

# Executors get the functions themselves and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUNDS, TOLERANCE = 50, 1e-10
Z_975 = 1.959963984540054
COEFFICIENTS = ["variable", "estimate", "std_error", "statistic", "p_value"]


def treatment_coded(df: DataFrame, column: str, baseline: str, level: str, out: str) -> DataFrame:
    """0/1 column for one level against an explicit baseline; others are null."""
    return df.withColumn(out, F.when(F.col(column) == level, 1.0).when(F.col(column) == baseline, 0.0))


def with_interaction(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(a) * F.col(b))


def _cross_products(weights: dict[int, np.ndarray]):
    """(group, place, value): sums of w x x', w x z, w z z, n and of squared weights' terms over a task's rows.

    Groups in ``weights`` are logits with these coefficients; others are linear.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            group, y = batch.column("group").to_numpy(), batch.column("y").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(len(y), -1)
            for g in np.unique(group).tolist():
                at = group == g
                xs, z = x[at], y[at]
                w = np.ones(len(z))
                if g in weights:
                    eta = xs @ weights[g]
                    mean = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
                    w = np.maximum(mean * (1 - mean), 1e-10)
                    z = eta + (z - mean) / w
                rows = np.column_stack([xs, z])
                part = np.append(((rows * w[:, None]).T @ rows).reshape(-1), len(z))
                sums[g] = sums[g] + part if g in sums else part
        for g, total in sums.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(total), g, dtype=np.int32)), pa.array(np.arange(len(total), dtype=np.int32)),
                pa.array(total)], names=["group", "place", "value"])

    return run


def _solved(table: pd.DataFrame) -> pd.DataFrame:
    """Coefficients of a group's sums; null where the terms cannot be told apart."""
    total = np.zeros(len(table))
    total[table["place"]] = table["value"]
    width = math.isqrt(len(total) - 1) - 1
    n, m = int(total[-1]), total[:-1].reshape(width + 1, width + 1)
    used = np.flatnonzero(np.diag(m)[:width] > 0)
    a, b = m[np.ix_(used, used)], m[used, width]
    scale = 1 / np.sqrt(np.diag(a))
    scaled = a * np.outer(scale, scale)
    estimate, variance = np.full(width, np.nan), np.full(width, np.nan)
    if len(used) and np.linalg.eigvalsh(scaled)[0] > 1e-12:
        inverse = np.linalg.inv(scaled) * np.outer(scale, scale)
        estimate[used], variance[used] = inverse @ b, np.diag(inverse)
        rest = float(m[width, width] - estimate[used] @ b)
    else:
        rest = np.nan
    return pd.DataFrame({"group": table["group"].iloc[:1], "n": [n], "p": [len(used)], "rest": [rest],
                         "estimate": [estimate.tolist()], "variance": [variance.tolist()]})


def fit_groups(rows: DataFrame, keys: Sequence[str], names: DataFrame) -> DataFrame:
    """Coefficients of a regression for each group of ``rows`` (keys, y, x).

    ``x`` has the terms' values after the intercept, padded with zeros to one
    length; rows with a null in y or x are left out. ``names`` has a row for
    each group: keys, ``logit`` (boolean) and ``variables`` (array of the
    terms' names). Returns keys, variable (intercept first), estimate,
    std_error, statistic, p_value (Student-t, for a logit normal), n and
    converged. Terms that cannot be told apart, and groups without rows, give
    nulls and converged false; so does a logit that still moves after ROUNDS.
    Linear groups are added up in one pass over ``rows``; the rows of logits,
    which are read again, are written to the checkpoint folder.
    """
    numbered = names.select(*keys, "logit", "variables").collect()  # a row for each model
    order = {tuple(r[k] for k in keys): i for i, r in enumerate(numbered)}
    spark = rows.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names.select(*keys).schema.fields)
    index = spark.createDataFrame([(*k, i) for k, i in order.items()], f"{kinds}, `group` int")
    same = None
    for k in keys:  # keys may be null
        match = rows[k].eqNullSafe(index[k])
        same = match if same is None else same & match
    used = rows.where(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull())).join(
        F.broadcast(index), same).select("group", F.col("y").cast("double").alias("y"), F.concat(
            F.array(F.lit(1.0)), F.transform("x", lambda v: v.cast("double"))).alias("x"))
    logits = {i for i, r in enumerate(numbered) if r.logit}
    found: dict[int, dict] = {}

    def one_pass(weights: dict[int, np.ndarray], source: DataFrame) -> dict[int, dict]:
        added = source.mapInArrow(_cross_products(weights), "`group` int, place int, value double").groupBy(
            "group", "place").agg(F.sum("value").alias("value"))
        solved = added.groupBy("group").applyInPandas(
            _solved, "`group` int, n long, p int, rest double, estimate array<double>, variance array<double>")
        # A coefficient vector for each model; unknown values come as nulls.
        return {r["group"]: r.asDict() | {"rest": np.nan if r["rest"] is None else r["rest"]} | {
            c: np.array(r[c], dtype=float) for c in ("estimate", "variance")} for r in solved.collect()}

    linear = used.where(~F.col("group").isin(sorted(logits))) if logits else used
    for g, r in (one_pass({}, linear) if len(logits) < len(numbered) else {}).items():
        df = r["n"] - r["p"]
        scale = max(r["rest"], 0.0) / df if df > 0 else float("nan")
        found[g] = r | {"df": df, "scale": scale, "converged": df > 0 and not np.isnan(r["rest"])}
    repeated = checkpointed(used.where(F.col("group").isin(sorted(logits)))) if logits else None
    first = repeated.select(F.size("x").alias("width")).first() if logits else None
    width = first.width if first else 1
    now = {g: np.zeros(width) for g in logits}
    for _ in range(ROUNDS if logits else 0):
        step = one_pass(now, repeated.where(F.col("group").isin(sorted(now))))
        for g in list(now):
            new = step[g]["estimate"] if g in step else np.full(width, np.nan)
            moved = np.nanmax(np.abs(np.nan_to_num(new) - now[g]) / (1e-4 + np.abs(now[g])), initial=0)
            bad = g not in step or np.isnan(step[g]["rest"])
            if g in step:
                found[g] = step[g] | {"df": None, "scale": 1.0, "converged": bool(not bad and moved < TOLERANCE)}
            if bad or found[g]["converged"] or np.abs(np.nan_to_num(new)).max() > 1e6:
                del now[g]
            else:
                now[g] = np.nan_to_num(new)
        if not now:
            break
    out = []
    for i, r in enumerate(numbered):
        fit = found.get(i)
        for k, variable in enumerate(["(Intercept)", *r.variables]):
            row = [None, None]
            if fit is not None and not np.isnan(fit["estimate"][k]):
                row = [float(fit["estimate"][k]), float(np.sqrt(fit["variance"][k] * fit["scale"]))]
            out.append((*(r[c] for c in keys), k, variable, *row, None if fit is None else fit["df"],
                        0 if fit is None else fit["n"], bool(fit and fit["converged"])))
    table = spark.createDataFrame(
        out, f"{kinds}, place int, variable string, estimate double, std_error double, df long, n long, converged boolean")
    statistic = F.try_divide("estimate", "std_error")
    return table.withColumn("statistic", statistic).select(
        *keys, "variable", "estimate", "std_error", "statistic",
        F.when(F.col("df").isNull(), normal_two_sided_p(F.col("statistic"))).otherwise(
            t_two_sided_p(F.col("statistic"), F.col("df").cast("double"))).alias("p_value"), "n", "converged")


def fit_glm(df: DataFrame, outcome: str, terms: Sequence[str], family: str = "gaussian") -> DataFrame:
    """Coefficient table of one model (intercept first); rows with a null term are left out."""
    rows = df.select(F.lit(0).alias("model"), F.col(outcome).cast("double").alias("y"),
                     F.array(*[F.col(f"`{t}`").cast("double") for t in terms]).alias("x"))
    names = df.sparkSession.createDataFrame(
        [(0, family == "binomial", list(terms))], "model int, logit boolean, variables array<string>")
    return fit_groups(rows, ["model"], names).select(*COEFFICIENTS)


def odds_ratio_interval(coefficients: DataFrame) -> DataFrame:
    """Wald interval of log-odds coefficients, exponentiated."""
    half = F.lit(Z_975) * F.col("std_error")
    return coefficients.select(
        "variable", F.exp("estimate").alias("odds_ratio"),
        F.exp(F.col("estimate") - half).alias("low"), F.exp(F.col("estimate") + half).alias("high"),
    )


def simple_slope(df: DataFrame, groups: Sequence[str], outcome: str, predictor: str) -> DataFrame:
    """One-covariate linear model per group, by built-in moments."""
    return df.groupBy(*groups).agg(
        F.regr_count(outcome, predictor).alias("n"),
        F.regr_slope(outcome, predictor).alias("slope"),
        F.regr_intercept(outcome, predictor).alias("intercept"),
    )
