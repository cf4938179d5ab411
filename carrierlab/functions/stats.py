"""Interval estimates that need a quantile function, as column expressions.

Both quantiles solve log T(x) = log p for a tail integral T. With a step in the
logarithm of x the integrand is T's own front factor times exp of a function
that falls ever faster, so its range is known beforehand and one Gauss-Legendre
rule of fixed length gives T for counts of any size; log T is concave, so
Newton's steps close in from one side. Work per row does not depend on the
counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from carrierlab.functions.columns import as_col

NODES, STEPS = 64, 12
# Beyond this exponent an integrand no longer counts.
REACH = 38.0
SHIFT = 10


def _rule() -> Column:
    """Nodes and weights of the Gauss-Legendre rule on (0, 1)."""
    at, weight = np.polynomial.legendre.leggauss(NODES)
    return F.array(*[
        F.struct(F.lit(float(a)).alias("at"), F.lit(float(w)).alias("weight"))
        for a, w in zip((at + 1) / 2, weight / 2)])


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of values that are computed once."""
    record = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.get(F.transform(F.array(record), body), F.lit(0))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number (Stirling, ten places on)."""
    y = x + SHIFT
    inverse = 1 / (y * y)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse / 1188)))) / y
    below = F.log(x)
    for k in range(1, SHIFT):
        below = below + F.log(x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - below


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def _range(slope: Column, bend: Column, last: Column) -> Column:
    """How far an integrand counts that falls at ``slope``, ever faster by ``bend``, at last at ``last``."""
    return F.when(bend > 0, 2 * REACH / (slope + F.sqrt(slope * slope + 2 * REACH * bend))).otherwise(
        F.lit(0.0)) + REACH / last


def _integral(length: Column, log_value: Callable[[Column], Column]) -> Column:
    """Integral of exp(log_value) from 0 to ``length``."""
    return length * F.aggregate(_rule(), F.lit(0.0), lambda total, node: total + node["weight"] * F.exp(
        log_value(node["at"] * length)))


def beta_tail_quantile(p: Column, a: Column, b: Column) -> Column:
    """x below which a beta distribution has the probability p; a, b of at least 1, p up to one half."""

    def solve(v: Column) -> Column:
        a, b = v["a"], v["b"]

        def step(y: Column) -> Column:
            x = F.exp(y)
            pull = (b - 1) * x / (1 - x)
            return _let({"x": x, "y": y, "length": _range(a - pull, pull / (1 - x), a)}, lambda w: _let({
                "integral": _integral(w["length"], lambda s: (b - 1) * (
                    F.log1p(-w["x"] * F.exp(-s)) - F.log1p(-w["x"])) - a * s)}, lambda g: w["y"] - g["integral"] * (
                a * w["y"] + (b - 1) * F.log1p(-w["x"]) - v["log_beta"] + F.log(g["integral"]) - v["log_p"])))

        return F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.log(a / (a + b)), lambda y, _: step(y)))

    return _let({"a": a, "b": b, "log_beta": log_beta(a, b), "log_p": F.log(p)}, solve)


def t_upper_quantile(p: Column, df: Column) -> Column:
    """t above which a Student-t distribution has the probability p below one half."""

    def solve(v: Column) -> Column:
        df = v["df"]

        def step(y: Column) -> Column:
            share = F.exp(2 * y) / df  # t^2 / df
            slope = (df * share - 1) / (1 + share)
            bend = 2 * (df + 1) * share / ((1 + share) * (1 + share))
            return _let({"share": share, "y": y, "length": _range(slope, bend, df)}, lambda w: _let({
                "integral": _integral(w["length"], lambda s: s - (df + 1) / 2 * (
                    F.log1p(w["share"] * F.exp(2 * s)) - F.log1p(w["share"])))}, lambda g: w["y"] + g["integral"] * (
                w["y"] - (df + 1) / 2 * F.log1p(w["share"]) - v["log_front"] + F.log(g["integral"]) - v["log_p"])))

        return F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(math.log(2.0)), lambda y, _: step(y)))

    # Density of t: (1 + t^2/df)^(-(df+1)/2) / (sqrt(df) B(1/2, df/2)).
    front = F.log(df) / 2 + log_beta(F.lit(0.5), df / 2)
    return _let({"df": df, "log_front": front, "log_p": F.log(p)}, solve)


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Probability of a Student-t value at least as far from 0; nodes from 0 to |t|, or from |t| outwards."""
    t = F.abs(t)

    def solve(v: Column) -> Column:
        t, df = v["t"], v["df"]
        power = (df + 1) / 2
        inside = _integral(t, lambda u: -power * F.log1p(u * u / df))
        share = t * t / df
        slope, bend = (df * share - 1) / (1 + share), 2 * (df + 1) * share / ((1 + share) * (1 + share))
        outside = _let({"length": _range(slope, bend, df)}, lambda w: t * _integral(
            w["length"], lambda s: s - power * F.log1p(share * F.exp(2 * s))))
        return F.when(t < 1, 1 - 2 * inside * F.exp(-v["log_front"])).otherwise(2 * outside * F.exp(-v["log_front"]))

    front = F.log(df) / 2 + log_beta(F.lit(0.5), df / 2)
    return F.when((df > 0) & ~F.isnan(t), _let({"t": t, "df": df, "log_front": front}, solve))


def normal_two_sided_p(z: Column) -> Column:
    """Probability of a standard normal value at least as far from 0."""
    z = F.abs(z)
    inside = _integral(z, lambda u: -u * u / 2)
    outside = _let({"z": z, "length": 2 * REACH / (z + F.sqrt(z * z + 2 * REACH))}, lambda v: F.exp(
        -v["z"] * v["z"] / 2) * _integral(v["length"], lambda s: -s * (v["z"] + s / 2)))
    front = 2 / math.sqrt(2 * math.pi)
    return F.when(~F.isnan(z), F.when(z < 1, 1 - front * inside).otherwise(front * outside))


def exact_interval(
    successes: str | Column, total: str | Column, conf: float = 0.95, null_when_zero: bool = False
) -> Column:
    """Exact (Clopper-Pearson) interval as struct<low, high>; unknown where the total is not positive.

    With no successes the interval is (0, upper); ``null_when_zero`` makes it
    null instead, the rule of the grouped binomial summary.
    """
    x, n = as_col(successes).cast("double"), as_col(total).cast("double")
    if null_when_zero:
        x = F.when(x > 0, x)
    tail = F.lit((1 - conf) / 2)
    known = x.isNotNull() & (n > 0)
    low = F.when(known, F.when(x <= 0, F.lit(0.0)).otherwise(beta_tail_quantile(tail, x, n - x + 1)))
    high = F.when(known, F.when(x >= n, F.lit(1.0)).otherwise(1 - beta_tail_quantile(tail, n - x, x + 1)))
    return F.struct(low.alias("low"), high.alias("high"))


def t_half_width(n: str | Column, sd: str | Column, conf: float = 0.95) -> Column:
    """Half-width of the Student-t interval of a mean; null for n < 2."""
    n, sd = as_col(n).cast("double"), as_col(sd).cast("double")
    return F.when(n > 1, t_upper_quantile(F.lit((1 - conf) / 2), n - 1)) * sd / F.sqrt(n)
