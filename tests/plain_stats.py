"""Beta and Student-t distributions in numpy, to compare the column expressions with."""

import math

import numpy as np


def _lgamma(values):
    return np.vectorize(math.lgamma, otypes=[float])(values)


def beta_cdf(x, a, b):
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, a, b)))
    inside = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    result = np.where(x >= 1, 1.0, 0.0)
    if not inside.any():
        return result
    x, a, b = x[inside], a[inside], b[inside]
    flip = x > (a + 1) / (a + b + 2)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    z = np.where(flip, 1 - x, x)
    front = np.exp(
        _lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)
    ) / p
    tiny = 1e-300

    def guard(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(z)
    d = 1 / guard(1 - (p + q) * z / (p + 1))
    frac = d.copy()
    # the fraction needs on the order of sqrt(max(a, b)) terms
    for m in range(1, 200 + int(8 * np.sqrt(max(p.max(), q.max())))):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / guard(1 + even * d), guard(1 + even / c)
        frac = frac * d * c
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / guard(1 + odd * d), guard(1 + odd / c)
        step = d * c
        frac = frac * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    value = front * frac
    result[inside] = np.where(flip, 1 - value, value)
    return result


def beta_quantile(prob, a, b):
    """Inverse of :func:`beta_cdf` by Newton steps inside a shrinking bracket."""
    prob, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (prob, a, b)))
    low, high = np.zeros(prob.shape), np.ones(prob.shape)
    x = a / (a + b)
    log_beta = _lgamma(a) + _lgamma(b) - _lgamma(a + b)
    for _ in range(200):
        error = beta_cdf(x, a, b) - prob
        low, high = np.where(error < 0, x, low), np.where(error < 0, high, x)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            density = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - log_beta)
            step = x - error / density
        inside = (step > low) & (step < high)
        following = np.where(error == 0, x, np.where(inside, step, (low + high) / 2))
        done = np.abs(following - x) <= 1e-14 * following
        x = following
        if np.all(done | (error == 0)):
            break
    return x


def t_two_sided_p(t, df):
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def t_quantile(prob, df):
    """Upper Student-t quantile for ``prob`` in (0.5, 1); unknown for df <= 0."""
    prob, df = np.broadcast_arrays(np.asarray(prob, dtype=float), np.asarray(df, dtype=float))
    used = np.where(df > 0, df, 1.0)
    y = beta_quantile(2 * prob - 1, 0.5, used / 2)
    return np.where(df > 0, np.sqrt(used * y / (1 - y)), np.nan)
