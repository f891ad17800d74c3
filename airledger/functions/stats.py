"""Small numeric helpers: Student's t distribution and outlier limits, vectorised with numpy."""

from __future__ import annotations

import math

import numpy as np


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the normal distribution function, by Newton steps from a rough start."""
    p = np.asarray(p, dtype=np.float64)
    tail = np.minimum(p, 1 - p)
    t = np.sqrt(-2 * np.log(tail))
    z = t - (2.30753 + 0.27061 * t) / (1 + t * (0.99229 + 0.04481 * t))
    erfc = np.vectorize(math.erfc, otypes=[float])
    for _ in range(4):
        upper = 0.5 * erfc(z / math.sqrt(2))
        step = (upper - tail) / (np.exp(-z * z / 2) / math.sqrt(2 * math.pi))
        z = z + step / (1 + z * step / 2)
    return np.where(p < 0.5, -z, z)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=np.float64) for v in (a, b, x)))
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    turn = x < (a + 1) / (a + b + 2)
    first = _beta_fraction(np.where(turn, a, b), np.where(turn, b, a), np.where(turn, x, 1 - x))
    part = front * first / np.where(turn, a, b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(turn, part, 1 - part)))


def t_upper(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) for t >= 0."""
    t, df = np.asarray(t, dtype=np.float64), np.asarray(df, dtype=np.float64)
    return 0.5 * incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def t_quantile(p: float | np.ndarray, df: float | np.ndarray) -> np.ndarray:
    """Inverse of Student's t distribution function for p > 0.5.

    Newton steps on the logarithm of the tail against the logarithm of t, which is close to
    a straight line; the start is the quantile for one or two degrees of freedom or, beyond,
    the normal quantile with its first correction.
    """
    p, df = np.broadcast_arrays(np.asarray(p, dtype=np.float64), np.asarray(df, dtype=np.float64))
    tail = 1 - p
    z = normal_quantile(p)
    start = np.where(df < 1.5, 1 / np.tan(np.pi * tail), np.where(df < 2.5, (1 - 2 * tail) / np.sqrt(2 * tail * (1 - tail)), z + (z**3 + z) / (4 * df)))
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    front = lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * np.log(df * np.pi)
    t = np.maximum(start, 1e-8)
    for _ in range(30):
        upper = t_upper(t, df)
        density = np.exp(front - (df + 1) / 2 * np.log1p(t * t / df))
        step = np.clip(np.log(upper / tail) * upper / (t * density), -1, 1)
        t = t * np.exp(step)
        if np.all(np.abs(step) < 1e-13):
            break
    return t


def t_p_value(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs."""
    if n < 3 or not math.isfinite(r):
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    t = abs(r) * math.sqrt((n - 2) / (1 - r * r))
    return float(2 * t_upper(np.array(t), np.array(float(n - 2))))


def esd_limit(n: np.ndarray, i: np.ndarray, alpha: float = 0.05) -> np.ndarray:
    """Limit of the i-th step of the generalised extreme studentised deviate test on n values.

    NaN where the test isn't defined (i < 1 or fewer than one degree of freedom).
    """
    n, i = np.broadcast_arrays(np.asarray(n, dtype=np.float64), np.asarray(i, dtype=np.float64))
    df = n - i - 1
    defined = (i >= 1) & (df >= 1)
    df = np.where(defined, df, 1.0)
    left = np.where(defined, n - i + 1, 3.0)
    pairs, back = np.unique(np.stack([left, df], axis=-1).reshape(-1, 2), axis=0, return_inverse=True)
    t = t_quantile(1 - alpha / (2 * pairs[:, 0]), pairs[:, 1])[back.reshape(-1)].reshape(df.shape)
    return np.where(defined, (n - i) * t / np.sqrt((df + t * t) * left), np.nan)
