"""Gamma and beta distribution functions as Arrow UDFs over NumPy batches.

Spark SQL has neither, and every value here needs an iteration, so these few functions are the only
Python in the library's row path. They work on whole Arrow batches and hold no state.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Coefficients of the Lanczos approximation (g = 7, 9 terms).
_LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)
_TINY = 1e-300


#: Shapes from here on use the uniform asymptotic expansion, whose error is far below double precision there.
LARGE_SHAPE = 1e5
#: Steps after which an iteration that hasn't converged is an error.
MOST_STEPS = 1_000_000


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(math.erfc, 1, 1)(x).astype(float)


def _gamma_large(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(a, x) for a large shape: Temme's uniform expansion with two terms."""
    mu = (x - a) / a
    far = np.abs(mu) > 0.01
    with np.errstate(all="ignore"):
        half = np.where(far, mu - np.log1p(mu), 0.0)
    # mu - log(1 + mu) by its series near zero, where the difference cancels.
    series = sum((-1) ** k * mu**k / k for k in range(2, 12))
    half = np.where(far, half, series)
    eta = np.sign(mu) * np.sqrt(2 * np.maximum(half, 0.0))
    with np.errstate(all="ignore"):
        c0 = np.where(np.abs(eta) > 0.02, 1 / mu - 1 / eta, -1 / 3 + eta / 12 - 2 * eta**2 / 135 + eta**3 / 864 + eta**4 / 2835)
        c1 = np.where(np.abs(eta) > 0.02, 1 / eta**3 - 1 / mu**3 - 1 / mu**2 - 1 / (12 * mu), -1 / 540 - eta / 288 + eta**2 / 378)
    rest = np.exp(-0.5 * a * eta**2) / np.sqrt(2 * np.pi * a) * (c0 + c1 / a)
    return 0.5 * _erfc(-eta * np.sqrt(a / 2)) - rest


def _stirling(z: np.ndarray) -> np.ndarray:
    """What Stirling's formula leaves of log Γ(z), for z of 100 or more."""
    return 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)


def _deviance(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x log(x / m) + m - x without cancellation where x is near m."""
    d = (x - m) / m
    near = sum((-1) ** k * d**k / (k * (k - 1)) for k in range(2, 20))
    with np.errstate(all="ignore"):
        far = (1 + d) * np.log1p(d) - d
    return m * np.where(np.abs(d) < 0.1, near, far)


def log_gamma(a: np.ndarray) -> np.ndarray:
    """log Γ(a) for a > 0."""
    small = a < 0.5
    x = np.where(small, a + 1.0, a) - 1.0
    s = np.full_like(x, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        s = s + c / (x + i)
    t = x + 7.5
    out = 0.5 * np.log(2 * np.pi) + (x + 0.5) * np.log(t) - t + np.log(s)
    return np.where(small, out - np.log(np.maximum(a, _TINY)), out)


def gamma_cdf_array(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma P(a, x): power series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    out[(a > 0) & (x <= 0)] = 0.0
    ok = (a > 0) & (x > 0) & np.isfinite(a) & np.isfinite(x)
    out[(a > 0) & np.isposinf(x)] = 1.0
    large = ok & (a >= LARGE_SHAPE)
    if large.any():
        out[large] = _gamma_large(a[large], x[large])
    ok &= ~large
    low = ok & (x < a + 1)
    if low.any():
        p, y = a[low], x[low]
        term = 1.0 / p
        total, k = term.copy(), p.copy()
        live = np.ones(p.shape, bool)
        while live.any():
            k = k + 1
            term = np.where(live, term * y / k, 0.0)
            total = total + term
            live = term > total * 1e-16
        out[low] = total * np.exp(-y + p * np.log(y) - log_gamma(p))
    high = ok & ~low
    if high.any():
        p, y = a[high], x[high]
        b = y + 1.0 - p
        c = np.full(p.shape, 1.0 / _TINY)
        d = 1.0 / np.where(b == 0, _TINY, b)
        h = d.copy()
        live = np.ones(p.shape, bool)
        i = 0
        while live.any():
            i += 1
            if i > MOST_STEPS:
                raise ArithmeticError("the incomplete gamma function did not converge")
            an = -i * (i - p)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = np.where(live, d * c, 1.0)
            h = h * step
            live = np.abs(step - 1.0) > 1e-15
        out[high] = 1.0 - h * np.exp(-y + p * np.log(y) - log_gamma(p))
    return np.clip(out, 0.0, 1.0)


def normal_quantile_array(p: np.ndarray) -> np.ndarray:
    """Inverse normal distribution: Newton steps on the logarithm of the smaller tail, from beyond the root.

    The logarithm is concave, so the steps come down to the root without passing it, however small the tail is.
    """
    p = np.asarray(p, float)
    tail, side = np.minimum(p, 1 - p), np.where(p < 0.5, -1.0, 1.0)
    ok = tail > 0
    q = np.where(ok, tail, 0.5)
    t = np.sqrt(np.maximum(-2 * np.log(2 * q), 0.0))
    for _ in range(MOST_STEPS):
        upper = np.maximum(0.5 * _erfc(t / np.sqrt(2)), 5e-324)
        step = (np.log(upper) - np.log(q)) * upper * np.sqrt(2 * np.pi) * np.exp(t * t / 2)
        t = np.maximum(t + step, 0.0)
        if np.all(np.abs(step) <= 1e-14 * (1 + t)):
            break
    else:
        raise ArithmeticError("the normal quantile did not converge")
    return np.where(ok, side * t, np.where(p == 0, -np.inf, np.where(p == 1, np.inf, np.nan)))


def gamma_quantile_array(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """x with P(a, x) = p: normal cube-root start, then Newton steps kept inside a shrinking bracket."""
    a, p = np.broadcast_arrays(np.asarray(a, float), np.asarray(p, float))
    ok = (a > 0) & (p > 0) & (p < 1)
    safe_a, safe_p = np.where(ok, a, 1.0), np.where(ok, p, 0.5)
    levels, at = np.unique(safe_p, return_inverse=True)
    z = normal_quantile_array(levels)[at].reshape(safe_p.shape)
    cube = 1 - 1 / (9 * safe_a) + z / (3 * np.sqrt(safe_a))
    x = safe_a * np.maximum(cube, 1e-3) ** 3
    start = np.exp((np.log(safe_p) + log_gamma(safe_a + 1)) / safe_a)
    x = np.where(cube > 0.1, x, start)
    low, high = np.zeros_like(x), np.full_like(x, np.inf)
    live = np.flatnonzero(ok.ravel())
    x, low, high = x.ravel(), low.ravel(), high.ravel()
    flat_a, flat_p = safe_a.ravel(), safe_p.ravel()
    for _ in range(MOST_STEPS):
        if not live.size:
            break
        y, s = x[live], flat_a[live]
        f = gamma_cdf_array(s, y) - flat_p[live]
        high[live] = np.where(f > 0, np.minimum(high[live], y), high[live])
        low[live] = np.where(f <= 0, np.maximum(low[live], y), low[live])
        with np.errstate(all="ignore"):
            pdf = np.exp(-y + (s - 1) * np.log(y) - log_gamma(s))
            new = y - f / pdf
        lo, hi = low[live], high[live]
        middle = np.where(np.isinf(hi), y * 2, (lo + hi) / 2)
        new = np.where((new >= lo) & (new <= hi) & (new > 0) & np.isfinite(new), new, middle)
        x[live] = new
        live = live[(np.abs(new - y) > 1e-12 * np.maximum(y, 1e-300)) & (np.isinf(hi) | (hi - lo > 1e-15 * hi))]
    if live.size:
        raise ArithmeticError("the Gamma quantile did not converge")
    x = x.reshape(safe_a.shape)
    return np.where(ok, x, np.where((a > 0) & (p == 0), 0.0, np.nan))


def beta_cdf_array(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    a, b, x = np.broadcast_arrays(*[np.asarray(v, float) for v in (a, b, x)])
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    n = p + q
    with np.errstate(all="ignore"):
        front = np.exp(log_gamma(n) - log_gamma(p) - log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        # Logarithms of large factorials cancel; their difference from Stirling's formula does not.
        apart = -_deviance(p, n * y) - _deviance(q, n * (1 - y)) + 0.5 * np.log(p / (2 * np.pi) * (q / n))
        large = np.exp(apart + _stirling(n) - _stirling(p) - _stirling(q)) / p
        front = np.where(np.minimum(p, q) > 100, large, front)
    c = np.ones_like(p)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    inside = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    for m in range(1, MOST_STEPS):
        step_all = np.ones_like(p)
        for num in (
            m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step_all = step_all * d * c
            h = h * d * c
        if np.all((np.abs(step_all - 1) < 1e-15) | ~inside):
            break
    else:
        raise ArithmeticError("the incomplete beta function did not converge")
    out = front * h
    out = np.where(flip, 1 - out, out)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.clip(out, 0, 1)))


def t_quantile_array(p: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """t with P(T <= t) = p: a bracket that grows until it holds t, then bisection."""
    q, v = np.broadcast_arrays(np.asarray(p, float), np.asarray(dof, float))
    side, tail = np.where(q < 0.5, -1.0, 1.0), np.minimum(q, 1 - q)
    ok = (tail > 0) & (v > 0)
    above = lambda t: 0.5 * beta_cdf_array(np.where(ok, v, 1.0) / 2, np.full(v.shape, 0.5), np.where(ok, v, 1.0) / (np.where(ok, v, 1.0) + t * t))
    low, high = np.zeros(q.shape), np.ones(q.shape)
    while (grow := ok & (above(high) > tail) & (high < 1e150)).any():
        high = np.where(grow, high * 2, high)
    for _ in range(MOST_STEPS):
        mid = (low + high) / 2
        if np.all(~ok | (high - low <= 1e-15 * high) | (mid <= low) | (mid >= high)):
            break
        more = above(mid) > tail
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    else:
        raise ArithmeticError("the t quantile did not converge")
    edge = np.where(tail == 0, side * np.inf, np.nan)
    return np.where(ok, side * (low + high) / 2, np.where(v > 0, edge, np.nan))


def _nullable(values: np.ndarray) -> pd.Series:
    return pd.Series(values).astype("object").where(~np.isnan(values), None).astype("Float64")


@F.pandas_udf(T.DoubleType())
def gamma_cdf(alpha: pd.Series, beta: pd.Series, x: pd.Series) -> pd.Series:
    """P(X <= x) of a Gamma with shape alpha and rate beta."""
    return _nullable(gamma_cdf_array(alpha.to_numpy(float), beta.to_numpy(float) * x.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def gamma_tail(alpha: pd.Series, beta: pd.Series, line: pd.Series) -> pd.Series:
    """P(X > line)."""
    return _nullable(1.0 - gamma_cdf_array(alpha.to_numpy(float), beta.to_numpy(float) * line.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def gamma_quantile(alpha: pd.Series, beta: pd.Series, p: pd.Series) -> pd.Series:
    """x with P(X <= x) = p."""
    return _nullable(gamma_quantile_array(alpha.to_numpy(float), p.to_numpy(float)) / beta.to_numpy(float))


@F.pandas_udf(T.DoubleType())
def binomial_tail(wins: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(W >= wins) for W binomial(n, p)."""
    k, m, q = wins.to_numpy(float), n.to_numpy(float), p.to_numpy(float)
    inner = beta_cdf_array(np.maximum(k, 1e-9), np.maximum(m - k + 1, 1e-9), q)
    return _nullable(np.where(k <= 0, 1.0, np.where(k > m, 0.0, inner)))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic."""
    s, v = t.to_numpy(float), dof.to_numpy(float)
    return _nullable(beta_cdf_array(v / 2, np.full(v.shape, 0.5), v / (v + s * s)))


@F.pandas_udf(T.DoubleType())
def t_quantile(p: pd.Series, dof: pd.Series) -> pd.Series:
    """t with P(T <= t) = p, by bisection; used on single summary rows."""
    q, v = p.to_numpy(float), dof.to_numpy(float)
    return _nullable(t_quantile_array(q, v))
