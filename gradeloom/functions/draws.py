"""Hypergeometric draws for counts of any size, vectorised in numpy.

numpy's own sampler stops at 10^9. Here a count is drawn by rejection from the envelope that every log-concave law
on the integers has around its mode (a flat top with exponential sides), against the exact probabilities; these
come from binomial terms in saddle-point form, which keep their digits where differences of log factorials would
cancel. Several colours are drawn by splitting: the first colour's count, then the next one's from what is left.
Counts up to 2^53 are exact as doubles."""

from __future__ import annotations

import math

import numpy as np

#: log(n!) less Stirling's formula, for n below 16.
_SMALL = np.array([0.0] + [math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) for n in range(1, 16)])


def _stirling_error(n: np.ndarray) -> np.ndarray:
    x = np.maximum(n, 16.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / x**2) / x**2) / x**2) / x
    return np.where(n < 16, _SMALL[np.minimum(n, 15).astype(np.int64)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x, without cancellation where x is near the mean."""
    v = (x - mean) / (x + mean)
    near = np.abs(v) < 0.1
    small, power, v2 = 2 * x * v**3 / 3, 2 * x * v**3, v**2
    for k in range(5, 27, 2):
        power = power * v2
        small = small + power / k
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.where(x > 0, x * np.log(x / mean), 0.0) + mean - x
    return np.where(near, (x - mean) * v + small, plain)


def _log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log P(X = x), 0 < p < 1."""
    q = 1 - p
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q) - 0.5 * (math.log(2 * math.pi) + np.log(x) + np.log1p(-x / n))
        ends = np.where(x == 0, n * np.log1p(-p), n * np.log(p))
    return np.where((x > 0) & (x < n), inner, np.where(n == 0, 0.0, ends))


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many of ``m`` rows drawn without return are of the ``good`` ones, for arrays of equal shape."""
    good, bad, m = (np.asarray(a, float) for a in np.broadcast_arrays(good, bad, m))
    low, high = np.maximum(0, m - bad), np.minimum(m, good)
    out = low.copy()
    todo = np.flatnonzero(low < high)
    g, b, k, lo, hi = (a[todo] for a in (good, bad, m, low, high))
    p = k / (g + b)
    base = _log_binomial(k, g + b, p)

    def log_p(x, at):
        inside = (x >= lo[at]) & (x <= hi[at])
        y = np.clip(x, lo[at], hi[at])
        return np.where(inside, _log_binomial(y, g[at], p[at]) + _log_binomial(k[at] - y, b[at], p[at]) - base[at], -np.inf)

    mode = np.clip(np.floor((k + 1) * (g + 1) / (g + b + 2)), lo, hi)
    left = np.arange(len(todo))
    top = log_p(mode, left)
    peak = np.exp(top)
    wide = 1 + peak / 2
    while len(left):
        w, c = wide[left], peak[left]
        flat = rng.random(len(left)) <= w / (1 + w)
        y = np.where(flat, rng.random(len(left)) * w, w + rng.exponential(size=len(left))) / c
        x = mode[left] + np.where(rng.random(len(left)) < 0.5, 1, -1) * np.round(y)
        height = np.log(rng.random(len(left))) + np.minimum(0, w - c * y)
        taken = height <= log_p(x, left) - top[left]
        out[todo[left[taken]]] = x[taken]
        left = left[~taken]
    return out.astype(np.int64)


def multivariate_hypergeometric(rng: np.random.Generator, colours: np.ndarray, m: int, size: int) -> np.ndarray:
    """``size`` draws [draw, colour] of ``m`` rows without return."""
    out = np.zeros((size, len(colours)), np.int64)
    left, rest = np.full(size, m, np.int64), int(np.sum(colours))
    for k, n in enumerate(np.asarray(colours, np.int64).tolist()):
        rest -= n
        out[:, k] = hypergeometric(rng, n, rest, left) if rest else left
        left = left - out[:, k]
    return out
