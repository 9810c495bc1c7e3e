"""Box statistics: quantile rule, objectives, binomial tail. Counts come from Spark; ratios are made here, in one order."""

from __future__ import annotations

import math

import numpy as np

LENIENT1, LENIENT2, ORIGINAL = "lenient1", "lenient2", "original"


def mean(cases: int, points: int) -> float:
    return cases / points if points else 0.0


def objective_score(objective: str, k0: int, n0: int, k1: int, n1: int) -> float:
    """Score of a candidate with k1 cases among n1 rows against the current box with k0 among n0."""
    m0, m1 = mean(k0, n0), mean(k1, n1)
    if objective == ORIGINAL:
        return m1 if n1 else -1.0
    if m1 == m0 or n1 == n0:
        return 0.0
    gain = m1 - m0
    return gain / abs(n0 - n1) if objective == LENIENT1 else n1 * gain / abs(n0 - n1)


def ranks(n: int, p: float) -> tuple[int, int]:
    """The two order statistics (from 0) around quantile p of n values."""
    at = (n - 1) * p
    return math.floor(at), math.ceil(at)


def quantile(values: np.ndarray, p: float) -> float:
    """Midpoint of the order statistics around p; where they are equal, of the neighbouring distinct values towards the
    inside: the next lower one for p above one half, else the next higher one."""
    return sorted_quantile(np.sort(np.asarray(values)), p)


def sorted_quantile(ordered: np.ndarray, p: float) -> float:
    """The quantile of ascending values."""
    return counted_quantile(ordered, np.ones(len(ordered), np.int64), p)


def counted_quantile(ordered: np.ndarray, counts: np.ndarray, p: float) -> float:
    """The quantile of ascending values of which each occurs so many times; none at all is allowed."""
    upto = np.cumsum(counts)
    n = int(upto[-1])
    a, b = (float(ordered[np.searchsorted(upto, rank, "right")]) for rank in ranks(n, p))
    if a == b:
        if p > 0.5:
            at = int(np.searchsorted(ordered, b, "left"))
            below = upto[at - 1] if at else 0
            a = float(ordered[np.searchsorted(upto, below, "left")]) if below else a
        else:
            upper = upto[np.searchsorted(ordered, a, "right") - 1]
            b = float(ordered[np.searchsorted(upto, upper, "right")]) if upper < n else b
    return midpoint(a, b)


def midpoint(a: float, b: float) -> float:
    half = (a + b) / 2
    return half if math.isfinite(half) else a / 2 + b / 2


def integer_quantile(values: np.ndarray, p: float) -> int:
    return math.trunc(quantile(np.asarray(values, np.float64), p))


def _stirling_error(n: float) -> float:
    """log n! less Stirling's formula for it."""
    if n <= 15:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - math.log(2 * math.pi) / 2
    m = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / m) / m) / m) / m) / n


def _deviance(x: float, m: float) -> float:
    """x log(x / m) + m - x, also where x is close to m."""
    if abs(x - m) >= 0.1 * (x + m):
        return x * math.log(x / m) + m - x
    v = (x - m) / (x + m)
    found, term, j = (x - m) * v, 2 * x * v, 0
    while True:
        term, j = term * v * v, j + 1
        more = found + term / (2 * j + 1)
        if more == found:
            return found
        found = more


def log_binomial_term(k: int, n: int, p: float) -> float:
    """log P(X = k) for X binomial, 0 < k <= n and 0 < p < 1, by deviances: differences of large logarithms lose digits."""
    if k == n:
        return n * math.log(p)
    errors = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k)
    return errors - _deviance(k, n * p) - _deviance(n - k, n * (1 - p)) + (math.log(n / k) - math.log(2 * math.pi * (n - k))) / 2


#: Terms that are made at once, and the logarithm, against the greatest one, from which on terms no longer count.
TERMS, NEGLIGIBLE = 8192, -60.0


def _terms_beside(top: int, end: int, n: int, odds: float) -> float:
    """Sum of the terms from beside top to end, in units of the term at top, until they no longer count."""
    total, last, up = 0.0, 0.0, end > top
    while top != end and last > NEGLIGIBLE:
        count = min(TERMS, abs(end - top))
        i = np.arange(top, top + count, dtype=np.float64) if up else np.arange(top, top - count, -1, dtype=np.float64)
        logs = last + np.cumsum(np.log((n - i) / (i + 1)) + odds if up else np.log(i / (n - i + 1)) - odds)
        total, last = total + float(np.exp(logs).sum()), float(logs[-1])
        top += count if up else -count
    return total


def binomial_greater(k: int, n: int, p: float) -> float:
    """P(X >= k) for X binomial in n trials of probability p. Terms fall on both sides of the greatest one of the tail; they are
    summed outwards from it, each from the one before, until they no longer count: some square roots of n of them."""
    if k <= 0:
        return 1.0
    if p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    odds = math.log(p) - math.log1p(-p)
    top = min(max(k, math.floor((n + 1) * p)), n)
    total = 1.0 + _terms_beside(top, n, n, odds) + _terms_beside(top, k, n, odds)
    return min(1.0, math.exp(log_binomial_term(top, n, p)) * total)


def harmonic_mean(a: float, b: float) -> float:
    return 2 * a * b / (a + b) if a + b else 0.0
