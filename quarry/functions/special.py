"""Gamma and chi-square functions and exact-test p-values, as plain Python over floats."""

from __future__ import annotations

import math

import numpy as np

EPS, ROUNDS = 1e-15, 10_000


def log_gamma(x: float) -> float:
    return math.lgamma(x)


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x >= a + 1:
        return 1.0 - gamma_q(a, x)
    term = total = 1 / a
    for i in range(1, ROUNDS):
        term *= x / (a + i)
        total += term
        if abs(term) < abs(total) * EPS:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        return 1.0 - gamma_p(a, x)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, ROUNDS):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < EPS:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def gamma_pdf(x: float, a: float, scale: float = 1.0) -> float:
    if x <= 0:
        return 0.0
    return math.exp((a - 1) * math.log(x / scale) - x / scale - math.lgamma(a)) / scale


def gamma_quantile(p: float, a: float, scale: float = 1.0) -> float:
    """x with gamma_p(a, x / scale) = p, by bisection."""
    low, high = 0.0, max(1.0, a)
    while gamma_p(a, high) < p and high < 1e300:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(a, mid) < p else (low, mid)
    return high * scale


def chi2_pdf(x: float, df: float) -> float:
    return gamma_pdf(x, df / 2, 2.0)


def chi2_p(x: float, df: float) -> float:
    return gamma_p(df / 2, x / 2)


def chi2_q(x: float, df: float) -> float:
    """Upper tail; for one degree of freedom erfc(sqrt(x / 2))."""
    if df == 1:
        return math.erfc(math.sqrt(x / 2)) if x > 0 else 1.0
    return gamma_q(df / 2, x / 2)


def chi2_quantile(p: float, df: float) -> float:
    return gamma_quantile(p, df / 2, 2.0)


def _tables(s: float, b: float, h: float, n: float) -> tuple[np.ndarray, np.ndarray] | None:
    """(supports, ln probabilities) of the 2x2 tables with these margins; None if a margin is degenerate.

    Only tables within 40 standard deviations of the mode are formed, all
    others together are below the smallest double; so a test of margins of
    10^8 takes some hundred thousand terms.
    """
    if b <= 0 or h <= 0 or b >= n or h >= n:
        return None
    low, high = int(max(0, b + h - n)), int(min(b, h))
    mode = min(max(int((b + 1) * (h + 1) / (n + 2)), low), high)
    spread = math.sqrt(b * h / n * (n - b) / n * (n - h) / max(n - 1, 1))
    width = int(40 * spread) + 60
    low, high = max(low, mode - width), min(high, mode + width)
    k = np.arange(low, high + 1, dtype=float)
    up = np.log((b - k[:-1]) * (h - k[:-1]) / ((k[:-1] + 1) * (n - b - h + k[:-1] + 1)))  # of the next to each
    p = np.append(0.0, np.cumsum(up))
    at = log_choose(b, mode) + log_choose(n - b, h - mode) - log_choose(n, h)
    return k, p - p[mode - low] + at


def _fisher(tables: tuple[np.ndarray, np.ndarray] | None, as_extreme: np.ndarray | None) -> float:
    return 1.0 if tables is None else min(1.0, float(np.exp(tables[1][as_extreme]).sum()))


def fisher_probability(s: float, b: float, h: float, n: float) -> float:
    """Sum over tables no more likely than the one seen."""
    t = _tables(s, b, h, n)
    if t is None:
        return 1.0
    seen = log_choose(b, s) + log_choose(n - b, h - s) - log_choose(n, h) if max(0, b + h - n) <= s <= min(b, h) else 0.0
    return _fisher(t, t[1] <= seen + 1e-9)


def fisher_chi2(s: float, b: float, h: float, n: float) -> float:
    """Sum over tables whose support is at least as far from the expected one."""
    t, e = _tables(s, b, h, n), b * h / n if n else 0.0
    return _fisher(t, None if t is None else np.abs(t[0] - e) >= abs(s - e) - 1e-9)


def information(s: float, b: float, h: float, n: float) -> float:
    """Information gain in bits of a 2x2 table."""
    if n <= 0 or b <= 0 or h <= 0 or b >= n or h >= n:
        return 0.0
    cells = ((s, b, h), (b - s, b, n - h), (h - s, n - b, h), (n - b - h + s, n - b, n - h))
    return math.fsum(x / n * math.log2(x * n / (r * c)) for x, r, c in cells if x > 0)


def _informations(k: np.ndarray, b: float, h: float, n: float) -> np.ndarray:
    """``information`` for several supports."""
    total = np.zeros(len(k))
    for x, r, c in ((k, b, h), (b - k, b, n - h), (h - k, n - b, h), (n - b - h + k, n - b, n - h)):
        total += np.where(x > 0, x / n * np.log2(np.maximum(x, 1e-300) * n / (r * c)), 0.0)
    return total


def fisher_information(s: float, b: float, h: float, n: float) -> float:
    """Sum over tables with at least the information gain seen."""
    t = _tables(s, b, h, n)
    return _fisher(t, None if t is None else _informations(t[0], b, h, n) >= information(s, b, h, n) - 1e-9)


def fisher_support(s: float, b: float, h: float, n: float) -> float:
    """Sum over tables with at least the support seen (one-sided)."""
    t = _tables(s, b, h, n)
    return _fisher(t, None if t is None else t[0] >= s - 1e-9)
