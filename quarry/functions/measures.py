"""Evaluation measures of rules and itemsets as columns.

s is the support of the whole set, b of the body, h of the head, n the total
weight.  Divisions whose denominator is 0 take the stated value of the measure.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import special

INF = float("inf")


def _over(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(otherwise))


def none(s, b, h, n):
    return F.lit(0.0)


def support(s, b, h, n):
    return s


def confidence(s, b, h, n):
    return F.when(b > 0, _over(s, b)).otherwise(0.0)


def confidence_difference(s, b, h, n):
    return F.abs(confidence(s, b, h, n) - _over(h, n))


def lift(s, b, h, n):
    return F.when((b > 0) & (h > 0), _over(s * n, b * h)).otherwise(0.0)


def lift_difference(s, b, h, n):
    return F.when((b > 0) & (h > 0), F.abs(lift(s, b, h, n) - 1)).otherwise(0.0)


def lift_quotient(s, b, h, n):
    v = lift(s, b, h, n)
    return F.when((b > 0) & (h > 0), 1 - F.when(v > 1, _over(F.lit(1.0), v)).otherwise(v)).otherwise(0.0)


def conviction(s, b, h, n):
    return F.when(b > s, _over(b * (n - h), (b - s) * n)).otherwise(0.0)


def conviction_difference(s, b, h, n):
    return F.when(b > s, F.abs(conviction(s, b, h, n) - 1)).otherwise(INF)


def conviction_quotient(s, b, h, n):
    v = conviction(s, b, h, n)
    return F.when(b > s, 1 - F.when(v > 1, _over(F.lit(1.0), v)).otherwise(v)).otherwise(INF)


def odds_ratio_like(s, b, h, n):
    """s (n - b) / (b (h - s)): how much the body raises the odds of the head."""
    low = (s <= 0) | (b <= 0) | (n <= b)
    return F.when(low, 0.0).when(h <= s, INF).otherwise(_over(s * (n - b), b * (h - s)))


def log_odds(s, b, h, n):
    v = odds_ratio_like(s, b, h, n)
    return F.when((s <= 0) | (b <= 0) | (n <= b), 0.0).when(h <= s, INF).otherwise(F.log2(F.when(v > 0, v)))


def certainty(s, b, h, n):
    p = _over(h, n)
    d = confidence(s, b, h, n) - p
    return F.when((b <= 0) | (n <= 0), 0.0).when(d >= 0, _over(d, 1 - p)).otherwise(_over(d, p))


def _margins(b, h, n):
    return (h > 0) & (h < n) & (b > 0) & (b < n)


def chi2(s, b, h, n):
    """Chi-square divided by n."""
    t = h * b - s * n
    return F.when(_margins(b, h, n), _over(t * t, h * (n - h) * b * (n - b))).otherwise(0.0)


def chi2_yates(s, b, h, n):
    t = F.abs(h * b - s * n) - 0.5 * n
    return F.when(_margins(b, h, n), _over(t * t, h * (n - h) * b * (n - b))).otherwise(0.0)


def information_gain(s, b, h, n):
    """In bits."""
    def cell(x, r, c):
        return F.when(x > 0, x / n * F.log2(_over(x * n, r * c))).otherwise(0.0)

    total = cell(s, b, h) + cell(b - s, b, n - h) + cell(h - s, n - b, h) + cell(n - b - h + s, n - b, n - h)
    return F.when(_margins(b, h, n), total).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return x.map(lambda v: special.chi2_q(v, 1)).astype(float)


def chi2_pvalue(s, b, h, n):
    return chi2_tail(chi2(s, b, h, n) * n)


def yates_pvalue(s, b, h, n):
    return chi2_tail(chi2_yates(s, b, h, n) * n)


def info_pvalue(s, b, h, n):
    return chi2_tail(2 * float(np.log(2)) * n * information_gain(s, b, h, n))


def _exact(f: Callable[[float, float, float, float], float]) -> Callable:
    @F.pandas_udf(T.DoubleType())
    def udf(s: pd.Series, b: pd.Series, h: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([f(*x) for x in zip(s, b, h, n)], dtype=float)

    return lambda s, b, h, n: udf(s.cast("double"), b.cast("double"), h.cast("double"), n.cast("double"))


fisher_probability = _exact(special.fisher_probability)
fisher_chi2 = _exact(special.fisher_chi2)
fisher_information = _exact(special.fisher_information)
fisher_support = _exact(special.fisher_support)

#: code: (measure, True if larger values are better)
MEASURES: dict[str, tuple[Callable, bool]] = {
    "x": (none, True),
    "o": (support, True),
    "c": (confidence, True),
    "d": (confidence_difference, True),
    "l": (lift, True),
    "a": (lift_difference, True),
    "q": (lift_quotient, True),
    "v": (conviction, True),
    "e": (conviction_difference, True),
    "r": (conviction_quotient, True),
    "k": (odds_ratio_like, True),
    "j": (log_odds, True),
    "z": (certainty, True),
    "n": (chi2, True),
    "p": (chi2_pvalue, False),
    "y": (chi2_yates, True),
    "t": (yates_pvalue, False),
    "i": (information_gain, True),
    "g": (info_pvalue, False),
    "f": (fisher_probability, False),
    "h": (fisher_chi2, False),
    "m": (fisher_information, False),
    "s": (fisher_support, False),
}


def measure(code: str, s: Column, b: Column, h: Column, n: Column, invalidate: bool = False) -> Column:
    """The measure; with ``invalidate`` the worst value where the support is no more than expected."""
    f, larger = MEASURES[code]
    value = f(s, b, h, n)
    return F.when(s * n <= h * b, 0.0 if larger else 1.0).otherwise(value) if invalidate else value


def passes(code: str, value: Column, threshold: float) -> Column:
    """Whether a value is at least as good as a threshold."""
    return value >= threshold if MEASURES[code][1] else value <= threshold


def log_quotient(s: Column, n: Column, frequencies: Column) -> Column:
    """log2 of the support quotient of a set over independent items; 0 for at most one item."""
    parts = F.aggregate(frequencies, F.lit(0.0), lambda acc, f: acc + F.log2(f / n))
    return F.when(F.size(frequencies) <= 1, 0.0).otherwise(F.log2(s / n) - parts)
