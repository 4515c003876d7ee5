"""Tails of distributions as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def erfc(x: Column) -> Column:
    """The complementary error function, to 1.2e-7 relative, by the Chebyshev fit of Numerical Recipes (erfcc)."""
    # The fit's coefficients, lowest first.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    z = F.abs(x)
    t = 1 / (1 + 0.5 * z)
    s = F.lit(c[-1])
    for a in reversed(c[:-1]):
        s = s * t + a
    y = t * F.exp(-z * z + s)
    return F.when(x >= 0, y).otherwise(2 - y)


def normal_sf(x: Column) -> Column:
    return 0.5 * erfc(x / math.sqrt(2))


def chi2_sf(x: Column, df: Column) -> Column:
    """Wilson and Hilferty's normal approximation of the chi-square tail."""
    k = 2 / (9 * df)
    return normal_sf((F.pow(x / df, 1 / 3) - (1 - k)) / F.sqrt(k))


def holm(p: Column, rank: Column, n: Column) -> Column:
    """Holm's step-down value of the p of a rank (from 1); running maxima over ranks complete it."""
    return F.least(F.lit(1.0), p * (n - rank + 1))
