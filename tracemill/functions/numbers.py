"""Scalar expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tidy(x: Column | str, digits: int = 4) -> Column:
    """Rounded, and never minus zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def rounded(x: Column | str, digits: int = 4) -> Column:
    """As tidy, by the SQL engine's arithmetic (half away from zero after the product), a small part of F.round's time; for numbers of up to 15 digits then."""
    x = F.col(x) if isinstance(x, str) else x
    up = F.abs(x) * 10.0**digits
    return F.signum(x) * (F.floor(up) + F.when(up - F.floor(up) >= 0.5, 1).otherwise(0)) / 10.0**digits + F.lit(0.0)


@F.pandas_udf(T.DoubleType())
def ln(x: pd.Series) -> pd.Series:
    """Natural logarithm as the C library rounds it, so as the SQL engine does; F.ln differs from it in the last bit of some values."""
    return pd.Series([math.log(v) if v > 0 else None for v in x], dtype="float64")


def sigma(mean: Column, gain: float = 1.0, exponent: float = 1.0) -> Column:
    """Expected deviation of a Poisson-like signal; the mean counts as 3 at least."""
    floor = F.greatest(mean, F.lit(3.0))
    return F.sqrt(gain * (floor if exponent == 1.0 else F.pow(floor, F.lit(exponent))))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate over rows with both; null if one of them does not vary."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread))


def hill(x: Column, h: float = 2.0, xc: float = 4.0) -> Column:
    """Hill curve scaled to 0.03 .. 0.97."""
    r = F.pow(x / xc, F.lit(h))
    return r / (1 + r) * 0.94 + 0.03


def t_quantile(p: float, free: Column) -> Column:
    """Quantile of Student's t by the expansion around the normal one; error under 0.002 from 5 degrees of freedom."""
    z = NormalDist().inv_cdf(p)
    terms = (
        (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    return sum((F.lit(t) / F.pow(free, F.lit(k + 1)) for k, t in enumerate(terms)), F.lit(z))


def normal_tail(z: Column) -> Column:
    """P(Z >= z) for z of either sign by a rational approximation, error under 1e-7."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)
