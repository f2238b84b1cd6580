"""Distribution tail probabilities for test statistics.

The Kolmogorov series is a plain Column expression (`aggregate` over a `sequence`), so KS
p-values stay JVM-side. Chi-square and Student-t tails need the regularised incomplete gamma /
beta functions, which Spark lacks; they run as Arrow pandas UDFs and are only ever applied to
result-sized tables (one row per feature or test), never to raw rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kolmogorov_sf(z: Column, terms: int = 100) -> Column:
    """Q(z) = 2 sum_{k>=1} (-1)^(k-1) exp(-2 k^2 z^2), the asymptotic KS tail (kstwobign.sf)."""
    z = z.cast("double")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(-2.0 * k * k * z * z))
    return F.when(z.isNull(), F.lit(None).cast("double")).when(z < 0.27, F.lit(1.0)) \
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))


# --------------------------------------------------------------- scalar numerics (driver or in-task)
def _gammainc_lower_series(a: float, x: float) -> float:
    term = 1.0 / a
    s = term
    n = a
    for _ in range(1000):
        n += 1.0
        term *= x / n
        s += term
        if abs(term) < abs(s) * 1e-15:
            break
    return s * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gammainc_upper_cf(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf_scalar(x: float, dof: float) -> float:
    """P(X > x) for X ~ chi2(dof): regularised upper incomplete gamma Q(dof/2, x/2)."""
    if x is None or dof is None or dof <= 0 or (isinstance(x, float) and math.isnan(x)):
        return float("nan")
    if math.isinf(x):
        return 0.0
    if x <= 0:
        return 1.0
    a, h = dof / 2.0, x / 2.0
    if h < a + 1.0:
        return max(0.0, min(1.0, 1.0 - _gammainc_lower_series(a, h)))
    return max(0.0, min(1.0, _gammainc_upper_cf(a, h)))


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, 1000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return h


def betainc_scalar(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1.0 - x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_sf_two_sided_scalar(t: float, df: float) -> float:
    """Two-sided p of Student's t: I_{df/(df+t^2)}(df/2, 1/2)."""
    if t is None or df is None or df <= 0 or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return max(0.0, min(1.0, betainc_scalar(df / 2.0, 0.5, df / (df + t * t))))


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf_scalar(float(a), float(b)) if pd.notna(a) and pd.notna(b) else np.nan
                      for a, b in zip(x, dof)])


@F.pandas_udf(T.DoubleType())
def t_sf_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_sf_two_sided_scalar(float(a), float(b)) if pd.notna(a) and pd.notna(b) else np.nan
                      for a, b in zip(t, df)])


@F.pandas_udf(T.DoubleType())
def erfc_udf(x: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(float(v)) if pd.notna(v) else np.nan for v in x])
