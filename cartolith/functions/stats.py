"""Statistics that Spark has no function for."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def skew_corrected(x) -> Column:
    """Sample skewness, corrected for bias; null below three values."""
    n = F.count(_c(x))
    return F.when(n > 2, F.skewness(_c(x)) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_corrected(x) -> Column:
    """Sample excess kurtosis, corrected for bias; null below four values."""
    n = F.count(_c(x))
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)).cast("double") * ((n + 1) * F.kurtosis(_c(x)) + 6))


def slope_stderr(y, x) -> Column:
    """Standard error of the slope of y over x."""
    n = F.count(_c(y))
    r2 = F.regr_r2(_c(y), _c(x))
    return F.when(n > 2, F.sqrt(F.greatest(F.lit(0.0), (1 - r2) * F.regr_syy(_c(y), _c(x)) / F.nullif(F.regr_sxx(_c(y), _c(x)), F.lit(0.0)) / (n - 2))))


def median(x) -> Column:
    return F.percentile(_c(x), F.lit(0.5))


def quantile(x, p: float) -> Column:
    return F.percentile(_c(x), F.lit(p))


def normal_two_sided(z) -> float | None:
    """2 * (1 - Phi(|z|))."""
    return None if z is None or z != z else math.erfc(abs(z) / math.sqrt(2))


def student_two_sided(t: float | None, df: float | None) -> float | None:
    """Two-sided p of Student's t by the incomplete beta function's continued fraction."""
    if t is None or df is None or t != t or df <= 0:
        return None
    if math.isinf(t):
        return 0.0
    return _beta(df / (df + t * t), df / 2, 0.5)


def _beta(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    tiny, d, c = 1e-300, 1 - (a + b) * x / (a + 1), 1.0
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


def _normal(z: pd.Series) -> pd.Series:
    return z.map(normal_two_sided).astype("float64")


def _student(t: pd.Series, df: pd.Series) -> pd.Series:
    none = lambda v: None if v is None or v != v else float(v)
    return pd.Series([student_two_sided(none(a), none(b)) for a, b in zip(t, df, strict=True)], dtype="float64")


def normal_p(z) -> Column:
    """For one aggregated row or a few."""
    return F.pandas_udf(_normal, "double")(_c(z))


def student_p(t, df) -> Column:
    """For one aggregated row or a few."""
    return F.pandas_udf(_student, "double")(_c(t), _c(df))
