"""Null-safe column arithmetic shared by all operators."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Num = int | float


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where the denominator is zero (ANSI division would raise)."""
    return F.try_divide(col(a), col(b))


def log_ratio(a: str | Column, b: str | Column) -> Column:
    return F.ln(ratio(a, b))


def clip(x: str | Column, lo: Num | Column | None = None, hi: Num | Column | None = None) -> Column:
    """Bound a column; NULL stays NULL (greatest/least would skip it)."""
    x = col(x)
    out = x
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(float(hi)))
    return F.when(x.isNotNull(), out)


def finite(x: str | Column) -> Column:
    """NaN and infinities become NULL."""
    x = col(x)
    bad = F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return F.when(~bad, x)


def r6(x: str | Column, digits: int = 6) -> Column:
    return F.round(col(x).cast("double"), digits)


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)), na_action="ignore")


def _beta_fraction(a: float, b: float, x: float) -> float:
    # Continued fraction of the incomplete beta function (modified Lentz scheme).
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 300):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def student_two_sided(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    if not math.isfinite(t) or dof <= 0:
        return float("nan")
    x = dof / (dof + t * t)
    a, b = dof / 2.0, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([
        None if pd.isna(a) or pd.isna(b) else student_two_sided(float(a), float(b))
        for a, b in zip(t, dof)
    ], dtype="float64")
