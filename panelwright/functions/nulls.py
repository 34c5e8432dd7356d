"""Arithmetic in which a missing value is NULL and nothing else: no NaN, no infinity, no error on zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def sdiv(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def slog(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log1p(x: Column) -> Column:
    return F.when(x > -1, F.log1p(x))


def expm1(x: Column) -> Column:
    return F.expm1(nmax(nmin(x, F.lit(700.0)), F.lit(-700.0)))


def ssqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def _all(*xs: Column) -> Column:
    return reduce(lambda a, b: a & b, (x.isNotNull() for x in xs))


def nmax(*xs: Column) -> Column:
    """The greatest, NULL where any is; Spark's greatest skips NULLs."""
    return F.when(_all(*xs), F.greatest(*xs))


def nmin(*xs: Column) -> Column:
    return F.when(_all(*xs), F.least(*xs))


def sign(x: Column) -> Column:
    return F.signum(x)
