"""Expressions on ARRAY<DOUBLE> rows and on normal distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once a row; in a lambda, an outer expression is worked out for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(x: Column) -> Column:
    """The row at unit length; NaN counts as 0, an all-zero row stays."""
    return bound(_clean(x), lambda y: bound(_norm(y), lambda n: F.transform(y, lambda v: v / n)))


def length(x: Column) -> Column:
    """What ``unit`` divides a row by."""
    return bound(_clean(x), _norm)


def _clean(x: Column) -> Column:
    return F.transform(x, lambda v: F.nanvl(v.cast("double"), F.lit(0.0)))


def _norm(y: Column) -> Column:
    return F.greatest(F.sqrt(dot(y, y)), F.lit(1e-12))


def logit_of_cosine(c: Column) -> Column:
    """Log-odds of (c + 1) / 2, clipped to [1e-4, 1 - 1e-4]."""
    p = F.least(F.greatest((c + 1.0) * 0.5, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.ln(p) - F.log1p(-p)


def log_density(x: Column, mean: Column, scale: Column) -> Column:
    return -0.5 * F.pow((x - mean) / scale, F.lit(2.0)) - F.ln(scale) - 0.5 * math.log(2 * math.pi)


# Coefficients of the rational approximation 7.1.26 of Abramowitz and Stegun.
ERFC = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERFC_P = 0.3275911


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, to about 1e-7."""
    a = F.abs(z) / math.sqrt(2)
    t = 1.0 / (1.0 + ERFC_P * a)
    poly = F.lit(0.0)
    for c in reversed(ERFC):
        poly = (poly + c) * t
    tail = 0.5 * poly * F.exp(-a * a)
    return F.when(z >= 0, tail).otherwise(1.0 - tail)
