"""Circular arithmetic as column expressions. Angles are degrees unless a period is given."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col


def wrap_angle(a: str | Column, period: float = 360.0, symmetric: bool = True) -> Column:
    """Wrap to ``[-period/2, period/2)`` or, not symmetric, to ``[0, period)``."""
    a = col(a).cast("double")
    p = F.lit(float(period))
    if symmetric:
        return F.pmod(a + p / 2, p) - p / 2
    return F.pmod(a, p)


def angle_difference(a: str | Column, b: str | Column, period: float = 360.0) -> Column:
    return wrap_angle(col(a) - col(b), period)


def _turn(a: str | Column, period: float) -> Column:
    return col(a).cast("double") * F.lit(2 * math.pi / period)


def resultant(a: str | Column, period: float = 360.0) -> Column:
    """Aggregate: mean resultant length R."""
    t = _turn(a, period)
    return F.sqrt(F.pow(F.avg(F.cos(t)), 2) + F.pow(F.avg(F.sin(t)), 2))


def circular_mean(a: str | Column, w: str | Column | None = None, period: float = 360.0, symmetric: bool = True) -> Column:
    """Aggregate: weighted circular mean, NULL when the weighted vectors cancel."""
    t = _turn(a, period)
    weight = F.lit(1.0) if w is None else col(w).cast("double")
    s, c = F.sum(weight * F.sin(t)), F.sum(weight * F.cos(t))
    mean = F.atan2(s, c) * F.lit(period / (2 * math.pi))
    return F.when((F.abs(s) < 1e-8) & (F.abs(c) < 1e-8), F.lit(None)).otherwise(wrap_angle(mean, period, symmetric))


def circular_std(a: str | Column, period: float = 360.0, degrees: bool = True) -> Column:
    """Aggregate: ``sqrt(-2 ln R)``. Degrees are of the full circle whatever the period is."""
    r = resultant(a, period)
    scale = 360.0 / (2 * math.pi) if degrees else 1.0
    return (
        F.when(r <= 0, F.lit(float("inf")))
        .when(r >= 1, F.lit(0.0))
        .otherwise(F.sqrt(F.lit(-2.0) * F.ln(r)) * F.lit(scale))
    )


def circular_variance(a: str | Column, period: float = 360.0) -> Column:
    return F.lit(1.0) - resultant(a, period)
