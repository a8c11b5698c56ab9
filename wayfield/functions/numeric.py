"""Column helpers for missing values, guarded division, binning and correlation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN means missing: turn it into NULL so that aggregates skip it."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def ratio(a: str | Column, b: str | Column) -> Column:
    """``a / b``, NULL when ``b`` is zero (plain division raises under ANSI mode)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def percent(a: str | Column, b: str | Column) -> Column:
    return ratio(col(a) * F.lit(100.0), b)


def hypot2(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def r2(sse: Column, sst: Column) -> Column:
    """Coefficient of determination from sums of squares, never below 0; 0 for a constant target."""
    return F.when(sst > 0, F.greatest(F.lit(0.0), F.lit(1.0) - F.try_divide(sse, sst))).otherwise(F.lit(0.0))


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation as an aggregate; NULL when a side is constant (``corr`` raises under ANSI mode)."""
    a, b = col(a).cast("double"), col(b).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), F.when(spread > 1e-300, spread))


def corr_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from pairwise sums; 0 where it is undefined."""
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    # a constant column leaves only rounding noise in n*sxx - sx*sx
    flat = (vx <= F.abs(n * sxx) * 1e-12) | (vy <= F.abs(n * syy) * 1e-12)
    return F.when(flat | (n < 2), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(n * sxy - sx * sy, F.sqrt(vx) * F.sqrt(vy)), F.lit(0.0))
    )


def bin_of(v: str | Column, lo: float | Column, step: float | Column) -> Column:
    """0-based index of the half-open bin ``[lo + i*step, lo + (i+1)*step)``."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    step = step if isinstance(step, Column) else F.lit(float(step))
    return F.floor(F.try_divide(col(v).cast("double") - lo, step)).cast("int")


def degrees_from(y: Column, x: Column) -> Column:
    return F.degrees(F.atan2(y, x))
