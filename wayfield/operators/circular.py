"""Circular statistics over tables and polar maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfield.functions.angles import circular_mean, circular_std, circular_variance
from wayfield.functions.numeric import hypot2, ratio
from wayfield.plans.ordered import quantiles


def circular_stats(df: DataFrame, keys: Sequence[str], angle: str, weight: str | None = None, period: float = 360.0) -> DataFrame:
    """Circular mean (weighted if asked), standard deviation and variance per group."""
    return df.groupBy(*keys).agg(
        circular_mean(angle, weight, period).alias("circ_mean"), circular_std(angle, period).alias("circ_std"),
        circular_variance(angle, period).alias("circ_var"),
    )


def rayleigh_vector(df: DataFrame, keys: Sequence[str], radius: str, angle: str) -> DataFrame:
    """Resultant of radii normalised to a sum of 1; a negative radius points the other way. Angle in (-180, 180]."""
    t = F.radians(F.col(angle) + F.when(F.col(radius) < 0, F.lit(180.0)).otherwise(F.lit(0.0)))
    r = F.abs(F.col(radius).cast("double"))
    total = F.sum(r)
    x, y = F.try_divide(F.sum(r * F.cos(t)), total), F.try_divide(F.sum(r * F.sin(t)), total)
    return df.groupBy(*keys).agg(hypot2(x, y).alias("rv_length"), F.degrees(F.atan2(y, x)).alias("rv_angle"))


def rayleigh_aggs(tuning: str | Column, angle: str | Column, prefix: str = "rayleigh") -> list[Column]:
    """Aggregates R and angle in [0, 360) of a tuning curve clipped at 0; NULL without mass."""
    v = F.greatest(F.col(tuning) if isinstance(tuning, str) else tuning, F.lit(0.0))
    t = F.radians(F.col(angle) if isinstance(angle, str) else angle)
    x, y, mass = F.sum(v * F.cos(t)), F.sum(v * F.sin(t)), F.sum(v)
    return [
        F.when(mass > 0, F.try_divide(hypot2(x, y), mass)).alias(f"{prefix}_r"),
        F.when(mass > 0, F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))).alias(f"{prefix}_angle"),
    ]


def rayleigh(df: DataFrame, keys: Sequence[str], tuning: str, angle: str) -> DataFrame:
    return df.groupBy(*keys).agg(*rayleigh_aggs(tuning, angle))


def rayleigh_stats(polar: DataFrame, keys: Sequence[str], distance: str = "db", angle: str = "angle", value: str = "value") -> DataFrame:
    """Peak bin of a polar map and the Rayleigh statistics of the peak's ring and of all rings together.

    Of equal peaks the first in (distance, angle) order counts. Bins the map does not have add nothing.
    """
    keys = list(keys)
    peak = polar.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.max(F.struct(F.col(value), (-F.col(distance)).alias("d"), (-F.col(angle)).alias("a"))).alias("_p")
    ).select(*keys, F.col(f"_p.{value}").alias("peak_value"), (-F.col("_p.d")).alias("peak_distance"), (-F.col("_p.a")).alias("peak_angle"))
    ring = polar.join(peak, keys).filter(F.col(distance) == F.col("peak_distance"))
    at_peak = ring.groupBy(*keys).agg(*rayleigh_aggs(value, angle, "ring"))
    at_peak = at_peak.withColumnsRenamed({"ring_r": "peak_r", "ring_angle": "peak_angle_rv"})
    per_angle = polar.groupBy(*keys, angle).agg(F.sum(value).alias("_v"))
    collapsed = per_angle.groupBy(*keys).agg(*rayleigh_aggs("_v", angle, "collapsed"), F.max("_v").alias("peak_collapsed"))
    return peak.join(at_peak, keys).join(collapsed, keys)


def polar_to_xy(df: DataFrame, angles: dict[str, float], x: str = "x", y: str = "y", hd: str | None = None, keep: Sequence[str] = (), delta: float = 0.0) -> DataFrame:
    """End point of each distance ray: ``angles`` maps distance columns to degrees; egocentric rays subtract heading."""
    rays = df.select(
        *keep, x, y, *([hd] if hd else []),
        F.explode(F.array(*[F.struct(F.lit(float(a) + delta).alias("angle"), F.col(c).cast("double").alias("distance")) for c, a in angles.items()])).alias("_r"),
    )
    t = F.radians(F.col("_r.angle") - F.col(hd)) if hd else F.radians(F.col("_r.angle"))
    return rays.select(
        *keep, F.col("_r.angle").alias("angle"),
        (F.col(x) + F.col("_r.distance") * F.cos(t)).alias("px"), (F.col(y) + F.col("_r.distance") * F.sin(t)).alias("py"),
    )


def gradient01(df: DataFrame, kind: str, keys: Sequence[str] = (), x: str = "x", y: str = "y", bounds: tuple[float, float] | None = None, out: str = "gradient") -> DataFrame:
    """Position on a 0-to-1 gradient along x (``horizontal``), y (``vertical``) or the distance from the half extent
    (``radial``). With ``bounds`` the range is fixed and values are clipped; else it is the group's own."""
    if bounds is not None:
        lo, hi = bounds
        v = F.col({"horizontal": x, "vertical": y}[kind])
        unit = (v - lo) / (hi - lo) if hi > lo else F.lit(0.0)
        return df.withColumn(out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), unit)))
    keys = list(keys)
    one = [] if keys else ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(0))
    by = keys or one
    if kind == "radial":
        half = base.groupBy(*by).agg(((F.max(x) - F.min(x)) / 2).alias("_mx"), ((F.max(y) - F.min(y)) / 2).alias("_my"))
        base = base.join(half, by).withColumn("_g", hypot2(F.col(x) - F.col("_mx"), F.col(y) - F.col("_my"))).drop("_mx", "_my")
    else:
        base = base.withColumn("_g", F.col({"horizontal": x, "vertical": y}[kind]))
    span = base.groupBy(*by).agg(F.min("_g").alias("_lo"), F.max("_g").alias("_hi"))
    return base.join(span, by).withColumn(out, F.try_divide(F.col("_g") - F.col("_lo"), F.col("_hi") - F.col("_lo"))).select(*df.columns, out)


def threshold_value(maps: DataFrame, keys: Sequence[str], kind: str, level: float = 0.9, value: str = "value") -> DataFrame:
    """Threshold of each map from its positive bins; infinite where no bin is positive."""
    keys = list(keys)
    positive = F.when(F.col(value) > 0, F.col(value))
    base = maps.groupBy(*keys).agg(F.max(positive).alias("_max"), F.avg(positive).alias("_mean"))
    if kind == "percentile":
        q = quantiles(maps.filter(F.col(value) > 0), keys, {"_q": (value, level)})
        base = base.join(q, keys, "left")
        pick = F.col("_q")
    else:
        pick = {"absolute": F.lit(float(level)), "percent": F.col("_max") * level, "mean": F.col("_mean")}[kind]
    return base.select(*keys, F.when(F.col("_max").isNull(), F.lit(float("inf"))).otherwise(pick).alias("threshold"))


def log_ratio_map(new: DataFrame, old: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """``ln(new / old)`` per bin of both maps; NULL where the old value is 0 or the ratio not positive."""
    both = new.withColumnRenamed(value, "_new").join(old.withColumnRenamed(value, "_old"), list(on))
    q = F.try_divide("_new", "_old")
    return both.select(*on, F.when(q > 0, F.ln(q)).alias("log_ratio"))


def minmax_map(maps: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Scale each map to [0, 1]; a flat map stays as it is."""
    span = maps.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).otherwise(F.col(value))
    return maps.join(span, list(keys)).withColumn(value, scaled).drop("_lo", "_hi")


def polar_error(true: DataFrame, calc: DataFrame, on: Sequence[str], room: str, angles: dict[str, float]) -> DataFrame:
    """MAE and RMSE of calculated wall distances over all, per angle, per room and per both; negative means no hit.

    ``level`` says what a row is over; absent angle is -1 and absent room ``all``.
    """
    def long(df: DataFrame, name: str) -> DataFrame:
        items = F.array(*[F.struct(F.lit(float(a)).alias("angle"), F.col(c).cast("double").alias(name)) for c, a in angles.items()])
        cols = [*on, *([room] if room in df.columns and name == "t" else [])]
        return df.select(*cols, F.explode(items).alias("_s")).select(*cols, f"_s.angle", f"_s.{name}")

    both = long(true, "t").join(long(calc, "c"), [*on, "angle"]).filter("t >= 0 and c >= 0")
    d = F.col("c") - F.col("t")
    # the finest level once; the coarser ones add up its sums
    fine = both.groupBy(room, "angle").agg(F.sum(F.abs(d)).alias("_a"), F.sum(d * d).alias("_s"), F.count(F.lit(1)).alias("n"))
    sets = fine.groupingSets([[], ["angle"], [room], [room, "angle"]], room, "angle").agg(
        F.sum("n").alias("n"), F.sum("_a").alias("_a"), F.sum("_s").alias("_s"), F.grouping_id().alias("level")
    )
    return sets.select(
        F.coalesce(room, F.lit("all")).alias("room"), F.coalesce("angle", F.lit(-1.0)).alias("angle"), "n",
        ratio("_a", "n").alias("mae"), F.sqrt(ratio("_s", "n")).alias("rmse"), F.col("level").cast("int"),
    )


def sentinel_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Negative (no hit) entries over the listed columns: count and share."""
    n = sum((F.when(F.col(c) < 0, 1).otherwise(0) for c in columns), F.lit(0))
    return df.groupBy(*keys).agg(
        F.sum(n).alias("n_negative"), (F.sum(n) * 100.0 / (F.count(F.lit(1)) * len(columns))).alias("pct_negative")
    )
