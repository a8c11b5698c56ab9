"""Small report tables: grouped scores, histograms, intersections and funnels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfield.functions.numeric import percent
from wayfield.operators.circular import gradient01
from wayfield.plans.ordered import quantiles


def group_stats(df: DataFrame, keys: Sequence[str], values: Sequence[str], sample: bool = True, half: bool = False) -> DataFrame:
    """Mean and standard deviation (sample or population, halved if asked) of several columns per group."""
    out = []
    for v in values:
        std = (F.stddev_samp if sample else F.stddev_pop)(v)
        out += [F.avg(v).alias(f"{v}_mean"), (std / 2 if half else std).alias(f"{v}_std")]
    return df.groupBy(*keys).agg(*out)


def value_extrema_by(df: DataFrame, by: str, score: str) -> DataFrame:
    return df.groupBy(by).agg(F.min(score).alias("lowest"), F.max(score).alias("highest"))


def median_by_size(subsets: DataFrame, size: str = "size", score: str = "r2") -> DataFrame:
    return quantiles(subsets, [size], {"median": (score, 0.5)})


def participation_counts(subsets: DataFrame, size: str = "size", cells: str = "cells", baseline: str = "is_baseline") -> DataFrame:
    """How often each cell takes part in subsets of each size; baselines do not count."""
    rows = subsets.filter(~F.col(baseline)).select(size, F.explode(cells).alias("cell"))
    return rows.groupBy(size, "cell").agg(F.count(F.lit(1)).alias("n"))


def score_histogram(df: DataFrame, keys: Sequence[str], score: str = "r2", bins: int = 20, baseline: str | None = "is_baseline") -> DataFrame:
    """Counts of scores, clipped at 0, in equal bins on [0, 1], the last one closed. Scores above 1 are out."""
    rows = df.filter(F.col(score).isNotNull())
    if baseline:
        rows = rows.filter(~F.col(baseline))
    v = F.greatest(F.lit(0.0), F.col(score))
    rows = rows.withColumn("_v", v).filter(F.col("_v") <= 1)
    place = F.least(F.floor(F.col("_v") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts over equal bins with their centres, empty bins included; the last bin is closed."""
    width = (hi - lo) / bins
    place = F.when(F.col(value) == hi, F.lit(bins - 1)).otherwise(F.floor((F.col(value) - lo) / width)).cast("int")
    counted = df.filter(F.col(value).between(lo, hi)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    centre = F.lit(lo) + (F.col("bin") + 0.5) * width
    return every.join(counted, "bin", "left").select("bin", centre.alias("centre"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram_limit(df: DataFrame, value: str, threshold: float, factor: float = 2.0, q: float = 0.995) -> DataFrame:
    """Upper limit of a histogram: the larger of ``factor * threshold`` and the ``q`` quantile."""
    return quantiles(df, [], {"_q": (value, q)}).select(F.greatest(F.lit(float(factor * threshold)), F.col("_q")).alias("hi"))


def flag_intersections(units: DataFrame, flags: Sequence[str], min_count: int = 1) -> DataFrame:
    """Exclusive combinations of flags with their counts; ``No_Class`` where no flag is set."""
    names = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags]))
    label = F.when(F.size(names) == 0, F.lit("No_Class")).otherwise(F.array_join(names, " & "))
    return units.groupBy(label.alias("combination")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def filter_funnel(units: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Node and flow counts of a chain of filters.

    ``kind`` node: units that pass or fail a stage, with their share. ``kind`` flow: units by status at a stage, status
    at the next and final outcome. One pass over the units and one over their (few) status combinations.
    """
    names = list(stages)
    status = {f"_s{i}": F.when(F.coalesce(c, F.lit(False)), "pass").otherwise("fail") for i, c in enumerate(stages.values())}
    combos = units.withColumns(status).groupBy(*status).agg(F.count(F.lit(1)).alias("_n"))
    kept = reduce(lambda a, b: a & b, [F.col(s) == "pass" for s in status])
    combos = combos.withColumn("_kept", kept)
    none = F.lit(None).cast("string")
    items = [
        F.struct(F.lit("node").alias("kind"), F.lit(n).alias("stage"), F.col(f"_s{i}").alias("status"), none.alias("next_status"), F.lit(None).cast("boolean").alias("kept"))
        for i, n in enumerate(names)
    ]
    items += [
        F.struct(F.lit("flow").alias("kind"), F.lit(names[i]).alias("stage"), F.col(f"_s{i}").alias("status"), F.col(f"_s{i + 1}").alias("next_status"), F.col("_kept").alias("kept"))
        for i in range(len(names) - 1)
    ]
    rows = combos.select(F.explode(F.array(*items)).alias("_i"), "_n")
    out = rows.groupBy("_i.kind", "_i.stage", "_i.status", "_i.next_status", "_i.kept").agg(F.sum("_n").alias("n"))
    # every unit is at every stage once, so a stage's rows add up to all units; the table has a few rows per stage
    whole = F.sum("n").over(W.partitionBy("kind", "stage"))
    return out.withColumn("pct", percent("n", whole))


def room_pair_separation(df: DataFrame, rooms: Sequence[str], pair: str = "room_pair", rate: str = "rate") -> DataFrame:
    """Mean rate per room pair as a square matrix: each pair fills both of its places."""
    stats = df.groupBy(pair).agg(F.avg(rate).alias("mean"), F.stddev_samp(rate).alias("std"))
    ends = F.split(pair, "_")
    one = stats.select(F.get(ends, F.lit(0)).alias("room"), F.get(ends, F.lit(1)).alias("other"), "mean", "std")
    both = one.unionByName(one.select(F.col("other").alias("room"), F.col("room").alias("other"), "mean", "std")).distinct()
    cells = [F.max(F.when(F.col("other") == r, F.col("mean"))).alias(f"to_{i}") for i, r in enumerate(rooms)]
    return both.groupBy("room").agg(*cells)


def room_pair_stats(df: DataFrame, pair: str = "room_pair", rate: str = "rate") -> DataFrame:
    return df.groupBy(pair).agg(F.avg(rate).alias("mean"), F.stddev_samp(rate).alias("std"), F.count(F.lit(1)).alias("n"))


def offset_all_room(scores: DataFrame, keys: Sequence[str] = (), offset: str = "offset_no", room: str = "room") -> DataFrame:
    """Per offset, the mean over single rooms: R2, and the root of the mean mse."""
    single = scores.filter(F.col(room) != "All")
    return single.groupBy(*keys, offset).agg(F.avg("r2_pooled").alias("r2"), F.sqrt(F.avg("mse")).alias("rmse"))


def axis_stretch(points: DataFrame, keys: Sequence[str], direction: tuple[float, float], x: str = "x", y: str = "y") -> DataFrame:
    """Variance (population) and extent of the points along a direction; centring changes neither."""
    length = (direction[0] ** 2 + direction[1] ** 2) ** 0.5
    along = F.col(x) * (direction[0] / length) + F.col(y) * (direction[1] / length)
    return points.groupBy(*keys).agg(F.var_pop(along).alias("variance"), (F.max(along) - F.min(along)).alias("extent"))


W_SHIFT = 1e-9  # fixed value: keeps the homogeneous divide finite


def colour_field(nodes: DataFrame, maps: DataFrame, keys: Sequence[str] = ("room",), kind: str = "horizontal") -> DataFrame:
    """Grid nodes of each room with their gradient value and their image under the room's map."""
    shaded = gradient01(nodes, kind, keys)
    joined = shaded.join(maps.select(*keys, "a", "b", F.col("tx").alias("_tx"), "c", "d", F.col("ty").alias("_ty")), list(keys))
    u = (F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("_tx")) / (1 + W_SHIFT)
    v = (F.col("c") * F.col("x") + F.col("d") * F.col("y") + F.col("_ty")) / (1 + W_SHIFT)
    return joined.withColumns({"u": u, "v": v}).drop("a", "b", "_tx", "c", "d", "_ty")
