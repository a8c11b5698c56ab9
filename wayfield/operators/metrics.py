"""Decoder scores: regression metrics per fold, offset and room, and their roll-ups.

Everything is built from sums that combine map-side, so a metric table costs one shuffle of partial sums per
grouping, whatever the number of frames behind one group is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfield.functions.numeric import r2, ratio

ROUND = 5


def _complete(df: DataFrame, axes: Mapping[str, tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for t, p in axes.values():
        cond = cond & F.col(t).isNotNull() & F.col(p).isNotNull()
    return cond


def regression_aggs(axes: Mapping[str, tuple[str, str]], where: Column | None = None) -> list[Column]:
    """Aggregates ``sse_<axis>``, ``sst_<axis>`` and ``n_samples`` over rows with every target and prediction."""
    out = []
    for name, (t, p) in axes.items():
        tc, pc = F.col(t), F.col(p)
        if where is not None:
            tc, pc = F.when(where, tc), F.when(where, pc)
        d = pc - tc
        out.append(F.coalesce(F.sum(d * d), F.lit(0.0)).alias(f"sse_{name}"))
        out.append(F.coalesce(F.count(tc) * F.var_pop(tc), F.lit(0.0)).alias(f"sst_{name}"))
    n = F.count(F.lit(1)) if where is None else F.count(F.when(where, F.lit(1)))
    return [*out, n.alias("n_samples")]


def scores_from_sums(df: DataFrame, axes: Sequence[str], mse: str = "distance") -> DataFrame:
    """Add ``r2_<axis>``, ``r2_pooled`` and ``mse`` to a table of sums.

    ``mse='distance'`` is the mean squared distance between the points, ``'axis_mean'`` divides it by the number of
    axes as well. It is rounded to five decimals.
    """
    if mse not in ("distance", "axis_mean"):
        raise ValueError("mse must be 'distance' or 'axis_mean'")
    sse = sum((F.col(f"sse_{a}") for a in axes), F.lit(0.0))
    sst = sum((F.col(f"sst_{a}") for a in axes), F.lit(0.0))
    n = F.col("n_samples") * (1 if mse == "distance" else len(axes))
    cols = {f"r2_{a}": r2(F.col(f"sse_{a}"), F.col(f"sst_{a}")) for a in axes}
    return df.withColumns(
        {**cols, "r2_pooled": r2(sse, sst), "mse": F.round(F.coalesce(ratio(sse, n), F.lit(0.0)), ROUND)}
    )


XY = {"x": ("x", "x_pred"), "y": ("y", "y_pred")}


def regression_metrics(
    df: DataFrame, keys: Sequence[str] = (), axes: Mapping[str, tuple[str, str]] = XY, mse: str = "distance"
) -> DataFrame:
    """One row of scores per group of ``keys`` (one row in all without keys)."""
    sums = df.groupBy(*keys).agg(*regression_aggs(axes, _complete(df, axes)))
    return scores_from_sums(sums, list(axes), mse)


def pooled_r2(df: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """R2 from the summed ``sse_*`` / ``sst_*`` columns of a score table."""
    sums = df.groupBy(*keys).agg(
        *[F.sum(f"sse_{a}").alias(f"sse_{a}") for a in axes], *[F.sum(f"sst_{a}").alias(f"sst_{a}") for a in axes]
    )
    sse = sum((F.col(f"sse_{a}") for a in axes), F.lit(0.0))
    sst = sum((F.col(f"sst_{a}") for a in axes), F.lit(0.0))
    return sums.withColumns({**{f"r2_{a}": r2(F.col(f"sse_{a}"), F.col(f"sst_{a}")) for a in axes}, "r2_pooled": r2(sse, sst)})


def pool_folds(scores: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Pool a fold-level score table over its folds and recompute R2 from the sums."""
    return pooled_r2(scores, keys, axes)


def stat_aggs(value: str | Column, name: str) -> list[Column]:
    """Aggregates ``<name>_mean``, ``_std`` (population) and ``_sem``; 0 for no values."""
    v = F.col(value) if isinstance(value, str) else value
    zero = F.lit(0.0)
    return [
        F.coalesce(F.avg(v), zero).alias(f"{name}_mean"),
        F.coalesce(F.stddev_pop(v), zero).alias(f"{name}_std"),
        F.coalesce(F.try_divide(F.stddev_pop(v), F.sqrt(F.count(v).cast("double"))), zero).alias(f"{name}_sem"),
    ]


def summary_stats(df: DataFrame, keys: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(*stat_aggs(value, name or value))


def decoder_offset_metrics(
    df: DataFrame,
    groups: Sequence[str] = ("project", "set_name", "room"),
    offset: str = "offset_no",
    fold: str = "fold",
    axes: Mapping[str, tuple[str, str]] = XY,
    mse: str = "distance",
) -> DataFrame:
    """Scores per (groups, offset, fold), and per (groups, offset) with ``fold`` NULL, from a single scan.

    ``n_folds`` is 1 on fold rows and the number of distinct folds on pooled rows. Only the fold level is computed
    from frames; the pooled level adds up the fold level's sums, count and moments, so no row is expanded twice.
    """
    complete = _complete(df, axes)
    moments = []
    for name, (t, p) in axes.items():
        tc = F.when(complete, F.col(t))
        d = F.when(complete, F.col(p) - F.col(t))
        moments += [
            F.coalesce(F.sum(d * d), F.lit(0.0)).alias(f"sse_{name}"),
            F.avg(tc).alias(f"_mean_{name}"),
            F.coalesce(F.count(tc) * F.var_pop(tc), F.lit(0.0)).alias(f"sst_{name}"),
        ]
    keys = [*groups, offset]
    per_fold = df.filter(F.col(groups[-1]) != "All").groupBy(*keys, fold).agg(
        *moments, F.count(F.lit(1)).alias("n_timestamps"), F.count(F.when(complete, F.lit(1))).alias("n_samples")
    )
    pooled_sums = [
        F.sum("n_timestamps").alias("n_timestamps"),
        F.sum("n_samples").alias("n_samples"),
        F.count(fold).alias("n_folds"),
    ]
    for name in axes:
        mean, n = F.col(f"_mean_{name}"), F.col("n_samples")
        # within-fold plus between-fold sums of squares
        between = F.sum(n * mean * mean) - F.try_divide(F.sum(n * mean) * F.sum(n * mean), F.sum(n))
        pooled_sums += [
            F.sum(f"sse_{name}").alias(f"sse_{name}"),
            (F.sum(f"sst_{name}") + F.coalesce(F.greatest(between, F.lit(0.0)), F.lit(0.0))).alias(f"sst_{name}"),
        ]
    both = with_summary(per_fold.withColumn("n_folds", F.lit(1).cast("bigint")), keys, {fold: F.lit(None)}, pooled_sums)
    return scores_from_sums(both.drop(*(f"_mean_{a}" for a in axes)), list(axes), mse)


def with_summary(rows: DataFrame, keys: Sequence[str], fixed: Mapping[str, Column], aggs: Sequence[Column]) -> DataFrame:
    """``rows``, and for each group one more row of ``fixed`` values and aggregates (NULL in other columns).

    For tables of few rows per group (folds, rooms): a group becomes one array with its summary at the end and is unfolded
    again, so ``rows`` is evaluated once.
    """
    grouped = rows.groupBy(*keys).agg(F.collect_list(F.struct(*rows.columns)).alias("_rows"), F.struct(*aggs).alias("_all"))
    made = {*grouped.schema["_all"].dataType.names}
    given = {**fixed, **{k: F.col(k) for k in keys}, **{c: F.col(f"_all.{c}") for c in made}}
    one = F.struct(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema))
    return grouped.select(F.inline(F.concat("_rows", F.array(one))))


def decoder_room_metrics(
    offset_scores: DataFrame,
    groups: Sequence[str] = ("project", "set_name"),
    room: str = "room",
    offset: str = "offset_no",
    fold: str = "fold",
    axes: Sequence[str] = ("x", "y"),
) -> DataFrame:
    """Per room, statistics over offsets of the pooled scores; then an ``All`` row per group.

    In the ``All`` row means are means of room means and the sums of squares are added up.
    """
    pooled = offset_scores.filter(F.col(fold).isNull() & (F.col(room) != "All"))
    totals = [
        F.max("n_folds").alias("n_folds"),
        F.countDistinct(offset).alias("n_offsets"),
        F.sum("n_timestamps").alias("n_timestamps_total"),
    ]
    sums = [F.sum(f"{s}_{a}").alias(f"{s}_{a}_total") for s in ("sse", "sst") for a in axes]
    rooms = pooled.groupBy(*groups, room).agg(
        *totals,
        *stat_aggs("r2_pooled", "r2_pooled"),
        *stat_aggs(F.sqrt("mse"), "rmse"),
        *[c for a in axes for c in stat_aggs(f"r2_{a}", f"r2_{a}")],
        *sums,
    )
    everything = [
        F.max("n_folds").alias("n_folds"),
        F.max("n_offsets").alias("n_offsets"),
        F.sum("n_timestamps_total").alias("n_timestamps_total"),
        *stat_aggs("r2_pooled_mean", "r2_pooled"),
        *stat_aggs("rmse_mean", "rmse"),
        *[c for a in axes for c in stat_aggs(f"r2_{a}_mean", f"r2_{a}")],
        *[F.sum(f"{s}_{a}_total").alias(f"{s}_{a}_total") for s in ("sse", "sst") for a in axes],
    ]
    both = with_summary(rooms, groups, {room: F.lit("All")}, everything)
    sse = sum((F.col(f"sse_{a}_total") for a in axes), F.lit(0.0))
    sst = sum((F.col(f"sst_{a}_total") for a in axes), F.lit(0.0))
    return both.withColumn("r2_pooled_across_offsets", r2(sse, sst))


def decoder_ensemble_metrics(
    df: DataFrame,
    groups: Sequence[str] = ("project", "set_name"),
    room: str = "room",
    row: str | Sequence[str] = "row_key",
    offset: str = "offset_no",
    fold: str = "fold",
    axes: Mapping[str, tuple[str, str]] = XY,
    mse: str = "distance",
) -> DataFrame:
    """Scores of the mean prediction over offsets, and an ``All`` row that is the plain mean of the rooms' scores.

    ``row`` names the column or columns that tell frames apart; numbers are cheaper than a text made of them.
    """
    known = df.filter(F.col(room) != "All")
    mean_rows = known.groupBy(*groups, room, *([row] if isinstance(row, str) else row)).agg(
        *[F.min_by(t, offset).alias(t) for t, _ in axes.values()],
        *[F.avg(p).alias(p) for _, p in axes.values()],
    )
    complete = _complete(mean_rows, axes)
    scores = mean_rows.groupBy(*groups, room).agg(
        *regression_aggs(axes, complete), F.count(F.lit(1)).alias("n_timestamps")
    )
    counts = known.groupBy(*groups, room, fold, offset).agg(F.lit(1)).groupBy(*groups, room).agg(
        F.countDistinct(fold).alias("n_folds"), F.countDistinct(offset).alias("n_offsets")
    )
    names = list(axes)
    rooms = scores_from_sums(scores, names, mse).withColumn("rmse", F.sqrt("mse")).join(counts, [*groups, room])
    everything = [
        F.sum("n_timestamps").alias("n_timestamps"),
        F.sum("n_samples").alias("n_samples"),
        F.max("n_folds").alias("n_folds"),
        F.max("n_offsets").alias("n_offsets"),
        *[F.avg(c).alias(c) for c in ("r2_pooled", "mse", "rmse")],
        *[F.avg(f"{s}_{a}").alias(f"{s}_{a}") for s in ("r2", "sse", "sst") for a in names],
    ]
    return with_summary(rooms, groups, {room: F.lit("All")}, everything)


def decoder_by_room(room_scores: DataFrame, room: str = "room", set_name: str = "set_name") -> DataFrame:
    """The short score table: test rows of single rooms, with ``r2`` and ``rmse``."""
    out = room_scores
    if set_name in out.columns:
        out = out.filter(F.col(set_name) == "test")
    out = out.filter(F.col(room) != "All")
    source = {"r2": ("r2_pooled_mean", "r2_pooled", "r2"), "rmse": ("rmse_mean", "rmse")}
    picked = [F.col(next(c for c in names if c in out.columns)).alias(k) for k, names in source.items()]
    extra = [c for c in ("fold", "offset_no", "n") if c in out.columns]
    return out.select(room, *picked, *extra)


def ensemble_rows(
    df: DataFrame, keys: Sequence[str], means: Sequence[str], firsts: Sequence[str], order: str = "offset_no"
) -> DataFrame:
    """One row per key: the mean of targets and predictions over offsets, the first value of the other columns."""
    return df.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in means], *[F.min_by(c, order).alias(c) for c in firsts]
    )


def mean_metrics(df: DataFrame, keys: Sequence[str], scalars: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in scalars])


def mean_lists(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Element-wise mean of an array column, cut to the shortest array of the group."""
    shortest = df.groupBy(*keys).agg(F.min(F.size(value)).alias("_len"))
    elements = df.select(*keys, F.posexplode(value).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.avg("_v").alias("_v"))
    joined = elements.join(shortest, list(keys)).filter(F.col("_i") < F.col("_len"))
    return joined.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias(value))


def mean_maps(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Key-wise mean of a map column."""
    entries = df.select(*keys, F.explode(value).alias("_k", "_v")).groupBy(*keys, "_k").agg(F.avg("_v").alias("_v"))
    return entries.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias(value))


def group_mean_mixed(df: DataFrame, keys: Sequence[str], value: str, vector: str) -> DataFrame:
    """Group mean where a row carries a scalar or an array; missing keys become ``unknown``.

    Result: keys, element (NULL for scalars), mean.
    """
    known = df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("unknown")) for k in keys})
    scalar = known.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("mean"))
    lists = mean_lists(known.filter(F.col(vector).isNotNull()), keys, vector)
    return scalar.withColumn("element", F.lit(None).cast("int")).unionByName(
        lists.select(*keys, F.posexplode(vector).alias("element", "mean"))
    )


def mean_rate(df: DataFrame, keys: Sequence[str], value: str, time: str = "timestamp", kind: str = "count") -> DataFrame:
    """Mean firing rate: spikes over recorded time for counts, plain mean for rates."""
    if kind == "count":
        rate = ratio(F.sum(value), F.max(time) - F.min(time))
    elif kind == "rate":
        rate = F.avg(value)
    else:
        raise ValueError("kind must be 'count' or 'rate'")
    return df.groupBy(*keys).agg(rate.alias("mean_rate"))


def max_window_rate(df: DataFrame, keys: Sequence[str], value: str, window: float, time: str = "timestamp", kind: str = "count") -> DataFrame:
    """Largest windowed mean rate; a window with fewer than two distinct times has no rate."""
    windows = df.withColumn("_w", F.floor(F.col(time) / F.lit(float(window))))
    rates = mean_rate_of(windows, [*keys, "_w"], value, time, kind)
    return rates.groupBy(*keys).agg(F.max("rate").alias("max_rate"))


def mean_rate_of(df: DataFrame, keys: Sequence[str], value: str, time: str, kind: str) -> DataFrame:
    span = F.max(time) - F.min(time)
    rate = ratio(F.sum(value), span) if kind == "count" else F.avg(value)
    return df.groupBy(*keys).agg(F.when(span > 0, rate).alias("rate"))


def weighted_mse(df: DataFrame, keys: Sequence[str], axes: Sequence[tuple[str, str]], weight: str | None = None) -> DataFrame:
    """Mean over all elements of ``w * (p - t)^2``."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    per_row = sum((F.pow(F.col(p) - F.col(t), 2) for t, p in axes), F.lit(0.0)) * w
    return df.groupBy(*keys).agg((F.sum(per_row) / (F.count(per_row) * len(axes))).alias("weighted_mse"))


def homogeneous_mse(
    df: DataFrame, keys: Sequence[str], axes: Sequence[tuple[str, str]], scale_pred: str, weight: str | None = None
) -> DataFrame:
    """As ``weighted_mse`` on homogeneous points: every target but the last axis is multiplied by ``scale + 1e-6``."""
    scaled = {f"_t{i}": F.col(t) * (F.col(scale_pred) + 1e-6) for i, (t, _) in enumerate(axes[:-1])}
    pairs = [(f"_t{i}", p) for i, (_, p) in enumerate(axes[:-1])] + [axes[-1]]
    return weighted_mse(df.withColumns(scaled), keys, pairs, weight)


def bbox(df: DataFrame, keys: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """Shared smallest and largest value over both axes."""
    return df.groupBy(*keys).agg(
        F.least(F.min(x), F.min(y)).alias("lo"), F.greatest(F.max(x), F.max(y)).alias("hi")
    )


def covariance_mismatch(df: DataFrame, keys: Sequence[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Frobenius norm of the difference between the sample covariance matrices of two point sets."""
    def parts(p: tuple[str, str]) -> tuple[Column, Column, Column]:
        return F.var_samp(p[0]), F.covar_samp(p[0], p[1]), F.var_samp(p[1])

    (axx, axy, ayy), (bxx, bxy, byy) = parts(a), parts(b)
    norm = F.sqrt(F.pow(axx - bxx, 2) + 2 * F.pow(axy - bxy, 2) + F.pow(ayy - byy, 2))
    return df.groupBy(*keys).agg(norm.alias("mismatch"))
