"""Tracking quality: speeds, interpolation gaps, stream summaries, frame rates and resampling.

A stream is a group of (session, stream). Order-dependent steps go through ``in_order``, so a stream may be any part
of the table; everything else is grouped sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfield.functions.numeric import hypot2, percent, ratio, safe_corr
from wayfield.plans.ordered import ROWS_PER_SLICE, in_order, quantiles
from wayfield.session import cut_lineage, stored

KEYS = ("session", "stream")
# Frame states. A missing frame is 0; interpolated frames are 2 to 4 by the kind of their gap.
MISSING, VALID, SHORT, LONG_TIME, LONG_DISTANCE = range(5)
_BLOCK = 512


def array_median(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(values)
    middle = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, middle)


def frame_speed(
    df: DataFrame, keys: Sequence[str] = KEYS, time: str = "ts", x: str = "x", y: str = "y", ties: Sequence[str] = ("frame_id",),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add ``speed`` from the previous frame; NULL on the first frame and where time does not advance."""
    out = in_order(df, keys, time, ties, lag={"_pt": time, "_px": x, "_py": y}, rows_per_slice=rows_per_slice)
    return out.withColumn("speed", _speed(time, x, y)).drop("_pt", "_px", "_py")


def _speed(time: str, x: str, y: str) -> Column:
    dt = F.col(time) - F.col("_pt")
    return F.when(dt > 0, F.try_divide(hypot2(F.col(x) - F.col("_px"), F.col(y) - F.col("_py")), dt))


def frame_state() -> Column:
    missing = F.col("x").isNull() | F.col("y").isNull()
    return F.when(missing, F.lit(MISSING)).when(F.col("interp") > 0, F.lit(SHORT)).otherwise(F.lit(VALID))


def track_frames(df: DataFrame, keys: Sequence[str] = KEYS, ties: Sequence[str] = ("frame_id",), rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Frames with index, state, speed, and ``run``: the count of frames so far that are not interpolated.

    All frames of one interpolated run share one ``run`` value, and so does the frame just before it.
    """
    flagged = df.withColumn("state", frame_state()).withColumn("gap", F.col("state") == SHORT)
    out = in_order(
        flagged, keys, "ts", ties, index="idx", lag={"_pt": "ts", "_px": "x", "_py": "y", "after_gap": "gap"},
        running={"run": F.when(~F.col("gap"), 1)}, rows_per_slice=rows_per_slice,
    )
    out = out.withColumns({"speed": _speed("ts", "x", "y"), "dt": F.col("ts") - F.col("_pt")})
    return out.withColumn("after_gap", F.coalesce(F.col("after_gap"), F.lit(False))).drop("_pt", "_px", "_py")


def gap_runs(frames: DataFrame, long_time: float, long_distance: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Maximal interpolated runs of ``track_frames`` with extent, distance, class, mean probability and peak speed.

    The peak speed covers the run and the frame on either side, so the frame after a run counts for the run as well.
    """
    run = F.explode(
        F.array_compact(F.array(F.col("run"), F.when(~F.col("gap") & F.col("after_gap"), F.col("run") - 1)))
    )
    member = frames.select(*keys, "idx", "ts", "x", "y", "p", "gap", "speed", F.col("run").alias("_own"), run.alias("run"))
    inside = F.col("gap") & (F.col("_own") == F.col("run"))

    def at(f, c: str) -> Column:
        return f(F.when(inside, F.col(c)), F.when(inside, F.col("idx")))

    runs = member.groupBy(*keys, "run").agg(
        F.min(F.when(inside, F.col("idx"))).alias("start_idx"), F.max(F.when(inside, F.col("idx"))).alias("end_idx"),
        F.count_if(inside).alias("length_frames"),
        F.min(F.when(inside, F.col("ts"))).alias("t_start"), F.max(F.when(inside, F.col("ts"))).alias("t_end"),
        at(F.min_by, "x").alias("_x0"), at(F.min_by, "y").alias("_y0"), at(F.max_by, "x").alias("_x1"), at(F.max_by, "y").alias("_y1"),
        F.avg(F.when(inside, F.col("p"))).alias("p_mean_run"), F.max("speed").alias("gap_peak_speed"),
    ).filter(F.col("length_frames") > 0)
    runs = runs.withColumns(
        {
            "duration": F.col("t_end") - F.col("t_start"),
            "distance": hypot2(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")),
        }
    ).drop("_x0", "_y0", "_x1", "_y1")
    runs = runs.withColumns(
        {
            "is_long_time": F.coalesce(F.col("duration") >= long_time, F.lit(False)),
            "is_long_distance": F.coalesce(F.col("distance") >= long_distance, F.lit(False)),
        }
    )
    return runs.withColumns(
        {
            "is_long": F.col("is_long_time") | F.col("is_long_distance"),
            "gap_avg_speed": F.when(F.col("duration") > 0, F.try_divide("distance", "duration")),
        }
    )


def classify_frames(frames: DataFrame, runs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Replace the state of interpolated frames by the class of their run."""
    kind = F.when(F.col("is_long_distance"), F.lit(LONG_DISTANCE)).when(F.col("is_long_time"), F.lit(LONG_TIME)).otherwise(F.lit(SHORT))
    classes = runs.select(*keys, "run", kind.alias("_kind"))
    joined = frames.join(classes, [*keys, "run"], "left")
    return joined.withColumn("state", F.when(F.col("gap"), F.coalesce("_kind", "state")).otherwise(F.col("state"))).drop("_kind")


def local_window(frames: DataFrame, seconds: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Frames that make up ``seconds`` at each stream's median frame distance, at least 1."""
    med = quantiles(frames, keys, {"_dt": ("dt", 0.5)})
    frames_in = F.when(F.col("_dt") > 0, F.greatest(F.lit(1), F.bround(F.lit(float(seconds)) / F.col("_dt")).cast("int")))
    return med.select(*keys, F.coalesce(frames_in, F.lit(1)).alias("window"))


def gap_speed_outliers(
    frames: DataFrame, runs: DataFrame, window: DataFrame | int, z_threshold: float, speed_max: float | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Compare each run's speeds with the median and MAD of the frame speeds around it.

    ``window`` frames on each side, as a number or as a table per stream. Frames meet runs through blocks of the frame
    index, so a long stream spreads over many tasks and no run is compared with frames it does not need.
    """
    keys = list(keys)
    wide = runs.withColumn("window", F.lit(window)) if isinstance(window, int) else runs.join(window, keys)
    before = F.struct(F.greatest(F.lit(0), F.col("start_idx") - F.col("window")).alias("lo"), (F.col("start_idx") - 1).alias("hi"))
    after = F.struct((F.col("end_idx") + 1).alias("lo"), (F.col("end_idx") + F.col("window")).alias("hi"))
    sides = wide.select(*keys, "run", F.explode(F.array(before, after)).alias("_s")).select(*keys, "run", "_s.lo", "_s.hi")
    blocks = sides.filter("hi >= lo").withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("lo") / _BLOCK), F.floor(F.col("hi") / _BLOCK)))
    )
    speeds = frames.filter("speed is not null").select(*keys, "idx", "speed", F.floor(F.col("idx") / _BLOCK).alias("_b"))
    near = blocks.join(speeds, [*keys, "_b"]).filter(F.col("idx").between(F.col("lo"), F.col("hi")))
    # a run gathers at most 2 x window speeds
    local = near.groupBy(*keys, "run").agg(F.collect_list("speed").alias("_v"))
    local = local.withColumn("v_local_median", array_median(F.col("_v")))
    local = local.withColumn("_mad", array_median(F.transform("_v", lambda v: F.abs(v - F.col("v_local_median")))))
    local = local.select(*keys, "run", "v_local_median", F.when(F.col("_mad") > 0, F.col("_mad")).alias("v_local_mad"))
    out = runs.join(local, [*keys, "run"], "left")
    out = out.withColumns(
        {
            "z_avg_speed": F.try_divide(F.col("gap_avg_speed") - F.col("v_local_median"), F.col("v_local_mad")),
            "z_peak_speed": F.try_divide(F.col("gap_peak_speed") - F.col("v_local_median"), F.col("v_local_mad")),
        }
    )
    fast = F.lit(False)
    if speed_max is not None:
        fast = F.coalesce(F.greatest("gap_avg_speed", "gap_peak_speed") >= speed_max, F.lit(False))
    relative = F.coalesce(F.greatest("z_avg_speed", "z_peak_speed") >= z_threshold, F.lit(False))
    return out.withColumns({"is_too_fast_absolute": fast, "is_too_fast_relative": relative, "is_too_fast": fast | relative})


def _state_counts() -> list[Column]:
    names = {MISSING: "missing", VALID: "valid", SHORT: "short", LONG_TIME: "long_time", LONG_DISTANCE: "long_distance"}
    return [F.count_if(F.col("state") == code).alias(f"frames_{n}") for code, n in names.items()]


def tracking_summary(frames: DataFrame, runs: DataFrame, low_p: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per stream from classified frames and runs (``is_too_fast`` included if the runs carry it).

    Frames without a probability count as not low in the share of low-probability frames.
    """
    keys = list(keys)
    both = F.col("speed").isNotNull() & F.col("v_provided").isNotNull()
    diff = F.when(both, F.col("v_provided") - F.col("speed"))
    frame_part = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames_total"),
        *_state_counts(),
        F.avg(F.when(F.col("state") == VALID, F.col("p"))).alias("mean_p_valid"),
        F.avg(F.when(F.col("gap"), F.col("p"))).alias("mean_p_interp"),
        F.when(F.count("p") > 0, ratio(F.count_if(F.col("p") < low_p), F.count(F.lit(1)))).alias("frac_low_p"),
        F.avg("speed").alias("speed_mean"), F.max("speed").alias("speed_max"),
        F.avg("v_provided").alias("v_provided_mean"), F.max("v_provided").alias("v_provided_max"),
        F.when(F.count_if(both) >= 3, safe_corr("speed", "v_provided")).alias("speed_r"),
        F.when(F.count_if(both) >= 3, F.avg(diff)).alias("speed_bias"),
        F.when(F.count_if(both) >= 3, F.sqrt(F.avg(diff * diff))).alias("speed_rmse"),
    )
    shares = {
        f"percent_{n}": percent(f"frames_{n}", "frames_total") for n in ("missing", "valid", "short", "long_time", "long_distance")
    }
    shares["percent_long"] = percent(F.col("frames_long_time") + F.col("frames_long_distance"), "frames_total")
    flags = ["is_long_time", "is_long_distance", "is_long"] + (["is_too_fast"] if "is_too_fast" in runs.columns else [])
    measures = {"length": "length_frames", "duration": "duration", "distance": "distance"}
    run_part = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_gaps"),
        *[F.max(c).alias(f"{n}_max") for n, c in measures.items()],
        *[(F.avg(F.col(f).cast("double")) * 100).alias(f"percent_runs_{f[3:]}") for f in flags],
    )
    run_q = quantiles(runs, keys, {f"{n}_{tag}": (c, q) for n, c in measures.items() for tag, q in (("median", 0.5), ("p95", 0.95))})
    speed_q = quantiles(
        frames, keys,
        {f"{n}_{tag}": (c, q) for n, c in (("speed", "speed"), ("v_provided", "v_provided")) for tag, q in (("median", 0.5), ("p05", 0.05), ("p95", 0.95))},
    )
    out = frame_part.withColumns(shares).join(run_part, keys, "left").join(run_q, keys, "left").join(speed_q, keys, "left")
    zero = {"num_gaps": F.coalesce("num_gaps", F.lit(0))}
    zero |= {f"percent_runs_{f[3:]}": F.coalesce(f"percent_runs_{f[3:]}", F.lit(0.0)) for f in flags}
    return out.withColumns(zero)


def tracking_timebins(frames: DataFrame, width: float, low_p: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Quality per time bin. The share of low-probability frames is over frames that have a probability."""
    n = F.count(F.lit(1))
    out = frames.groupBy(*keys, F.floor(F.col("ts") / F.lit(float(width))).alias("bin")).agg(
        n.alias("n_frames"), F.avg("speed").alias("mean_speed"), F.avg("v_provided").alias("mean_speed_provided"), F.avg("p").alias("mean_p"),
        F.count_if(F.col("state") == SHORT).alias("count_short"),
        F.count_if(F.col("state") == LONG_TIME).alias("count_long_time"),
        F.count_if(F.col("state") == LONG_DISTANCE).alias("count_long_distance"),
        ratio(F.count_if(F.col("p") < low_p), F.count("p")).alias("frac_low_p"),
    )
    out = out.withColumn("count_long", F.col("count_long_time") + F.col("count_long_distance"))
    kinds = ("short", "long_time", "long_distance", "long")
    return out.withColumns({f"pct_{k}": percent(f"count_{k}", "n_frames") for k in kinds}).withColumns(
        {"bin_start": F.col("bin") * F.lit(float(width)), "bin_end": (F.col("bin") + 1) * F.lit(float(width))}
    )


def timebin_state_join(frames: DataFrame, width: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bins left-joined with their state counts, the join form of ``tracking_timebins``."""
    binned = frames.withColumn("bin", F.floor(F.col("ts") / F.lit(float(width))))
    bins = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n_frames"))
    counts = binned.filter(F.col("state") >= SHORT).groupBy(*keys, "bin").agg(
        F.count_if(F.col("state") == SHORT).alias("count_short"),
        F.count_if(F.col("state") == LONG_TIME).alias("count_long_time"),
        F.count_if(F.col("state") == LONG_DISTANCE).alias("count_long_distance"),
    )
    return bins.join(counts, [*keys, "bin"], "left").fillna(0)


def stream_composition(summary: DataFrame, stream: str = "stream") -> DataFrame:
    """Share of each frame state per stream, from summed counts or, without counts, from mean percentages."""
    states = ("missing", "valid", "short", "long_time", "long_distance")
    if all(f"frames_{s}" in summary.columns for s in states):
        sums = summary.groupBy(stream).agg(*[F.sum(f"frames_{s}").alias(f"_{s}") for s in states])
        total = sum((F.col(f"_{s}") for s in states), F.lit(0))
        return sums.select(stream, *[percent(f"_{s}", total).alias(f"percent_{s}") for s in states])
    return summary.groupBy(stream).agg(*[F.avg(f"percent_{s}").alias(f"percent_{s}") for s in states])


def gap_flag_counts(runs: DataFrame, streams: DataFrame, stream: str = "stream") -> DataFrame:
    """Runs per stream that are long in time, in distance and in both; 0 for streams without runs."""
    counts = runs.groupBy(stream).agg(
        F.count_if("is_long_time").alias("n_long_time"), F.count_if("is_long_distance").alias("n_long_distance"),
        F.count_if(F.col("is_long_time") & F.col("is_long_distance")).alias("n_both"),
    )
    return streams.select(stream).distinct().join(counts, stream, "left").fillna(0)


def project_gap_stats(runs: DataFrame, project: str = "session") -> DataFrame:
    base = runs.groupBy(project).agg(F.count(F.lit(1)).alias("n_gaps"), F.max("duration").alias("duration_max"), F.max("distance").alias("distance_max"))
    q = quantiles(runs, [project], {f"{c}_{t}": (c, p) for c in ("duration", "distance") for t, p in (("median", 0.5), ("p95", 0.95))})
    return base.join(q, project)


def interp_share(df: DataFrame, keys: Sequence[str], count: str = "interp", limit: int = 5, p: str = "p", low_p: float = 0.5) -> DataFrame:
    """Share of frames with fewer than ``limit`` interpolations; without that counter, of frames of low probability."""
    test = F.col(count) < limit if count in df.columns else F.col(p) < low_p
    return df.groupBy(*keys).agg(percent(F.count_if(test), F.count(F.lit(1))).alias("share"))


# ---------------------------------------------------------------- frame rate


def _deltas(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Times, frame distances and their inverses: three numbers a frame, worked out once for all their consumers."""
    out = in_order(df.select(*keys, time, *ties), keys, time, ties, lag={"_pt": time}, rows_per_slice=rows_per_slice)
    dt = F.col(time) - F.col("_pt")
    return stored(out.select(*keys, F.col(time).alias("t"), dt.alias("dt"), F.when(dt > 0, F.try_divide(F.lit(1.0), dt)).alias("fps")))


def fps_stats(df: DataFrame, keys: Sequence[str] = KEYS, time: str = "ts", ties: Sequence[str] = ("frame_id",), unit: float = 1.0) -> DataFrame:
    """Duration, frames, and spread of the frame distance, of its inverse, and of frames per ``unit`` seconds."""
    keys = list(keys)
    d = _deltas(df, keys, time, ties)
    per_unit = df.groupBy(*keys, F.floor(F.col(time) / F.lit(float(unit))).alias("_s")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    base = d.groupBy(*keys).agg(
        (F.max("t") - F.min("t")).alias("duration"), F.count(F.lit(1)).alias("frames_total"),
        *[f(c).alias(f"{c}_{n}") for c in ("dt", "fps") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))],
    )
    counts = per_unit.groupBy(*keys).agg(F.avg("n").alias("count_mean"), F.min("n").alias("count_min"), F.max("n").alias("count_max"))
    tags = (("median", 0.5), ("p05", 0.05), ("p95", 0.95))
    dq = quantiles(d, keys, {f"{c}_{t}": (c, q) for c in ("dt", "fps") for t, q in tags})
    cq = quantiles(per_unit, keys, {f"count_{t}": ("n", q) for t, q in tags})
    return base.join(counts, keys).join(dq, keys, "left").join(cq, keys, "left")


def clean_deltas(df: DataFrame, keys: Sequence[str] = KEYS, time: str = "ts", ties: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Positive frame distances with ``keep``: inside the quartile fences, or all of fewer than 8."""
    keys = list(keys)
    d = _deltas(df, keys, time, ties).filter("dt > 0")
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    q = quantiles(d, keys, {"_q1": ("dt", 0.25), "_q3": ("dt", 0.75)}).join(n, keys)
    iqr = F.col("_q3") - F.col("_q1")
    lo = F.greatest(F.col("_q1") - iqr * 1.5, F.lit(1e-9))
    keep = (F.col("_n") < 8) | F.col("dt").between(lo, F.col("_q3") + iqr * 1.5)
    return d.join(q, keys).withColumn("keep", keep).drop("_q1", "_q3", "_n")


def fps_clean(df: DataFrame, keys: Sequence[str] = KEYS, time: str = "ts", ties: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Frame-rate statistics without outlying frame distances, and the share dropped."""
    keys = list(keys)
    d = clean_deltas(df, keys, time, ties)
    kept = d.filter("keep")
    base = d.groupBy(*keys).agg(percent(F.count_if(~F.col("keep")), F.count(F.lit(1))).alias("pct_dropped"))
    stats = kept.groupBy(*keys).agg(F.avg("dt").alias("dt_mean"), F.stddev_pop("dt").alias("dt_std"), F.avg("fps").alias("fps_mean"))
    tags = (("median", 0.5), ("p05", 0.05), ("p95", 0.95))
    q = quantiles(kept, keys, {f"{c}_{t}": (c, p) for c in ("dt", "fps") for t, p in tags})
    return base.join(stats, keys, "left").join(q, keys, "left")


def sample_dt(df: DataFrame, keys: Sequence[str] = KEYS, time: str = "ts", ties: Sequence[str] = ("frame_id",), rate_hz: float | None = None) -> DataFrame:
    """Time one sample stands for: given by the rate, else the median frame distance."""
    if rate_hz:
        return df.select(*keys).distinct().withColumn("dt", F.lit(1.0 / rate_hz))
    return quantiles(_deltas(df, keys, time, ties), keys, {"dt": ("dt", 0.5)})


def rolling_fps(
    df: DataFrame, window: int, keys: Sequence[str] = KEYS, time: str = "ts", ties: Sequence[str] = ("frame_id",), unit: float = 1.0,
    clean: bool = True, smooth_short: bool = False,
) -> DataFrame:
    """Mean frame rate per ``unit`` seconds since the start, smoothed by a centred moving mean of ``window`` units.

    Frame distances outside the quartile fences are left out unless ``clean`` is off. A stream with fewer units than the
    window is not smoothed unless ``smooth_short``. An even window reaches one unit further back than ahead. Units without frames are missing before smoothing; each
    unit hands its value to the units whose window holds it, so empty stretches cost nothing and a long recording
    needs no window in one task. Units with no value in reach are absent.
    """
    keys = list(keys)
    d = clean_deltas(df, keys, time, ties).filter("keep") if clean else _deltas(df, keys, time, ties).filter("dt > 0")
    start = df.groupBy(*keys).agg(F.min(time).alias("_t0"))
    per = d.join(start, keys).groupBy(*keys, F.floor((F.col("t") - F.col("_t0")) / F.lit(float(unit))).alias("unit_no")).agg(F.avg("fps").alias("_v"))
    last = per.groupBy(*keys).agg(F.max("unit_no").alias("_last"))
    back = window // 2
    ahead = window - 1 - back
    spread = per.join(last, keys)
    smooth = F.lit(True) if smooth_short else F.col("_last") + 1 >= window
    lo = F.when(smooth, F.greatest(F.lit(0), F.col("unit_no") - ahead)).otherwise(F.col("unit_no"))
    hi = F.when(smooth, F.least(F.col("_last"), F.col("unit_no") + back)).otherwise(F.col("unit_no"))
    return spread.select(*keys, F.explode(F.sequence(lo, hi)).alias("unit_no"), "_v").groupBy(*keys, "unit_no").agg(F.avg("_v").alias("fps"))


def resample_linear(
    df: DataFrame, rate: float, max_gap: float, columns: Sequence[str] = ("x", "y"), keys: Sequence[str] = KEYS, time: str = "ts",
    ties: Sequence[str] = ("frame_id",),
) -> DataFrame:
    """Resample to ticks ``k / rate``, linear between complete frames at most ``max_gap`` seconds apart.

    Each frame makes the ticks up to the next frame itself, so no time base is built or joined. Ticks inside a longer
    gap have no value and are absent; a tick that falls on a frame is always there.
    """
    ok = df.dropna(subset=[*columns, time])
    nxt = {f"_n_{c}": c for c in (time, *columns)}
    pairs = in_order(ok.select(*keys, time, *columns, *ties), keys, time, ties, lead=nxt)
    t, u = F.col(time), F.col(f"_n_{time}")
    first = F.ceil(t * F.lit(float(rate)))
    bridged = (u - t <= max_gap) & (u > t)
    stop = F.when(bridged, F.ceil(u * F.lit(float(rate))) - 1).otherwise(F.when(F.coalesce(u > t, F.lit(True)), F.floor(t * F.lit(float(rate)))))
    ticks = pairs.withColumn("tick", F.explode(F.when(stop >= first, F.sequence(first, stop))))
    at = F.col("tick") / F.lit(float(rate))
    share = F.coalesce(F.when(bridged, (at - t) / (u - t)), F.lit(0.0))
    values = [(F.col(c) + F.coalesce(F.col(f"_n_{c}") - F.col(c), F.lit(0.0)) * share).alias(c) for c in columns]
    return ticks.select(*keys, "tick", at.alias(time), *values)


def frame_at_time(ticks: DataFrame, frames: DataFrame, on: Sequence[str], tick: str = "tick", time: str = "ts", frame: str = "frame_id") -> DataFrame:
    """First frame at or after each tick, per ``on`` group.

    Ticks and frames are laid in one order, ticks before frames of the same time, and the next known frame is carried
    back, which stays linear where a range join would not.
    """
    a = ticks.select(*on, F.col(tick).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(frames.schema[frame].dataType).alias(frame), F.col(tick))
    b = frames.select(*on, F.col(time).alias("_t"), F.lit(1).alias("_kind"), frame, F.lit(None).cast(ticks.schema[tick].dataType).alias(tick))
    both = in_order(a.unionByName(b), on, "_t", ["_kind", frame], next_known={"_hit": frame})
    return both.filter("_kind = 0").select(*on, tick, F.col("_hit").alias(frame))


def top_n_per_stream(summary: DataFrame, n: int, by: str = "percent_long", stream: str = "stream", project: str = "session") -> DataFrame:
    """The ``n`` worst projects of each stream, first per salt, so no task sorts a whole stream."""
    from wayfield.operators.cells import top_rows

    return top_rows(summary, [stream], [F.desc(by), F.col(project)], n).withColumnRenamed("_r", "rank")


def worst_projects(summary: DataFrame, gaps: DataFrame, n: int = 20, by: str = "percent_long", project: str = "session") -> DataFrame:
    return summary.join(gaps, project, "left").orderBy(F.desc(by), project).limit(n)


def source_of(stream: str = "stream") -> Column:
    """The tracker a stream comes from: its name up to the first underscore."""
    return F.split_part(F.col(stream), F.lit("_"), F.lit(1))


def label_streams(table: DataFrame, primary: str, stream: str = "stream") -> DataFrame:
    """Add ``source`` and ``is_primary``, false for a stream without a name."""
    return table.withColumns({"source": source_of(stream), "is_primary": F.coalesce(F.col(stream) == primary, F.lit(False))})


def report_tables(
    df: DataFrame, long_time: float, long_distance: float, bin_width: float, window: int | None, z_threshold: float, keys: Sequence[str] = KEYS,
    low_p: float = 0.5, speed_max: float | None = None, window_seconds: float | None = None, primary: str = "PC_HeadPos", stream: str = "stream",
) -> dict[str, DataFrame]:
    """The four report tables: ``summary``, ``gap_runs``, ``per_timebin`` and ``fps_stats``.

    Speeds around a gap are taken from ``window`` frames on each side or, if that is None, from ``window_seconds`` at each
    stream's median frame distance. The first three tables say where a stream comes from (``source``, ``is_primary``);
    summary and gap runs carry the settings they were made with, NULL for one that was not set. Frames and runs feed
    several tables each, so both are written once to the checkpoint folder.
    """
    if (window is None) == (window_seconds is None):
        raise ValueError("give either window or window_seconds")
    # The names of the settings in the report files
    settings = {
        "bin_width_s": bin_width, "long_time_threshold_s": long_time, "long_dist_threshold_cm": long_distance, "speed_max_cm_s": speed_max,
        "z_speed_thresh": z_threshold, "v_local_window_s": window_seconds, "lowP_thresh": low_p,
    }
    made_with = {n: F.lit(None if v is None else float(v)).cast("double") for n, v in settings.items()}
    frames = cut_lineage(track_frames(df, keys))
    around = local_window(frames, window_seconds, keys) if window is None else window
    runs = cut_lineage(gap_speed_outliers(frames, stored(gap_runs(frames, long_time, long_distance, keys)), around, z_threshold, speed_max, keys))
    states = classify_frames(frames, runs, keys)
    return {
        "summary": label_streams(tracking_summary(states, runs, low_p, keys), primary, stream).withColumns(made_with),
        "gap_runs": label_streams(runs, primary, stream).withColumns(made_with),
        "per_timebin": label_streams(tracking_timebins(states, bin_width, low_p, keys), primary, stream),
        "fps_stats": fps_stats(df, keys),
    }


def summary_gap_join(summary: DataFrame, runs: DataFrame, session: str = "session") -> DataFrame:
    """A summary table with its sessions' gap statistics; sessions without gaps keep their row."""
    return summary.join(project_gap_stats(runs), session, "left")
