"""Temporal folds, cross-validation splits, sequence windows and trace smoothing."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfield.functions.numeric import finite
from wayfield.plans.ordered import ROWS_PER_SLICE, in_order, with_blocks
from wayfield.session import stored

# Fixed value: the rooms whose folds are shifted when nothing else is said, and by how much.
DEFAULT_SHIFT = {"B": 1}


def assign_fold(
    df: DataFrame, k: int, keys: Sequence[str] = ("session",), time: str = "ts", ties: Sequence[str] = ("frame_id",), room: str = "room",
    shift: Mapping[str, int] | None = None, fold: str = "fold", rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Cut each room's stretch of row numbers into ``k`` equal folds, numbered from 1; NULL outside every room.

    Row numbers run over the whole group. ``shift`` moves the fold numbers of a room round the circle. Numbered rows are
    written once, as both the rooms' stretches and the result read them; so are the stretches, a row per group and room.
    """
    if fold in df.columns:
        return df
    keys = list(keys)
    numbered = stored(in_order(df, keys, time, ties, index="_i", rows_per_slice=rows_per_slice))
    span = stored(numbered.filter(F.col(room).isNotNull()).groupBy(*keys, room).agg(F.min("_i").alias("_lo"), F.max("_i").alias("_hi")))
    joined = numbered.join(span, [*keys, room], "left")
    base = F.least(
        F.lit(k), F.coalesce(F.floor(F.try_divide((F.col("_i") - F.col("_lo")) * F.lit(float(k)), F.col("_hi") - F.col("_lo"))) + 1, F.lit(1))
    )
    moved = base
    for name, by in (DEFAULT_SHIFT if shift is None else shift).items():
        moved = F.when(F.col(room) == name, F.pmod(base - 1 + by, F.lit(k)) + 1).otherwise(moved)
    return joined.withColumn(fold, F.when(F.col("_lo").isNotNull(), moved).cast("int")).select(*df.columns, fold)


def cv_splits(
    df: DataFrame, k: int, train_rooms: Sequence[str], test_rooms: Sequence[str], keys: Sequence[str] = ("session",), time: str = "ts",
    ties: Sequence[str] = ("frame_id",), room: str = "room", fold: str = "fold", rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """One row per (fold number, row): ``test`` for the fold itself in the test rooms, ``val`` for the last part of
    every other fold in each train room, ``train`` for the rest of the train rooms."""
    by = [*keys, room, fold]
    rows = df.filter(F.col(fold).isNotNull() & F.col(room).isin(sorted({*train_rooms, *test_rooms})))
    numbered = in_order(rows, by, time, ties, index="_i", rows_per_slice=rows_per_slice)
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    counted = numbered.join(size, by)
    held = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(max(k - 1, 1))))
    late = (F.col("_i") >= F.col("_n") - held) if k > 1 else F.lit(False)
    train, test = F.col(room).isin(list(train_rooms)), F.col(room).isin(list(test_rooms))
    own = F.col(fold) == F.col("split_fold")
    kind = F.when(test & own, "test").when(train & ~own & late, "val").when(train & ~own, "train")
    split = counted.withColumn("split_fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("set", kind)
    return split.filter("set is not null").select(*df.columns, "split_fold", "set")


def _block_of(i: Column, n: Column, k: int) -> Column:
    """Block of row ``i`` of ``n`` cut into ``k`` contiguous blocks, the first ``n % k`` of them one row longer."""
    q, r = F.floor(n / F.lit(k)), F.pmod(n, F.lit(k))
    long_part = r * (q + 1)
    return F.when(i < long_part, F.floor(F.try_divide(i, q + 1))).otherwise(r + F.floor(F.try_divide(i - long_part, q))).cast("int")


def expanding_splits(
    df: DataFrame, k: int, scenario: str = "train_val_test", keys: Sequence[str] = ("session",), time: str = "ts", ties: Sequence[str] = ("frame_id",),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Growing training prefix over ``k`` contiguous blocks.

    ``train_val_test``: fold f trains on blocks 0..f+1, each of them in turn held out as ``val`` (``sub_fold``), and
    tests on block f+2. ``train_val`` has no test block. ``train_test`` trains on 0..f and tests on block f+1.
    """
    plan: list[list[tuple[int, int, str]]] = [[] for _ in range(k)]
    for f in range(k):
        if scenario == "train_test":
            if f + 1 >= k:
                break
            for b in range(f + 1):
                plan[b].append((f, 0, "train"))
            plan[f + 1].append((f, 0, "test"))
            continue
        if f + (2 if scenario == "train_val_test" else 1) >= k:
            break
        for s in range(f + 2):
            for b in range(f + 2):
                plan[b].append((f, s, "val" if b == s else "train"))
            if scenario == "train_val_test":
                plan[f + 2].append((f, s, "test"))
    numbered = in_order(df, keys, time, ties, index="_i", rows_per_slice=rows_per_slice)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    blocks = numbered.join(size, list(keys)).withColumn("block", _block_of(F.col("_i"), F.col("_n"), k))
    member = None
    for b, entries in enumerate(plan):
        items = F.array(*[F.struct(F.lit(f).alias("fold_no"), F.lit(s).alias("sub_fold"), F.lit(kind).alias("set")) for f, s, kind in entries])
        if entries:
            member = F.when(F.col("block") == b, items) if member is None else member.when(F.col("block") == b, items)
    return blocks.select(*df.columns, "block", F.explode(member).alias("_m")).select(*df.columns, "block", "_m.*")


def nested_splits(df: DataFrame, k: int, keys: Sequence[str] = ("session",), time: str = "ts", ties: Sequence[str] = ("frame_id",)) -> DataFrame:
    """``k`` folds over ``k + 2`` blocks: fold f trains and validates on blocks 0..f and tests on block f+1, f from 1."""
    out = expanding_splits(df, k + 2, "train_val_test", keys, time, ties)
    return out.withColumn("fold_no", F.col("fold_no") + 1)


def sequence_windows(
    df: DataFrame, length: int, features: Sequence[str], targets: Sequence[str], keys: Sequence[str] = ("session", "fold"), time: str = "ts",
    ties: Sequence[str] = ("frame_id",), carry: Sequence[str] = ("room",), last_state: bool = True, max_gap: float | None = None,
    rows_per_slice: int = ROWS_PER_SLICE, rows_per_block: int = 1_000_000,
) -> DataFrame:
    """Feature windows of ``length`` rows per group, each labelled by the row after it.

    ``window`` is an array of feature structs in time order. With ``last_state`` false the window's own targets come
    along as ``window_targets``. A window with a missing feature or target is dropped; so is one that crosses a time
    step longer than ``max_gap``, if given. Groups with ``length`` rows or fewer give nothing.
    """
    keys = list(keys)
    numbered = in_order(df, keys, time, ties, index="_i", lag={"_before": time}, rows_per_slice=rows_per_slice)
    blocks = with_blocks(numbered, "_i", length, 0, rows_per_block)
    w = W.partitionBy(*keys, "_block").orderBy("_i").rowsBetween(-length, -1)
    upto = W.partitionBy(*keys, "_block").orderBy("_i").rowsBetween(-length + 1, 0)
    row_ok = F.lit(True)
    for c in [*features, *([] if last_state else targets)]:
        row_ok = row_ok & finite(c).isNotNull()
    cols: dict[str, Column] = {
        "window": F.collect_list(F.struct(*[F.col(c) for c in features])).over(w),
        "_whole": F.min(row_ok.cast("int")).over(w) == 1,
        "_step": F.max(F.col(time) - F.col("_before")).over(upto),
    }
    if not last_state:
        cols["window_targets"] = F.collect_list(F.struct(*[F.col(c) for c in targets])).over(w)
    out = blocks.withColumns(cols).filter(F.col("_own") & (F.col("_i") >= length) & F.col("_whole"))
    if last_state:
        for c in targets:
            out = out.filter(finite(c).isNotNull())
    if max_gap is not None:
        out = out.filter(F.col("_step") <= max_gap)
    extra = [] if last_state else ["window_targets"]
    return out.select(*keys, *ties, time, *[c for c in carry if c in df.columns], *targets, "window", *extra)


def fold_boundaries(df: DataFrame, keys: Sequence[str] = ("session",), time: str = "ts", ties: Sequence[str] = ("frame_id",), fold: str = "fold") -> DataFrame:
    """Times at which the fold number changes; rows without a fold are ignored."""
    known = in_order(df.filter(F.col(fold).isNotNull()), keys, time, ties, lag={"_before": fold})
    return known.filter(F.col("_before").isNotNull() & (F.col(fold) != F.col("_before"))).select(*keys, time, F.col("_before").alias("fold_before"), fold)


def gauss_smooth_trace(
    df: DataFrame, value: str, sigma: float, keys: Sequence[str] = ("cell",), time: str = "timestamp", ties: Sequence[str] = ("row_id",),
    rows_per_slice: int = ROWS_PER_SLICE, rows_per_block: int = 1_000_000,
) -> DataFrame:
    """Convolve each trace with a normalised Gaussian of ``sigma`` samples, cut at three sigma.

    Missing values weigh as 0 and are missing again in the result; beyond the ends the trace is 0.
    """
    keys = list(keys)
    half = math.ceil(3 * sigma)
    norm = sum(math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1))
    numbered = in_order(df, keys, time, ties, index="_i", rows_per_slice=rows_per_slice)
    blocks = with_blocks(numbered, "_i", half, half, rows_per_block)
    w = W.partitionBy(*keys, "_block").orderBy("_i").rowsBetween(-half, half)
    near = F.collect_list(F.struct(F.col("_i").alias("i"), F.coalesce(finite(value), F.lit(0.0)).alias("v"))).over(w)
    weighted = F.aggregate(
        "_near", F.lit(0.0), lambda acc, s: acc + s["v"] * F.exp(F.lit(-0.5) * F.pow((s["i"] - F.col("_i")) / F.lit(float(sigma)), 2))
    )
    out = blocks.withColumn("_near", near).filter("_own")
    return out.withColumn("smoothed", F.when(finite(value).isNotNull(), weighted / F.lit(norm))).select(*df.columns, "smoothed")


def decimate(df: DataFrame, most: int, keys: Sequence[str] = ("cell",), time: str = "timestamp", ties: Sequence[str] = ("row_id",)) -> DataFrame:
    """Keep every s-th row of each trace, s = ceil(rows / most)."""
    numbered = in_order(df, keys, time, ties, index="_i")
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    stride = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(most)))
    return numbered.join(size, list(keys)).filter(F.pmod(F.col("_i"), stride) == 0).select(*df.columns)


def temporal_fade(df: DataFrame, keys: Sequence[str] = ("session", "room"), time: str = "ts", ties: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Weight ``exp(-linspace(3, 0, n))`` by age within the group: the latest row has weight 1."""
    numbered = in_order(df, keys, time, ties, index="_i")
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    place = F.coalesce(F.try_divide(F.col("_i"), F.col("_n") - 1), F.lit(0.0))
    return numbered.join(size, list(keys)).withColumn("fade", F.exp(F.lit(-3.0) * (1 - place))).select(*df.columns, "fade")


def dense_bins(bounds: DataFrame, keys: Sequence[str], lo: str = "lo", hi: str = "hi", name: str = "bin", chunk: int = 10_000) -> DataFrame:
    """Every integer from ``lo`` to ``hi`` per row of ``bounds``, made in chunks so that no single array grows long.

    Stretches of a hundred chunks are dealt to all tasks before they are filled, so the bins of one long trace are made
    by many. The number of tasks is given, as Spark would merge the few short rows that stand for them.
    """
    spark = bounds.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    far = chunk * 100
    dealt = bounds.select(*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), F.explode(F.sequence(F.floor(F.col(lo) / far), F.floor(F.col(hi) / far))).alias("_f"))
    dealt = dealt.repartition(tasks, *keys, "_f")

    def stretches(df: DataFrame, width: int, place: str) -> DataFrame:
        first, last = F.greatest(F.col("_lo"), F.col(place) * width), F.least(F.col("_hi"), F.col(place) * width + (width - 1))
        return df.withColumns({"_lo": first, "_hi": last})

    parts = stretches(dealt, far, "_f").withColumn("_c", F.explode(F.sequence(F.floor(F.col("_lo") / chunk), F.floor(F.col("_hi") / chunk))))
    return stretches(parts, chunk, "_c").select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(name))


def binned_rates(df: DataFrame, width: float, keys: Sequence[str] = ("cell",), time: str = "timestamp") -> DataFrame:
    """Spikes per second in each bin between a trace's first and last spike, empty bins included."""
    keys = list(keys)
    counts = df.groupBy(*keys, F.floor(F.col(time) / F.lit(float(width))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bounds = counts.groupBy(*keys).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    bins = dense_bins(bounds, keys).join(counts, [*keys, "bin"], "left")
    return bins.select(*keys, "bin", (F.coalesce("n", F.lit(0)) / F.lit(float(width))).alias("rate_bin"))


def rate_variants(
    df: DataFrame, width: float, half_window: int, sigma: float, keys: Sequence[str] = ("cell",), time: str = "timestamp", rows_per_block: int = 1_000_000,
) -> DataFrame:
    """Binned rate with its centred rectangular mean over ``2 * half_window + 1`` bins and its Gaussian smoothing."""
    keys = list(keys)
    bins = binned_rates(df, width, keys, time)
    smooth = gauss_smooth_trace(bins, "rate_bin", sigma, keys, "bin", (), rows_per_block=rows_per_block).withColumnRenamed("smoothed", "rate_gauss")
    # the dense bin number is the index
    blocks = with_blocks(smooth, "bin", half_window, half_window, rows_per_block)
    w = W.partitionBy(*keys, "_block").orderBy("bin").rowsBetween(-half_window, half_window)
    return blocks.withColumn("rate_rect", F.avg("rate_bin").over(w)).filter("_own").drop("_block", "_own")


def adaptive_rate(
    df: DataFrame, n: int, keys: Sequence[str] = ("cell",), time: str = "timestamp", ties: Sequence[str] = ("row_id",), rows_per_block: int = 1_000_000,
) -> DataFrame:
    """Rate at each spike from the time the last ``n`` spikes span; NULL for a trace's first spikes."""
    numbered = in_order(df, keys, time, ties, index="_i")
    blocks = with_blocks(numbered, "_i", n - 1, 0, rows_per_block)
    w = W.partitionBy(*keys, "_block").orderBy("_i")
    span = F.col(time) - F.lag(time, n - 1).over(w)
    return blocks.withColumn("rate_adaptive", F.try_divide(F.lit(float(n)), span)).filter("_own").select(*df.columns, "rate_adaptive")
