"""Ordered work on groups of any size.

Tracking operators need a row order inside a session, a room or a fold, and one such group may hold a large part of
the table. A window partitioned by the group alone would then run in one task. The helpers here split every large
group into *slices* of its order column, run ordinary Spark windows inside the slices, and carry the few values that
cross a border (counts, sums, last rows) in a table with one row per slice of a large group. Groups are measured
first, by a sample; where none is above ``rows_per_slice`` the plan is the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayfield.session import stored

ROWS_PER_SLICE = 2_000_000
#: Sampled rows that stand for one slice's rows.
SAMPLES = 64


@dataclass(frozen=True)
class Slices:
    """Where the large groups of one (table, keys, order) are cut; measured once and passed along a chain of steps.

    ``borders`` has a row per large group, None if there is none: ``_tops`` and, between them, ``_inner`` places (order, ties).
    """

    keys: tuple[str, ...]
    order: Column
    ties: tuple[str, ...]
    borders: DataFrame | None


def _place(order: Column, ties: Sequence[str]) -> Column:
    return F.struct(order.alias("o"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(ties)])


def slice_borders(df: DataFrame, keys: Sequence[str], order: str | Column, ties: Sequence[str] = (), rows_per_slice: int = ROWS_PER_SLICE) -> Slices:
    """Cut every group of more than about ``rows_per_slice`` rows at equal shares of its rows, by one pass over keys, order and ties.

    The sketch of a group is a uniform sample of its places, ``SAMPLES`` for each slice; groups with more than one slice's worth are
    cut at every half slice. Places are compared as they are sorted, so any type of order will do, rows without an order
    come first, and rows that crowd at one value of it are cut by their ties, whatever the skew. The sample only chooses the
    plan, never the result; it is stored before it is used, so repeated tasks see the same cuts.
    """
    order = F.col(order) if isinstance(order, str) else order
    rate = min(1.0, SAMPLES / rows_per_slice)
    sample = df.select(*keys, _place(order, ties).alias("_p"))
    sample = sample.filter(F.rand(11) < rate) if rate < 1 else sample
    step = max(1, int(rate * rows_per_slice / 2))
    lists = sample.groupBy(*keys).agg(F.sort_array(F.collect_list("_p")).alias("_s")).filter(F.size("_s") > rate * rows_per_slice)
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(step), F.size("_s") - 1, F.lit(step)), lambda i: F.get(F.col("_s"), i)))
    # two levels of about the square root of their number: a row compares itself with few of them
    fan = F.ceil(F.sqrt(F.size("_c"))).cast("int")
    starts = F.sequence(F.lit(1), F.size("_c"), F.col("_fan"))
    borders = lists.select(*keys, cuts.alias("_c")).withColumn("_fan", fan).select(
        *keys, "_fan", F.transform(starts, lambda i: F.get(F.col("_c"), i - 1)).alias("_tops"), F.transform(starts, lambda i: F.slice(F.col("_c"), i, F.col("_fan"))).alias("_inner")
    )
    borders = stored(borders)
    return Slices(tuple(keys), order, tuple(ties), None if borders.isEmpty() else borders)


def with_slices(
    df: DataFrame, keys: Sequence[str], order: str | Column, rows_per_slice: int = ROWS_PER_SLICE, ties: Sequence[str] = (), slices: Slices | None = None
) -> DataFrame | None:
    """Add ``_slice`` (BIGINT, ascending with order and ties inside a group) and ``_split`` (is the group split at all).

    ``slices`` are measured here unless they are given. If no group is large the result is None and the caller keeps its
    plain plan. The joined table has a row per large group, so at most ``rows / rows_per_slice`` rows.
    """
    slices = slices or slice_borders(df, keys, order, ties, rows_per_slice)
    if slices.borders is None:
        return None
    place = _place(slices.order, slices.ties)
    keys = list(keys)
    joined = df.withColumn("_at", place).join(slices.borders, keys, "left") if keys else df.withColumn("_at", place).join(F.broadcast(slices.borders))
    outer = F.size(F.filter("_tops", lambda b: b <= F.col("_at")))
    inner = F.size(F.filter(F.get(F.col("_inner"), F.col("_outer") - 1), lambda b: b <= F.col("_at")))
    number = F.when(F.col("_outer") > 0, (F.col("_outer") - 1) * F.col("_fan") + inner).otherwise(0)
    joined = joined.withColumn("_outer", outer).withColumns({"_slice": F.coalesce(number, F.lit(0)).cast("bigint"), "_split": F.col("_tops").isNotNull()})
    return joined.select(*df.columns, "_slice", "_split")


def in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    index: str | None = None,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    running: Mapping[str, Column] | None = None,
    last_known: Mapping[str, str] | None = None,
    next_known: Mapping[str, str] | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
    slices: Slices | None = None,
) -> DataFrame:
    """Add order-dependent columns to each group of ``keys``, rows ordered by ``order`` then ``ties``.

    ``index``: 0-based row number. ``lag`` / ``lead``: new name -> column of the neighbouring row. ``running``: new
    name -> expression summed over all rows so far, this one included. ``last_known`` / ``next_known``: new name ->
    column whose latest (earliest) non-missing value at or before (after) this row is wanted.

    One shuffle on (keys, slice) serves all of them, the join of carried values included. ``slices``: the cuts of the
    same keys, order and ties, where a step before has measured them (``slice_borders``).
    """
    keys = list(keys)
    lag, lead, running = dict(lag or {}), dict(lead or {}), dict(running or {})
    last_known, next_known = dict(last_known or {}), dict(next_known or {})
    sliced = with_slices(df, keys, order, rows_per_slice, ties, slices)
    split_groups = sliced is not None
    sliced = sliced if split_groups else df
    for name, expr in running.items():
        sliced = sliced.withColumn(f"_add_{name}", F.coalesce(expr, F.lit(0)))
    on = keys + ["_slice"] if split_groups else keys or [F.lit(0)]
    sort = [F.col(order), *[F.col(t) for t in ties]]
    w = W.partitionBy(*on).orderBy(*sort)
    upto, onward = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)

    local: dict[str, Column] = {}
    if index:
        local[index] = F.row_number().over(w).cast("bigint") - 1
    for name, c in lag.items():
        local[name] = F.lag(c).over(w)
    for name, c in lead.items():
        local[name] = F.lead(c).over(w)
    if lag or lead:
        local["_pos"] = F.row_number().over(w)
    if lead:
        local["_is_last"] = F.lead(F.lit(1)).over(w).isNull()
    for name in running:
        local[name] = F.sum(f"_add_{name}").over(upto)
    for name, c in last_known.items():
        local[name] = F.last(c, ignorenulls=True).over(upto)
    for name, c in next_known.items():
        local[name] = F.first(c, ignorenulls=True).over(onward)
    out = sliced.withColumns(local)
    new = [*([index] if index else []), *lag, *lead, *running, *last_known, *next_known]
    keep = [*[c for c in df.columns if c not in new], *new]
    if not split_groups:
        return out.select(*keep)

    # carried values: only slices of split groups, so the table is bounded by rows / rows_per_slice
    place = F.struct(*sort)
    split = sliced.filter("_split")
    edge = [F.count(F.lit(1)).alias("_n")]
    if lag:
        edge.append(F.max(F.struct(place, F.struct(*[F.col(c).alias(n) for n, c in lag.items()]).alias("v"))).alias("_tail"))
    if lead:
        edge.append(F.min(F.struct(place, F.struct(*[F.col(c).alias(n) for n, c in lead.items()]).alias("v"))).alias("_head"))
    edge += [F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in running]
    edge += [
        F.max(F.when(F.col(c).isNotNull(), F.struct(place, F.col(c).alias("v")))).alias(f"_last_{n}")
        for n, c in last_known.items()
    ]
    edge += [
        F.min(F.when(F.col(c).isNotNull(), F.struct(place, F.col(c).alias("v")))).alias(f"_next_{n}")
        for n, c in next_known.items()
    ]
    edges = split.groupBy(*on).agg(*edge)
    row = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_slice")
    before = row.rowsBetween(W.unboundedPreceding, -1)
    after = row.rowsBetween(1, W.unboundedFollowing)
    carry = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c_index")]
    if lag:
        carry.append(F.lag("_tail").over(row)["v"].alias("_c_lag"))
    if lead:
        carry.append(F.lead("_head").over(row)["v"].alias("_c_lead"))
    carry += [F.sum(f"_sum_{n}").over(before).alias(f"_c_{n}") for n in running]
    carry += [F.max(f"_last_{n}").over(before)["v"].alias(f"_c_{n}") for n in last_known]
    carry += [F.min(f"_next_{n}").over(after)["v"].alias(f"_c_{n}") for n in next_known]
    carried = edges.select(*on, *carry)
    out = out.join(carried, on, "left")

    fix: dict[str, Column] = {}
    if index:
        fix[index] = F.col(index) + F.coalesce(F.col("_c_index"), F.lit(0))
    for name in lag:
        fix[name] = F.when(F.col("_pos") == 1, F.col("_c_lag")[name]).otherwise(F.col(name))
    for name in lead:
        fix[name] = F.when(F.col("_is_last"), F.col("_c_lead")[name]).otherwise(F.col(name))
    for name in running:
        fix[name] = F.col(name) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
    for name in (*last_known, *next_known):
        fix[name] = F.coalesce(F.col(name), F.col(f"_c_{name}"))
    return out.withColumns(fix).select(*keep)


def with_blocks(df: DataFrame, index: str, before: int, after: int, rows: int = 1_000_000) -> DataFrame:
    """Cut an indexed group into blocks of ``rows`` rows, each with copies of its neighbours' border rows.

    A ROWS window of ``before`` preceding and ``after`` following rows partitioned by (keys, ``_block``) then sees
    everything it needs; keep only the rows with ``_own`` afterwards. Border rows alone are copied.
    """
    rows = max(rows, before, after, 1)
    block = F.floor(F.col(index) / F.lit(rows))
    pos = F.pmod(F.col(index), F.lit(rows))
    targets = F.array_compact(
        F.array(
            block,
            F.when((pos < after) & (block > 0), block - 1),
            F.when(pos >= rows - before, block + 1),
        )
    )
    return (
        df.withColumn("_home", block)
        .withColumn("_block", F.explode(targets))
        .withColumn("_own", F.col("_home") == F.col("_block"))
        .drop("_home")
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per group: ``{out: (column, q)}``; missing values are skipped.

    Small groups use the built-in exact aggregate, which keeps a group's distinct values in one buffer. A group above
    ``rows_per_slice`` is never gathered: its values are counted per slice, the slices that hold the wanted ranks are
    found from the counts, and only the rows of those slices are ranked.
    """
    keys = list(keys)
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    probs = sorted({q for _, q in wanted.values()})
    on = keys + ["_m"]
    long = df.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(c).alias("_m"), F.col(c).cast("double").alias("_v")) for c in columns])).alias("_s"),
    ).select(*keys, "_s._m", "_s._v").filter(F.col("_v").isNotNull())
    sliced = with_slices(long, on, "_v", rows_per_slice)
    split_groups = sliced is not None

    small = (sliced.filter(~F.col("_split")) if split_groups else long).groupBy(*on).agg(
        F.percentile("_v", F.array(*[F.lit(float(q)) for q in probs])).alias("_p")
    ).select(*on, F.posexplode("_p").alias("_q", "_value"))

    pick = [
        F.max(F.when((F.col("_m") == c) & (F.col("_q") == probs.index(q)), F.col("_value"))).alias(name)
        for name, (c, q) in wanted.items()
    ]
    if not split_groups:
        return small.groupBy(*keys).agg(*pick)

    split = sliced.filter("_split")
    sizes = split.groupBy(*on, "_slice").count()
    grp = W.partitionBy(*on)
    sizes = sizes.withColumn(
        "_below", F.coalesce(F.sum("count").over(grp.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_total", F.sum("count").over(grp))
    ask = F.explode(F.array(*[F.struct(F.lit(i).alias("_q"), F.lit(float(q)).alias("_prob")) for i, q in enumerate(probs)]))
    ranks = (
        sizes.withColumn("_a", ask)
        .withColumn("_at", F.col("_a._prob") * (F.col("_total") - 1))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
        .filter((F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("count")))
        .select(*on, "_slice", "_below", F.col("_a._q").alias("_q"), "_at", "_rank")
    )
    # at most two ranks per quantile of a split group: bounded by rows / rows_per_slice
    needed = ranks.select(*on, "_slice").distinct()
    counts = split.join(needed, on + ["_slice"], "left_semi").groupBy(*on, "_slice", "_v").count()
    counts = counts.withColumn(
        "_upto", F.sum("count").over(W.partitionBy(*on, "_slice").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    )
    large = (
        counts.join(ranks, on + ["_slice"])
        .filter(
            (F.col("_rank") - F.col("_below") < F.col("_upto"))
            & (F.col("_rank") - F.col("_below") >= F.col("_upto") - F.col("count"))
        )
        .groupBy(*on, "_q")
        .agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.max("_at").alias("_at"))
        .select(*on, "_q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))).alias("_value"))
    )
    both = small.unionByName(large)
    return both.groupBy(*keys).agg(*pick)
