"""Row-level work on frame and unit tables: filters, reshaping, scaling, validation and set operations."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfield.functions.numeric import finite, percent
from wayfield.plans.ordered import ROWS_PER_SLICE, in_order


def time_range_filter(df: DataFrame, start: float, end: float, closed: bool = True, time: str = "ts") -> DataFrame:
    t = F.col(time)
    return df.filter((t >= float(start)) & ((t <= float(end)) if closed else (t < float(end))))


# Two names of the same flag column.
FLAG_ALIASES = {"Velocity_Cell": "Speed_Cell", "Speed_Cell": "Velocity_Cell"}


def label_condition(df: DataFrame, wanted: Mapping[str, object]) -> Column:
    """All of ``column == value`` or ``column in values``; unknown columns are skipped with a warning."""
    tests = [F.lit(True)]
    for name, value in wanted.items():
        column = name if name in df.columns else FLAG_ALIASES.get(name, name)
        if column not in df.columns:
            warnings.warn(f"no column {name} to filter by", stacklevel=2)
            continue
        c = F.col(column)
        tests.append(c.isin(list(value)) if isinstance(value, (list, tuple, set)) else c == value)
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def filter_by_labels(df: DataFrame, wanted: Mapping[str, object], require: bool = False) -> DataFrame:
    """Units that match every label. ``require`` looks whether any unit is left and raises if none is."""
    kept = df.filter(label_condition(df, wanted))
    if require and kept.isEmpty():
        raise ValueError(f"no unit matches {dict(wanted)}")
    return kept


def label_counts(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    return df.agg(F.count_if(label_condition(df, wanted)).alias("n_active"), F.count(F.lit(1)).alias("n_total"))


def include_exclude_filter(
    df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), min_rate: float | None = None,
    max_rate: float | None = None, label: str = "label", rate: str = "rate",
) -> DataFrame:
    tests = [F.lit(True)]
    if include:
        tests.append(F.col(label).isin(list(include)))
    if exclude:
        tests.append(~F.col(label).isin(list(exclude)))
    if min_rate is not None:
        tests.append(F.col(rate) >= min_rate)
    if max_rate is not None:
        tests.append(F.col(rate) <= max_rate)
    return df.filter(reduce(lambda a, b: a & b, tests))


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows with a missing value in any of the listed columns the table has."""
    present = [c for c in columns if c in df.columns]
    return df.dropna(subset=present) if present else df


def room_filter(df: DataFrame, source: str, target: str, mode: str = "both", room: str = "room") -> DataFrame:
    names = {"both": [source, target], "source": [source], "target": [target]}[mode]
    return df.filter(F.col(room).isin(names))


def normalise_room(room: str | Column) -> Column:
    """``A'`` becomes ``a``; names without the mark stay, NULL stays NULL."""
    c = F.col(room) if isinstance(room, str) else room
    # marked only in the capitalised form: first letter upper, rest lower
    capital = F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 20)))
    marked = c.contains("'") & (capital == c)
    return F.when(marked, F.lower(F.regexp_replace(c, "'", ""))).otherwise(c)


def normalise_rooms(rooms: str) -> Column:
    """An array of names as ``[A,a]``; missing names are left out, no names at all give NULL."""
    clean = F.transform(F.filter(rooms, lambda r: r.isNotNull()), normalise_room)
    return F.when(F.size(clean) > 0, F.concat(F.lit("["), F.array_join(clean, ","), F.lit("]")))


def scale_positions(value: str | Column, scale: Column | float, offset: Column | float = 0.0, reverse: bool = False, scale_only: bool = False) -> Column:
    """Linear scaler ``v * scale + offset``, its inverse, or only its scale. Missing values stay missing."""
    v = F.col(value) if isinstance(value, str) else value
    k = scale if isinstance(scale, Column) else F.lit(float(scale))
    b = F.lit(0.0) if scale_only else (offset if isinstance(offset, Column) else F.lit(float(offset)))
    return F.try_divide(v - b, k) if reverse else v * k + b


def minmax_scaler(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Scale and offset that map the joint range of the columns to [0, 1]."""
    lo = F.least(*[F.min(c) for c in columns]) if len(columns) > 1 else F.min(columns[0])
    hi = F.greatest(*[F.max(c) for c in columns]) if len(columns) > 1 else F.max(columns[0])
    span = df.groupBy(*keys).agg(lo.alias("_lo"), hi.alias("_hi"))
    scale = F.coalesce(F.try_divide(F.lit(1.0), F.col("_hi") - F.col("_lo")), F.lit(1.0))
    return span.select(*keys, scale.alias("scale"), (-F.col("_lo") * scale).alias("offset"))


def rmse_to_cm(df: DataFrame, cm_per_unit: float) -> DataFrame:
    """Rescale every column whose name contains ``rmse``."""
    hits = [c for c in df.columns if "rmse" in c.lower()]
    return df.withColumns({c: F.col(c) * F.lit(float(cm_per_unit)) for c in hits})


def validate_table(
    df: DataFrame, keys: Sequence[str], time: str = "ts", row: str = "frame_id", required: Sequence[str] = (), cell_prefix: str = "Cell",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Quality report per group: rows, missing and duplicate times, order, cell columns, all-missing cell columns."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    cells = [c for c in df.columns if c.startswith(cell_prefix)]
    if not keys:
        whole = validate_table(df.withColumn("_all", F.lit(0)), ["_all"], time, row, required, cell_prefix, rows_per_slice)
        return whole.drop("_all")
    checked = in_order(df, keys, row, lag={"_before": time}, rows_per_slice=rows_per_slice)
    t = finite(time)
    distinct = df.select(*keys, t.alias("_t")).groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("_n"))
    duplicates = distinct.groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias("duplicate_times"))
    empty = sum((F.when(F.count(finite(c)) == 0, 1).otherwise(0) for c in cells), F.lit(0))
    report = checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(t.isNull()).alias("missing_times"),
        (F.count_if(F.col(time) < F.col("_before")) == 0).alias("is_monotonic"),
        F.lit(len(cells)).alias("n_cell_columns"),
        empty.alias("n_empty_cells"),
    )
    return report.join(duplicates, list(keys))


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a missing feature or target."""
    return df.filter(reduce(lambda a, b: a & b, [finite(c).isNotNull() for c in columns]))


def finite_report(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    whole = reduce(lambda a, b: a & b, [finite(c).isNotNull() for c in columns])
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(~whole).alias("n_dropped"),
        percent(F.count_if(~whole), F.count(F.lit(1))).alias("pct_dropped"),
    )


def heading_radians(df: DataFrame, hd: str = "hd") -> DataFrame:
    return df.withColumn(hd, F.radians(hd))


def select_by_rooms(df: DataFrame, wanted: Sequence[str], room: str = "room") -> DataFrame:
    """Rooms of the data that were asked for."""
    return df.filter(F.col(room).isin(list(wanted))).select(room).distinct()


# ---------------------------------------------------------------- set operations


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first)


def except_rows(df: DataFrame, remove: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(remove.select(*on), list(on), "left_anti")


def common_ids(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.select(*on).intersect(b.select(*on))


def align_by_id(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b, list(on), "inner")


def split_membership(df: DataFrame, split: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(split.select(*on), list(on), "left_semi")


def distinct_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def param_grid(table: DataFrame, values: Mapping[str, Sequence], first: Sequence[str] = ()) -> DataFrame:
    """Every combination of a table's distinct rows with the listed values of further parameters, chosen keys first.

    The table stays distributed, whatever its size; the values are given by the caller, in Python, and are exploded per
    row. NULL is a value like any other.
    """
    grid = table.distinct()
    for name, items in values.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in items])))
    return grid.select(*first, *[c for c in grid.columns if c not in first])


def skip_list(grid: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Parameter rows that were not run yet."""
    return grid.join(done.select(*on).distinct(), list(on), "left_anti")


def append_done(done: DataFrame, params: DataFrame, score: Column, seconds: Column) -> DataFrame:
    return done.unionByName(params.withColumns({"score": score, "seconds": seconds}), allowMissingColumns=True)


def missing_pairs(df: DataFrame, keys: Sequence[str], folds: int, offsets: Sequence[int], fold: str = "fold", offset: str = "offset_no") -> DataFrame:
    """Expected (fold, offset) pairs of each group that have no row."""
    present = df.select(*keys, fold, offset).distinct()
    expected = (
        df.select(*keys).distinct()
        .withColumn(fold, F.explode(F.sequence(F.lit(1), F.lit(folds))))
        .withColumn(offset, F.explode(F.array(*[F.lit(int(o)) for o in offsets])))
    )
    return expected.join(present, [*keys, fold, offset], "left_anti")


def training_plan(
    folds: int, offsets: Sequence[int], joint: Sequence[str], rooms: DataFrame, done: DataFrame, room: str = "room", fold: str = "fold", offset: str = "offset_no"
) -> DataFrame:
    """Jobs still to run: one step for the jointly trained rooms, one per other room, for each fold and offset."""
    step = F.when(F.col(room).isin(list(joint)), F.lit("+".join(joint))).otherwise(F.col(room))
    steps = rooms.select(step.alias("step")).distinct()
    jobs = steps.withColumn(fold, F.explode(F.sequence(F.lit(1), F.lit(folds)))).withColumn(
        offset, F.explode(F.array(*[F.lit(int(o)) for o in offsets]))
    )
    return jobs.join(done.select("step", fold, offset).distinct(), ["step", fold, offset], "left_anti")


def room_order(df: DataFrame, preferred: Sequence[str], room: str = "room") -> DataFrame:
    """Sort key per row: place in the preferred list, then length and name. Rooms not listed come last."""
    place = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(room))
    rank = F.when(place > 0, place).otherwise(F.lit(len(preferred) + 1))
    return df.withColumns({"room_rank": rank.cast("int"), "room_length": F.length(room)}).orderBy("room_rank", "room_length", room)


def sort_keys(df: DataFrame, keys: Sequence[str] = ("row_key", "offset_no", "fold")) -> DataFrame:
    return df.orderBy(*keys)


def count_lookup(df: DataFrame, keys: Sequence[str], distinct: Mapping[str, str], rows: str = "n") -> DataFrame:
    """Per group, the number of distinct values of each column (``distinct``: column to result name) and of rows.

    Counts of the distinct combinations come first, so the second aggregate sees a few rows per group.
    """
    combos = df.groupBy(*keys, *distinct).agg(F.count(F.lit(1)).alias(rows))
    return combos.groupBy(*keys).agg(*[F.countDistinct(c).alias(name) for c, name in distinct.items()], F.sum(rows).alias(rows))
