"""The cross-room map table: every room pair of every group fitted in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfield.operators.affine import decompose_affine, moment_aggs, solve_moments
from wayfield.operators.decoding import column_suffixes
from wayfield.operators.outlines import Outlines, with_inside_table
from wayfield.operators.rooms import Polygon, with_inside


def pair_rows(
    wide: DataFrame, pairs: Sequence[tuple[str, str]], rooms: Sequence[str], room: str = "room", mode: str = "both",
    x: str = "x_pred", y: str = "y_pred", keep: Sequence[str] = (),
) -> DataFrame:
    """One row per frame and room pair it belongs to, with both rooms' predicted positions.

    Frames with any missing prediction are dropped. ``mode`` says whether a pair uses the frames of ``both`` rooms or
    only those recorded in the ``source`` or ``target`` room.
    """
    name = column_suffixes(rooms)
    complete = wide.dropna(subset=[f"{p}_{name[r]}" for r in rooms for p in (x, y) if f"{p}_{name[r]}" in wide.columns])
    here = F.col(room)
    options = []
    for s, t in pairs:
        member = {"both": here.isin(s, t), "source": here == s, "target": here == t}[mode]
        options.append(
            F.when(
                member,
                F.struct(
                    F.lit(s).alias("source_room"), F.lit(t).alias("target_room"),
                    F.col(f"{x}_{name[s]}").alias("sx"), F.col(f"{y}_{name[s]}").alias("sy"),
                    F.col(f"{x}_{name[t]}").alias("tx"), F.col(f"{y}_{name[t]}").alias("ty"),
                ),
            )
        )
    return complete.select(*keep, F.explode(F.array_compact(F.array(*options))).alias("_p")).select(*keep, "_p.*")


def _centre(name: str, polygons: Sequence[Polygon]) -> tuple[Column, Column]:
    x = y = None
    for p in polygons:
        cx, cy = p.centroid
        hit = F.col(name) == p.name
        x = F.when(hit, F.lit(cx)) if x is None else x.when(hit, F.lit(cx))
        y = F.when(hit, F.lit(cy)) if y is None else y.when(hit, F.lit(cy))
    return x, y


def centred_pairs(rows: DataFrame, polygons: Sequence[Polygon]) -> DataFrame:
    """Flag pairs whose points lie inside both outlines and centre each point on its room's centroid."""
    both = with_inside(with_inside(rows, polygons, "sx", "sy", "source_room", out="_in_s"), polygons, "tx", "ty", "target_room", out="_in_t")
    flagged = both.withColumn("inside", F.col("_in_s") & F.col("_in_t")).drop("_in_s", "_in_t")
    csx, csy = _centre("source_room", polygons)
    ctx, cty = _centre("target_room", polygons)
    return flagged.withColumns(
        {
            "sx": F.col("sx") - csx, "sy": F.col("sy") - csy,
            "tx": F.col("tx") - ctx, "ty": F.col("ty") - cty,
        }
    )


def mapping_fits(
    wide: DataFrame, pairs: Sequence[tuple[str, str]], polygons: Sequence[Polygon], keys: Sequence[str] = (),
    room: str = "room", mode: str = "both", min_points: int = 10,
) -> DataFrame:
    """Fitted map per (keys, pair) with its quality and decomposition.

    ``min_points`` is tested before the outline filter; at least two points must remain after it. Both counts and all
    moments come from one aggregate.
    """
    rows = centred_pairs(pair_rows(wide, pairs, [p.name for p in polygons], room, mode, keep=keys), polygons)
    return _fits(rows, keys, min_points)


def _fits(rows: DataFrame, keys: Sequence[str], min_points: int) -> DataFrame:
    by = [*keys, "source_room", "target_room"]
    moments = moment_aggs(F.col("sx"), F.col("sy"), F.col("tx"), F.col("ty"), F.col("inside"))
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_points"), *moments)
    enough = sums.filter((F.col("n_points") >= min_points) & (F.col("n") >= 2))
    return decompose_affine(solve_moments(enough))


def mapping_stats(
    wide: DataFrame, pairs: Sequence[tuple[str, str]], polygons: Sequence[Polygon], keys: Sequence[str] = (),
    room: str = "room", mode: str = "both", min_points: int = 10, cm_per_unit: float = 1.0,
) -> DataFrame:
    """The eight-column table: rooms, fit quality, angle, reflection and stretch of each pair's map."""
    return _stats(mapping_fits(wide, pairs, polygons, keys, room, mode, min_points), keys, cm_per_unit)


def _stats(fits: DataFrame, keys: Sequence[str], cm_per_unit: float) -> DataFrame:
    return fits.select(
        *keys, "source_room", "target_room", F.col("r2").alias("affinity_r2"),
        (F.col("rmse") * F.lit(float(cm_per_unit))).alias("rmse_cm"),
        "angle_deg", "reflection", "max_eigenvalue", "min_eigenvalue",
    )


def centred_pairs_table(rows: DataFrame, outlines: Outlines, keys: Sequence[str], room: str = "room") -> DataFrame:
    """``centred_pairs`` against each session's own outlines, with the rooms that a room excludes cut out of it."""
    for side, out in (("source_room", "s"), ("target_room", "t")):
        names = {**{k: k for k in keys}, room: side}
        rows = with_inside_table(rows, outlines, names, f"{out}x", f"{out}y", out=f"_in_{out}", centroid=(f"_c{out}x", f"_c{out}y"))
    rows = rows.withColumns({"inside": F.col("_in_s") & F.col("_in_t")} | {f"{a}{c}": F.col(f"{a}{c}") - F.col(f"_c{a}{c}") for a in "st" for c in "xy"})
    return rows.drop("_in_s", "_in_t", "_csx", "_csy", "_ctx", "_cty")


def mapping_stats_table(
    wide: DataFrame, pairs: Sequence[tuple[str, str]], outlines: Outlines, keys: Sequence[str],
    room: str = "room", mode: str = "both", min_points: int = 10, cm_per_unit: float = 1.0,
) -> DataFrame:
    """``mapping_stats`` over sessions with outlines of their own (an index on ``keys`` and ``room``), in one job.

    A pair's points inside both outlines of their session are centred on those outlines' centroids.
    """
    rooms = sorted({r for pair in pairs for r in pair})
    rows = centred_pairs_table(pair_rows(wide, pairs, rooms, room, mode, keep=keys), outlines, keys, room)
    return _stats(_fits(rows, keys, min_points), keys, cm_per_unit)
