"""Rooms as time intervals and as polygons.

A session's rooms and outlines are a handful of literals. They enter a plan as column expressions, so labelling a
frame or testing a point joins nothing and shuffles nothing. The ``*_table`` variants take a
DataFrame instead, for many sessions with rooms or outlines of their own; they join on the session key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EDGE_TOLERANCE = 1e-12


@dataclass(frozen=True)
class Room:
    name: str
    index: int
    start: float
    end: float
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Polygon:
    name: str
    vertices: Sequence[tuple[float, float]] = field(default_factory=list)

    @property
    def edges(self) -> list[tuple[float, float, float, float]]:
        v = list(self.vertices)
        return [(*v[i], *v[(i + 1) % len(v)]) for i in range(len(v))]

    @property
    def centroid(self) -> tuple[float, float]:
        cross = [(x1 * y2 - x2 * y1, x1 + x2, y1 + y2) for x1, y1, x2, y2 in self.edges]
        twice = sum(c for c, _, _ in cross)
        return sum(c * sx for c, sx, _ in cross) / (3 * twice), sum(c * sy for c, _, sy in cross) / (3 * twice)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*self.vertices)
        return min(xs), min(ys), max(xs), max(ys)


# ---------------------------------------------------------------- time intervals


def room_at(time: str, rooms: Sequence[Room]) -> Column:
    """First room, in map order, whose half-open interval holds the time; NULL when there is none."""
    t = F.col(time)
    label = None
    for r in rooms:
        hit = (t >= F.lit(float(r.start))) & (t < F.lit(float(r.end)))
        label = F.when(hit, r.name) if label is None else label.when(hit, r.name)
    return F.lit(None).cast("string") if label is None else label


def assign_room(df: DataFrame, rooms: Sequence[Room], time: str = "ts", room: str = "room") -> DataFrame:
    return df if room in df.columns else df.withColumn(room, room_at(time, rooms))


def assign_room_table(df: DataFrame, rooms: DataFrame, on: Sequence[str], time: str = "ts", room: str = "room") -> DataFrame:
    """As ``assign_room`` for ``rooms(on…, room, ord, t0, t1)`` that differ between sessions."""
    packed = rooms.groupBy(*on).agg(
        F.array_sort(F.collect_list(F.struct(F.col("ord"), F.col("t0"), F.col("t1"), F.col(room).alias("name")))).alias("_rooms")
    )
    hit = F.filter("_rooms", lambda r: (F.col(time) >= r["t0"]) & (F.col(time) < r["t1"]))
    return df.join(packed, list(on), "left").withColumn(room, F.get(hit, F.lit(0))["name"]).drop("_rooms")


def room_membership(df: DataFrame, rooms: Sequence[Room], time: str = "ts", room: str = "room") -> DataFrame:
    """The rows of each room with the room's index; rows outside every room are left out."""
    labelled = assign_room(df, rooms, time, room).filter(F.col(room).isNotNull())
    index = F.coalesce(*[F.when(F.col(room) == r.name, F.lit(r.index)) for r in rooms])
    return labelled.withColumn("room_index", index)


def room_counts(df: DataFrame, rooms: Sequence[Room], time: str = "ts") -> DataFrame:
    """Rows per room, rooms without rows included with 0."""
    label = room_at(time, rooms)
    one = df.select(label.alias("_r")).agg(*[F.count_if(F.col("_r") == r.name).alias(f"n{i}") for i, r in enumerate(rooms)])
    rows = F.array(
        *[
            F.struct(F.lit(r.name).alias("room"), F.lit(r.index).alias("room_index"), F.col(f"n{i}").alias("n_rows"))
            for i, r in enumerate(rooms)
        ]
    )
    return one.select(F.explode(rows).alias("_s")).select("_s.*")


def overall_time_range(rooms: DataFrame, keys: Sequence[str] = (), start: str = "t0", end: str = "t1") -> DataFrame:
    return rooms.groupBy(*keys).agg(F.min(start).alias("t_min"), F.max(end).alias("t_max"))


def transition_padding(df: DataFrame, seconds: float, keys: Sequence[str], time: str = "ts", room: str = "room", ties: Sequence[str] = ()) -> DataFrame:
    """Drop rows within ``seconds`` of a room change.

    A change happens at the first row of the new room. The latest change at or before a row and the earliest one
    after it are carried along the order, so no pair of rows is ever compared.
    """
    from wayfield.plans.ordered import in_order, slice_borders

    slices = slice_borders(df, keys, time, ties)
    marked = in_order(df, keys, time, ties, index="_i", lag={"_before": room}, slices=slices)
    changed = marked.withColumn(
        "_change", F.when((F.col("_i") > 0) & ~F.col(room).eqNullSafe(F.col("_before")), F.col(time))
    )
    near = in_order(changed, keys, time, ties, last_known={"_prev": "_change"}, next_known={"_next": "_change"}, slices=slices)
    close = (F.col(time) - F.col("_prev") <= seconds) | (F.col("_next") - F.col(time) <= seconds)
    return near.filter(~F.coalesce(close, F.lit(False))).select(*df.columns)


# ---------------------------------------------------------------- polygons


def edge_array(polygon: Polygon) -> Column:
    """The outline as a literal array of edges (folded to a constant)."""
    names = ("x1", "y1", "x2", "y2")
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, e)]) for e in polygon.edges])


def room_edges(room: str | Column, polygons: Sequence[Polygon]) -> Column:
    """Edges of the outline of the room named in the row; NULL for a room without one."""
    room = F.col(room) if isinstance(room, str) else room
    out = None
    for p in polygons:
        out = F.when(room == p.name, edge_array(p)) if out is None else out.when(room == p.name, edge_array(p))
    return out


def bind(values: dict[str, Column], body) -> Column:
    """``body`` of a struct of the values, each computed once however often the body uses it.

    Written out, a test against every edge of every room would become one method too long for the JVM to compile.
    """
    packed = F.array(F.struct(*[v.alias(n) for n, v in values.items()]))
    return F.get(F.transform(packed, body), F.lit(0))


_ON_EDGE = 1_000_000


def _ring_code(p: Column, edges: Column) -> Column:
    """Number of edges a ray to the right of the point crosses, plus a large step for each edge the point lies on."""

    def visit(acc: Column, e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        wx, wy = p["x"] - e["x1"], p["y"] - e["y1"]
        straddles = (e["y1"] > p["y"]) != (e["y2"] > p["y"])
        crosses = straddles & (p["x"] < F.try_divide(dx * wy, dy) + e["x1"])
        tol = F.lit(EDGE_TOLERANCE)
        touches = (
            (F.abs(dx * wy - dy * wx) <= tol * F.sqrt(dx * dx + dy * dy))
            & p["x"].between(F.least(e["x1"], e["x2"]) - tol, F.greatest(e["x1"], e["x2"]) + tol)
            & p["y"].between(F.least(e["y1"], e["y2"]) - tol, F.greatest(e["y1"], e["y2"]) + tol)
        )
        return acc + F.when(crosses, F.lit(1)).otherwise(F.lit(0)) + F.when(touches, F.lit(_ON_EDGE)).otherwise(F.lit(0))

    return F.aggregate(edges, F.lit(0), visit)


def inside_edges(x: Column, y: Column, edges: Column, edge: bool = False) -> Column:
    """Even-odd test of a point against an array of edges; false without edges. ``edge`` says whether the outline
    itself counts as inside."""
    code = bind({"x": x, "y": y, "edges": edges}, lambda p: _ring_code(p, p["edges"]))

    def verdict(c: Column) -> Column:
        on = c["v"] >= _ON_EDGE
        crossed = F.pmod(c["v"], F.lit(2)) == 1
        return (crossed | on) if edge else (crossed & ~on)

    return F.coalesce(bind({"v": code}, verdict), F.lit(False))


def in_polygon(x: str | Column, y: str | Column, polygon: Polygon, edge: bool = False) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return inside_edges(x, y, edge_array(polygon), edge)


def in_room(x: str | Column, y: str | Column, room: str | Column, polygons: Sequence[Polygon], edge: bool = False) -> Column:
    """Is the point inside the outline of the room named in the row? False for a room without an outline."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return inside_edges(x, y, room_edges(room, polygons), edge)


def _quick(p: Polygon) -> tuple[Column, Column]:
    """Crossing parity of (``_px``, ``_py``) with precomputed slopes, and whether the point is so close to the line of
    an edge that the exact test must decide."""
    x, y = F.col("_px"), F.col("_py")
    crossings, gaps = F.lit(0), []
    for x1, y1, x2, y2 in p.edges:
        dx, dy = x2 - x1, y2 - y1
        length = math.hypot(dx, dy)
        if length == 0:
            continue
        gaps.append(F.abs(x * F.lit(dy / length) - y * F.lit(dx / length) + F.lit((y1 * dx - x1 * dy) / length)))
        if dy != 0:
            hit = ((y < F.lit(y1)) != (y < F.lit(y2))) & (x < y * F.lit(dx / dy) + F.lit(x1 - y1 * dx / dy))
            crossings = crossings + hit.cast("int")
    near = F.least(*gaps) <= F.lit(1e-9) if len(gaps) > 1 else F.lit(True)
    return F.pmod(crossings, F.lit(2)) == 1, near


def with_inside(
    df: DataFrame, polygons: Sequence[Polygon], x: str = "x", y: str = "y", room: str = "room", edge: bool = False, out: str = "inside"
) -> DataFrame:
    """Add the in-outline flag to a large table.

    The usual point is decided by a few multiplications per edge inside generated code; only a point almost on the
    line of an edge goes through the exact test of ``in_room``. The one-element explode keeps the coordinates from
    being computed again for every edge.
    """
    nan = F.lit(float("nan"))
    at = F.struct(F.coalesce(F.col(x).cast("double"), nan).alias("_px"), F.coalesce(F.col(y).cast("double"), nan).alias("_py"))
    placed = df.withColumn("_at", F.explode(F.array(at))).select(*df.columns, "_at._px", "_at._py")
    flag = None
    for p in polygons:
        odd, near = _quick(p)
        test = F.when(near, in_polygon("_px", "_py", p, edge)).otherwise(odd)
        hit = F.col(room) == p.name
        flag = F.when(hit, test) if flag is None else flag.when(hit, test)
    return placed.withColumn(out, F.coalesce(flag, F.lit(False))).drop("_px", "_py")


def points_in_polygon(df: DataFrame, polygons: Sequence[Polygon], x: str = "x", y: str = "y", room: str = "room", edge: bool = False) -> DataFrame:
    return with_inside(df, polygons, x, y, room, edge, "_inside").filter("_inside").drop("_inside")


def points_in_polygon_table(
    df: DataFrame, outlines: DataFrame, on: Sequence[str], x: str = "x", y: str = "y", edge: bool = False, inside: str = "inside"
) -> DataFrame:
    """Flag points against ``outlines(on…, edges ARRAY<STRUCT<x1,y1,x2,y2>>)``, one outline per key."""
    joined = df.join(outlines.select(*on, "edges"), list(on), "left")
    return joined.withColumn(inside, inside_edges(F.col(x), F.col(y), F.col("edges"), edge)).drop("edges")


def outline_table(boundary: DataFrame, on: Sequence[str], order: str = "vertex_no", x: str = "x", y: str = "y") -> DataFrame:
    """Vertices of each outline as one array of edges, last vertex joined to the first. An outline is short."""
    packed = boundary.groupBy(*on).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("_v")
    )
    following = F.concat(F.slice("_v", 2, F.greatest(F.size("_v") - 1, F.lit(0))), F.slice("_v", 1, 1))
    edges = F.zip_with(
        "_v", following,
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )
    return packed.select(*on, edges.alias("edges"))


def polygon_area_centroid(outlines: DataFrame, on: Sequence[str], scale: float = 1.0) -> DataFrame:
    """Signed area and area centroid by the shoelace sums; the centroid of a flat outline is NULL."""
    k = F.lit(float(scale))

    def total(f) -> Column:
        return F.aggregate("edges", F.lit(0.0), lambda acc, e: acc + f(e))

    def cross(e: Column) -> Column:
        return e["x1"] * e["y2"] - e["x2"] * e["y1"]

    sums = outlines.select(
        *on,
        F.size("edges").alias("n_vertices"),
        total(cross).alias("_a"),
        total(lambda e: cross(e) * (e["x1"] + e["x2"])).alias("_cx"),
        total(lambda e: cross(e) * (e["y1"] + e["y2"])).alias("_cy"),
    )
    whole = F.when(F.abs("_a") > 1e-12, F.col("_a"))
    return sums.select(
        *on, "n_vertices",
        (F.col("_a") / 2 * k * k).alias("area"),
        (F.try_divide(F.col("_cx"), whole * 3) * k).alias("cx"),
        (F.try_divide(F.col("_cy"), whole * 3) * k).alias("cy"),
    )


def densify_boundary(outlines: DataFrame, on: Sequence[str], n: int) -> DataFrame:
    """``n`` evenly spaced points per edge, each edge without its end point."""
    edges = outlines.select(*on, F.posexplode("edges").alias("edge_no", "e"))
    steps = edges.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    f = F.col("step") / F.lit(float(n))
    return steps.select(
        *on, "edge_no", "step",
        (F.col("e.x1") + (F.col("e.x2") - F.col("e.x1")) * f).alias("x"),
        (F.col("e.y1") + (F.col("e.y2") - F.col("e.y1")) * f).alias("y"),
    )


def grid_nodes(bounds: DataFrame, n: int, keys: Sequence[str] = (), lo: str = "lo", hi: str = "hi") -> DataFrame:
    """An n-by-n node grid over ``[lo, hi]`` on both axes, per row of ``bounds``; node index 0 to n-1."""
    axis = F.sequence(F.lit(0), F.lit(n - 1))
    step = (F.col(hi) - F.col(lo)) / F.lit(float(n - 1))
    return (
        bounds.withColumn("gx", F.explode(axis))
        .withColumn("gy", F.explode(axis))
        .select(*keys, "gx", "gy", (F.col(lo) + F.col("gx") * step).alias("x"), (F.col(lo) + F.col("gy") * step).alias("y"))
    )


def room_grid(bounds: DataFrame, n: int, polygons: Sequence[Polygon]) -> DataFrame:
    """Grid nodes covered by each room's outline (its edge included)."""
    nodes = grid_nodes(bounds, n)
    rooms = nodes.withColumn("room", F.explode(F.array(*[F.lit(p.name) for p in polygons])))
    return points_in_polygon(rooms, polygons, edge=True)


def in_room_without_holes(x: str, y: str, room: Polygon, holes: Sequence[Polygon], edge: bool = True) -> Column:
    """Inside the room and in none of the rooms it excludes (holes lie inside the outer ring)."""
    inside = in_polygon(x, y, room, edge)
    for hole in holes:
        inside = inside & ~in_polygon(x, y, hole, not edge)
    return inside


# ---------------------------------------------------------------- distance to the wall

NEARBY = 0.05  # fixed value: how far outside a point may lie and still be snapped back


def _cast_rays(x: np.ndarray, y: np.ndarray, polygon: Polygon, angles: np.ndarray, nearby: float) -> np.ndarray:
    """Distances (points by angles) for one room, all edges and angles at once."""
    x1, y1, x2, y2 = np.array(polygon.edges).T
    ex, ey = x2 - x1, y2 - y1
    length = np.hypot(ex, ey)
    wx, wy = x[:, None] - x1, y[:, None] - y1
    with np.errstate(divide="ignore", invalid="ignore"):
        straddles = (y1 > y[:, None]) != (y2 > y[:, None])
        odd = (straddles & (wx < ex * wy / ey)).sum(axis=1) % 2 == 1
        f = np.clip((wx * ex + wy * ey) / (length * length), 0, 1)
        nx, ny = x1 + f * ex, y1 + f * ey
        gaps = np.hypot(x[:, None] - nx, y[:, None] - ny)
        best = gaps.argmin(axis=1)
        rows = np.arange(len(x))
        gap, nx, ny = gaps[rows, best], nx[rows, best], ny[rows, best]
        inside = odd | (gap <= EDGE_TOLERANCE)
        cx, cy = polygon.centroid
        norm = np.hypot(cx - nx, cy - ny)
        flat = norm < 1e-9
        ux, uy = np.where(flat, 0.0, (cx - nx) / norm), np.where(flat, 1.0, (cy - ny) / norm)
        sx, sy = np.where(inside, x, nx + nearby * ux), np.where(inside, y, ny + nearby * uy)
        dx, dy = np.cos(np.radians(angles)), np.sin(np.radians(angles))
        vx, vy = (x1 - sx[:, None])[:, None, :], (y1 - sy[:, None])[:, None, :]
        denom = dx[:, None] * ey - dy[:, None] * ex
        denom = np.where(np.abs(denom) > 1e-15, denom, np.nan)
        t = (vx * ey - vy * ex) / denom
        u = (vx * dy[:, None] - vy * dx[:, None]) / denom
        hit = np.where((t >= 0) & (u >= -EDGE_TOLERANCE) & (u <= 1 + EDGE_TOLERANCE), t, np.inf).min(axis=2)
    hit[~np.isfinite(hit)] = -1.0
    hit[~inside & ~(gap <= nearby)] = -1.0
    return hit


def ray_distance(
    df: DataFrame, angles: Sequence[float], polygons: Sequence[Polygon], x: str = "x", y: str = "y", room: str = "room", nearby: float = NEARBY
) -> DataFrame:
    """Distance from each point to its room's wall along each angle (degrees), one row per point and angle.

    -1 where the ray meets no wall or the point lies farther than ``nearby`` outside. A point slightly outside is
    moved to the nearest wall point and from there by ``nearby`` towards the room's centroid.
    """
    rays = ray_distances(df, angles, polygons, x, y, room, nearby)
    table = F.array(*[F.lit(float(a)) for a in angles])
    return rays.select(*df.columns, F.posexplode("distances").alias("_i", "distance")).select(
        *df.columns, F.get(table, F.col("_i")).alias("angle"), "distance"
    )


def ray_distances(
    df: DataFrame, angles: Sequence[float], polygons: Sequence[Polygon], x: str = "x", y: str = "y", room: str = "room", nearby: float = NEARBY
) -> DataFrame:
    """``ray_distance`` as one array ``distances`` per point, the form polar maps take: no row is multiplied.

    Points times angles times edges is matrix work: a vectorised function over Arrow batches, row by row independent.
    """
    turns, outlines = np.array([float(a) for a in angles]), list(polygons)

    @F.pandas_udf("array<double>")
    def cast(px: pd.Series, py: pd.Series, names: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(px), dtype=object)
        for p in outlines:
            rows = np.flatnonzero((names == p.name).to_numpy() & px.notna().to_numpy() & py.notna().to_numpy())
            if len(rows):
                found = _cast_rays(px.to_numpy(float)[rows], py.to_numpy(float)[rows], p, turns, nearby)
                for i, r in enumerate(rows):
                    out.iat[r] = found[i]
        return out

    return df.withColumn("distances", cast(F.col(x).cast("double"), F.col(y).cast("double"), F.col(room)))
