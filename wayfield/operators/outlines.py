"""Outlines that differ between sessions: point tests, masks and wall distances against a table of outlines.

An outline is cut into slabs of equal height, about as many as it has edges, and a slab lists the edges that reach into it.
A point computes its slab from its own y and meets only that slab's edges, a few of thousands. Slabs are as high as needed for
four entries per edge, so an index grows with its outline however long the edges are. Ring 0 is the outline; further rings
are holes, the outlines of the rooms that a room excludes, at most ``MAX_HOLES`` of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayfield.operators.rooms import EDGE_TOLERANCE, NEARBY, bind
from wayfield.session import cut_lineage, stored

MAX_HOLES = 61
_REACH = 2 * EDGE_TOLERANCE


@dataclass(frozen=True)
class Outlines:
    """``edges``: a row per edge with its ring; ``heads``: slab height, lowest y and centroid; ``slabs``: edges by slab."""

    on: tuple[str, ...]
    edges: DataFrame
    heads: DataFrame
    slabs: DataFrame


def ring_edges(boundary: DataFrame, on: Sequence[str], order: str = "vertex_no", x: str = "x", y: str = "y", exclude: DataFrame | None = None, room: str = "room") -> DataFrame:
    """on…, ring, x1, y1, x2, y2: a row per edge, the last vertex joined to the first.

    ``exclude(on…, hole)`` names the rooms that are cut out of a room, by their value of ``room``; their outlines become its
    further rings.
    """
    on = list(on)
    w = W.partitionBy(*on).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    at = [F.col(x).cast("double"), F.col(y).cast("double")]
    sides = boundary.select(
        *on, F.lit(0).alias("ring"), at[0].alias("x1"), at[1].alias("y1"),
        *(F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(n) for c, n in zip(at, ("x2", "y2"))),
    )
    if exclude is None:
        return sides
    rank = F.dense_rank().over(W.partitionBy(*on).orderBy("hole"))
    named = exclude.select(*on, "hole").distinct().withColumn("_ring", rank)
    too_many = F.raise_error(F.lit(f"an outline with more than {MAX_HOLES} holes"))
    named = named.withColumn("_ring", F.when(F.col("_ring") <= MAX_HOLES, F.col("_ring")).otherwise(too_many))
    others = [k for k in on if k != room]
    cut = sides.select(*others, F.col(room).alias("hole"), "x1", "y1", "x2", "y2").join(named, [*others, "hole"])
    return sides.unionByName(cut.select(*on, F.col("_ring").alias("ring"), "x1", "y1", "x2", "y2"))


def index_outlines(edges: DataFrame, on: Sequence[str]) -> Outlines:
    """The slab index of every outline; written once, as every test reads it, as tables whose size Spark knows when it joins points."""
    on = list(on)
    edges = cut_lineage(edges.select(*on, "ring", "x1", "y1", "x2", "y2"))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    cross = F.when(F.col("ring") == 0, F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).otherwise(0.0)
    sums = edges.groupBy(*on).agg(
        F.count(F.lit(1)).alias("_n"), F.min(low).alias("y0"), F.max(high).alias("_y1"), F.sum(high - low).alias("_rise"),
        F.sum(cross).alias("_a"), F.sum(cross * (F.col("x1") + F.col("x2"))).alias("_cx"), F.sum(cross * (F.col("y1") + F.col("y2"))).alias("_cy"),
    )
    height = F.greatest((F.col("_y1") - F.col("y0")) / F.col("_n"), F.col("_rise") / (F.col("_n") * 3))
    whole = F.when(F.abs("_a") > 1e-12, F.col("_a") * 3)
    heads = stored(
        sums.select(*on, "y0", F.when(height > 0, height).otherwise(1.0).alias("step"), F.try_divide("_cx", whole).alias("cx"), F.try_divide("_cy", whole).alias("cy"))
    )
    placed = edges.join(heads, on)
    reach = F.sequence(_slab(low - _REACH), _slab(high + _REACH))
    slabs = placed.select(*on, F.explode(reach).alias("slab"), F.struct("ring", "x1", "y1", "x2", "y2").alias("e"))
    return Outlines(tuple(on), edges, heads, stored(slabs.groupBy(*on, "slab").agg(F.collect_list("e").alias("edges"))))


def _slab(y: Column) -> Column:
    return F.floor((y - F.col("y0")) / F.col("step"))


def _ring_codes(p: Column) -> Column:
    """Two masks of rings: those whose parity is odd to the right of the point, and those that it lies on."""

    def visit(acc: Column, e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        wx, wy = p["x"] - e["x1"], p["y"] - e["y1"]
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), e["ring"])
        crosses = ((e["y1"] > p["y"]) != (e["y2"] > p["y"])) & (p["x"] < F.try_divide(dx * wy, dy) + e["x1"])
        tol = F.lit(EDGE_TOLERANCE)
        touches = (
            (F.abs(dx * wy - dy * wx) <= tol * F.sqrt(dx * dx + dy * dy))
            & p["x"].between(F.least(e["x1"], e["x2"]) - tol, F.greatest(e["x1"], e["x2"]) + tol)
            & p["y"].between(F.least(e["y1"], e["y2"]) - tol, F.greatest(e["y1"], e["y2"]) + tol)
        )
        none = F.lit(0).cast("long")
        return F.struct(
            acc["odd"].bitwiseXOR(F.when(crosses, bit).otherwise(none)).alias("odd"),
            acc["on"].bitwiseOR(F.when(touches, bit).otherwise(none)).alias("on"),
        )

    zero = F.lit(0).cast("long")
    return F.aggregate(p["edges"], F.struct(zero.alias("odd"), zero.alias("on")), visit)


def with_inside_table(
    df: DataFrame, outlines: Outlines, keys: Mapping[str, str] | None = None, x: str | Column = "x", y: str | Column = "y",
    edge: bool = False, out: str = "inside", centroid: tuple[str, str] | None = None,
) -> DataFrame:
    """Add the flag whether a point lies in its outline and in none of its holes, and the outline's centroid if wanted.

    ``keys`` maps key columns of the index to columns of ``df`` (same names if left out). ``edge``: do the outline and
    the holes' borders count as inside? Points without an outline or a coordinate are outside.
    """
    keys = dict(keys or {}) or {k: k for k in outlines.on}
    px, py = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    work = df.withColumns({"_px": px.cast("double"), "_py": py.cast("double")})

    extra = [F.col(c).alias(name) for c, name in zip(("cx", "cy"), centroid or ())]
    heads = outlines.heads.alias("heads")
    work = work.alias("rows").join(heads, [F.col(f"rows.{keys[k]}") == F.col(f"heads.{k}") for k in outlines.on], "left")
    work = work.select(*[F.col(f"rows.{c}") for c in df.columns], "_px", "_py", _slab(F.col("_py")).alias("_slab"), *extra)
    slabs = outlines.slabs.alias("slabs")
    on = [F.col(f"rows.{keys[k]}") == F.col(f"slabs.{k}") for k in outlines.on] + [F.col("_slab") == F.col("slabs.slab")]
    work = work.alias("rows").join(slabs, on, "left")
    codes = bind({"x": F.col("_px"), "y": F.col("_py"), "edges": F.col("slabs.edges")}, _ring_codes)

    def verdict(c: Column) -> Column:
        odd, on_ring = c["v"]["odd"], c["v"]["on"]
        covered = odd.bitwiseOR(on_ring) if edge else odd.bitwiseAND(F.bitwise_not(on_ring))
        cut = odd.bitwiseAND(F.bitwise_not(on_ring)) if edge else odd.bitwiseOR(on_ring)
        return (covered.bitwiseAND(F.lit(1)) == 1) & (F.call_function("shiftright", cut, F.lit(1)) == 0)

    flag = F.coalesce(bind({"v": codes}, verdict), F.lit(False))
    return work.select(*[F.col(f"rows.{c}") for c in df.columns], *(centroid or ()), flag.alias(out))


def mask_map_table(
    maps: DataFrame, outlines: Outlines, n: int, lo: float, hi: float, keys: Mapping[str, str] | None = None, at: str = "node", value: str = "value"
) -> DataFrame:
    """``mask_map`` for maps of many sessions: 0 where a bin's ``node`` is outside its outline, missing where its ``centre`` is."""
    shift, step = 0.5 if at == "centre" else 0.0, (hi - lo) / (n - 1)
    x, y = F.lit(lo) + (F.col("bx") + shift) * step, F.lit(lo) + (F.col("by") + shift) * step
    inside = with_inside_table(maps, outlines, keys, x, y, edge=True, out="_inside")
    blank = F.lit(None if at == "centre" else 0.0).cast("double")
    return inside.withColumn(value, F.when(F.col("_inside"), F.col(value)).otherwise(blank)).drop("_inside")


# ---------------------------------------------------------------- distance to the wall


class Walls:
    """Edges of one outline in slabs of one direction: those that a line along it can meet."""

    CANDIDATES = 1 << 21

    def __init__(self, edges: np.ndarray, angle: float = 0.0):
        self.cos, self.sin = np.cos(np.radians(angle)), np.sin(np.radians(angle))
        self.x1, self.y1 = self.turned(edges[:, 0], edges[:, 1])
        self.x2, self.y2 = self.turned(edges[:, 2], edges[:, 3])
        low, high = np.minimum(self.y1, self.y2), np.maximum(self.y1, self.y2)
        n = len(edges)
        self.low = float(low.min())
        self.step = max((float(high.max()) - self.low) / n, float((high - low).sum()) / (3 * n)) or 1.0
        first, last = self.slab(low - _REACH), self.slab(high + _REACH)
        self.base, slabs = int(first.min()), int(last.max()) - int(first.min()) + 1
        counts = last - first + 1
        edge = np.repeat(np.arange(n), counts)
        slab = np.repeat(first - self.base, counts) + np.arange(len(edge)) - np.repeat(np.cumsum(counts) - counts, counts)
        order = np.argsort(slab, kind="stable")
        self.edge = edge[order]
        self.start = np.searchsorted(slab[order], np.arange(slabs + 1))

    def turned(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x * self.cos + y * self.sin, y * self.cos - x * self.sin

    def slab(self, y: np.ndarray) -> np.ndarray:
        return np.floor((y - self.low) / self.step).astype(np.int64)

    def pairs(self, low: np.ndarray, high: np.ndarray):
        """(points, edges) in blocks, each point with the edges of the slabs between its two heights."""
        slabs = len(self.start) - 1
        begin = self.start[np.clip(self.slab(low) - self.base, 0, slabs)]
        end = self.start[np.clip(self.slab(high) - self.base + 1, 0, slabs)]
        counts = np.maximum(end - begin, 0)
        total = np.cumsum(counts)
        at = 0
        while at < len(low):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + self.CANDIDATES, side="right")))
            c = counts[at:stop]
            point = np.repeat(np.arange(at, stop), c)
            yield point, self.edge[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[at:stop], c)]
            at = stop


def _inside(walls: Walls, ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inside ring 0 and no other ring, by crossings."""
    odd = np.zeros((len(x), int(ring.max()) + 1), dtype=bool)
    for point, e in walls.pairs(y, y):
        straddles = (walls.y1[e] > y[point]) != (walls.y2[e] > y[point])
        point, e = point[straddles], e[straddles]
        cut = (walls.x2[e] - walls.x1[e]) * (y[point] - walls.y1[e]) / (walls.y2[e] - walls.y1[e]) + walls.x1[e]
        right = x[point] < cut
        np.logical_xor.at(odd, (point[right], ring[e[right]]), True)
    return odd[:, 0] & ~odd[:, 1:].any(axis=1)


def _nearest(walls: Walls, x: np.ndarray, y: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance to the nearest wall point and that point, where it is no further than ``within``; else infinite."""
    gap, nx, ny = np.full(len(x), np.inf), np.zeros(len(x)), np.zeros(len(x))
    for point, e in walls.pairs(y - within - _REACH, y + within + _REACH):
        ex, ey = walls.x2[e] - walls.x1[e], walls.y2[e] - walls.y1[e]
        length = np.where((ex == 0) & (ey == 0), 1.0, ex * ex + ey * ey)
        f = np.clip(((x[point] - walls.x1[e]) * ex + (y[point] - walls.y1[e]) * ey) / length, 0, 1)
        px, py = walls.x1[e] + f * ex, walls.y1[e] + f * ey
        d = np.hypot(x[point] - px, y[point] - py)
        order = np.lexsort((e, d, point))
        first = order[np.append(True, np.diff(point[order]) > 0)] if len(order) else order
        gap[point[first]], nx[point[first]], ny[point[first]] = d[first], px[first], py[first]
    gap[gap > within] = np.inf
    return gap, nx, ny


def _rays(walls: Walls, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance along the walls' direction to the first wall; infinite where there is none."""
    px, py = walls.turned(x, y)
    best = np.full(len(x), np.inf)
    for point, e in walls.pairs(py, py):
        rise = walls.y2[e] - walls.y1[e]
        ok = np.abs(rise) > 1e-15
        point, e, rise = point[ok], e[ok], rise[ok]
        u = (py[point] - walls.y1[e]) / rise
        t = walls.x1[e] + u * (walls.x2[e] - walls.x1[e]) - px[point]
        hit = (t >= 0) & (u >= -EDGE_TOLERANCE) & (u <= 1 + EDGE_TOLERANCE)
        np.minimum.at(best, point[hit], t[hit])
    return best


def wall_distances(x: np.ndarray, y: np.ndarray, edges: np.ndarray, ring: np.ndarray, centroid: tuple[float, float], angles: Sequence[float], nearby: float) -> np.ndarray:
    """Distances (points by angles) to the walls of one outline, its holes' walls included; -1 where there is none."""
    level = Walls(edges)
    gap, nx, ny = _nearest(level, x, y, max(nearby, EDGE_TOLERANCE))
    inside = _inside(level, ring, x, y) | (gap <= EDGE_TOLERANCE)
    norm = np.hypot(centroid[0] - nx, centroid[1] - ny)
    flat = norm < 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        ux, uy = np.where(flat, 0.0, (centroid[0] - nx) / norm), np.where(flat, 1.0, (centroid[1] - ny) / norm)
    sx, sy = np.where(inside, x, nx + nearby * ux), np.where(inside, y, ny + nearby * uy)
    out = np.stack([_rays(Walls(edges, a), sx, sy) for a in angles], axis=1)
    out[~np.isfinite(out)] = -1.0
    out[~inside & ~(gap <= nearby)] = -1.0
    return out


def ray_distances_table(
    df: DataFrame, angles: Sequence[float], outlines: Outlines, x: str = "x", y: str = "y", nearby: float = NEARBY, rows_per_chunk: int = 50_000
) -> DataFrame:
    """``ray_distances`` for outlines by key: one array ``distances`` per point, null without an outline or a coordinate.

    Points of an outline are dealt to chunks of about ``rows_per_chunk`` rows; a chunk meets its outline, sent along once, in a
    task of its own, so neither a session with many points nor one with a long outline is held whole with others.
    """
    on, turns = list(outlines.on), [float(a) for a in angles]
    counts = cut_lineage(df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_chunk)).alias("_chunks")))
    same = [F.col(f"rows.{k}").eqNullSafe(F.col(f"counts.{k}")) for k in on]
    points = df.alias("rows").join(counts.alias("counts"), same)
    points = points.select(*[F.col(f"rows.{c}") for c in df.columns], F.pmod(F.xxhash64(*[F.col(f"rows.{c}") for c in df.columns]), F.col("_chunks")).alias("_chunk"))
    packed = outlines.edges.groupBy(*on).agg(F.collect_list(F.struct("ring", "x1", "y1", "x2", "y2")).alias("_e")).join(outlines.heads.select(*on, "cx", "cy"), on)
    sent = packed.join(counts, on).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))).drop("_chunks")
    kept = df.columns

    def cast(rows: pd.DataFrame, outline: pd.DataFrame) -> pd.DataFrame:
        found: list = [None] * len(rows)
        px, py = (pd.to_numeric(rows[c]).to_numpy(float) for c in (x, y))
        at = np.flatnonzero(np.isfinite(px) & np.isfinite(py))
        if len(outline) and len(at):
            edges = np.array([[e[k] for k in ("x1", "y1", "x2", "y2")] for e in outline["_e"][0]], dtype=float)
            ring = np.array([e["ring"] for e in outline["_e"][0]])
            # an order of its own: equal results whatever order the edges came in
            order = np.lexsort((*edges.T[::-1], ring))
            centre = (float(outline["cx"][0]), float(outline["cy"][0]))
            for i, d in zip(at, wall_distances(px[at], py[at], edges[order], ring[order], centre, turns, nearby), strict=True):
                found[i] = d
        return rows[kept].assign(distances=pd.Series(found, index=rows.index, dtype=object))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", distances array<double>"
    return points.groupBy(*on, "_chunk").cogroup(sent.groupBy(*on, "_chunk")).applyInPandas(cast, schema)


def ray_distance_table(
    df: DataFrame, angles: Sequence[float], outlines: Outlines, x: str = "x", y: str = "y", nearby: float = NEARBY, rows_per_chunk: int = 50_000
) -> DataFrame:
    """One row per point and angle, as ``ray_distance``; points without an outline have none."""
    rays = ray_distances_table(df, angles, outlines, x, y, nearby, rows_per_chunk)
    table = F.array(*[F.lit(float(a)) for a in angles])
    return rays.select(*df.columns, F.posexplode("distances").alias("_i", "distance")).select(*df.columns, F.get(table, F.col("_i")).alias("angle"), "distance")
