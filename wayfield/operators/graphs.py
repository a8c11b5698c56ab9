"""Neighbour joins between points and the smoothness of a mapping over neighbour graphs.

Points meet through square buckets, never all against all. Points at one place are merged first, a crowded bucket is
salted, and nearest neighbours are searched in a quadtree that is as deep as the places are dense.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from wayfield.functions.numeric import hypot2
from wayfield.plans.ordered import in_order, quantiles
from wayfield.session import cut_lineage, stored

BUCKET_ROWS = 50_000


def _bucket(c: str, width: float | Column) -> Column:
    width = width if isinstance(width, Column) else F.lit(float(width))
    return F.floor(F.col(c) / width)


def radius_join(
    queries: DataFrame, points: DataFrame, radius: float, on: Sequence[str] = (), qx: str = "x", qy: str = "y", px: str = "px", py: str = "py",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Every (query, point) pair of a group at most ``radius`` apart, with ``distance``.

    Queries go to the nine buckets around them. Where points crowd into one bucket, its points are dealt to salts and
    the queries that look there are copied to each salt; the salts come from bucket counts, one row per crowded bucket
    and so at most points / bucket_rows rows.
    """
    on = list(on)
    p = points.withColumns({"_bx": _bucket(px, radius), "_by": _bucket(py, radius)})
    key = [*on, "_bx", "_by"]
    crowded = p.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bucket_rows)
    crowded = crowded.select(*key, F.ceil(F.col("_n") / F.lit(bucket_rows)).cast("int").alias("_salts"))
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    q = queries.withColumn("_i", near).withColumn("_j", near)
    q = q.withColumns({"_bx": _bucket(qx, radius) + F.col("_i"), "_by": _bucket(qy, radius) + F.col("_j")}).drop("_i", "_j")
    salts = F.coalesce("_salts", F.lit(1))
    dealt = F.pmod(F.xxhash64(px, py, *[c for c in points.columns if c not in (*on, px, py)]), salts).cast("int")
    p = p.join(crowded, key, "left").withColumn("_salt", dealt).drop("_salts")
    q = q.join(crowded, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    d = hypot2(F.col(qx) - F.col(px), F.col(qy) - F.col(py))
    return q.join(p, [*key, "_salt"]).withColumn("distance", d).filter(F.col("distance") <= radius).drop("_bx", "_by", "_salt")


def near_points_join(nodes: DataFrame, points: DataFrame, radius: float, on: Sequence[str] = (), x: str = "x", y: str = "y", px: str = "px", py: str = "py") -> DataFrame:
    """Nodes with any point closer than ``radius``.

    One place counts once, however many points it holds; copies of a node in the nine buckets around it are tested by a
    semi join, which stops at the first point and writes no pair.
    """
    on = list(on)
    places = points.select(*on, px, py).distinct().withColumns({"_bx": _bucket(px, radius), "_by": _bucket(py, radius)}).alias("p")
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    asked = nodes.select(*on, x, y).distinct().withColumn("_i", near).withColumn("_j", near)
    asked = asked.withColumns({"_bx": _bucket(x, radius) + F.col("_i"), "_by": _bucket(y, radius) + F.col("_j")}).alias("q")
    same = [F.col(f"q.{c}") == F.col(f"p.{c}") for c in (*on, "_bx", "_by")]
    within = hypot2(F.col(f"q.{x}") - F.col(f"p.{px}"), F.col(f"q.{y}") - F.col(f"p.{py}")) < radius
    hits = asked.join(places, reduce(lambda a, b: a & b, [*same, within]), "left_semi").select(*on, x, y).distinct()
    return nodes.join(hits, [*on, x, y], "left_semi")


# quadtree: codes of 31 bits an axis; nodes at even levels, up to DEEPEST
_BITS, DEEPEST, _BLOCK = 31, 30, 1 << 14
#: Places of a leaf, which are compared as one matrix, and the distances that are held of it at a time.
PLACES_PER_CELL, _PAIRS = 256, 1 << 20


def _spread_bits(v: Column) -> Column:
    """Bit i of a 31-bit number moved to bit 2i."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _bit_length(v: np.ndarray) -> np.ndarray:
    high = v >> 31
    return np.where(high > 0, 31 + np.frexp(high.astype(float))[1], np.frexp((v & 0x7FFFFFFF).astype(float))[1])


def _leaf_levels(codes: np.ndarray, crowd: int) -> np.ndarray:
    """For each of the rising codes the coarsest even level whose cell around it has at most ``crowd`` codes.

    A cell is crowded if some code and the ``crowd``-th after it are both inside, that is if they share its prefix.
    """
    n = len(codes)
    deepest = np.full(n, -1, dtype=np.int64)
    if n > crowd:
        shared = _BITS - (_bit_length(codes[:-crowd] ^ codes[crowd:]) + 1) // 2
        for back in range(crowd + 1):
            np.maximum(deepest[back : n - crowd + back], shared, out=deepest[back : n - crowd + back])
    return np.minimum((deepest + 2) // 2 * 2, DEEPEST)


def _place_levels(placed: DataFrame, keys: Sequence[str], crowd: int) -> DataFrame:
    """``placed`` with ``level``: places in order of their codes, in blocks of ranks with ``crowd`` border rows on both sides."""
    ranked = in_order(placed, keys, "code", ("x", "y"), index="_n")
    rows = max(_BLOCK, crowd)
    at, block = F.pmod(F.col("_n"), F.lit(rows)), F.floor(F.col("_n") / rows)
    shares = F.array_compact(F.array(block, F.when((at < crowd) & (block > 0), block - 1), F.when(at >= rows - crowd, block + 1)))
    dealt = ranked.withColumn("_block", F.explode(shares))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        table = table.append_column("level", pa.array(_leaf_levels(table["code"].to_numpy(), crowd)))
        own = table["_n"].to_numpy() // rows == table["_block"].to_numpy()
        return table.filter(pa.array(own)).drop_columns(["_n", "_block"])

    return dealt.groupBy(*keys, "_block").applyInArrow(run, placed.schema.add("level", "long"))


def _nearest_in_cell(table: pa.Table, k: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """The nearest ``k + 1`` ids of each place (or of the ``asked`` ones) among the places given (itself too, equal distances by
    id): the furthest distance, infinite where there are fewer, all distances and the ids."""
    x, y = table["x"].to_numpy(), table["y"].to_numpy()
    lists = table["ids"].combine_chunks()
    flat, held = lists.flatten(), lists.value_lengths().to_numpy()
    first = np.cumsum(held) - held
    rank = np.empty(len(flat), dtype=np.int64)
    rank[pc.array_sort_indices(flat).to_numpy()] = np.arange(len(flat))
    asked = np.arange(len(x)) if asked is None else asked
    n, most, places = len(asked), min(k + 1, len(flat)), min(k + 1, len(x))
    step, picked, distances = max(1, _PAIRS // len(x)), [], []
    for at in range(0, n, step):
        some = asked[at : at + step]
        dx, dy = x[some, None] - x, y[some, None] - y
        d = np.sqrt(dx * dx + dy * dy)
        row, column = np.nonzero(d <= np.partition(d, places - 1, axis=1)[:, places - 1 : places])
        near = d[row, column]
        order = np.lexsort((near, row))
        row, column, near = row[order], column[order], near[order]
        # places go where nearer ones hold enough ids
        ids = held[column]
        before = np.cumsum(ids) - ids
        begins = np.r_[True, (row[1:] != row[:-1]) | (near[1:] != near[:-1])]
        begins = np.maximum.accumulate(np.where(begins, np.arange(len(row)), 0))
        keep = before[begins] - before[np.searchsorted(row, row)] < most
        row, column, near, ids = row[keep], column[keep], near[keep], ids[keep]
        entry = np.repeat(first[column] - np.cumsum(ids) + ids, ids) + np.arange(ids.sum())
        row, near = np.repeat(row, ids), np.repeat(near, ids)
        order = np.lexsort((rank[entry], near, row))
        # of equal distances at the end of a list the smaller ids stay
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < most]
        picked.append(entry[order])
        distances.append(near[order])
    distance, ends = np.concatenate(distances), pa.array(np.arange(n + 1) * most, pa.int32())
    furthest = distance.reshape(n, most)[:, -1] if most > k else np.full(n, np.inf)
    return furthest, pa.ListArray.from_arrays(ends, pa.array(distance)), pa.ListArray.from_arrays(ends, flat.take(pa.array(np.concatenate(picked))))


@dataclass
class NearLists:
    """The nearest ids of every place. ``base``: keys (renamed, see ``named``), id, x and y of the points. ``lists``: a row per place, with
    its leaf (``own_level``, ``own_cell``) and the ``distance`` and ``j`` of the ``k + 1`` nearest ids, its own among them. ``sigma``: the median distance of each group, where it was asked for."""

    k: int
    keys: list[str]
    named: dict[str, str]
    base: DataFrame
    lists: DataFrame
    sigma: DataFrame | None = None


def _near_lists(points: DataFrame, k: int, keys: Sequence[str], x: str, y: str, row: str, places_per_cell: int | None = None) -> NearLists:
    """The ``k + 1`` nearest ids of each place; equal distances go by id.

    Places: the distinct positions of a group, each with its ``k + 1`` smallest ids, which is all any neighbour list can
    need of it. Tree: places in order of their Morton codes; only cells with more than ``places_per_cell`` places (``PLACES_PER_CELL``
    if not given) are split, in sixteen, so a dense spot is deep and the rest shallow. The places of a leaf are compared with each
    other as one matrix. A place is done if the circle of its k-th neighbour stays inside its leaf; where a leaf has too few points the
    circle is the diagonal of the cell above it, which holds more than k. The other places look into the cells that meet their circle,
    at their leaf's level or the one above, and descend: a node's places are candidates, its children stay if they reach into the circle,
    and the circle shrinks to any child that alone holds enough points. All places take a step per round, 15 rounds at
    most. Places closer together than 2^-30 of a group's extent share a leaf.
    """
    crowd = max(places_per_cell or PLACES_PER_CELL, k + 1)
    # names of their own for the keys, which may be called like a column of the tree
    named, keys = {f"_k{i}": c for i, c in enumerate(keys)}, [f"_k{i}" for i in range(len(keys))] or ["_all"]
    group = [F.col(c).alias(k) for k, c in named.items()] or [F.lit(0).alias("_all")]
    base = stored(points.select(*group, F.col(row).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna())
    spot, node = [*keys, "x", "y"], [*keys, "level", "cell"]
    ids = base.withColumn("_r", F.row_number().over(W.partitionBy(*spot).orderBy("id"))).filter(F.col("_r") <= k + 1)
    places = ids.groupBy(*spot).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    extent = stored(
        base.groupBy(*keys).agg(
            F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-300)).alias("span")
        )
    )
    index = {c: F.least(F.floor((F.col(c) - F.col(f"{c}0")) / F.col("span") * F.lit(float(1 << _BITS))), F.lit((1 << _BITS) - 1)) for c in "xy"}
    placed = places.join(extent, keys).withColumn("code", _spread_bits(index["x"]).bitwiseOR(F.shiftleft(_spread_bits(index["y"]), 1))).drop("x0", "y0", "span")
    placed = _place_levels(stored(placed), keys, crowd)

    def shift(v: Column, by: Column) -> Column:
        return F.call_function("shiftright", v, by.cast("int"))

    held = stored(placed.withColumn("cell", shift(F.col("code"), (F.lit(_BITS) - F.col("level")) * 2)).select(*node, "x", "y", "ids"))

    # nodes: leaves with their places, and everything above them with counts
    leaves = held.groupBy(*node).agg(F.sum(F.size("ids")).alias("m"))
    up = F.explode(F.sequence(F.lit(0).cast("long"), F.col("level"), F.lit(2).cast("long")))
    above = leaves.withColumn("_v", up).select(*keys, F.col("_v").alias("level"), shift(F.col("cell"), (F.col("level") - F.col("_v")) * 2).alias("cell"), "m", (F.col("_v") == F.col("level")).alias("_own"))
    nodes = stored(above.groupBy(*node).agg(F.sum("m").alias("m"), F.max("_own").alias("_own")))
    children = nodes.filter("level > 0").select(*keys, (F.col("level") - 2).alias("level"), F.call_function("shiftright", F.col("cell"), F.lit(4)).alias("cell"), F.col("cell").alias("_child"), "m", F.col("_own").alias("_child_own"))

    def reach_of(table: pa.Table) -> pa.Table:
        return table.drop_columns(["ids"]).append_column("r", pa.array(_nearest_in_cell(table, k)[0]))

    local = held.groupBy(*node).applyInArrow(reach_of, held.drop("ids").schema.add("r", "double"))

    # places whose circle leaves their leaf, and the cells that meet it
    width = lambda level: F.col("span") * F.pow(F.lit(2.0), -level)
    side = lambda level: F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))
    slack = F.col("span") * F.lit(1e-12)
    round_ = F.least("r", width(F.col("level") - 2) * F.lit(math.sqrt(2) * (1 + 1e-9)))
    open_ = local.filter("level > 0 and r > 0").join(extent, keys).withColumn("r", round_)
    leaving = F.lit(False)
    for c in "xy":
        low = shift(index[c], F.lit(_BITS) - F.col("level")) * width(F.col("level"))
        at, reach = F.col(c) - F.col(f"{c}0"), F.col("r") * F.lit(1 + 1e-9) + slack
        leaving = leaving | (at - reach < low) | (at + reach > low + width(F.col("level")))
    asked = open_.filter(leaving).withColumnsRenamed({"level": "own_level", "cell": "own_cell"})
    asked = asked.withColumn("level", F.when(F.col("r") <= width(F.col("own_level")), F.col("own_level")).otherwise(F.col("own_level") - 2))
    for c in "xy":
        at, reach = F.col(c) - F.col(f"{c}0"), F.col("r") * F.lit(1 + 1e-9) + slack
        number = lambda v: F.least(F.greatest(F.floor(v / width(F.col("level"))), F.lit(0).cast("long")), side(F.col("level")) - 1)
        asked = asked.withColumn(f"_c{c}", F.sequence(number(at - reach), number(at + reach)))
    asked = asked.withColumn("_cx", F.explode("_cx")).withColumn("_cy", F.explode("_cy"))
    asked = asked.withColumn("cell", _spread_bits(F.col("_cx")).bitwiseOR(F.shiftleft(_spread_bits(F.col("_cy")), 1))).drop("_cx", "_cy")
    elsewhere = (F.col("level") != F.col("own_level")) | (F.col("cell") != F.col("own_cell"))
    asked = stored(asked.filter(elsewhere))

    ask = [*spot, "own_level", "own_cell", "r"]
    # leaves above the cells that a place starts from
    starts = asked.select(*node).distinct().filter("level > 0")
    upper = F.explode(F.sequence(F.lit(0).cast("long"), F.col("level") - 2, F.lit(2).cast("long"))).alias("_v")
    chain = starts.select(*keys, F.col("level").alias("_from"), F.col("cell").alias("_start"), upper)
    chain = chain.select(*keys, "_from", "_start", F.col("_v").alias("level"), shift(F.col("_start"), (F.col("_from") - F.col("_v")) * 2).alias("cell"))
    covered = chain.join(nodes.filter("_own").select(*node), node).select(*keys, F.col("level").alias("_over"), F.col("cell").alias("_over_cell"), F.col("_from").alias("level"), F.col("_start").alias("cell"))
    found = [asked.join(covered, node).select(*ask, F.col("_over").alias("level"), F.col("_over_cell").alias("cell")).distinct()]
    down = asked.join(nodes, node)
    for _ in range(DEEPEST // 2 + 1):
        near, far = _cell_distances(down, width(F.col("level")))
        down = down.withColumns({"_near": near, "_far": far})
        closer = F.min(F.when(F.col("m") > k, F.col("_far"))).over(W.partitionBy(*spot))
        down = down.withColumn("r", F.least("r", closer * F.lit(1 + 1e-9))).filter(F.col("_near") <= F.col("r"))
        frontier = stored(down.select(*ask, "x0", "y0", "span", "level", "cell", "_own"))
        found.append(frontier.filter("_own").select(*ask, "level", "cell"))
        inner = frontier.filter("not _own")
        if inner.isEmpty():
            break
        down = inner.drop("_own").join(children, node).withColumns({"level": F.col("level") + 2, "cell": F.col("_child"), "_own": F.col("_child_own")})
    visits = reduce(DataFrame.unionByName, found).filter(elsewhere)
    # the k + 1 nearest points of each place of a leaf, among its own places and those of all leaves that its places look into
    own = leaves.select(*node, F.col("level").alias("own_level"), F.col("cell").alias("own_cell"))
    looks = visits.select(*own.columns).distinct().unionByName(own)
    shared = looks.join(held, node).select(*own.columns, "x", "y", "ids").withColumn("_own", elsewhere == F.lit(False))

    def compare(table: pa.Table) -> pa.Table:
        mine = np.flatnonzero(table["_own"].to_numpy())
        _, distance, j = _nearest_in_cell(table, k, mine)
        return table.select([*spot, "own_level", "own_cell"]).take(pa.array(mine)).append_column("distance", distance).append_column("j", j)

    listed = shared.select(*spot, "own_level", "own_cell").schema.add("distance", ArrayType(DoubleType())).add("j", ArrayType(base.schema["id"].dataType))
    return NearLists(k, keys, named, base, shared.groupBy(*keys, "own_level", "own_cell").applyInArrow(compare, listed))


def knn_join(points: DataFrame, k: int, keys: Sequence[str] = (), x: str = "x", y: str = "y", row: str = "id", places_per_cell: int | None = None) -> DataFrame:
    """The ``k`` nearest other points of each point: ``i``, ``j``, ``distance``; equal distances go by id."""
    near = _near_lists(points, k, keys, x, y, row, places_per_cell)
    spot = [*near.keys, "x", "y"]
    lists = near.lists.select(*spot, F.arrays_zip("distance", "j").alias("near"))
    rows = near.base.join(lists, spot).select(*near.keys, F.col("id").alias("i"), F.slice(F.filter("near", lambda s: s["j"] != F.col("id")), 1, k).alias("near"))
    out = rows.select(*near.keys, "i", F.explode("near").alias("_s")).select(*near.keys, "i", F.col("_s.j").alias("j"), F.col("_s.distance").alias("distance"))
    return out.drop("_all").withColumnsRenamed(near.named)


def _cell_distances(df: DataFrame, width: Column) -> tuple[Column, Column]:
    """Distance from (x, y) to the nearest and to the furthest point of the cell, a little widened against rounding."""

    def low(shift: int) -> Column:
        v = F.shiftright("cell", shift).bitwiseAND(F.lit(0x5555555555555555))
        for step, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
            v = v.bitwiseOR(F.shiftright(v, step)).bitwiseAND(F.lit(mask))
        return v * width

    slack = F.col("span") * F.lit(1e-12)
    gaps, spans = [], []
    for c, bit in (("x", 0), ("y", 1)):
        at, start = F.col(c) - F.col(f"{c}0"), low(bit)
        gaps.append(F.greatest(start - slack - at, at - (start + width + slack), F.lit(0.0)))
        spans.append(F.greatest(at - (start - slack), start + width + slack - at))
    return hypot2(*gaps), hypot2(*spans)


def grid_neighbour_join(points: DataFrame, keys: Sequence[str] = (), neighbours: int = 8, weighted: bool = True, x: str = "x", y: str = "y", row: str = "id") -> DataFrame:
    """Lattice neighbours ``i -> j`` with weight; of points on one lattice cell the smallest id is the neighbour."""
    steps = [(1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)]
    if neighbours == 8:
        steps += [(dx, dy, 1 / math.sqrt(2) if weighted else 1.0) for dx in (1, -1) for dy in (1, -1)]
    on = [*keys, "_gx", "_gy"]
    cells = points.select(*keys, F.col(row).alias("i"), F.bround(x).cast("bigint").alias("_gx"), F.bround(y).cast("bigint").alias("_gy"))
    owner = cells.groupBy(*on).agg(F.min("i").alias("j"))
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(w).alias("w")) for a, b, w in steps]))
    asking = cells.withColumn("_m", moves).select(*keys, "i", (F.col("_gx") + F.col("_m.dx")).alias("_gx"), (F.col("_gy") + F.col("_m.dy")).alias("_gy"), "_m.w")
    return asking.join(owner, on).filter(F.col("i") != F.col("j")).select(*keys, "i", "j", "w")


def _merge_edges(edges: DataFrame, keys: Sequence[str], half: bool) -> DataFrame:
    """Each linked pair once, ``i`` the smaller id, the weights of both directions added up; ``half`` averages them and caps the result at 1."""
    pairs = edges.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "w")
    total = F.sum("w")
    return pairs.groupBy(*keys, "i", "j").agg((F.least(total / 2, F.lit(1.0)) if half else total).alias("w"))


def _degrees(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    ends = edges.select(*keys, F.explode(F.array("i", "j")).alias("i"), "w")
    return ends.groupBy(*keys, "i").agg(F.sum("w").alias("_d"))


def graph_products(
    edges: DataFrame | NearLists, nodes: DataFrame, keys: Sequence[str], products: Mapping[str, tuple[str, str]], normalised: bool = True, epsilon: float = 1e-8, row: str = "id"
) -> DataFrame:
    """The two sums of ``x' L y`` for pairs of signals (name: x, y) over a symmetric graph (each pair of nodes once), the Frobenius norm of
    L, and the number of nodes per group.

    For the normalised Laplacian with s = 1 / (sqrt(d) + eps): ``_o_`` and the name is sum d s^2 x y, over nodes, ``_x_`` and the name
    is sum w s_i s_j (x_i y_j + x_j y_i), over pairs; x' L y is their difference. A graph held as lists gives the sums of the
    Laplacian that is not normalised, and no norm, which needs merged pairs.
    """
    if isinstance(edges, NearLists):
        if normalised:
            raise ValueError("a graph held as lists is not normalised")
        return _list_products(edges, nodes, list(keys), products, row)
    keys, signals = list(keys), list(dict.fromkeys(c for pair in products.values() for c in pair))
    degree = _degrees(edges, keys)
    full = nodes.select(*keys, F.col(row).alias("i"), *signals).join(degree, [*keys, "i"], "left").withColumn("_d", F.coalesce("_d", F.lit(0.0)))
    s = F.lit(1.0) / (F.sqrt("_d") + F.lit(epsilon)) if normalised else F.lit(1.0)
    full = stored(full.withColumn("_s", s))
    own = full.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.col("_d") * F.col("_s") * F.col("_s"), 2)).alias("_f1"),
        *[F.sum(F.col("_d") * (F.col("_s") * F.col(x)) * (F.col("_s") * F.col(y))).alias(f"_o_{name}") for name, (x, y) in products.items()],
    )
    a = full.select(*keys, "i", F.col("_s").alias("_si"), *[F.col(c).alias(f"_i_{c}") for c in signals])
    b = full.select(*keys, F.col("i").alias("j"), F.col("_s").alias("_sj"), *[F.col(c).alias(f"_j_{c}") for c in signals])
    wide = edges.join(a, [*keys, "i"]).join(b, [*keys, "j"]).withColumn("_w", F.col("w") * F.col("_si") * F.col("_sj"))
    crossed = lambda x, y: F.col(f"_i_{x}") * F.col(f"_j_{y}") + F.col(f"_j_{x}") * F.col(f"_i_{y}")
    cross = wide.groupBy(*keys).agg(
        F.sum(2 * F.col("_w") * F.col("_w")).alias("_f2"), *[F.sum(F.col("_w") * crossed(x, y)).alias(f"_x_{name}") for name, (x, y) in products.items()]
    )
    both = own.join(cross, keys, "left")
    zero = F.lit(0.0)
    return both.select(
        *keys, "n", F.sqrt(F.col("_f1") + F.coalesce("_f2", zero)).alias("fro"),
        *[c for name in products for c in (F.col(f"_o_{name}"), F.coalesce(f"_x_{name}", zero).alias(f"_x_{name}"))],
    )


def _list_products(graph: NearLists, nodes: DataFrame, keys: Sequence[str], products: Mapping[str, tuple[str, str]], row: str) -> DataFrame:
    """``graph_products`` of a kernel graph whose edges are never rows: each leaf has its places' lists and the sums of the nodes in them.

    Both directions of an edge are added, so every entry of a list counts for its two ends. Points of a place that are not among its
    ``k + 1`` smallest ids have one list, and their sums are one.
    """
    signals = list(dict.fromkeys(c for pair in products.values() for c in pair))
    at = {c: n for n, c in enumerate(signals)}
    pairs = [(at[x], at[y]) for x, y in products.values()]
    product = {name: F.col(x) * F.col(y) for name, (x, y) in products.items()}
    # 0, NULL where no node has a value
    own = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[(F.lit(0.0) * F.sum(v)).alias(f"_z_{name}") for name, v in product.items()])
    group = [F.col(c).alias(k) for k, c in graph.named.items()] or [F.lit(0).alias("_all")]
    values = {f"_s_{c}": F.col(c) for c in signals} | {f"_p_{name}": v for name, v in product.items()}
    by_id = nodes.groupBy(*group, F.col(row).alias("id")).agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(name) for name, v in values.items()])
    by_id = stored(by_id.dropna(subset=[*graph.keys, "id"]))
    spot, leaf, k, held = [*graph.keys, "x", "y"], [*graph.keys, "own_level", "own_cell"], graph.k, graph.keys
    rank = F.row_number().over(W.partitionBy(*spot).orderBy("id"))
    dealt = graph.base.withColumn("_id", F.when(rank <= k + 1, F.col("id"))).join(by_id, [*graph.keys, "id"])
    dealt = dealt.groupBy(*spot, "_id").agg(F.count(F.lit(1)).alias("_m"), *[F.sum(c).alias(c) for c in values])
    sources = dealt.join(graph.lists.select(*spot, "own_level", "own_cell"), spot).select(*leaf, "x", "y", F.col("_id").alias("id"), "_m", *values)
    ends = graph.lists.select(*leaf, F.explode("j").alias("id")).distinct().join(by_id, [*graph.keys, "id"])
    ends = ends.select(*leaf, F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), "id", F.lit(0).cast("bigint").alias("_m"), *values)
    lists = graph.lists.join(graph.sigma, graph.keys, "left").withColumn("_sigma", _width())
    sums = [f"{part}{name}" for name in products for part in ("_o_", "_x_")]
    schema = lists.select(*graph.keys).schema
    for name in sums:
        schema = schema.add(name, "double")

    def run(table: pa.Table, nodes: pa.Table) -> pa.Table:
        totals = _leaf_products(table, nodes, k, [f"_s_{c}" for c in signals], [f"_p_{name}" for name in products], pairs)
        out = table.select(held).slice(0, 1)
        for name, total in zip(sums, totals.ravel(), strict=True):
            out = out.append_column(name, pa.array([total] * len(out), pa.float64()))
        return out

    # names of their own, as both sides come from one table
    there = sources.unionByName(ends).withColumnsRenamed({c: f"_of_{c}" for c in leaf})
    parts = lists.groupBy(*leaf).cogroup(there.groupBy(*[f"_of_{c}" for c in leaf])).applyInArrow(run, schema)
    total = parts.groupBy(*graph.keys).agg(*[F.sum(c).alias(c) for c in sums])
    both = own.join(total.drop("_all").withColumnsRenamed(graph.named), list(keys), "left") if keys else own.crossJoin(total)
    zero = F.lit(0.0)
    return both.select(
        *keys, "n", *[c for name in products for c in ((F.col(f"_z_{name}") + F.coalesce(f"_o_{name}", zero)).alias(f"_o_{name}"), F.coalesce(f"_x_{name}", zero).alias(f"_x_{name}"))]
    )


def _leaf_products(lists: pa.Table, nodes: pa.Table, k: int, signals: Sequence[str], products: Sequence[str], pairs: Sequence[tuple[int, int]]) -> np.ndarray:
    """For each product the two sums over the edges that start in a leaf. ``nodes``: points that start edges (``_m`` of them, with a
    place) and points where edges end (``_m`` 0)."""
    totals = np.zeros((len(pairs), 2))
    many = nodes["_m"].to_numpy()
    source, end = np.flatnonzero(many > 0), np.flatnonzero(many == 0)
    if not len(lists) or not len(source):
        return totals
    s, p = (np.column_stack([nodes[c].to_numpy() for c in names]) for names in (signals, products))
    ids = nodes["id"].combine_chunks()
    known = ids.take(pa.array(end))
    number = lambda v: pc.fill_null(pc.index_in(v, value_set=known), -1).to_numpy()
    held = lists["j"].combine_chunks()
    code, length = number(held.flatten()), held.value_lengths().to_numpy()
    first, own = np.cumsum(length) - length, number(ids.take(pa.array(source)))
    distance = lists["distance"].combine_chunks().flatten().to_numpy()
    w = np.exp(-(distance * distance) / (2.0 * np.repeat(lists["_sigma"].to_numpy(), length) ** 2))

    def place(table: pa.Table) -> np.ndarray:
        out = np.empty(len(table), dtype=complex)
        out.real, out.imag = table["x"].to_numpy(), table["y"].to_numpy()
        return out

    spots = place(lists)
    order = np.argsort(spots)
    row = order[np.searchsorted(spots[order], place(nodes.take(pa.array(source))))]
    # by pieces, as a crowd has many lists
    step = max(1, _PAIRS // (k + 1))
    for at in range(0, len(source), step):
        of, mine = row[at : at + step], source[at : at + step]
        size = length[of]
        who, begin = np.repeat(np.arange(len(of)), size), np.cumsum(size) - size
        rank = np.arange(size.sum()) - np.repeat(begin, size)
        entry = np.repeat(first[of], size) + rank
        itself = code[entry] == own[at : at + step][who]
        # a point that its list does not hold is one of a crowd: the first k are its neighbours
        listed = np.bincount(who, weights=itself, minlength=len(of)) > 0
        weight = np.where(~itself & (listed[who] | (rank < k)), w[entry], 0.0)
        target = end[code[entry]]
        out, into = np.bincount(who, weights=weight, minlength=len(of)), np.bincount(target, weights=weight * many[mine][who], minlength=len(nodes))
        totals[:, 0] += out @ p[mine] + into @ p
        z = np.column_stack([np.bincount(who, weights=weight * s[target, c], minlength=len(of)) for c in range(len(signals))])
        totals[:, 1] += [(s[mine, a] * z[:, b] + s[mine, b] * z[:, a]).sum() for a, b in pairs]
    return totals


def graph_energy(
    edges: DataFrame, nodes: DataFrame, keys: Sequence[str], signals: Sequence[str], normalised: bool = True, epsilon: float = 1e-8, row: str = "id"
) -> DataFrame:
    """``x' L x`` of each signal (``e_`` and its name), the Frobenius norm of L and the number of nodes, as ``graph_products``."""
    sums = graph_products(edges, nodes, keys, {c: (c, c) for c in signals}, normalised, epsilon, row)
    return sums.select(*keys, "n", "fro", *[(F.col(f"_o_{c}") - F.col(f"_x_{c}")).alias(f"e_{c}") for c in signals])


def _smoothness(energy: DataFrame, keys: Sequence[str]) -> DataFrame:
    fro = F.when(F.col("fro") > 0, F.col("fro")).otherwise(F.lit(1.0))
    lap_x = F.try_divide(F.col("e_tx") - F.col("e_sx"), fro * F.col("n"))
    lap_y = F.try_divide(F.col("e_ty") - F.col("e_sy"), fro * F.col("n"))
    return energy.withColumns({"lap_x": lap_x, "lap_y": lap_y, "lap": (lap_x + lap_y) / 2})


def _width() -> Column:
    return F.greatest(F.coalesce("_sigma", F.lit(1.0)), F.lit(1e-8))


def kernel_edges(points: DataFrame, k: int, keys: Sequence[str], x: str, y: str, row: str = "id") -> DataFrame:
    """Gaussian-weighted k-nearest-neighbour graph, each pair once, both directions added; sigma is the group's median neighbour
    distance (1 where all neighbours coincide)."""
    near = stored(knn_join(points, k, keys, x, y, row))
    sigma = quantiles(near.filter("distance > 0"), keys, {"_sigma": ("distance", 0.5)})
    joined = near.join(stored(sigma), list(keys), "left")
    s = _width()
    w = F.exp(-(F.col("distance") * F.col("distance")) / (2.0 * s * s))
    return stored(_merge_edges(joined.select(*keys, "i", "j", w.alias("w")), keys, half=False))


def kernel_lists(points: DataFrame, k: int, keys: Sequence[str], x: str, y: str, row: str = "id") -> NearLists:
    """The graph of ``kernel_edges`` as lists of neighbours, for ``graph_products``; an id stands once at a place."""
    near = _near_lists(points, k, keys, x, y, row)
    near.lists = stored(near.lists)
    # of its place's list a point has all but itself, also where its id stands at other places; a crowd's distances are all 0
    every = F.arrays_zip("distance", "j")
    others = lambda own: F.filter(every, lambda s: (s["distance"] > 0) & (s["j"] != own["j"]))
    apart = F.flatten(F.transform(F.filter(every, lambda s: s["distance"] == 0), lambda own: others(own)["distance"]))
    distances = stored(near.lists.select(*near.keys, F.explode(apart).alias("distance")))
    near.sigma = stored(quantiles(distances, near.keys, {"_sigma": ("distance", 0.5)}))
    return near


def knn_laplacian(points: DataFrame, k: int, keys: Sequence[str], row: str = "id") -> DataFrame:
    """Smoothness change from source (sx, sy) to target (tx, ty) over the source's neighbour graph, per group."""
    edges = kernel_edges(points, k, keys, "sx", "sy", row)
    return _smoothness(graph_energy(edges, points, keys, ["sx", "sy", "tx", "ty"], row=row), keys)


def grid_laplacian(points: DataFrame, keys: Sequence[str], neighbours: int = 8, weighted: bool = True, row: str = "id") -> DataFrame:
    """As ``knn_laplacian`` on the lattice of rounded source positions, with the derived ratios."""
    edges = stored(_merge_edges(grid_neighbour_join(points, keys, neighbours, weighted, "sx", "sy", row), keys, half=True))
    out = _smoothness(graph_energy(edges, points, keys, ["sx", "sy", "tx", "ty"], row=row), keys)
    source, target = F.col("e_sx") + F.col("e_sy"), F.col("e_tx") + F.col("e_ty")
    return out.withColumns({"e_source": source, "e_target": target}).withColumns(
        {
            "lap_exp": F.exp(-F.col("lap")), "lap_ratio": F.try_divide("e_source", F.greatest(F.col("e_target"), F.lit(1e-12))),
            "lap_inv": F.when(F.col("lap") > -1, F.try_divide(F.lit(1.0), 1 + F.col("lap"))),
            "de": F.col("e_target") - F.col("e_source"), "de_over_e": (F.col("e_target") - F.col("e_source")) / (F.col("e_source") + 1e-12),
        }
    )


def residual_energy(
    points: DataFrame, maps: DataFrame, k: int, keys: Sequence[str], x: str = "sx", y: str = "sy", tx: str = "tx", ty: str = "ty", row: str = "id"
) -> DataFrame:
    """Laplacian energy of the residuals of affine maps over the source's neighbour graph: a row per group and map.

    ``maps`` holds a, b, mx, c, d, my; its other columns (as room and fold) name the map. A residual is t - (a x + b y + m), so its energy
    comes from the products of t, x, y and 1 over the graph, which serve all maps: no point is copied to a map, and the graph stays lists of
    neighbours, as with a hundred of them the pairs are a hundred times the points. Repeated points are one
    in the graph. A map with a missing name has no pairs, only its nodes' sum.
    """
    edges = kernel_lists(points.select(*keys, row, x, y).distinct(), k, keys, x, y, row)
    signals, products = {}, {}
    for axis, target in (("x", tx), ("y", ty)):
        # where a target or a coordinate is missing there is no residual
        parts, there = [F.col(target), F.col(x), F.col(y), F.lit(1.0)], F.col(target).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()
        signals |= {f"_{axis}{n}": F.when(there, part) for n, part in enumerate(parts)}
        products |= {f"_{axis}{p}{q}": (f"_{axis}{p}", f"_{axis}{q}") for p in range(4) for q in range(p, 4)}
    nodes = points.select(*keys, row, *[part.alias(name) for name, part in signals.items()])
    sums = graph_products(edges, nodes, keys, products, normalised=False, row=row)
    names = [c for c in maps.columns if c not in ("a", "b", "mx", "c", "d", "my")]
    known = reduce(lambda one, other: one & other, [F.col(c).isNotNull() for c in names], F.lit(True))
    energy = []
    for axis, named in (("x", ("a", "b", "mx")), ("y", ("c", "d", "my"))):
        v = [F.lit(1.0), *[-F.col(c) for c in named]]
        for p in range(4):
            for q in range(p, 4):
                product = F.col(f"_o__{axis}{p}{q}") - F.when(known, F.col(f"_x__{axis}{p}{q}")).otherwise(0.0)
                energy.append((1 if p == q else 2) * v[p] * v[q] * product)
    return sums.crossJoin(maps).select(*keys, *names, "n", reduce(lambda one, other: one + other, energy).alias("energy"))


def map_laplacian(pairs: DataFrame, keys: Sequence[str], n_bins: int) -> DataFrame:
    """Smoothness change from map ``a`` to map ``b`` over the complete graph of n_bins-by-n_bins bins.

    A weight depends on the distance between two bins alone, so the matrix is block-Toeplitz: it is applied by FFT of its
    circulant embedding (2 n_bins a side) and never written out. A map is one array of at most n_bins^2 values. Missing
    bins count as 0.
    """
    packed = pairs.groupBy(*keys).agg(F.collect_list(F.struct((F.col("by") * n_bins + F.col("bx")).cast("int").alias("k"), F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))).alias("_s"))

    def part(name: str) -> Column:
        return F.transform("_s", lambda s: s[name]).alias(f"_{name}")

    arrays = packed.select(*keys, part("k"), part("a"), part("b"))
    schema = pairs.select(*keys).schema.add("laplacian", "double")

    def score(batches):
        graph = BinGraph(n_bins)
        for pdf in batches:
            values = [graph.energy(k, b) - graph.energy(k, a) for k, a, b in zip(pdf["_k"], pdf["_a"], pdf["_b"])]
            scaled = np.array(values, dtype=float) / (graph.norm * n_bins * n_bins)
            yield pd.concat([pdf[list(keys)], pd.Series(scaled, index=pdf.index, name="laplacian")], axis=1)

    return arrays.mapInPandas(score, schema)


class BinGraph:
    """The normalised Laplacian of all bins of an n-by-n map, Gaussian weights with the median distance as width."""

    def __init__(self, n: int):
        self.n = n
        step = np.minimum(np.arange(2 * n), 2 * n - np.arange(2 * n)).astype(float)
        distance = np.hypot(step[:, None], step)
        # pairs at each offset: (n - dx)(n - dy) for every sign
        gap = np.arange(n, dtype=float)
        times = np.outer(n - gap, n - gap) * np.outer(1 + (gap > 0), 1 + (gap > 0))
        d = np.hypot(gap[:, None], gap).ravel()
        order = np.argsort(d, kind="stable")
        upto = np.cumsum(times.ravel()[order])
        half = upto[-1] / 2
        middle = [d[order[np.searchsorted(upto, r, side="left")]] for r in ((half, half + 1) if upto[-1] % 2 == 0 else (half + 0.5,))]
        weight = np.exp(-(distance**2) / (2 * np.mean(middle) ** 2))
        self.kernel, squared = np.fft.rfft2(weight), np.fft.rfft2(weight**2)
        self.scale = 1 / np.sqrt(self._apply(self.kernel, np.ones((n, n))))
        part = self.scale**2
        self.norm = float(np.sqrt((part * self._apply(squared, part)).sum() + (1 - 2 * part).sum()))

    def _apply(self, kernel: np.ndarray, values: np.ndarray) -> np.ndarray:
        wide = np.fft.rfft2(values, s=(2 * self.n, 2 * self.n))
        return np.fft.irfft2(wide * kernel, s=(2 * self.n, 2 * self.n))[: self.n, : self.n]

    def energy(self, bins: np.ndarray, values: np.ndarray) -> float:
        m = np.zeros(self.n * self.n)
        m[bins] = values
        m = m.reshape(self.n, self.n)
        u = m * self.scale
        return float((m * m).sum() - (u * self._apply(self.kernel, u)).sum())


def map_stats(pairs: DataFrame, keys: Sequence[str], n_bins: int) -> DataFrame:
    """Correlation, divergences, marginal earth mover's distance and smoothness change of each map pair."""
    from wayfield.operators.maps import map_correlation, map_emd_marginal, map_js, map_kl

    pairs = cut_lineage(pairs)
    out = map_correlation(pairs, keys)
    for part in (map_kl(pairs, keys), map_js(pairs, keys, n_bins * n_bins), map_emd_marginal(pairs, keys), map_laplacian(pairs, keys, n_bins)):
        out = out.join(part, list(keys), "left")
    return out
