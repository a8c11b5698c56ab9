"""Outlines by session against plain crossings over every edge."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfield.operators import outlines as O
from wayfield.operators import rooms as R
from wayfield.sources import views as V

ON = ["session", "room"]


def star(n: int, seed: int, waves: int = 0) -> np.ndarray:
    """A closed outline of n vertices without crossings: the radius jumps with the angle, or goes in waves."""
    rng = np.random.default_rng(seed)
    a = np.linspace(0, 2 * np.pi, n, endpoint=False)
    r = 0.3 + 0.2 * (rng.random(n) if not waves else (1 + np.sin(waves * a)) / 2)
    return np.stack([0.5 + r * np.cos(a), 0.5 + r * np.sin(a)], axis=1)


def crossings(points: np.ndarray, vertices: np.ndarray) -> np.ndarray:
    x1, y1 = vertices.T
    x2, y2 = np.roll(vertices, -1, axis=0).T
    out = []
    for x, y in points:
        up = (y1 > y) != (y2 > y)
        out.append((x < (x2[up] - x1[up]) * (y - y1[up]) / (y2[up] - y1[up]) + x1[up]).sum() % 2 == 1)
    return np.array(out)


@pytest.fixture(scope="module")
def shapes() -> dict:
    return {(1, "A"): star(10_000, 1, 9), (1, "B"): star(7, 2), (2, "A"): star(3000, 3), (2, "hole"): 0.5 + (star(40, 4) - 0.5) * 0.3}


@pytest.fixture(scope="module")
def index(spark, shapes):
    rows = [(s, r, i, float(x), float(y)) for (s, r), v in shapes.items() for i, (x, y) in enumerate(v)]
    boundary = spark.createDataFrame(rows, "session int, room string, vertex_no int, x double, y double")
    exclude = spark.createDataFrame([(2, "A", "hole"), (2, "A", "hole"), (2, "A", "nowhere")], "session int, room string, hole string")
    return O.index_outlines(O.ring_edges(boundary, ON, exclude=exclude), ON)


def points(n: int) -> np.ndarray:
    return np.random.default_rng(9).random((n, 2))


def test_ten_thousand_vertices(spark, shapes, index):
    p = points(2000)
    rows = [(s, r, i, float(x), float(y)) for s, r in [*shapes, (3, "A")] for i, (x, y) in enumerate(p)]
    df = spark.createDataFrame([*rows, (1, "A", -1, None, 0.5), (1, None, -2, 0.5, 0.5)], "session int, room string, i int, x double, y double")
    got = {(r.session, r.room, r.i): r.inside for r in O.with_inside_table(df, index).collect()}
    assert len(got) == len(rows) + 2 and not got[1, "A", -1] and not got[1, None, -2]
    for key, vertices in shapes.items():
        want = crossings(p, vertices)
        if key == (2, "A"):
            want &= ~crossings(p, shapes[2, "hole"])
        assert [got[*key, i] for i in range(len(p))] == want.tolist()
    assert not any(got[3, "A", i] for i in range(len(p)))
    # a few entries per edge, and few edges in a slab
    entries = index.slabs.filter("session = 1 and room = 'A'").agg(F.sum(F.size("edges")).alias("n"), F.avg(F.size("edges")).alias("mean")).first()
    assert entries.n <= 50_000 and entries.mean < 40


def test_edge_counts_where_asked(spark):
    square = [(1, "A", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])]
    hole = [(1, "H", i, x, y) for i, (x, y) in enumerate([(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)])]
    boundary = spark.createDataFrame(square + hole, "session int, room string, vertex_no int, x double, y double")
    index = O.index_outlines(O.ring_edges(boundary, ON, exclude=spark.createDataFrame([(1, "A", "H")], "session int, room string, hole string")), ON)
    at = [(0.5, 0.5), (0.4, 0.5), (0.0, 0.5), (0.2, 1.0), (0.2, 0.2), (1.2, 0.5)]
    df = spark.createDataFrame([(1, "A", i, *xy) for i, xy in enumerate(at)], "session int, room string, i int, x double, y double")
    for edge, want in ((False, [4]), (True, [1, 2, 3, 4])):
        assert sorted(r.i for r in O.with_inside_table(df, index, edge=edge).filter("inside").collect()) == want


def test_rays_in_chunks_like_literal_outlines(spark):
    vertices = [(1, p.name, i, float(x), float(y)) for p in V.POLYGONS for i, (x, y) in enumerate(p.vertices)]
    index = O.index_outlines(O.ring_edges(spark.createDataFrame(vertices, "session int, room string, vertex_no int, x double, y double"), ON), ON)
    p = np.random.default_rng(3).uniform(-0.2, 1.3, (600, 2))
    rows = [(1, room, i, float(x), float(y)) for room in ("A", "B", "a") for i, (x, y) in enumerate(p)]
    rows += [(1, "A", 1000 + i, 0.5, 0.5) for i in range(50)] + [(1, "A", 2000, None, 1.0), (1, "Z", 2001, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "session int, room string, i int, x double, y double")
    angles = [0.0, 30.0, 90.0, 200.0, 315.0]
    want = {(r.room, r.i): r.distances for r in R.ray_distances(df, angles, V.POLYGONS).collect()}
    got = {(r.room, r.i): r.distances for r in O.ray_distances_table(df, angles, index, rows_per_chunk=100).collect()}
    assert got.keys() == want.keys()
    for key, d in want.items():
        assert (got[key] is None) == (d is None) and (d is None or np.allclose(got[key], d, atol=1e-9)), key


def test_rays_against_a_long_outline(shapes):
    vertices = shapes[1, "A"]
    edges = np.hstack([vertices, np.roll(vertices, -1, axis=0)])
    p = points(200)
    got = O.wall_distances(p[:, 0], p[:, 1], edges, np.zeros(len(edges), dtype=int), (0.5, 0.5), [0.0, 77.0], 0.05)
    inside = crossings(p, vertices)
    for (x, y), distances in zip(p[inside], got[inside], strict=True):
        for angle, distance in zip((0.0, 77.0), distances, strict=True):
            dx, dy = np.cos(np.radians(angle)), np.sin(np.radians(angle))
            ex, ey = edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]
            den = dx * ey - dy * ex
            t = ((edges[:, 0] - x) * ey - (edges[:, 1] - y) * ex) / den
            u = ((edges[:, 0] - x) * dy - (edges[:, 1] - y) * dx) / den
            assert distance == pytest.approx(t[(t >= 0) & (u >= 0) & (u <= 1)].min(), abs=1e-9)
