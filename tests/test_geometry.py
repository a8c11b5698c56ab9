"""Outlines and affine maps against closed forms and NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfield.operators import affine as A
from wayfield.operators import rooms as R
from wayfield.operators.rooms import Polygon, Room
from wayfield.plans import mapping as P

SQUARE = Polygon("S", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])
HOLE = Polygon("H", [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)])


def points(spark, xy, room="S"):
    return spark.createDataFrame([(i, room, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, room string, x double, y double")


def test_outline_counts_only_when_asked(spark):
    edge = [(0, 0), (1, 1), (0.5, 0), (0.5, 1), (0, 0.5), (1, 0.5)]
    df = points(spark, [*edge, (0.5, 0.5), (1.5, 0.5), (-0.1, 0), (0.5, 1.1)])
    assert [r.id for r in R.points_in_polygon(df, [SQUARE]).orderBy("id").collect()] == [6]
    assert [r.id for r in R.points_in_polygon(df, [SQUARE], edge=True).orderBy("id").collect()] == list(range(7))
    table = R.outline_table(spark.createDataFrame([("S", i, x, y) for i, (x, y) in enumerate(SQUARE.vertices)], "room string, vertex_no int, x double, y double"), ["room"])
    for edge_counts in (False, True):
        flagged = R.points_in_polygon_table(df, table, ["room"], edge=edge_counts)
        assert flagged.filter("inside").count() == (7 if edge_counts else 1)


def test_hole(spark):
    df = points(spark, [(0.1, 0.1), (0.5, 0.5), (0.25, 0.5), (2, 2)])
    assert [r.id for r in df.filter(R.in_room_without_holes("x", "y", SQUARE, [HOLE])).orderBy("id").collect()] == [0, 2]


def test_area_and_centroid():
    assert SQUARE.centroid == (0.5, 0.5)
    t = Polygon("T", [(0.0, 0.0), (3.0, 0.0), (0.0, 3.0)])
    np.testing.assert_allclose(t.centroid, (1.0, 1.0))


def test_wall_distance(spark):
    df = points(spark, [(0.5, 0.25), (1.02, 0.5), (3.0, 3.0)])
    got = R.ray_distance(df, [0, 90, 180, 270], [SQUARE]).toPandas().pivot(index="id", columns="angle", values="distance")
    np.testing.assert_allclose(got.loc[0], [0.5, 0.75, 0.5, 0.25], atol=1e-12)
    np.testing.assert_allclose(got.loc[1], [0.05, 0.5, 0.95, 0.5], atol=1e-12)  # moved in by 0.05
    np.testing.assert_allclose(got.loc[2], [-1] * 4)
    arrays = R.ray_distances(df, [0, 90, 180, 270], [SQUARE]).orderBy("id").toPandas()
    np.testing.assert_allclose(np.stack(arrays["distances"]), got.to_numpy(), atol=1e-12)


def test_room_labels_are_half_open_and_first_wins(spark):
    rooms = [Room("A", 0, 0.0, 10.0), Room("B", 1, 5.0, 20.0)]
    df = spark.createDataFrame([(0.0,), (7.0,), (10.0,), (20.0,), (-1.0,)], "ts double")
    got = {r.ts: r.room for r in R.assign_room(df, rooms).collect()}
    assert got == {0.0: "A", 7.0: "A", 10.0: "B", 20.0: None, -1.0: None}


@pytest.mark.parametrize("reflect", [False, True])
def test_fit_recovers_a_known_map(spark, reflect):
    rng = np.random.default_rng(1)
    frames = []
    for g in range(3):
        src = rng.normal(size=(500, 2))
        m = rng.normal(size=(2, 2)) @ (np.diag([1, -1]) if reflect else np.eye(2))
        tgt = src @ m.T + rng.normal(size=2) + 0.01 * rng.normal(size=(500, 2))
        frames.append(pd.DataFrame(np.c_[src, tgt], columns=["sx", "sy", "tx", "ty"]).assign(g=g))
    pdf = pd.concat(frames)
    got = A.decompose_affine(A.fit_affine(spark.createDataFrame(pdf), ["g"], ("sx", "sy"), ("tx", "ty"))).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        design = np.c_[part[["sx", "sy"]], np.ones(len(part))]
        w = np.linalg.lstsq(design, part[["tx", "ty"]].to_numpy(), rcond=None)[0]
        r = got.loc[g]
        np.testing.assert_allclose([[r.a, r.c], [r.b, r.d], [r.tx, r.ty]], w, atol=1e-9)
        left = part[["tx", "ty"]].to_numpy() - design @ w
        np.testing.assert_allclose(r.rmse, np.sqrt((left**2).sum(axis=1).mean()), rtol=1e-6)
        u, s, vt = np.linalg.svd(w[:2].T)
        np.testing.assert_allclose([r.max_eigenvalue, r.min_eigenvalue], s, atol=1e-9)
        q = u @ vt
        assert r.reflection == (np.linalg.det(q) < 0)
        if r.reflection:
            axis = np.array([np.cos(np.radians(r.angle_deg)), np.sin(np.radians(r.angle_deg))])
            np.testing.assert_allclose(q @ axis, axis, atol=1e-9)
        else:
            np.testing.assert_allclose(r.angle_deg, np.degrees(np.arctan2(q[1, 0], q[0, 0])) % 360, atol=1e-7)


def test_degenerate_source_has_no_map(spark):
    df = spark.createDataFrame([(1, float(i), 2.0 * i, 1.0, float(i)) for i in range(5)], "g int, sx double, sy double, tx double, ty double")
    assert A.fit_affine(df, ["g"], ("sx", "sy"), ("tx", "ty")).first()["a"] is None


MAPS = {
    "unique": (0.5, 0, 1, 0, 0.5, 1), "translation": (1, 0, 2, 0, 1, 0), "all": (1, 0, 0, 0, 1, 0), "line": (1, 0, 0, 0, -1, 4), "none": (1, 0, 3, 0, -1, 4), "shear": (1, 1, 0, 0, 1, 0),
}


def test_fixed_sets(spark):
    df = spark.createDataFrame([(k, *[float(x) for x in v]) for k, v in MAPS.items()], "k string, a double, b double, tx double, c double, d double, ty double")
    got = A.affine_report(df).toPandas().set_index("k")
    fixed = A.fixed_set(df).toPandas().set_index("k")
    assert fixed["fixed_case"].to_dict() == {**{k: k for k in MAPS if k != "shear"}, "shear": "line"}
    np.testing.assert_allclose(fixed.loc["unique", ["fixed_x", "fixed_y"]].astype(float), [2, 2])
    np.testing.assert_allclose(fixed.loc["line", ["fixed_x", "fixed_y"]].astype(float), [0, 2])
    assert abs(fixed.loc["line", "dir_x"]) == 1 and fixed.loc["translation", "residual"] == np.inf
    assert got.loc["line", "line_type"] == "reflection_axis" and got.loc["shear", "line_type"] == "stationary_line"
    assert got.loc["all", "message"] == "No remapping beyond noise." and got.loc["none", "message"] == "No simple invariant structure detected."


def test_inverse_undoes_the_map(spark):
    df = spark.createDataFrame([(0.3, 0.7, 2.0, 1.0, 0.5, -1.0, 3.0, 0.1)], "x double, y double, a double, b double, tx double, c double, d double, ty double")
    there = A.apply_affine(df)
    back = A.apply_affine(there, "x_map", "y_map", ("x2", "y2"), inverse=True).first()
    np.testing.assert_allclose([back["x2"], back["y2"]], [0.3, 0.7])


def test_mapping_needs_points_before_the_outline_filter(spark):
    rng = np.random.default_rng(2)
    xy = rng.random((40, 2))
    pdf = pd.DataFrame({"room": ["S"] * 20 + ["T"] * 20, "x_pred_S": xy[:, 0], "y_pred_S": xy[:, 1], "x_pred_T": xy[:, 1] * 0.5 + 0.1, "y_pred_T": 1 - xy[:, 0]})
    polygons = [SQUARE, Polygon("T", [(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (-1.0, 2.0)])]
    df = spark.createDataFrame(pdf)
    assert P.mapping_stats(df, [("S", "T")], polygons, min_points=41).count() == 0
    r = P.mapping_stats(df, [("S", "T")], polygons, min_points=40).first()
    assert r["affinity_r2"] > 1 - 1e-9 and not r["reflection"]
    assert P.mapping_stats(df, [("S", "T")], polygons, mode="source", min_points=21).count() == 0
