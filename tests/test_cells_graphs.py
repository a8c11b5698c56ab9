"""Neighbours, clusters and decoders against brute force on small inputs."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks import graph_checks
from checks.affine_checks import room_fit
from wayfield.operators import cells as C
from wayfield.operators import decoding as D
from wayfield.operators import graphs as G
from wayfield.operators import maps as M


def brute_knn(pdf, k):
    out = set()
    for _, part in pdf.groupby("g"):
        p, ids = part[["x", "y"]].to_numpy(), part["id"].to_numpy()
        d = np.hypot(p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1])
        for i in range(len(p)):
            order = sorted((d[i, j], ids[j]) for j in range(len(p)) if j != i)[:k]
            out |= {(int(ids[i]), int(j)) for _, j in order}
    return out


@pytest.mark.parametrize("k", [1, 5])
def test_knn_with_copies_crowds_and_outliers(spark, k):
    rng = np.random.default_rng(4)
    copies = np.full((60, 2), 0.5)
    crowd = 0.5 + rng.normal(size=(120, 2)) * 1e-4
    wide = rng.random((80, 2)) * 10
    far = np.array([[1000.0, 1000.0], [-500.0, 3.0]])
    xy = np.r_[copies, crowd, wide, far, rng.random((4, 2))]
    pdf = pd.DataFrame({"g": [1] * (len(xy) - 4) + [2] * 4, "id": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})
    got = G.knn_join(spark.createDataFrame(pdf), k, ["g"]).toPandas()
    assert {(int(a), int(b)) for a, b in zip(got["i"], got["j"])} == brute_knn(pdf, k)


def test_radius_join_with_salted_buckets(spark):
    rng = np.random.default_rng(6)
    q, p = rng.random((50, 2)), np.r_[rng.random((200, 2)), np.full((300, 2), 0.31)]
    qdf = spark.createDataFrame(pd.DataFrame({"qid": range(50), "x": q[:, 0], "y": q[:, 1]}))
    pdf = spark.createDataFrame(pd.DataFrame({"pid": range(500), "px": p[:, 0], "py": p[:, 1]}))
    got = G.radius_join(qdf, pdf, 0.1, bucket_rows=20).toPandas()
    d = np.hypot(q[:, None, 0] - p[None, :, 0], q[:, None, 1] - p[None, :, 1])
    assert set(zip(got["qid"], got["pid"])) == set(zip(*np.where(d <= 0.1))) and len(got) == (d <= 0.1).sum()


def greedy(embedding, most, least, share):
    labels, order, label = np.zeros(len(embedding), int), list(np.argsort(np.linalg.norm(embedding, axis=1))[::-1]), 1
    while order and label <= most:
        seed = embedding[order[0]]
        dims = seed**2 / (seed**2).max() > share
        near = np.linalg.norm(embedding[:, dims] - seed[dims], axis=1) < np.linalg.norm(embedding[:, dims], axis=1)
        members = near & (labels == 0)
        if members.sum() >= least:
            labels[members] = label
            label += 1
            order = [i for i in order if not members[i]]
        else:
            order.pop(0)
    return labels


@pytest.mark.parametrize("most,batch", [(100, 4), (3, 256)])
def test_norm_clusters(spark, most, batch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8)) * 3
    e = np.concatenate([c + rng.normal(size=(n, 8)) for c, n in zip(centres, (30, 20, 12, 6, 3, 2))])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(e)], "cell int, embedding array<double>")
    got = C.norm_clusters(df, most, 5, 0.1, seeds_per_pass=batch).toPandas().sort_values("cell")["cluster"].to_numpy()
    want = greedy(e, most, 5, 0.1)
    assert (got == want).all() and want.max() > 2


def test_merge_clusters(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(3, 200))
    signals = np.concatenate([base[i] * w + rng.normal(size=(5, 200)) * s for i, w, s in ((0, 1, 0.3), (0, 1, 1.2), (1, 1, 0.5), (2, 0.05, 1), (2, 0.05, 1))])
    labels = np.repeat([1, 2, 3, 4, 5], 5)
    r = np.corrcoef(signals)
    corr = spark.createDataFrame([(i, j, float(r[i, j])) for i in range(25) for j in range(i, 25)], "cell_a int, cell_b int, r double")
    clusters = spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "cell int, cluster int")
    got = C.merge_clusters(corr, clusters).toPandas().sort_values("cell")["cluster"].to_numpy()
    now = labels.copy()
    changed = True
    while changed:
        changed = False
        ids = sorted(set(now))
        intra = {c: r[np.ix_(now == c, now == c)][np.triu_indices((now == c).sum(), 1)].mean() for c in ids}
        pairs = sorted(((a, b, r[np.ix_(now == a, now == b)].mean()) for n, a in enumerate(ids) for b in ids[n + 1:]), key=lambda p: -p[2])
        for a, b, m in pairs:
            top, low = max(intra[a], intra[b]), min(intra[a], intra[b])
            if (m / top > 0.5 and low / top < 0.5) or top < 0.1:
                now[now == b] = a
                changed = True
                break
    assert (got == now).all() and len(set(now)) < 5


def test_pair_sums_skip_missing_values(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(60, 4))
    x[rng.random(x.shape) < 0.3] = np.nan
    rows = [(1, i, c, float(x[i, c])) for i in range(60) for c in range(4)]
    df = spark.createDataFrame(rows, "block int, row int, cell int, rate double")
    got = C.corr_by_block(df, ["block"], "row").toPandas()
    want = pd.DataFrame(x).corr()
    for r in got.itertuples():
        np.testing.assert_allclose(r.r, want.iloc[r.cell_a, r.cell_b], atol=1e-9)
    assert len(got) == 10


def test_fold_decoder_against_normal_equations(spark):
    rng = np.random.default_rng(11)
    n = 200
    pdf = pd.DataFrame({"s": 1, "row_id": range(n), "room": np.where(rng.random(n) < 0.5, "A", "B"), "fold": rng.integers(1, 4, n), "f1": rng.normal(size=n), "f2": rng.normal(size=n)})
    pdf["x"] = pdf["f1"] * np.where(pdf["room"] == "A", 1.0, -2.0) + 0.1 * rng.normal(size=n)
    got = D.fold_decoder(spark.createDataFrame(pdf), ["s"], ["f1", "f2"], ["x"], ridge=0.5).toPandas()
    assert len(got) == 2 * n
    for (fold, room), part in got.groupby(["fold", "predicted_room"]):
        train = pdf[(pdf["fold"] != fold) & (pdf["room"] == room)]
        design = np.c_[np.ones(len(train)), train[["f1", "f2"]]]
        w = np.linalg.solve(design.T @ design + 0.5 * np.eye(3), design.T @ train["x"])
        test = pdf.set_index("row_id").loc[part["row_id"]]
        np.testing.assert_allclose(part["x_pred"], np.c_[np.ones(len(test)), test[["f1", "f2"]]] @ w, atol=1e-8)


def test_fold_decoder_with_five_hundred_features(spark):
    rng = np.random.default_rng(12)
    n, d = 1500, 500
    x = rng.normal(size=(n, d))
    y = x @ rng.normal(size=(d, 2)) + 0.1 * rng.normal(size=(n, 2))
    names = [f"c{i}" for i in range(d)]
    pdf = pd.DataFrame(x, columns=names).assign(s="one", row_id=range(n), room=np.where(rng.random(n) < 0.6, "A", "B"), fold=rng.integers(1, 3, n), x=y[:, 0], y=y[:, 1])
    pdf.loc[0, "c7"] = np.nan
    packed = pdf.drop(columns=names).assign(cells=pdf[names].to_numpy().tolist())
    got = D.fold_decoder(spark.createDataFrame(packed).repartition(6), ["s"], "cells", ["x", "y"], ridge=1.0, rows_per_chunk=200).toPandas()
    assert len(got) == 2 * n and got["x_pred"].isna().sum() == 2
    good = pdf.dropna()
    for (fold, room), part in got.groupby(["fold", "predicted_room"]):
        train = good[(good["fold"] != fold) & (good["room"] == room)]
        design = np.c_[np.ones(len(train)), train[names]]
        w = np.linalg.solve(design.T @ design + np.eye(d + 1), design.T @ train[["x", "y"]])
        part = part.dropna().sort_values("row_id")
        test = good.set_index("row_id").loc[part["row_id"]]
        np.testing.assert_allclose(part[["x_pred", "y_pred"]], np.c_[np.ones(len(test)), test[names]] @ w, atol=1e-6)


def test_knn_in_a_dense_spot_with_far_outliers(spark):
    rng = np.random.default_rng(14)
    spot = 3.0 + rng.normal(size=(700, 2)) * 1e-6
    xy = np.r_[spot, rng.random((60, 2)) * 1e4, np.stack([np.arange(40.0), np.zeros(40)], axis=1), np.full((30, 2), 7.5)]
    pdf = pd.DataFrame({"g": 1, "id": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})
    got = G.knn_join(spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(5), 4, ["g"]).toPandas()
    assert {(int(a), int(b)) for a, b in zip(got["i"], got["j"])} == brute_knn(pdf, 4)


@pytest.mark.parametrize("k, places", [(3, 5), (6, 40)])
def test_knn_across_the_borders_of_many_leaves(spark, k, places):
    """A lattice (equal distances, which go by id), a crowd, copies and outliers, in leaves that neighbours lie outside of."""
    rng = np.random.default_rng(31)
    lattice = np.stack(np.meshgrid(np.arange(18.0), np.arange(18.0)), axis=-1).reshape(-1, 2)
    xy = np.r_[lattice, lattice[:9], np.full((12, 2), 3.0), 5.0 + rng.normal(size=(150, 2)) * 1e-3, [[900.0, -3.0], [-40.0, 70.0], [901.0, -3.0]]] + 1e6
    pdf = pd.DataFrame({"g": 1, "id": rng.permutation(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})
    got = G.knn_join(spark.createDataFrame(pdf).repartition(4), k, ["g"], places_per_cell=places).toPandas()
    assert {(int(a), int(b)) for a, b in zip(got["i"], got["j"], strict=True)} == brute_knn(pdf, k) and len(got) == k * len(pdf)


def test_places_of_a_leaf_are_compared_as_one_matrix(monkeypatch):
    rng = np.random.default_rng(32)
    x, y, copies = rng.integers(0, 4, 30).astype(float), np.arange(30.0) % 7, rng.integers(1, 4, 30)
    ids = np.split(rng.permutation(copies.sum()), np.cumsum(copies)[:-1])
    table = pa.table({"x": x, "y": y, "ids": [sorted(v.tolist()) for v in ids]})
    want = [sorted((np.hypot(x[i] - x[q], y[i] - y[q]), int(j)) for q in range(30) for j in ids[q])[:5] for i in range(30)]
    for pairs in (1, 1 << 20):
        monkeypatch.setattr(G, "_PAIRS", pairs)
        furthest, distance, j = G._nearest_in_cell(table, 4)
        assert j.to_pylist() == [[b for _, b in row] for row in want]
        np.testing.assert_allclose(distance.to_pylist(), [[a for a, _ in row] for row in want])
        np.testing.assert_allclose(furthest, [row[-1][0] for row in want])
    assert np.isinf(G._nearest_in_cell(table.slice(0, 1), 4)[0]).all()


def test_linked_pairs_are_held_once(spark):
    edges = spark.createDataFrame([(1, 1, 2, 0.5), (1, 2, 1, 0.25), (1, 3, 2, 1.0)], "g int, i int, j int, w double")
    assert sorted(map(tuple, G._merge_edges(edges, ["g"], half=False).collect())) == [(1, 1, 2, 0.75), (1, 2, 3, 1.0)]
    assert sorted(map(tuple, G._merge_edges(edges, ["g"], half=True).collect())) == [(1, 1, 2, 0.375), (1, 2, 3, 0.5)]


def test_residual_energy_of_many_maps(spark):
    rng = np.random.default_rng(33)
    n, k = 60, 4
    pdf = pd.DataFrame(rng.random((n, 4)), columns=["sx", "sy", "tx", "ty"]).assign(g=1, id=np.arange(n))
    pdf.loc[[3, 17], "ty"] = None
    maps = pd.DataFrame(rng.normal(size=(3, 6)), columns=["a", "b", "mx", "c", "d", "my"]).assign(room=["A", "B", "a"], fold=[1, 2, 3])
    points = spark.createDataFrame(pdf).withColumn("ty", F.nanvl("ty", F.lit(None).cast("double")))
    nameless = spark.createDataFrame(maps.head(1)).withColumns({"room": F.lit("x"), "fold": F.lit(None).cast("long")})
    got = G.residual_energy(points, spark.createDataFrame(maps).unionByName(nameless), k, ["g"]).toPandas().set_index("room")
    p = pdf[["sx", "sy"]].to_numpy()
    d = np.hypot(p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1])
    near = np.argsort(d + np.diag(np.full(n, np.inf)), axis=1)[:, :k]
    sigma = np.median(np.take_along_axis(d, near, axis=1))
    w = np.zeros((n, n))
    np.put_along_axis(w, near, np.exp(-np.take_along_axis(d, near, axis=1) ** 2 / (2 * sigma**2)), axis=1)
    w += w.T
    for m in maps.itertuples():
        want = 0.0
        for r in (pdf["tx"] - (m.a * pdf["sx"] + m.b * pdf["sy"] + m.mx), pdf["ty"] - (m.c * pdf["sx"] + m.d * pdf["sy"] + m.my)):
            r = r.fillna(0).to_numpy()
            want += (w.sum(1) * r * r).sum() - r @ w @ r
        assert got.loc[m.room, "n"] == n and got.loc[m.room, "fold"] == m.fold
        np.testing.assert_allclose(got.loc[m.room, "energy"], want, rtol=1e-9)
    # repeated points stand once in the graph; a map with a missing name has no pairs
    m, twice = maps.loc[0], G.residual_energy(points.union(points), spark.createDataFrame(maps), k, ["g"]).toPandas().set_index("room")
    r = [(pdf["tx"] - (m.a * pdf["sx"] + m.b * pdf["sy"] + m.mx)).to_numpy(), (pdf["ty"] - (m.c * pdf["sx"] + m.d * pdf["sy"] + m.my)).fillna(0).to_numpy()]
    np.testing.assert_allclose(got.loc["x", "energy"], sum((w.sum(1) * v * v).sum() for v in r), rtol=1e-9)
    np.testing.assert_allclose(twice.loc["A", "energy"], sum(2 * (w.sum(1) * v * v).sum() - 4 * v @ w @ v for v in r), rtol=1e-9)


def test_products_over_lists_are_those_over_pairs(spark):
    """A crowd of more points than a list has ids, an id at two places, and a group of one point."""
    rng = np.random.default_rng(35)
    pdf = pd.DataFrame(rng.random((90, 4)), columns=["sx", "sy", "tx", "ty"]).assign(g=np.r_[np.full(89, 1), 2], id=np.arange(90))
    pdf.loc[:14, ["sx", "sy"]] = 0.25
    pdf.loc[88, "id"] = 40
    points, products = spark.createDataFrame(pdf).repartition(3), {"tt": ("tx", "tx"), "xy": ("sx", "ty")}
    at = ["_o_tt", "_x_tt", "_o_xy", "_x_xy"]
    graphs = [make(points, 5, ["g"], "sx", "sy") for make in (G.kernel_edges, G.kernel_lists)]
    pairs, lists = (G.graph_products(g, points, ["g"], products, normalised=False).toPandas().set_index("g").sort_index() for g in graphs)
    assert lists["n"].tolist() == pairs["n"].tolist() == [89, 1]
    np.testing.assert_allclose(lists[at], pairs[at], rtol=1e-10)
    with pytest.raises(ValueError):
        G.graph_products(graphs[1], points, ["g"], products)


def test_residual_energy_query_weighs_a_hundred_neighbours(spark, tmp_path):
    """Groups of 240, 130 and 60 points: of each point the hundred nearest count, or all others where there are fewer."""
    rng = np.random.default_rng(34)
    user, n = np.repeat([0, 1, 2], [240, 130, 60]), 430
    k = rng.integers(0, 100, n)
    events = pd.DataFrame({"event_id": rng.permutation(n), "user_id": user, "event_type": "click", "value": rng.random(n) * 500, "props": [f'{{"k": {v}}}' for v in k]})
    spark.createDataFrame(events).withColumn("ts", F.lit("2024-01-02").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    m = 400
    lines = pd.DataFrame({"l_orderkey": np.arange(m), "l_partkey": 1, "l_suppkey": 1, "l_linenumber": np.arange(m) % 7 + 1, "l_quantity": rng.integers(1, 51, m) * 1.0})
    lines = lines.assign(l_extendedprice=rng.random(m) * 1e5, l_discount=rng.random(m) / 10, l_tax=rng.random(m) / 12, l_returnflag="A", l_linestatus="O")
    spark.createDataFrame(lines).withColumn("l_shipdate", F.lit("1995-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = graph_checks.residual_energy(spark, str(tmp_path)).toPandas()
    maps = room_fit(spark, str(tmp_path)).toPandas()
    assert len(got) == 3 * len(maps) == 45
    p, t = np.c_[events["value"] / 500, k / 100.0], np.c_[k * 3.6 / 360, events["value"] / 400]
    for cell in range(3):
        x, y, ids = p[user == cell], t[user == cell], events["event_id"].to_numpy()[user == cell]
        d = np.hypot(*(x[:, None] - x[None]).transpose(2, 0, 1))
        w, rows = np.zeros_like(d), np.arange(len(x))
        near = [[j for j in np.lexsort((ids, d[i])) if j != i][:100] for i in rows]
        sigma = np.median(np.concatenate([d[i, near[i]] for i in rows]))
        for i in rows:
            w[i, near[i]] = np.exp(-d[i, near[i]] ** 2 / (2 * sigma**2))
        w += w.T
        for f in maps.itertuples():
            r = y - np.c_[f.a * x[:, 0] + f.b * x[:, 1] + f.tx, f.c * x[:, 0] + f.d * x[:, 1] + f.ty]
            want = (w.sum(1) @ (r * r)).sum() - (r * (w @ r)).sum()
            row = got[(got["cell"] == cell) & (got["room"] == f.room) & (got["fold"] == f.fold)].iloc[0]
            assert row["n"] == len(x)
            np.testing.assert_allclose(row["energy"], want, rtol=1e-8)


def test_leaf_levels_split_crowded_cells_only():
    rng = np.random.default_rng(2)
    codes = np.sort(np.r_[rng.integers(0, 1 << 62, 300), (1 << 61) + rng.integers(0, 1 << 12, 50)])
    levels = G._leaf_levels(codes, 5)
    count = lambda level, code: int((codes >> 2 * (31 - level) == code >> 2 * (31 - level)).sum())
    for level, code in zip(levels.tolist(), codes.tolist(), strict=True):
        assert level % 2 == 0 and (level == G.DEEPEST or count(level, code) <= 5)
        assert level == 0 or count(level - 2, code) > 5


def test_border_length_is_the_connected_part(spark):
    walls = spark.createDataFrame([("R", x, y, 1.0 if x == 0 else 2.0) for x in range(2) for y in range(6)], "room string, bx int, by int, distance double")
    values = {(0, 0): 10.0, (0, 1): 5.0, (0, 3): 9.0, (1, 5): 1.0}
    maps = spark.createDataFrame([(1, "R", x, y, v) for (x, y), v in values.items()], "cell int, room string, bx int, by int, value double")
    scores = spark.createDataFrame([(1, "R", 0.9, 0, 1)], "cell int, room string, score double, start int, stop int")
    got = M.border_length(maps, walls, scores, ["cell"], 0.0).first()
    assert got["length_score"] == pytest.approx(2 / 6)


def test_sample_is_seeded_and_balanced(spark):
    df = spark.range(1000).select(F.col("id").alias("row_key"), F.when(F.col("id") % 10 == 0, "a").otherwise("B").alias("room"))
    first = C.sample_per_room(df, 40, 2, seed=1).toPandas()
    again = C.sample_per_room(df.repartition(13), 40, 2, seed=1).toPandas()
    assert first.groupby("room").size().to_dict() == {"a": 20, "B": 20}
    assert sorted(first["row_key"]) == sorted(again["row_key"])


def test_rank_with_one_score_for_most_rows(spark):
    df = spark.range(1000).selectExpr("id cell", "'A' room", "case when id < 900 then 5D else cast(id as double) end score")
    got = {r.cell: r.rank for r in C.rank_in_room(df).collect()}
    # ranks 1 to 100 for the distinct scores, then 900 rows share the mean of 101 to 1000
    assert all(got[i] == (550 if i < 900 else 1000 - i) for i in range(1000))


def test_top_rows_beyond_the_pruning_limit(spark):
    df = spark.range(9000).selectExpr("id cell", "cast(id % 2 as string) room", "cast(id as double) score")
    got = C.top_rows(df, ["room"], [F.desc("score")], 3000).collect()
    assert len(got) == 6000 and all(r._r == (8999 - r.cell) // 2 + 1 for r in got)


@pytest.mark.parametrize("in_order", [False, True])
def test_kernel_grids_of_interleaved_keys(spark, monkeypatch, in_order):
    """Fewer grids held than keys: sums stay the same; in key order a task sends each grid once."""
    rng = np.random.default_rng(30)
    pdf = pd.DataFrame({"k": np.arange(4000) % 8, "sx": rng.random(4000), "sy": rng.random(4000), "tx": rng.random(4000), "ty": rng.random(4000)})
    df = spark.createDataFrame(pdf).repartition(3)
    want = M.kernel_mapping(df, ["k"], 9, 0.0, 1.0, 0.1).toPandas().sort_values(["k", "gx", "gy"]).reset_index(drop=True)
    monkeypatch.setattr(M, "HELD", 6 * 81 * 3)
    got = M.kernel_mapping(df, ["k"], 9, 0.0, 1.0, 0.1, in_key_order=in_order).toPandas().sort_values(["k", "gx", "gy"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)
