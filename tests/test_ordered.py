"""Order-dependent plans must not depend on how a large group is sliced."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfield.operators import folds as S
from wayfield.operators import tracking as K
from wayfield.plans.ordered import in_order, quantiles, with_blocks, with_slices


@pytest.fixture(scope="module")
def rows(spark):
    """One group with most rows, half of them crowded into a hundredth of the time, and some small groups."""
    rng = np.random.default_rng(3)
    n = 3000
    g = np.where(rng.random(n) < 0.8, 0, rng.integers(1, 6, n))
    t = np.where(rng.random(n) < 0.5, rng.random(n), rng.random(n) * 100).round(2)
    v = np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n).round(3))
    pdf = pd.DataFrame({"g": g, "t": t, "id": np.arange(n), "v": v, "flag": rng.random(n) < 0.4})
    return spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None))).repartition(7).cache(), pdf


def test_slices_bound_the_largest_task(rows):
    df, _ = rows
    sliced = with_slices(df, ["g"], "t", 100)
    most = sliced.groupBy("g", "_slice").count().agg(F.max("count")).first()[0]
    assert most < 300 < df.filter("g = 0").count()
    assert with_slices(df, ["g"], "t", 10_000) is None


@pytest.mark.parametrize("limit", [20, 200, 1_000_000])
def test_in_order_equals_plain_windows(rows, limit):
    df, _ = rows
    got = in_order(
        df, ["g"], "t", ["id"], index="i", lag={"pv": "v", "pid": "id"}, lead={"nid": "id"}, running={"s": F.col("flag").cast("int")},
        last_known={"lk": "v"}, next_known={"nk": "v"}, rows_per_slice=limit,
    ).toPandas().sort_values("id").reset_index(drop=True)
    w = W.partitionBy("g").orderBy("t", "id")
    want = df.withColumns(
        {
            "i": F.row_number().over(w).cast("bigint") - 1, "pv": F.lag("v").over(w), "pid": F.lag("id").over(w), "nid": F.lead("id").over(w),
            "s": F.sum(F.col("flag").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)),
            "lk": F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, 0)), "nk": F.first("v", True).over(w.rowsBetween(0, W.unboundedFollowing)),
        }
    ).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want)


@pytest.mark.parametrize("limit", [20, 300, 1_000_000])
def test_quantiles_are_exact(rows, limit):
    df, pdf = rows
    got = quantiles(df, ["g"], {"med": ("v", 0.5), "p95": ("v", 0.95), "lo": ("v", 0.0), "t9": ("t", 0.9)}, limit).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        v = part["v"].dropna()
        np.testing.assert_allclose(got.loc[g, ["med", "p95", "lo", "t9"]].astype(float), [np.percentile(v, 50), np.percentile(v, 95), v.min(), np.percentile(part["t"], 90)])


def test_quantiles_of_one_repeated_value(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), F.when(F.col("id") < 4000, 7.0).otherwise(F.col("id") * 1.0).alias("v"))
    got = quantiles(df, ["g"], {"m": ("v", 0.5), "p": ("v", 0.9)}, 50).first()
    assert got["m"] == 7.0 and got["p"] == np.percentile([7.0] * 4000 + list(range(4000, 5000)), 90)


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_blocks_hold_their_neighbours(rows, size):
    df, _ = rows
    indexed = in_order(df, ["g"], "t", ["id"], index="i")
    w = W.partitionBy("g", "_block").orderBy("i").rowsBetween(-3, 2)
    got = with_blocks(indexed, "i", 3, 2, size).withColumn("s", F.sum("id").over(w)).filter("_own").select("id", "s").toPandas().sort_values("id")
    want = indexed.withColumn("s", F.sum("id").over(W.partitionBy("g").orderBy("i").rowsBetween(-3, 2))).select("id", "s").toPandas().sort_values("id")
    assert got["s"].tolist() == want["s"].tolist()


def track(spark, n=400, sessions=2):
    rng = np.random.default_rng(5)
    out = []
    for s in range(sessions):
        t = np.cumsum(rng.integers(1, 4, n)).astype(float)
        x, y = rng.normal(size=n).cumsum(), rng.normal(size=n).cumsum()
        gap = rng.random(n) < 0.3
        lost = rng.random(n) < 0.1
        out.append(pd.DataFrame({"session": s, "stream": "PC_H", "frame_id": np.arange(n) + s * n, "ts": t, "x": np.where(lost, np.nan, x), "y": y, "p": rng.random(n), "interp": gap.astype(int), "v_provided": rng.random(n)}))
    pdf = pd.concat(out, ignore_index=True)
    return spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None))), pdf


@pytest.mark.parametrize("limit", [25, 1_000_000])
def test_gap_runs_against_numpy(spark, limit):
    df, pdf = track(spark)
    frames = K.track_frames(df, rows_per_slice=limit)
    runs = K.gap_speed_outliers(frames, K.gap_runs(frames, 4.0, 3.0), 6, 3.0, 5.0).toPandas()
    want = {}
    for s, part in pdf.groupby("session"):
        x, y, ts = part["x"].to_numpy(), part["y"].to_numpy(), part["ts"].to_numpy()
        gap = (part["interp"].to_numpy() > 0) & ~np.isnan(x)
        v = np.r_[np.nan, np.hypot(np.diff(x), np.diff(y)) / np.diff(ts)]
        i = 0
        while i < len(gap):
            if gap[i]:
                j = i
                while j + 1 < len(gap) and gap[j + 1]:
                    j += 1
                local = np.r_[v[max(0, i - 6):i], v[j + 1:j + 7]]
                local = local[~np.isnan(local)]
                med = np.median(local) if len(local) else np.nan
                around = v[max(0, i - 1):j + 2]
                want[(s, i)] = (j, ts[j] - ts[i], np.hypot(x[j] - x[i], y[j] - y[i]), np.nanmax(around) if np.isfinite(around).any() else np.nan, med)
                i = j
            i += 1
    assert len(runs) == len(want)
    for r in runs.itertuples():
        end, duration, distance, peak, med = want[(r.session, r.start_idx)]
        assert r.end_idx == end
        np.testing.assert_allclose([r.duration, r.distance, r.gap_peak_speed, r.v_local_median], [duration, distance, peak, med], atol=1e-9)


def test_every_interpolated_frame_is_in_one_run(spark):
    df, _ = track(spark)
    frames = K.track_frames(df, rows_per_slice=30)
    runs = K.gap_runs(frames, 4.0, 3.0)
    assert runs.agg(F.sum("length_frames")).first()[0] == frames.filter("gap").count()
    states = K.classify_frames(frames, runs)
    assert states.filter("gap and state < 2").count() == 0 and states.count() == frames.count()


def test_folds_cover_rooms_and_splits_are_disjoint(spark):
    df, _ = track(spark)
    rooms = df.withColumn("room", F.when(F.col("ts") < 300, "A").when(F.col("ts") < 600, "B"))
    folded = S.assign_fold(rooms, 5, rows_per_slice=40)
    per = folded.filter("room is not null").groupBy("session", "room").agg(F.sort_array(F.collect_set("fold")).alias("f")).collect()
    assert per and all(r["f"] == [1, 2, 3, 4, 5] for r in per)
    assert folded.filter("(room is null) <> (fold is null)").count() == 0
    splits = S.cv_splits(folded, 5, ["A", "B"], ["A"], rows_per_slice=40)
    assert splits.groupBy("split_fold", "frame_id").count().filter("count > 1").count() == 0
    whole = S.cv_splits(folded, 5, ["A", "B"], ["A"]).exceptAll(splits).count()
    assert whole == 0


def test_one_row_room_gets_fold_one(spark):
    df = spark.createDataFrame([(1, 1, 0.0, "A")], "session int, frame_id int, ts double, room string")
    assert S.assign_fold(df, 4).first()["fold"] == 1


@pytest.mark.parametrize("block", [7, 1000])
def test_sequence_windows(spark, block):
    df, pdf = track(spark)
    data = df.withColumns({"fold": F.lit(1), "room": F.lit("A")})
    got = S.sequence_windows(data, 5, ["x", "y"], ["y"], rows_per_slice=50, rows_per_block=block).toPandas()
    n = 0
    for _, part in pdf.groupby("session"):
        x, y = part["x"].to_numpy(), part["y"].to_numpy()
        for i in range(5, len(part)):
            if not np.isnan(x[i - 5:i]).any():
                n += 1
                row = got[got["frame_id"] == part["frame_id"].iloc[i]].iloc[0]
                np.testing.assert_allclose([w["x"] for w in row["window"]], x[i - 5:i])
                assert row["y"] == y[i]
    assert len(got) == n > 100


@pytest.mark.parametrize("block", [3, 1000])
def test_gauss_smoothing_against_numpy(spark, block):
    df, pdf = track(spark, 120, 1)
    got = S.gauss_smooth_trace(df, "x", 1.5, ["session"], "ts", ["frame_id"], rows_per_slice=20, rows_per_block=block).orderBy("frame_id").toPandas()
    k = np.arange(-5, 6)
    kernel = np.exp(-0.5 * (k / 1.5) ** 2)
    want = np.convolve(np.nan_to_num(pdf["x"]), kernel / kernel.sum(), mode="same")
    want[np.isnan(pdf["x"])] = np.nan
    np.testing.assert_allclose(got["smoothed"].astype(float), want, atol=1e-9)


def test_crowds_nulls_and_strings_are_cut_by_their_ties(spark):
    from wayfield.plans import ordered

    rng = np.random.default_rng(21)
    # one value of the order column holds most rows, and many have none
    rows = [(1, None if i % 5 == 0 else ("same" if i % 3 else f"s{int(rng.integers(0, 40)):02}"), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g int, o string, i int").repartition(7)
    slices = ordered.slice_borders(df, ["g"], "o", ["i"], 200)
    cut = ordered.with_slices(df, ["g"], "o", 200, ["i"], slices)
    sizes = [r["count"] for r in cut.groupBy("_slice").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 800 and cut.filter("not _split").count() == 0
    got = ordered.in_order(df, ["g"], "o", ["i"], index="n", lag={"before": "i"}, running={"sum": F.col("i")}, rows_per_slice=200, slices=slices).toPandas().sort_values("n")
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2]))
    assert got["i"].tolist() == [r[2] for r in want] and got["n"].tolist() == list(range(4000))
    assert got["sum"].tolist() == np.cumsum([r[2] for r in want]).tolist()
    assert got["before"].tolist()[1:] == [r[2] for r in want][:-1]


def test_shared_slices_are_measured_once(spark, monkeypatch):
    from wayfield.plans import ordered

    df = spark.range(3000).selectExpr("id % 2 g", "id t")
    slices = ordered.slice_borders(df, ["g"], "t", (), 100)
    monkeypatch.setattr(ordered, "slice_borders", lambda *a, **k: pytest.fail("measured again"))
    once = ordered.in_order(df, ["g"], "t", index="n", rows_per_slice=100, slices=slices)
    twice = ordered.in_order(once, ["g"], "t", running={"c": F.lit(1)}, rows_per_slice=100, slices=slices)
    assert twice.filter("c <> n + 1").count() == 0 and twice.count() == 3000


def test_one_long_trace_is_filled_by_many_tasks(spark):
    bounds = spark.createDataFrame([(1, -7, 30_000_000), (2, 5, 4)], "cell int, lo long, hi long").filter("hi >= lo")
    bins = S.dense_bins(bounds, ["cell"])
    parts = bins.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("bin").alias("lo"), F.max("bin").alias("hi")).collect()
    assert len(parts) >= 6 and sum(r.n for r in parts) == 30_000_008 and max(r.n for r in parts) < 15_000_000
    assert min(r.lo for r in parts) == -7 and max(r.hi for r in parts) == 30_000_000
