"""Sources, sinks and the live operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_ordered import track
from wayfield.operators import decoding as D
from wayfield.operators import frames as FR
from wayfield.operators import tracking as K
from wayfield.sources import tables as T
from wayfield.streaming import live as L

SCHEMA = "session int, name string, v double"


def test_write_append_and_scan_csv(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", float("nan"))], SCHEMA)
    T.write_table(df, path, overwrite=True, fmt="csv")
    T.write_table(df, path, fmt="csv")
    back = T.scan_table(spark, path, SCHEMA)
    assert back.count() == 4 and back.filter("v is null").count() == 2
    T.write_table(df, path, overwrite=True, fmt="csv")
    assert T.scan_table(spark, path, SCHEMA).count() == 2
    with pytest.raises(ValueError):
        T.scan_table(spark, path)


def test_collect_files_by_name_and_parent(spark, tmp_path):
    for folder in ("one", "two"):
        for name in ("stats.csv", "other.csv"):
            target = tmp_path / folder
            target.mkdir(exist_ok=True)
            (target / name).write_text(f"session,name,v\n1,{folder}-{name},2.0\n")
    got = T.collect_files(spark, str(tmp_path), r"st.*\.csv", SCHEMA, "csv")
    assert sorted(r["name"] for r in got.collect()) == ["one-stats.csv", "two-stats.csv"]
    assert all(r["_source_file"].endswith("stats.csv") for r in got.collect())
    only = T.stats_files(spark, str(tmp_path), "stats.csv", SCHEMA, "csv", ["two"])
    assert [r["name"] for r in only.collect()] == ["two-stats.csv"]


def test_streams_need_both_coordinates():
    assert T.stream_names(["TC_b.X", "TC_b.Y", "PC_a.X", "PC_a.Y", "EC_c.X", "ZZ_d.X", "ZZ_d.Y"]) == ["PC_a", "TC_b"]


def test_label_filter(spark):
    df = spark.createDataFrame([(1, True, "x"), (2, False, "y")], "cell int, Speed_Cell boolean, label string")
    assert [r["cell"] for r in FR.filter_by_labels(df, {"Velocity_Cell": True}).collect()] == [1]
    with pytest.warns(UserWarning):
        assert FR.filter_by_labels(df, {"nothing": 1}).count() == 2
    with pytest.raises(ValueError):
        FR.filter_by_labels(df, {"label": ["z"]}, require=True)


def test_room_columns_survive_case_insensitive_names():
    assert D.column_suffixes(["A", "B", "a"]) == {"A": "A", "B": "B", "a": "a2"}


def test_skipped_files_are_listed(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "good"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-broken.parquet").write_bytes(b"not a parquet file")
    skipped = T.skipped_files(spark, str(tmp_path), r"part-.*\.parquet", "id long", glob="*.parquet").collect()
    assert [r["_source_file"].rsplit("/", 1)[-1] for r in skipped] == ["part-broken.parquet"]
    assert T.collect_files(spark, str(tmp_path), r"part-.*\.parquet", "id long", glob="*.parquet", skip_unreadable=True).count() == 5


def live_source(spark, tmp_path, batches, shuffle, files_per_batch=1):
    df, pdf = track(spark, 300, 3)
    rng = np.random.default_rng(0)
    pdf = pdf.sort_values("ts")
    order = np.argsort(pdf["ts"].to_numpy() + (rng.random(len(pdf)) * 8 if shuffle else 0), kind="stable")
    pdf = pdf.iloc[order]
    schema = df.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).schema
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate(np.array_split(np.arange(len(pdf)), batches)):
        piece = pdf.iloc[part].astype({"frame_id": "int64", "session": "int64", "interp": "int64"})
        piece = piece.assign(event_time=pd.to_datetime(piece["ts"], unit="s", utc=True))
        piece["event_time"] = piece["event_time"].astype("datetime64[us, UTC]")
        piece.assign(x=piece["x"].astype(object).where(piece["x"].notna(), None).astype("float64")).to_parquet(folder / f"{i:03}.parquet")
    stream = L.read_stream(spark, str(folder), schema, files_per_batch=files_per_batch).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    return df, stream


@pytest.mark.parametrize("shuffle, files_per_batch", [(False, 1), (True, 1), (True, 2), (True, None)])
def test_live_gap_runs_span_batches(spark, tmp_path, shuffle, files_per_batch):
    df, stream = live_source(spark, tmp_path, 5, shuffle, files_per_batch)
    out = L.run_available(L.stream_gap_runs(stream, 4.0, 3.0, delay="20 seconds", idle_seconds=1e6)).toPandas()
    frames = K.track_frames(df)
    end = frames.agg(F.max("ts")).first()[0] - 20
    known = frames.filter(F.col("ts") <= end)
    runs = K.gap_runs(frames, 4.0, 3.0)
    closed = runs.join(known.select("session", "stream", (F.col("idx") - 1).alias("end_idx")), ["session", "stream", "end_idx"]).toPandas()
    cols = ["session", "start_idx", "end_idx", "length_frames", "duration", "distance", "p_mean_run"]
    a, b = (p[cols].astype(float).sort_values(["session", "start_idx"]).reset_index(drop=True) for p in (out, closed))
    pd.testing.assert_frame_equal(a, b)


def test_idle_streams_close_their_open_run(spark, tmp_path):
    # session 1 ends inside a run; session 2 goes on, so event time passes the end of session 1
    rows = [(1, "a", i, float(i), 1.0 * i, 0.0, 0.5, int(i >= 6)) for i in range(10)] + [(2, "a", 100 + i, float(i), 0.0, 0.0, None, 0) for i in range(400)]
    schema = "session long, stream string, frame_id long, ts double, x double, y double, p double, interp int"
    df = spark.createDataFrame(rows, schema).withColumn("event_time", F.timestamp_micros(((F.col("ts") + 1000) * 1_000_000).cast("long")))
    folder = str(tmp_path / "in")
    df.filter("ts < 200").coalesce(1).write.parquet(folder)
    df.filter("ts >= 200").coalesce(1).write.mode("append").parquet(folder)
    stream = L.read_stream(spark, folder, df.schema, files_per_batch=1)
    got = L.run_available(L.stream_gap_runs(stream, 2.0, 5.0, delay="5 seconds", idle_seconds=100.0)).collect()
    assert [(r["session"], r["start_idx"], r["end_idx"], r["duration"], r["distance"], r["p_mean_run"]) for r in got] == [(1, 6, 9, 3.0, 3.0, 0.5)]
    assert got[0]["is_long_time"] and not got[0]["is_long_distance"]
    still_open = L.run_available(L.stream_gap_runs(stream, 2.0, 5.0, delay="5 seconds", idle_seconds=1e6))
    assert still_open.count() == 0


class Kept:
    """A map or list state in memory, for one group; counts the calls to it."""

    def __init__(self):
        self.map, self.list, self.value, self.calls = {}, [], None, 0

    def __getattribute__(self, name):
        if name not in ("map", "list", "value", "calls"):
            self.calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return bool(self.map)

    def getValue(self, key):
        return self.map.get(key)

    def updateValue(self, key, value):
        self.map[key] = value

    def iterator(self):
        return iter(self.map.items())

    def get(self):
        return iter(self.list)

    def put(self, rows):
        self.list = rows

    def appendList(self, rows):
        self.list = self.list + rows

    def clear(self):
        self.list = []


class KeptValue(Kept):
    """A value state."""

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Group:
    """The handle of one group, and the times of a batch."""

    def __init__(self):
        self.states, self.timers, self.watermark = {}, set(), 0

    def getMapState(self, name, *schemas):
        return self.states.setdefault(name, Kept())

    getListState = getMapState

    def getValueState(self, name, *schemas):
        return self.states.setdefault(name, KeptValue())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_many_short_streams_share_a_call_and_a_table():
    rng = np.random.default_rng(1)
    n = 400
    frames = pd.DataFrame({"session": rng.integers(0, n, 12_000).astype(str), "stream": "a", "ts": rng.random(12_000) * 1000, "tie": np.arange(12_000), "x": 1.0, "y": 2.0, "p": 0.5})
    frames["at"], frames["gap"] = frames["ts"] + 5000, rng.random(12_000) < 0.6
    group, runs = Group(), L.GapRuns(["session", "stream"], 1.0, 1.0, 10.0, 1e6)
    runs.init(group)
    got = list(runs.handleInputRows((0,), iter([frames.iloc[:7000], frames.iloc[7000:]]), group))
    # one table leaves, and a state is written once per stream and read for none, as there is nothing yet
    assert len(got) == 1
    assert group.states["open"].calls <= n + 1 and group.states["held"].calls <= 1 and len(group.timers) == 1
    # the watermark passes all frames but the last ones: only streams that it passes frames of are read
    group.watermark = int(frames["at"].max() * 1000) - 8_000
    held = {r[0] for r in group.states["held"].list if r[3] <= group.watermark / 1000}
    group.states["open"].calls, fired = 0, group.timers.pop()
    assert fired <= group.watermark and 0 < len(held) < n
    got += list(runs.handleExpiredTimer((0,), group, None))
    assert len(got) == 2 and group.states["open"].calls <= 2 * len(held) + 1 and min(group.timers) > group.watermark

    want = []
    for session, own in frames.sort_values(["ts", "tie"]).groupby("session"):
        last = max(own["at"].max() - 10.0, group.watermark / 1000)
        own = own[own["at"] <= last].reset_index(drop=True)
        run = (own["gap"] != own["gap"].shift()).cumsum()
        for _, part in own[own["gap"]].groupby(run[own["gap"]]):
            if part.index[-1] + 1 < len(own):
                want.append((session, int(part.index[0]), int(part.index[-1]), part["ts"].iloc[0], part["ts"].iloc[-1], 0.5))
    cols = ["session", "start_idx", "end_idx", "t_start", "t_end", "p_mean_run"]
    assert sorted(pd.concat(got)[cols].itertuples(index=False, name=None)) == sorted(want)


@pytest.mark.parametrize("groups", [1, 64])
def test_streams_without_a_key_and_frames_without_a_time(spark, tmp_path, groups):
    # a large number beside a missing one must stay exact; the frames without a time are left out
    big = 2**60 + 1
    rows = [(s, "a", i, float(i), 1.0 * i, 0.0, None, int(2 <= i <= 4)) for s in (big, None, big + 1) for i in range(30)] + [(s, "a", 90, None, 1.0, 1.0, 0.5, 1) for s in (big, None)]
    schema = "session long, stream string, frame_id long, ts double, x double, y double, p double, interp int"
    df = spark.createDataFrame(rows, schema).withColumn("event_time", F.timestamp_micros(((F.col("ts") + 1000) * 1_000_000).cast("long")))
    folder = str(tmp_path / "in")
    df.coalesce(1).write.parquet(folder)
    stream = L.read_stream(spark, folder, df.schema)
    out = L.run_available(L.stream_gap_runs(stream, 2.0, 5.0, delay="5 seconds", groups=groups))
    assert dict(out.dtypes)["session"] == "bigint"
    got = sorted(((r["session"] or 0, r["start_idx"], r["end_idx"], r["distance"], r["p_mean_run"]) for r in out.collect()))
    assert got == [(s, 2, 4, 2.0, None) for s in (0, big, big + 1)]


def test_live_timebins_equal_batch(spark, tmp_path):
    df, stream = live_source(spark, tmp_path, 4, True)
    out = L.run_available(L.stream_timebins(stream, "50 seconds", "20 seconds"))
    last = df.agg(F.max("ts")).first()[0] - 20
    want = df.groupBy("session", F.floor(F.col("ts") / 50).alias("bin")).count().filter((F.col("bin") + 1) * 50 <= last)
    got = out.select("session", F.floor(F.unix_timestamp("bin_start") / 50).alias("bin"), F.col("n_frames").alias("count"))
    assert want.count() > 0 and want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0
