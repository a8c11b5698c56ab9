"""Live forms of three tracking operators. On bounded input each gives the rows of its batch form.

``event_time`` is a TIMESTAMP (watermarks do not take the zone-less type); ``ts`` is the same time in seconds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayfield.functions.numeric import ratio
from wayfield.operators.rooms import Room, assign_room
from wayfield.operators.tracking import KEYS, MISSING, SHORT, VALID, frame_state
from wayfield.session import shared_folder


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_timebins(frames: DataFrame, width: str = "1 day", delay: str = "10 minutes", low_p: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Quality per tumbling time bin; a bin is final once the watermark passes its end."""
    states = frames.withColumn("state", frame_state()).withWatermark("event_time", delay)
    out = states.groupBy(F.window("event_time", width), *keys).agg(
        F.count(F.lit(1)).alias("n_frames"), F.avg("v_provided").alias("mean_speed_provided"), F.avg("p").alias("mean_p"),
        F.count_if(F.col("state") == MISSING).alias("count_missing"), F.count_if(F.col("state") == VALID).alias("count_valid"),
        F.count_if(F.col("state") == SHORT).alias("count_interpolated"), ratio(F.count_if(F.col("p") < low_p), F.count("p")).alias("frac_low_p"),
    )
    return out.select(*keys, F.col("window.start").alias("bin_start"), F.col("window.end").alias("bin_end"), *[c for c in out.columns if c not in ("window", *keys)])


def stream_room_label(frames: DataFrame, rooms: Sequence[Room], time: str = "ts") -> DataFrame:
    """Room of each frame. The rooms are literals, so labelling keeps no state and joins nothing."""
    return assign_room(frames, rooms, time)


_RUN = "start_idx bigint, end_idx bigint, length_frames bigint, t_start double, t_end double, duration double, distance double, p_mean_run double, is_long_time boolean, is_long_distance boolean"
# one stream's frames so far and its open run; ``at`` is the event time of that run's last frame
_OPEN = "frames bigint, is_open boolean, start_idx bigint, length bigint, t_start double, t_end double, at double, x0 double, y0 double, x1 double, y1 double, p_sum double, p_n bigint"
_NOTHING = (0, False, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
_FRAME = "ts double, at double, tie bigint, x double, y double, p double, gap boolean"
_FRAMES = np.dtype([("stream", "i8"), ("ts", "f8"), ("at", "f8"), ("tie", "i8"), ("x", "f8"), ("y", "f8"), ("p", "f8"), ("gap", "?")])
_FRAME_COLUMNS = _FRAMES.names[1:]
GROUPS = 256
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class GapRuns(StatefulProcessor):
    """Runs of a group of streams: a map state for their open runs, a list state for frames before the watermark, one timer.

    A call costs about as much for a thousand short streams as for one: a group's frames are one record array, states
    are read and written only for streams of which the watermark has passed a frame, and the runs leave as one table.
    """

    def __init__(self, keys: Sequence[str], long_time: float, long_distance: float, hold: float, idle_seconds: float) -> None:
        self.keys, self.columns = list(keys), [*keys, *[c.split()[0] for c in _RUN.split(", ")]]
        self.long_time, self.long_distance, self.hold, self.idle_seconds = long_time, long_distance, hold, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        names = ", ".join(f"{k} string" for k in self.keys)
        self.open = handle.getMapState("open", names, _OPEN)
        self.held = handle.getListState("held", f"{names}, {_FRAME}")
        # the timer's time or -1, and a time before which no open run has waited long enough
        self.wake = handle.getValueState("wake", "timer bigint, idle double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        streams: dict[tuple, int] = {}
        parts = [self._coded(pdf, streams) for pdf in rows if len(pdf)]
        if parts:
            yield from self._advance(streams, np.concatenate(parts), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance({}, np.empty(0, _FRAMES), timerValues)

    def close(self) -> None:
        pass

    def _coded(self, pdf: pd.DataFrame, streams: dict[tuple, int]) -> np.ndarray:
        """Frames as records, their streams as numbers; new streams are added to ``streams``."""
        own = pdf.groupby(self.keys, sort=False, dropna=False).ngroup().to_numpy()
        firsts = pdf[self.keys].iloc[np.unique(own, return_index=True)[1]]
        names = [tuple(v if isinstance(v, str) else None for v in row) for row in firsts.itertuples(index=False, name=None)]
        out = np.empty(len(pdf), _FRAMES)
        out["stream"] = np.array([streams.setdefault(name, len(streams)) for name in names])[own]
        for c in _FRAME_COLUMNS:
            out[c] = pdf[c].to_numpy(dtype=_FRAMES[c])
        return out

    def _advance(self, streams: dict[tuple, int], new: np.ndarray, times) -> Iterator[pd.DataFrame]:
        """Take the frames that the watermark has passed in time order, stream by stream; write what changed."""
        watermark = times.getCurrentWatermarkInMs()
        now = watermark / 1000
        timer, idle = self.wake.get() or (-1, np.inf)
        k = len(self.keys)
        # whatever is held has a timer
        held = [tuple(r) for r in self.held.get()] if timer >= 0 else []
        old = np.array([(streams.setdefault(r[:k], len(streams)), *r[k:]) for r in held], _FRAMES)
        frames = np.concatenate([old, new])
        frames = frames[np.lexsort((frames["tie"], frames["ts"], frames["stream"]))]
        begins = np.flatnonzero(np.diff(frames["stream"], prepend=-1))
        sizes = np.diff(begins, append=len(frames))
        # frames this far behind their stream's last one can get no earlier neighbour: Spark drops what comes later than that
        mark = np.maximum(now, frames["at"][begins + sizes - 1] - self.hold)
        ready = frames["at"] <= np.repeat(mark, sizes)
        n_ready = np.add.reduceat(ready, begins, dtype=np.int64) if len(begins) else sizes
        names, known = list(streams), self.open.exists()
        out: list[tuple] = []
        due = np.inf if idle <= now else idle
        taken = set()
        # a stream's ready frames are its first ones; without any, the rest of the stream waits as it is
        for begin, size, n in zip(begins.tolist(), sizes.tolist(), n_ready.tolist(), strict=True):
            name = names[frames["stream"][begin]]
            taken.add(name)
            if n:
                state = (self.open.getValue(name) if known else None) or _NOTHING
                state = self._take(name, tuple(state), frames[begin : begin + n], out)
                if n == size:
                    state, due = self._waited(name, state, now, due, out)
                self.open.updateValue(name, state)
        if known and idle <= now:
            # some stream without frames may have waited long enough
            for name, state in [(tuple(a), tuple(b)) for a, b in self.open.iterator()]:
                if name not in taken:
                    after, due = self._waited(name, state, now, due, out)
                    if after != state:
                        self.open.updateValue(name, after)
        keep = frames[~ready]
        if ready.any():
            if len(keep):
                self.held.put(self._as_rows(keep, names))
            elif held:
                self.held.clear()
        elif len(new):
            self.held.appendList(self._as_rows(new, names))
        # wake up when the watermark reaches the first held frame, or when an open run has waited long enough
        first = min(float(keep["at"].min()) if len(keep) else np.inf, due)
        wake = max(int(first * 1000) + 1, watermark + 1) if first < np.inf else -1
        if wake != timer:
            if timer > watermark:
                self.handle.deleteTimer(timer)
            if wake >= 0:
                self.handle.registerTimer(wake)
        if (wake, due) != (timer, idle):
            self.wake.update((wake, float(due)))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def _take(self, name: tuple, state: tuple, done: np.ndarray, out: list[tuple]) -> tuple:
        """One stream's state after its next frames; runs that they close are added to ``out``."""
        n, is_open, start, length, t0, t1, at, x0, y0, x1, y1, p_sum, p_n = state
        gap, p = done["gap"], done["p"]
        before = np.append(is_open, gap[:-1])
        begins, ends = np.flatnonzero(gap & ~before).tolist(), np.flatnonzero(~gap & before).tolist()
        if is_open:
            # the open run goes on, or is closed by the first frame
            begins = [0, *begins]
        sums = np.append(0.0, np.cumsum(np.nan_to_num(p)))
        known = np.append(0, np.cumsum(~np.isnan(p)))
        for i, begin in enumerate(begins):
            end = ends[i] if i < len(ends) else len(gap)
            if not is_open:
                _, t0, _, _, x0, y0, _, _ = done[begin].item()
                is_open, start, length, p_sum, p_n = True, n + begin, 0, 0.0, 0
            if end > begin:
                _, t1, at, _, x1, y1, _, _ = done[end - 1].item()
                length += end - begin
                p_sum, p_n = p_sum + float(sums[end] - sums[begin]), p_n + int(known[end] - known[begin])
            if i < len(ends):
                is_open = False
                out.append(self._run(name, start, length, t0, t1, x0, y0, x1, y1, p_sum, p_n))
        return n + len(gap), is_open, start, length, t0, t1, at, x0, y0, x1, y1, p_sum, p_n

    def _waited(self, name: tuple, state: tuple, now: float, due: float, out: list[tuple]) -> tuple[tuple, float]:
        """The state of a stream that holds no frames, its open run closed after ``idle_seconds``; else when that will be."""
        n, is_open, start, length, t0, t1, at, *rest = state
        if not is_open:
            return state, due
        if at + self.idle_seconds > now:
            return state, min(due, at + self.idle_seconds)
        out.append(self._run(name, start, length, t0, t1, *rest))
        return (n, False, *state[2:]), due

    def _run(self, name, start, length, t0, t1, x0, y0, x1, y1, p_sum, p_n) -> tuple:
        duration, distance = t1 - t0, ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
        mean_p = p_sum / p_n if p_n else None
        return (*name, start, start + length - 1, length, t0, t1, duration, distance, mean_p, duration >= self.long_time, distance >= self.long_distance)

    def _as_rows(self, frames: np.ndarray, names: list[tuple]) -> list[tuple]:
        """Frames as state rows, missing numbers as None."""
        return [(*names[r[0]], *(None if v != v else v for v in r[1:])) for r in frames.tolist()]


def stream_gap_runs(
    frames: DataFrame, long_time: float, long_distance: float, delay: str = "10 minutes", idle_seconds: float = 86400.0, keys: Sequence[str] = KEYS, tie: str = "frame_id",
    groups: int = GROUPS,
) -> DataFrame:
    """Interpolated runs of each stream, emitted when a later frame closes them.

    Frames are held until the watermark passes them and then taken in time order, so late frames up to ``delay`` find
    their place and a run may span any number of batches. A stream without frames for ``idle_seconds`` of event time
    after its last one closes its open run. State per stream is one open run and the frames within ``delay`` of its last
    one, also on a first batch, when there is no watermark yet; a batch that readies no frame only appends to it.

    Streams are dealt by hash to ``groups`` groups, each one call of the processor in a batch: calling it per stream costs
    far more than the work on a short one. More groups serve more cores; the number stays as it is for a checkpoint's
    life. A step holds the frames that one batch has of a group (57 bytes each), which ``files_per_batch`` bounds. Frames
    without a time have no place and are left out. The session is set to the RocksDB state store, which list states and
    timers need.
    """
    keys = list(keys)
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    gap = (F.col("interp") > 0) & F.col("x").isNotNull() & F.col("y").isNotNull()
    # keys travel as text, which holds a missing one beside any number; a missing tie comes last
    source = frames.withWatermark("event_time", delay).filter(F.col("event_time").isNotNull() & F.col("ts").isNotNull()).select(
        F.pmod(F.hash(*keys), F.lit(groups)).alias("streams"), "event_time", *[F.col(k).cast("string").alias(k) for k in keys],
        "ts", (F.unix_micros("event_time") / 1e6).alias("at"), F.coalesce(F.col(tie).cast("bigint"), F.lit(2**63 - 1)).alias("tie"),
        "x", "y", "p", F.coalesce(gap, F.lit(False)).alias("gap"),
    )
    types = dict(frames.select(*keys).dtypes)
    schema = ", ".join(f"{k} string" for k in keys) + ", " + _RUN
    hold = pd.Timedelta(delay.replace("interval ", "")).total_seconds()
    runs = source.groupBy("streams").transformWithStateInPandas(GapRuns(keys, long_time, long_distance, hold, idle_seconds), schema, "append", "EventTime")
    return runs.withColumns({k: F.col(k).cast(types[k]) for k in keys})


def run_available(df: DataFrame, timeout: float = 3600) -> DataFrame:
    """Process everything the source holds now into a parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    )
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("the stream did not finish in time")
    return spark.read.schema(df.schema).parquet(f"{folder}/out")
