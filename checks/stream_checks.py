"""Live operators, replayed over the whole event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tracking_checks  # noqa: F401 - defines the frame steps used below
from checks.registry import check
from wayfield.sources import views as V
from wayfield.streaming import live as L


def live_frames(spark, sf):
    schema = V.table(spark, sf, "events").schema
    events = L.read_stream(spark, f"{sf}/events*.parquet", schema)
    return V.tracking_frames(events, extra=["cast(ts as timestamp) event_time"])


@check(
    "stream_timebins",
    """select session, stream, bin, count(*) n_frames, avg(v_provided) mean_speed_provided, avg(p) mean_p, count(*) filter (where x is null or y is null) count_missing,
      count(*) filter (where x is not null and y is not null and interp=0) count_valid, count(*) filter (where x is not null and y is not null and interp>0) count_interpolated,
      count(*) filter (where p<0.5)/count(p) frac_low_p from (select *, floor(ts/86400)::bigint bin from tracking)
      where (bin+1)*86400<=(select max(ts)-600 from tracking) group by session, stream, bin""",
    "mean_speed_provided mean_p frac_low_p",
)
def stream_timebins(spark, sf):
    out = L.run_available(L.stream_timebins(live_frames(spark, sf)))
    start = (F.unix_micros("bin_start") - V.EPOCH_MICROS) / 1e6
    return out.withColumn("bin", F.floor(start / 86400)).drop("bin_start", "bin_end")


@check(
    "stream_room_label",
    "select frame_id, ts, r.room from tracking t left join rooms r on t.ts>=r.t0 and t.ts<r.t1", "ts",
)
def stream_room_label(spark, sf):
    out = L.stream_room_label(live_frames(spark, sf), V.ROOMS).select("frame_id", "ts", "room")
    return L.run_available(out)


@check(
    "stream_gap_runs",
    """with f as (select * from tframes where ts<=(select max(ts)-600 from tracking)),
      r as (select session, stream, run, min(idx) start_idx, max(idx) end_idx, count(*) length_frames, min(ts) t_start, max(ts) t_end, avg(p) p_mean_run,
        sqrt((arg_max(x, idx)-arg_min(x, idx))^2+(arg_max(y, idx)-arg_min(y, idx))^2) distance from f where gap group by session, stream, run)
      select r.session, r.stream, start_idx, end_idx, length_frames, t_start, t_end, t_end-t_start duration, distance, p_mean_run, t_end-t_start>=20000 is_long_time, distance>=50 is_long_distance
      from r where exists (select 1 from f where f.session=r.session and f.stream=r.stream and f.idx=r.end_idx+1)
        or (t_end+86400<=(select max(ts)-600 from tracking) and not exists (select 1 from tframes f where f.session=r.session and f.stream=r.stream and f.idx=r.end_idx+1))""",
    "t_start t_end duration distance p_mean_run",
)
def stream_gap_runs(spark, sf):
    """Runs closed by the end of the replay; the last ones stay open until more frames come."""
    return L.run_available(L.stream_gap_runs(live_frames(spark, sf), 20000.0, 50.0))
