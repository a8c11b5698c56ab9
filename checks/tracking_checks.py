"""Tracking quality: speeds, gaps, stream summaries and frame rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, define
from wayfield.operators import tracking as K
from wayfield.session import stored
from wayfield.sources import views as V

# thresholds for the test events: frames of one session lie hours apart
LONG_TIME, LONG_DISTANCE, BIN, WINDOW, Z = 20000.0, 50.0, 86400.0, 5, 3.0

define(
    "tframes",
    """select *, case when ts>pt then sqrt((x-px)^2+(y-py)^2)/(ts-pt) end speed, ts-pt dt,
      sum((not gap)::int) over (partition by session, stream order by ts, frame_id) run,
      row_number() over (partition by session, stream order by ts, frame_id)-1 idx from (
      select *, (x is not null and y is not null and interp>0) gap, lag(ts) over w pt, lag(x) over w px, lag(y) over w py,
        case when x is null or y is null then 0 when interp>0 then 2 else 1 end state
      from tracking window w as (partition by session, stream order by ts, frame_id))""",
)
define(
    "truns",
    """select *, duration>=20000 is_long_time, distance>=50 is_long_distance, duration>=20000 or distance>=50 is_long,
      case when duration>0 then distance/duration end gap_avg_speed,
      (select max(speed) from tframes f where f.session=r.session and f.stream=r.stream and f.idx between start_idx-1 and end_idx+1) gap_peak_speed
      from (select session, stream, run, min(idx) start_idx, max(idx) end_idx, count(*) length_frames, min(ts) t_start, max(ts) t_end,
        avg(p) p_mean_run, max(ts)-min(ts) duration,
        sqrt((arg_max(x, idx)-arg_min(x, idx))^2+(arg_max(y, idx)-arg_min(y, idx))^2) distance
        from tframes where gap group by session, stream, run) r""",
)
define(
    "tstates",
    """select f.* replace (case when gap then case when is_long_distance then 4 when is_long_time then 3 else 2 end else state end as state)
      from tframes f left join truns r on r.session=f.session and r.stream=f.stream and r.run=f.run""",
)
define(
    "twindow",
    """select session, stream, case when median(dt)>0 then greatest(1, round_even(100000/median(dt), 0)::int) else 1 end w from tframes group by all""",
)


def speeds_sql(source: str, width: str) -> str:
    """Runs beside the median and MAD of the speeds of ``width`` frames on each side."""
    return f"""with n as (select r.session, r.stream, r.run, f.speed from {source} r join tframes f on f.session=r.session and f.stream=r.stream
        and (f.idx between r.start_idx-{width} and r.start_idx-1 or f.idx between r.end_idx+1 and r.end_idx+{width}) where speed is not null),
      m as (select session, stream, run, median(speed) med from n group by all),
      d as (select m.session, m.stream, m.run, med v_local_median, nullif(median(abs(speed-med)), 0) mad from n join m
        on n.session=m.session and n.stream=m.stream and n.run=m.run group by all)
      select r.*, v_local_median, mad v_local_mad, (gap_avg_speed-v_local_median)/mad z_avg_speed, (gap_peak_speed-v_local_median)/mad z_peak_speed,
        coalesce(greatest((gap_avg_speed-v_local_median)/mad, (gap_peak_speed-v_local_median)/mad)>=3, false) is_too_fast
      from truns r left join d on d.session=r.session and d.stream=r.stream and d.run=r.run"""


define("tspeeds", speeds_sql("truns", "5"))
define("trun_windows", "select truns.*, w from truns join twindow on twindow.session=truns.session and twindow.stream=truns.stream")
define("tspeeds_timed", speeds_sql("trun_windows", "w"))
_RUN = "session, stream, start_idx, end_idx, length_frames, t_start, t_end, duration, distance, p_mean_run, gap_avg_speed, gap_peak_speed"
_RUN_D = "t_start t_end duration distance p_mean_run gap_avg_speed gap_peak_speed"


def frames(spark, sf):
    return K.track_frames(V.tracking(spark, sf))


def runs(spark, sf):
    return K.gap_runs(frames(spark, sf), LONG_TIME, LONG_DISTANCE)


def fast_runs(spark, sf):
    # frames and runs have several readers each
    f = stored(frames(spark, sf))
    return K.gap_speed_outliers(f, stored(K.gap_runs(f, LONG_TIME, LONG_DISTANCE)), WINDOW, Z)


def states(spark, sf):
    f = frames(spark, sf)
    return K.classify_frames(f, K.gap_runs(f, LONG_TIME, LONG_DISTANCE))


@check("frame_speed", "select frame_id, session, stream, ts, speed from tframes", "ts speed")
def frame_speed(spark, sf):
    return K.frame_speed(V.tracking(spark, sf)).select("frame_id", "session", "stream", "ts", "speed")


@check("frame_state", "select frame_id, state from tframes")
def frame_state(spark, sf):
    return V.tracking(spark, sf).select("frame_id", K.frame_state().alias("state"))


@check("gap_runs", f"select {_RUN} from truns", _RUN_D)
def gap_runs(spark, sf):
    return runs(spark, sf).select(*_RUN.split(", "))


@check("gap_classify", "select frame_id, state, gap from tstates")
def gap_classify(spark, sf):
    return states(spark, sf).select("frame_id", "state", "gap")


@check("gap_flags", "select session, stream, start_idx, is_long_time, is_long_distance, is_long from truns")
def gap_flags(spark, sf):
    return runs(spark, sf).select("session", "stream", "start_idx", "is_long_time", "is_long_distance", "is_long")


@check(
    "gap_speed_outlier",
    "select session, stream, start_idx, gap_avg_speed, gap_peak_speed, v_local_median, v_local_mad, z_avg_speed, z_peak_speed, is_too_fast from tspeeds",
    "gap_avg_speed gap_peak_speed v_local_median v_local_mad z_avg_speed z_peak_speed",
)
def gap_speed_outlier(spark, sf):
    return fast_runs(spark, sf).select(
        "session", "stream", "start_idx", "gap_avg_speed", "gap_peak_speed", "v_local_median", "v_local_mad", "z_avg_speed", "z_peak_speed", "is_too_fast"
    )


@check(
    "local_window",
    """select session, stream, case when median(dt)>0 then greatest(1, round_even(100000/median(dt), 0)::int) else 1 end "window"
      from tframes group by all""",
)
def local_window(spark, sf):
    return K.local_window(frames(spark, sf), 100000.0)


@check("run_mean_p", "select session, stream, start_idx, p_mean_run from truns", "p_mean_run")
def run_mean_p(spark, sf):
    return runs(spark, sf).select("session", "stream", "start_idx", "p_mean_run")


def _spread(col: str, name: str) -> str:
    return f"quantile_cont({col}, 0.5) {name}_median, quantile_cont({col}, 0.05) {name}_p05, quantile_cont({col}, 0.95) {name}_p95"


define(
    "tsummary",
    f"""with f as (select session, stream, count(*) frames_total,
        {', '.join(f"count(*) filter (where state={i}) frames_{n}" for i, n in enumerate(("missing", "valid", "short", "long_time", "long_distance")))},
        avg(p) filter (where state=1) mean_p_valid, avg(p) filter (where gap) mean_p_interp,
        case when count(p)>0 then count(*) filter (where p<0.5)/count(*) end frac_low_p, avg(speed) speed_mean, max(speed) speed_max,
        avg(v_provided) v_provided_mean, max(v_provided) v_provided_max, {_spread('speed', 'speed')}, {_spread('v_provided', 'v_provided')},
        case when count(*) filter (where speed is not null and v_provided is not null)>=3 then corr(speed, v_provided) end speed_r,
        case when count(*) filter (where speed is not null and v_provided is not null)>=3 then avg(v_provided-speed) end speed_bias,
        case when count(*) filter (where speed is not null and v_provided is not null)>=3 then sqrt(avg((v_provided-speed)^2)) end speed_rmse
        from tstates group by session, stream),
      r as (select session, stream, count(*) num_gaps, {', '.join(f"quantile_cont({c}, 0.5) {n}_median, quantile_cont({c}, 0.95) {n}_p95, max({c})::double {n}_max" for n, c in (('length', 'length_frames'), ('duration', 'duration'), ('distance', 'distance')))},
        100.0*avg(is_long_time::int) pt, 100.0*avg(is_long_distance::int) pd, 100.0*avg(is_long::int) pl, 100.0*avg(is_too_fast::int) pf
        from tspeeds group by session, stream)
      select f.*, {', '.join(f"100.0*frames_{n}/frames_total percent_{n}" for n in ("missing", "valid", "short", "long_time", "long_distance"))},
        100.0*(frames_long_time+frames_long_distance)/frames_total percent_long, coalesce(num_gaps, 0) num_gaps,
        length_median, length_p95, length_max, duration_median, duration_p95, duration_max, distance_median, distance_p95, distance_max,
        coalesce(pt, 0) percent_runs_long_time, coalesce(pd, 0) percent_runs_long_distance, coalesce(pl, 0) percent_runs_long, coalesce(pf, 0) percent_runs_too_fast
      from f left join r on r.session=f.session and r.stream=f.stream""",
)
_SUMMARY_D = (
    "mean_p_valid mean_p_interp frac_low_p speed_mean speed_max v_provided_mean v_provided_max speed_r speed_bias speed_rmse speed_median speed_p05 speed_p95 "
    "v_provided_median v_provided_p05 v_provided_p95 percent_missing percent_valid percent_short percent_long_time percent_long_distance percent_long "
    "length_median length_p95 length_max duration_median duration_p95 duration_max distance_median distance_p95 distance_max "
    "percent_runs_long_time percent_runs_long_distance percent_runs_long percent_runs_too_fast"
)


_SETTINGS = ("bin_width_s", "long_time_threshold_s", "long_dist_threshold_cm", "speed_max_cm_s", "z_speed_thresh", "v_local_window_s", "lowP_thresh")


def settings_sql(speed_max: str, window_seconds: str) -> str:
    """The report columns that name the source and the settings."""
    values = ("86400", "20000", "50", speed_max, "3", window_seconds, "0.5")
    label = "split_part(stream, '_', 1) source, stream='PC_HeadPos' is_primary"
    return ", ".join([label, *[f"{v}::double {n}" for n, v in zip(_SETTINGS, values)]])


def summary(spark, sf):
    return K.report_tables(V.tracking(spark, sf), LONG_TIME, LONG_DISTANCE, BIN, WINDOW, Z)["summary"]


@check("tracking_summary", f"select *, {settings_sql('null', 'null')} from tsummary", _SUMMARY_D, 8)
def tracking_summary(spark, sf):
    return summary(spark, sf).withColumn("length_max", F.col("length_max").cast("double"))


define(
    "ttimebins",
    """select *, count_long_time+count_long_distance count_long, 100.0*count_short/n_frames pct_short, 100.0*count_long_time/n_frames pct_long_time,
      100.0*count_long_distance/n_frames pct_long_distance, 100.0*(count_long_time+count_long_distance)/n_frames pct_long,
      bin*86400.0::double bin_start, (bin+1)*86400.0::double bin_end from (
      select session, stream, floor(ts/86400)::bigint bin, count(*) n_frames, avg(speed) mean_speed, avg(v_provided) mean_speed_provided, avg(p) mean_p,
        count(*) filter (where state=2) count_short, count(*) filter (where state=3) count_long_time, count(*) filter (where state=4) count_long_distance,
        count(*) filter (where p<0.5)/count(p) frac_low_p from tstates group by all)""",
)


@check(
    "tracking_timebins", "select * from ttimebins",
    "mean_speed mean_speed_provided mean_p frac_low_p pct_short pct_long_time pct_long_distance pct_long bin_start bin_end",
)
def tracking_timebins(spark, sf):
    return K.tracking_timebins(states(spark, sf), BIN)


@check("timebin_state_join", "select session, stream, bin, n_frames, count_short, count_long_time, count_long_distance from ttimebins")
def timebin_state_join(spark, sf):
    return K.timebin_state_join(states(spark, sf), BIN)


@check(
    "report_tables",
    """select 'summary' "table", count(*) n, sum(frames_total)::bigint total from tsummary union all
      select 'gap_runs', count(*), sum(length_frames)::bigint from truns union all
      select 'per_timebin', count(*), sum(n_frames)::bigint from ttimebins union all
      select 'fps_stats', count(distinct session), count(*) from tframes""",
)
def report_tables(spark, sf):
    t = K.report_tables(V.tracking(spark, sf), LONG_TIME, LONG_DISTANCE, BIN, WINDOW, Z)
    size = {"summary": "frames_total", "gap_runs": "length_frames", "per_timebin": "n_frames", "fps_stats": "frames_total"}
    parts = [t[k].agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("total")).select(F.lit(k).alias("table"), "n", "total") for k, c in size.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_REPORT_RUN = f"{_RUN}, is_long_time, is_long_distance, is_long, v_local_median, z_avg_speed, z_peak_speed"


@check(
    "report_gap_runs",
    f"""select *, is_too_fast_absolute or is_too_fast_relative is_too_fast from (
      select {_REPORT_RUN}, coalesce(greatest(gap_avg_speed, gap_peak_speed)>=0.002, false) is_too_fast_absolute, is_too_fast is_too_fast_relative,
      {settings_sql('0.002', '100000')} from tspeeds_timed)""",
    _RUN_D + " v_local_median z_avg_speed z_peak_speed",
)
def report_gap_runs(spark, sf):
    """Every row of the gap report, with windows of a given time and a limit on the speed."""
    t = K.report_tables(V.tracking(spark, sf), LONG_TIME, LONG_DISTANCE, BIN, None, Z, speed_max=0.002, window_seconds=100000.0)
    return t["gap_runs"].drop("run", "v_local_mad")


@check(
    "report_timebins", "select *, split_part(stream, '_', 1) source, stream='PC_HeadPos' is_primary from ttimebins",
    "mean_speed mean_speed_provided mean_p frac_low_p pct_short pct_long_time pct_long_distance pct_long bin_start bin_end",
)
def report_timebins(spark, sf):
    return K.report_tables(V.tracking(spark, sf), LONG_TIME, LONG_DISTANCE, BIN, WINDOW, Z)["per_timebin"]


@check(
    "stream_composition",
    f"""select stream, {', '.join(f"100.0*sum(frames_{n})/sum(frames_total) percent_{n}" for n in ("missing", "valid", "short", "long_time", "long_distance"))}
      from tsummary group by stream""",
    "percent_missing percent_valid percent_short percent_long_time percent_long_distance",
)
def stream_composition(spark, sf):
    counted = states(spark, sf).groupBy("session", "stream").agg(*K._state_counts())
    return K.stream_composition(counted)


@check(
    "gap_flag_counts",
    """select s.stream, count(*) filter (where is_long_time) n_long_time, count(*) filter (where is_long_distance) n_long_distance,
      count(*) filter (where is_long_time and is_long_distance) n_both
      from (select distinct stream from tracking union all select 'XX_HeadPos') s left join truns r on r.stream=s.stream group by s.stream""",
)
def gap_flag_counts(spark, sf):
    t = V.tracking(spark, sf)
    streams = t.select("stream").union(t.select(F.lit("XX_HeadPos")))
    return K.gap_flag_counts(runs(spark, sf), streams)


define(
    "tproject",
    """select session, count(*) n_gaps, max(duration) duration_max, max(distance) distance_max, median(duration) duration_median,
      quantile_cont(duration, 0.95) duration_p95, median(distance) distance_median, quantile_cont(distance, 0.95) distance_p95 from truns group by session""",
)
_PROJECT_D = "duration_max distance_max duration_median duration_p95 distance_median distance_p95"


@check("project_gap_stats", "select * from tproject", _PROJECT_D)
def project_gap_stats(spark, sf):
    return K.project_gap_stats(runs(spark, sf))


def small_summary(spark, sf):
    s = states(spark, sf).groupBy("session", "stream").agg(F.count(F.lit(1)).alias("frames_total"), F.count_if(F.col("state") >= K.LONG_TIME).alias("_l"))
    return s.select("session", "stream", "frames_total", (F.col("_l") * 100.0 / F.col("frames_total")).alias("percent_long"))


@check(
    "summary_gap_join",
    """select s.session, stream, frames_total, percent_long, n_gaps::double n_gaps, p.duration_max, p.distance_max, p.duration_median, p.duration_p95, p.distance_median, p.distance_p95
      from tsummary s left join tproject p on p.session=s.session""",
    "percent_long n_gaps " + _PROJECT_D,
)
def summary_gap_join(spark, sf):
    return K.summary_gap_join(small_summary(spark, sf), runs(spark, sf))


@check(
    "top_n_per_stream",
    """select * from (select session, stream, frames_total, percent_long, row_number() over (partition by stream order by percent_long desc, session)::int "rank"
      from tsummary) where "rank"<=5""",
    "percent_long",
)
def top_n_per_stream(spark, sf):
    return K.top_n_per_stream(small_summary(spark, sf), 5)


@check(
    "worst_projects",
    """select s.session, stream, percent_long, n_gaps, p.duration_median from tsummary s left join tproject p on p.session=s.session
      where stream='PC_HeadPos' order by percent_long desc, s.session limit 20""",
    "percent_long duration_median",
)
def worst_projects(spark, sf):
    primary = small_summary(spark, sf).filter("stream = 'PC_HeadPos'")
    out = K.worst_projects(primary, K.project_gap_stats(runs(spark, sf)), 20)
    return out.select("session", "stream", "percent_long", "n_gaps", "duration_median")


@check("interp_share", "select stream, 100.0*count(*) filter (where interp<1)/count(*) share from tracking group by stream", "share")
def interp_share(spark, sf):
    return K.interp_share(V.tracking(spark, sf), ["stream"], limit=1)


@check("low_confidence_share", "select stream, 100.0*count(*) filter (where p<0.5)/count(*) share from tracking group by stream", "share")
def low_confidence_share(spark, sf):
    return K.interp_share(V.tracking(spark, sf).drop("interp"), ["stream"])


define("tdeltas", "select session, stream, ts, dt, case when dt>0 then 1/dt end fps from tframes")
_T = (("median", 0.5), ("p05", 0.05), ("p95", 0.95))


@check(
    "fps_stats",
    f"""select * from (select session, stream, max(ts)-min(ts) duration, count(*) frames_total, avg(dt) dt_mean, min(dt) dt_min, max(dt) dt_max,
        avg(fps) fps_mean, min(fps) fps_min, max(fps) fps_max, {_spread('dt', 'dt')}, {_spread('fps', 'fps')} from tdeltas group by all)
      join (select session, stream, avg(n) count_mean, min(n)::double count_min, max(n)::double count_max, {_spread('n', 'count')}
        from (select session, stream, floor(ts/86400) s, count(*) n from tracking group by all) group by all) using (session, stream)""",
    "duration " + " ".join(f"{c}_{t}" for c in ("dt", "fps", "count") for t in ("mean", "min", "max", "median", "p05", "p95")), 8,
)
def fps_stats(spark, sf):
    return K.fps_stats(V.tracking(spark, sf), unit=86400.0)


define(
    "tclean",
    """select d.*, n<8 or dt between greatest(q1-1.5*(q3-q1), 1e-9) and q3+1.5*(q3-q1) keep from tdeltas d join (
      select session, stream, count(*) n, quantile_cont(dt, 0.25) q1, quantile_cont(dt, 0.75) q3 from tdeltas where dt>0 group by all) q
      on q.session=d.session and q.stream=d.stream where dt>0""",
)


@check(
    "fps_clean",
    f"""select session, stream, 100.0*count(*) filter (where not keep)/count(*) pct_dropped, avg(dt) filter (where keep) dt_mean,
      stddev_pop(dt) filter (where keep) dt_std, avg(fps) filter (where keep) fps_mean,
      {', '.join(f"quantile_cont({c}, {q}) filter (where keep) {c}_{t}" for c in ('dt', 'fps') for t, q in _T)} from tclean group by session, stream""",
    "pct_dropped dt_mean dt_std fps_mean dt_median dt_p05 dt_p95 fps_median fps_p05 fps_p95", 8,
)
def fps_clean(spark, sf):
    return K.fps_clean(V.tracking(spark, sf))


@check("sample_dt", "select session, stream, median(dt) dt from tdeltas group by all", "dt")
def sample_dt(spark, sf):
    return K.sample_dt(V.tracking(spark, sf))


@check(
    "rolling_fps",
    """with u as (select d.session, d.stream, floor((ts-t0)/21600)::bigint unit_no, avg(fps) v from tclean d join (
        select session, stream, min(ts) t0 from tracking group by all) s on s.session=d.session and s.stream=d.stream where keep group by all),
      l as (select session, stream, max(unit_no) last from u group by all),
      g as (select session, stream, last, unnest(range(last+1)) unit_no from l),
      f as (select g.session, g.stream, g.last, g.unit_no, u.v from g left join u on u.session=g.session and u.stream=g.stream and u.unit_no=g.unit_no)
      select session, stream, unit_no, fps from (select *, case when last+1>=6 then avg(v) over (partition by session, stream order by unit_no rows between 3 preceding and 2 following) else v end fps from f)
      where fps is not null""",
    "fps", 9,
)
def rolling_fps(spark, sf):
    return K.rolling_fps(V.tracking(spark, sf), 6, unit=21600.0)


@check(
    "resample_linear",
    """with p as (select *, lead(ts) over w nt, lead(x) over w nx, lead(y) over w ny from tracking where x is not null and y is not null
        window w as (partition by session, stream order by ts, frame_id)),
      t as (select *, unnest(range(ceil(ts*0.001)::bigint, case when nt-ts<=50000 and nt>ts then ceil(nt*0.001)::bigint when nt is null or nt>ts then floor(ts*0.001)::bigint+1 else 0 end)) tick from p)
      select session, stream, tick, tick/0.001 ts, x+coalesce((nx-x)*case when nt-ts<=50000 and nt>ts then (tick/0.001-ts)/(nt-ts) end, 0) x,
        y+coalesce((ny-y)*case when nt-ts<=50000 and nt>ts then (tick/0.001-ts)/(nt-ts) end, 0) y from t""",
    "ts x y", 5,
)
def resample_linear(spark, sf):
    return K.resample_linear(V.tracking(spark, sf), 0.001, 50000.0)


@check(
    "frame_at_time",
    """select k.session, k.tick, min_by(f.frame_id, f.ts) frame_id from (select distinct session, 86400.0::double*d tick from tracking, (select unnest(range(32)) d)) k
      left join tracking f on f.session=k.session and f.ts>=k.tick group by k.session, k.tick""",
    "tick frame_id",
)
def frame_at_time(spark, sf):
    t = V.tracking(spark, sf)
    ticks = t.select("session").distinct().withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(31))))
    ticks = ticks.select("session", (F.col("day") * F.lit(86400.0)).alias("tick"))
    return K.frame_at_time(ticks, t, ["session"])
