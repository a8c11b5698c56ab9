"""Folds, splits, sequence windows and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, define
from wayfield.operators import folds as S
from wayfield.operators import rooms as R
from wayfield.session import stored
from wayfield.sources import views as V

K = 4


def labelled(spark, sf):
    return R.assign_room(V.tracking(spark, sf), V.ROOMS).select("session", "frame_id", "ts", "x", "y", "room")


def folded(spark, sf):
    return S.assign_fold(labelled(spark, sf), K)


define(
    "folded",
    f"""select session, frame_id, ts, x, y, room, case when room is not null then case when room='B' then (base-1+1)%{K}+1 else base end end::int fold from (
      select *, least({K}, coalesce(floor((i-lo)*{K}.0::double/nullif(hi-lo, 0))+1, 1)) base from (
        select *, min(i) over (partition by session, room) lo, max(i) over (partition by session, room) hi from (
          select *, row_number() over (partition by session order by ts, frame_id)-1 i from labelled)))""",
)


@check("assign_fold", "select frame_id, ts, room, coalesce(fold, 0)::int fold from folded", "ts")
def assign_fold(spark, sf):
    # 0 stands for frames of no room
    return folded(spark, sf).select("frame_id", "ts", "room", F.coalesce("fold", F.lit(0)).alias("fold"))


@check(
    "assign_fold_multi_offset",
    """with w as (select row_key, offset_no, actual_room room, min(x) x from pred_long group by all),
      i as (select *, row_number() over (partition by offset_no order by x, row_key)-1 i from w),
      b as (select *, min(i) over (partition by offset_no, room) lo, max(i) over (partition by offset_no, room) hi from i)
      select row_key, offset_no, room, case when room='B' then (least(5, floor((i-lo)*5.0::double/(hi-lo))+1)-1+1)%5+1 else least(5, floor((i-lo)*5.0::double/(hi-lo))+1) end::int fold from b""",
)
def assign_fold_multi_offset(spark, sf):
    # read several times: for the cuts, the numbers and the sums at the cuts
    rows = stored(V.pred_long(spark, sf, by=["row_key"]).select("row_key", "offset_no", "x", F.col("actual_room").alias("room")).distinct())
    return S.assign_fold(rows, 5, ["offset_no"], "x", ["row_key"]).drop("x")


@check(
    "cv_splits",
    f"""with n as (select *, row_number() over w-1 i, count(*) over (partition by session, room, fold) n from folded where room in ('A','B','a')
        window w as (partition by session, room, fold order by ts, frame_id)),
      s as (select *, unnest(range(1, {K}+1))::int split_fold from n)
      select frame_id, split_fold, case when room in ('A','a') and fold=split_fold then 'test' when i>=n-greatest(1, floor(n/{K - 1})) then 'val' else 'train' end "set"
      from s where (room in ('A','a') and fold=split_fold) or (room in ('A','B') and fold<>split_fold)""",
)
def cv_splits(spark, sf):
    return S.cv_splits(folded(spark, sf), K, ["A", "B"], ["A", "a"]).select("frame_id", "split_fold", "set")


define(
    "seq_rows",
    """select *, row_number() over (partition by session, fold order by ts, frame_id)-1 i, lag(ts) over (partition by session, fold order by ts, frame_id) b
      from folded where fold is not null""",
)


@check(
    "sequence_windows",
    """select a.session, a.fold, a.frame_id, a.room, a.x, a.y, sum(b.x) sum_x, min(b.y) min_y, arg_min(b.x, b.i) first_x, arg_max(b.y, b.i) last_y
      from seq_rows a join seq_rows b on a.session=b.session and a.fold=b.fold and b.i between a.i-5 and a.i-1
      where a.i>=5 and a.x is not null and a.y is not null
      group by all having count(b.x)=5 and count(b.y)=5""",
    "x y sum_x min_y first_x last_y",
)
def sequence_windows(spark, sf):
    out = S.sequence_windows(folded(spark, sf).filter("fold is not null"), 5, ["x", "y"], ["x", "y"])
    xs = F.transform("window", lambda s: s["x"])
    ys = F.transform("window", lambda s: s["y"])
    return out.select(
        "session", "fold", "frame_id", "room", "x", "y", F.aggregate(xs, F.lit(0.0), lambda a, v: a + v).alias("sum_x"),
        F.array_min(ys).alias("min_y"), F.get(xs, F.lit(0)).alias("first_x"), F.get(ys, F.lit(4)).alias("last_y"),
    )


@check(
    "sequence_windows_unbroken",
    """select a.session, a.fold, a.frame_id, avg(b.x) mean_x from seq_rows a
      join seq_rows b on a.session=b.session and a.fold=b.fold and b.i between a.i-3 and a.i-1
      join (select session, fold, i, max(ts-b) over (partition by session, fold order by i rows between 2 preceding and current row) step from seq_rows) g
        on g.session=a.session and g.fold=a.fold and g.i=a.i
      where a.i>=3 and step<=90000 and a.x is not null group by all having count(b.x)=3""",
    "mean_x",
)
def sequence_windows_unbroken(spark, sf):
    out = S.sequence_windows(folded(spark, sf).filter("fold is not null"), 3, ["x"], ["x"], max_gap=90000.0)
    return out.select("session", "fold", "frame_id", (F.aggregate("window", F.lit(0.0), lambda a, s: a + s["x"]) / 3).alias("mean_x"))


define("blocked", "select session, frame_id, ntile(5) over (partition by session order by ts, frame_id)-1 block from tracking")


@check(
    "expanding_splits",
    """select frame_id, b.block::int block, f::int fold_no, s::int sub_fold, case when b.block=s then 'val' when b.block=f+2 then 'test' else 'train' end "set"
      from blocked b, unnest(range(3)) t(f), unnest(range(4)) u(s) where s<=f+1 and b.block<=f+2""",
)
def expanding_splits(spark, sf):
    t = V.tracking(spark, sf).select("session", "frame_id", "ts")
    return S.expanding_splits(t, 5).select("frame_id", "block", "fold_no", "sub_fold", "set")


@check(
    "expanding_splits_train_test",
    """select frame_id, b.block::int block, f::int fold_no, case when b.block=f+1 then 'test' else 'train' end "set"
      from blocked b, unnest(range(4)) t(f) where b.block<=f+1""",
)
def expanding_splits_train_test(spark, sf):
    t = V.tracking(spark, sf).select("session", "frame_id", "ts")
    return S.expanding_splits(t, 5, "train_test").select("frame_id", "block", "fold_no", "set")


@check(
    "nested_splits",
    """select session, f::int fold_no, s::int sub_fold, case when b.block=s then 'val' when b.block=f+1 then 'test' else 'train' end "set", count(*) n
      from blocked b, unnest(range(1, 4)) t(f), unnest(range(4)) u(s) where s<=f and b.block<=f+1 group by all""",
)
def nested_splits(spark, sf):
    t = V.tracking(spark, sf).select("session", "frame_id", "ts")
    return S.nested_splits(t, 3).groupBy("session", "fold_no", "sub_fold", "set").agg(F.count(F.lit(1)).alias("n"))


@check(
    "fold_boundaries",
    """select session, ts, b fold_before, fold from (select *, lag(fold) over (partition by session order by ts, frame_id) b from folded where fold is not null)
      where b is not null and fold<>b""",
    "ts",
)
def fold_boundaries(spark, sf):
    return S.fold_boundaries(folded(spark, sf))


define("trace", 'select cell, row_id, "timestamp", case when spikes=4 then null else rate end v, row_number() over (partition by cell order by "timestamp", row_id)-1 i from activity')


@check(
    "gauss_smooth_trace",
    f"""select a.row_id, case when a.v is not null then sum(coalesce(b.v, 0)*exp(-0.5*((b.i-a.i)/2.0::double)^2))/
        (select sum(exp(-0.5*(k/2.0::double)^2)) from unnest(range(-6, 7)) t(k)) end smoothed
      from trace a join trace b on a.cell=b.cell and b.i between a.i-6 and a.i+6 group by a.row_id, a.v""",
    "smoothed",
)
def gauss_smooth_trace(spark, sf):
    a = V.activity(spark, sf).select("cell", "row_id", "timestamp", F.when(F.col("spikes") != 4, F.col("rate")).alias("v"))
    return S.gauss_smooth_trace(a, "v", 2.0).select("row_id", "smoothed")


@check(
    "decimate",
    "select cell, row_id from (select *, count(*) over (partition by cell) n from trace) where i % greatest(1, ceil(n/100.0))::bigint = 0",
)
def decimate(spark, sf):
    return S.decimate(V.activity(spark, sf), 100).select("cell", "row_id")


@check(
    "temporal_fade",
    """select frame_id, exp(-3.0::double*(1-coalesce(i::double/nullif(n-1, 0), 0))) fade from (select frame_id, row_number() over (partition by session, room order by ts, frame_id)-1 i,
      count(*) over (partition by session, room) n from labelled)""",
    "fade", 8,
)
def temporal_fade(spark, sf):
    known = labelled(spark, sf).withColumn("room", F.coalesce("room", F.lit("none")))
    return S.temporal_fade(known).select("frame_id", "fade")


define(
    "dense",
    """with c as (select cell, floor("timestamp"/3600)::bigint bin, count(*) n from activity group by all)
      select g.cell, g.bin, coalesce(n, 0)/3600.0::double rate_bin from (select cell, unnest(range(min(bin), max(bin)+1)) bin from c group by cell) g left join c on c.cell=g.cell and c.bin=g.bin""",
)


@check("binned_rates", "select * from dense", "rate_bin", 9)
def binned_rates(spark, sf):
    return S.binned_rates(V.activity(spark, sf), 3600.0)


@check(
    "rate_variants",
    """with m as (select sum(exp(-0.5*(k/1.5::double)^2)) norm from unnest(range(-5, 6)) t(k)),
      g as (select a.cell, a.bin, sum(b.rate_bin*exp(-0.5*((b.bin-a.bin)/1.5::double)^2)) s from dense a join dense b on a.cell=b.cell and b.bin between a.bin-5 and a.bin+5 group by all)
      select d.cell, d.bin, rate_bin, s/norm rate_gauss, avg(rate_bin) over (partition by d.cell order by d.bin rows between 2 preceding and 2 following) rate_rect
      from dense d join g on g.cell=d.cell and g.bin=d.bin, m""",
    "rate_bin rate_gauss rate_rect", 9,
)
def rate_variants(spark, sf):
    return S.rate_variants(V.activity(spark, sf), 3600.0, 2, 1.5)


@check(
    "adaptive_rate",
    """select row_id, 5/nullif(t-lag(t, 4) over (partition by cell order by t, row_id), 0) rate_adaptive from (select *, "timestamp" t from activity)""",
    "rate_adaptive", 9,
)
def adaptive_rate(spark, sf):
    return S.adaptive_rate(V.activity(spark, sf), 5).select("row_id", "rate_adaptive")
