"""Score tables of a position decoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, define
from wayfield.operators import metrics as M
from wayfield.operators.metrics import XY
from wayfield.sources import views as V

GROUPS = ("project", "set_name", "room")


def scored(spark, sf):
    return V.pred_long(spark, sf).withColumnsRenamed({"predicted_room": "project", "actual_room": "room"})


define("scored", "select * exclude(predicted_room, actual_room), predicted_room project, actual_room room from pred_long")

_SUMS = """count(*) n_timestamps, count(x_pred) n_samples,
 sum((x_pred-x)*(x_pred-x)) sse_x, sum((y_pred-y)*(y_pred-y)) sse_y,
 count(x)*var_pop(x) sst_x, count(y)*var_pop(y) sst_y"""
_SCORES = """case when sst_x>0 then greatest(0, 1-sse_x/sst_x) else 0 end r2_x,
 case when sst_y>0 then greatest(0, 1-sse_y/sst_y) else 0 end r2_y,
 case when sst_x+sst_y>0 then greatest(0, 1-(sse_x+sse_y)/(sst_x+sst_y)) else 0 end r2_pooled"""
define(
    "offset_scores",
    f"""select *, {_SCORES}, round((sse_x+sse_y)/n_samples, 5) mse from (
  select project, set_name, room, offset_no, fold, cast(1 as bigint) n_folds, {_SUMS} from scored group by all
  union all by name
  select project, set_name, room, offset_no, cast(null as int) fold, count(distinct fold) n_folds, {_SUMS}
  from scored group by project, set_name, room, offset_no)""",
)
_ALL = "sse_x sse_y sst_x sst_y r2_x r2_y r2_pooled mse"


@check(
    "regression_metrics",
    f"""select *, {_SCORES}, round((sse_x+sse_y)/n_samples, 5) mse from (
      select project, {_SUMS.replace('count(*) n_timestamps,', '')} from scored group by project)""",
    _ALL,
)
def regression_metrics(spark, sf):
    return M.regression_metrics(scored(spark, sf), ["project"])


@check(
    "regression_metrics_axis_mean",
    """select room, count(*) n_samples, sum((x_pred-x)^2) sse_x, sum((y_pred-y)^2) sse_y,
      round((sum((x_pred-x)^2)+sum((y_pred-y)^2))/(2*count(*)), 5) mse from scored group by room""",
    "sse_x sse_y mse",
)
def regression_metrics_axis_mean(spark, sf):
    return M.regression_metrics(scored(spark, sf), ["room"], mse="axis_mean").select("room", "n_samples", "sse_x", "sse_y", "mse")


@check("decoder_offset_metrics", "select * replace (coalesce(fold, 0) as fold) from offset_scores", _ALL)
def decoder_offset_metrics(spark, sf):
    # fold 0 stands for the pooled rows, whose fold is NULL
    return M.decoder_offset_metrics(scored(spark, sf), GROUPS).fillna(0, ["fold"])


_STATS = "r2_pooled_mean r2_pooled_std r2_pooled_sem rmse_mean rmse_std rmse_sem r2_x_mean r2_x_std r2_x_sem r2_y_mean r2_y_std r2_y_sem sse_x_total sse_y_total sst_x_total sst_y_total r2_pooled_across_offsets"


def _stat(value: str, name: str) -> str:
    return f"avg({value}) {name}_mean, stddev_pop({value}) {name}_std, stddev_pop({value})/sqrt(count({value})) {name}_sem"


define(
    "room_scores",
    f"""select *, case when sst_x_total+sst_y_total>0
      then greatest(0, 1-(sse_x_total+sse_y_total)/(sst_x_total+sst_y_total)) else 0 end r2_pooled_across_offsets
    from (
      with rooms_only as (
        select project, set_name, room, max(n_folds) n_folds, count(distinct offset_no) n_offsets,
          sum(n_timestamps)::bigint n_timestamps_total, {_stat('r2_pooled', 'r2_pooled')}, {_stat('sqrt(mse)', 'rmse')},
          {_stat('r2_x', 'r2_x')}, {_stat('r2_y', 'r2_y')}, sum(sse_x) sse_x_total, sum(sse_y) sse_y_total,
          sum(sst_x) sst_x_total, sum(sst_y) sst_y_total
        from offset_scores where fold is null group by project, set_name, room)
      select * from rooms_only
      union all by name
      select project, set_name, 'All' room, max(n_folds) n_folds, max(n_offsets) n_offsets,
        sum(n_timestamps_total)::bigint n_timestamps_total, {_stat('r2_pooled_mean', 'r2_pooled')}, {_stat('rmse_mean', 'rmse')},
        {_stat('r2_x_mean', 'r2_x')}, {_stat('r2_y_mean', 'r2_y')}, sum(sse_x_total) sse_x_total,
        sum(sse_y_total) sse_y_total, sum(sst_x_total) sst_x_total, sum(sst_y_total) sst_y_total
      from rooms_only group by project, set_name)""",
)


@check("decoder_room_metrics", "select * from room_scores", _STATS)
def decoder_room_metrics(spark, sf):
    return M.decoder_room_metrics(M.decoder_offset_metrics(scored(spark, sf), GROUPS), GROUPS[:2])


@check(
    "decoder_by_room",
    "select room, r2_pooled_mean r2, rmse_mean rmse from room_scores where set_name='test' and room<>'All'",
    "r2 rmse",
)
def decoder_by_room(spark, sf):
    rooms = M.decoder_room_metrics(M.decoder_offset_metrics(scored(spark, sf), GROUPS), GROUPS[:2])
    return M.decoder_by_room(rooms)


define(
    "ensemble_scores",
    f"""select m.*, sqrt(mse) rmse, n_folds, n_offsets from (
      select *, {_SCORES}, round((sse_x+sse_y)/n_samples, 5) mse from (
        select project, set_name, room, {_SUMS} from (
          select project, set_name, room, row_key, min_by(x, offset_no) x, min_by(y, offset_no) y,
            avg(x_pred) x_pred, avg(y_pred) y_pred from scored group by all) group by all)) m
    join (select project, set_name, room, count(distinct fold) n_folds, count(distinct offset_no) n_offsets
      from scored group by all) using (project, set_name, room)""",
)


@check(
    "decoder_ensemble_metrics",
    """select * from ensemble_scores union all by name
    select project, set_name, 'All' room, sum(n_timestamps)::bigint n_timestamps, sum(n_samples)::bigint n_samples,
      max(n_folds) n_folds, max(n_offsets) n_offsets, avg(r2_pooled) r2_pooled, avg(mse) mse, avg(rmse) rmse,
      avg(r2_x) r2_x, avg(r2_y) r2_y, avg(sse_x) sse_x, avg(sse_y) sse_y, avg(sst_x) sst_x, avg(sst_y) sst_y
    from ensemble_scores group by project, set_name""",
    _ALL + " rmse",
)
def decoder_ensemble_metrics(spark, sf):
    keyed = V.pred_keyed(spark, sf, by=V.ROW).withColumnsRenamed({"predicted_room": "project", "actual_room": "room"})
    return M.decoder_ensemble_metrics(keyed, GROUPS[:2], row=V.ROW)


@check(
    "pooled_r2",
    f"""select *, {_SCORES} from (select room, sum(sse_x) sse_x, sum(sse_y) sse_y, sum(sst_x) sst_x, sum(sst_y) sst_y
      from offset_scores where fold is not null group by room)""",
    "sse_x sse_y sst_x sst_y r2_x r2_y r2_pooled",
)
def pooled_r2(spark, sf):
    return M.pooled_r2(M.decoder_offset_metrics(scored(spark, sf), GROUPS).filter("fold is not null"), ["room"])


@check(
    "pool_folds",
    f"""select *, {_SCORES} from (select project, set_name, room, offset_no, sum(sse_x) sse_x, sum(sse_y) sse_y,
      sum(sst_x) sst_x, sum(sst_y) sst_y from offset_scores where fold is not null group by all)""",
    "sse_x sse_y sst_x sst_y r2_x r2_y r2_pooled",
)
def pool_folds(spark, sf):
    scores = M.decoder_offset_metrics(scored(spark, sf), GROUPS).filter("fold is not null")
    return M.pool_folds(scores, [*GROUPS, "offset_no"])


@check(
    "summary_stats",
    "select cell, avg(rate) rate_mean, stddev_pop(rate) rate_std, stddev_pop(rate)/sqrt(count(rate)) rate_sem from activity group by cell",
    "rate_mean rate_std rate_sem",
)
def summary_stats(spark, sf):
    return M.summary_stats(V.activity(spark, sf), ["cell"], "rate")


@check(
    "ensemble_rows",
    """select row_key, predicted_room, avg(x) x, avg(y) y, avg(x_pred) x_pred, avg(y_pred) y_pred,
      min_by(actual_room, offset_no) actual_room, min_by(fold, offset_no) fold from pred_long group by row_key, predicted_room""",
    "x y x_pred y_pred",
)
def ensemble_rows(spark, sf):
    return M.ensemble_rows(V.pred_long(spark, sf, by=["row_key"]), ["row_key", "predicted_room"], ["x", "y", "x_pred", "y_pred"], ["actual_room", "fold"])


@check(
    "mean_metrics",
    "select fold, avg(x_pred) x_pred, avg(y_pred) y_pred from pred_long group by fold",
    "x_pred y_pred",
)
def mean_metrics(spark, sf):
    return M.mean_metrics(V.pred_long(spark, sf), ["fold"], ["x_pred", "y_pred"])


@check(
    "mean_list_metrics",
    """select cluster_label, i::int element, avg(embedding[i+1]::double) mean from
      (select label cluster_label, embedding, unnest(range(64)) i from embeddings) group by all""",
    "mean", 5,
)
def mean_list_metrics(spark, sf):
    v = V.vectors(spark, sf).withColumn("embedding", F.col("embedding").cast("array<double>"))
    return M.mean_lists(v, ["cluster_label"], "embedding").select("cluster_label", F.posexplode("embedding").alias("element", "mean"))


@check(
    "mean_map_metrics",
    """select room, k "key", avg(v) mean from (select actual_room room, unnest(['x','y']) k,
      unnest([x_pred-x, y_pred-y]) v from pred_long) group by all""",
    "mean",
)
def mean_map_metrics(spark, sf):
    p = V.pred_long(spark, sf).select(
        F.col("actual_room").alias("room"),
        F.create_map(F.lit("x"), F.col("x_pred") - F.col("x"), F.lit("y"), F.col("y_pred") - F.col("y")).alias("m"),
    )
    return M.mean_maps(p, ["room"], "m").select("room", F.explode("m").alias("key", "mean"))


@check(
    "group_mean_mixed",
    """with r as (select coalesce(case when event_type='signup' then null else event_type end, 'unknown') k,
        case when user_id%2=0 then value end s,
        case when user_id%2=1 then [value, user_id::double] end l from events)
      select k "group", -1 element, avg(s) mean from r where s is not null group by k
      union all
      select k, i::int, avg(l[i+1]) from (select k, l, unnest(range(2)) i from r where l is not null) group by k, i""",
    "mean",
)
def group_mean_mixed(spark, sf):
    e = V.table(spark, sf, "events").selectExpr(
        "case when event_type='signup' then null else event_type end `group`",
        "case when user_id%2=0 then value end s",
        "case when user_id%2=1 then array(value, cast(user_id as double)) end l",
    )
    return M.group_mean_mixed(e, ["group"], "s", "l").fillna(-1, ["element"])


@check(
    "mean_rate",
    """select cell, case when max("timestamp")>min("timestamp") then sum(spikes)/(max("timestamp")-min("timestamp")) end mean_rate
      from activity group by cell""",
    "mean_rate", 9,
)
def mean_rate(spark, sf):
    return M.mean_rate(V.activity(spark, sf), ["cell"], "spikes")


@check("mean_rate_by_room", """select cell, room, avg(rate) mean_rate from activity a
      join rooms r on a."timestamp">=r.t0 and a."timestamp"<r.t1 group by cell, room""", "mean_rate")
def mean_rate_by_room(spark, sf):
    from wayfield.operators.rooms import assign_room

    a = assign_room(V.activity(spark, sf), V.ROOMS, "timestamp").filter("room is not null")
    return M.mean_rate(a, ["cell", "room"], "rate", kind="rate")


@check(
    "max_window_rate",
    """select cell, max(r) max_rate from (select cell, floor("timestamp"/86400) w,
      case when max("timestamp")>min("timestamp") then sum(spikes)/(max("timestamp")-min("timestamp")) end r
      from activity group by all) group by cell""",
    "max_rate", 8,
)
def max_window_rate(spark, sf):
    return M.max_window_rate(V.activity(spark, sf), ["cell"], "spikes", 86400.0)


@check(
    "weighted_mse",
    """select actual_room, sum(l*((x_pred-x)^2+(y_pred-y)^2))/(2*count(*)) weighted_mse from
      (select *, fold*0.5 l from pred_long) group by actual_room""",
    "weighted_mse",
)
def weighted_mse(spark, sf):
    p = V.pred_long(spark, sf).withColumn("w", F.col("fold") * F.lit(0.5))
    return M.weighted_mse(p, ["actual_room"], [("x", "x_pred"), ("y", "y_pred")], "w")


@check(
    "homogeneous_mse",
    """select actual_room, sum(w*((x_pred-x*(h+1e-6::double))^2+(y_pred-y*(h+1e-6::double))^2+(h-1)^2))/(3*count(*)) weighted_mse
      from (select *, fold*0.5 w, 1+offset_no*0.1 h from pred_long) group by actual_room""",
    "weighted_mse",
)
def homogeneous_mse(spark, sf):
    p = V.pred_long(spark, sf).withColumns(
        {"w": F.col("fold") * F.lit(0.5), "h": F.lit(1.0) + F.col("offset_no") * F.lit(0.1), "one": F.lit(1.0)}
    )
    return M.homogeneous_mse(p, ["actual_room"], [("x", "x_pred"), ("y", "y_pred"), ("one", "h")], "h", "w")


@check(
    "bbox",
    "select predicted_room, least(min(x_pred), min(y_pred)) lo, greatest(max(x_pred), max(y_pred)) hi from pred_long group by predicted_room",
    "lo hi",
)
def bbox(spark, sf):
    return M.bbox(V.pred_long(spark, sf), ["predicted_room"], "x_pred", "y_pred")


@check(
    "covariance_mismatch",
    """select predicted_room, sqrt((var_samp(x)-var_samp(x_pred))^2+2*(covar_samp(x,y)-covar_samp(x_pred,y_pred))^2
      +(var_samp(y)-var_samp(y_pred))^2) mismatch from pred_long group by predicted_room""",
    "mismatch",
)
def covariance_mismatch(spark, sf):
    return M.covariance_mismatch(V.pred_long(spark, sf), ["predicted_room"], ("x", "y"), ("x_pred", "y_pred"))
