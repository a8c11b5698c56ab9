"""Small report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.affine_checks import room_fit
from checks.metric_checks import GROUPS, scored
from checks.registry import check, define
from checks.room_checks import inside_sql
from wayfield.operators import metrics as M
from wayfield.operators import reports as P
from wayfield.operators import rooms as R
from wayfield.sources import views as V


@check(
    "time_group_stats",
    """select row_key, predicted_room, avg(x) x_mean, stddev_samp(x) x_std, avg(x_pred) x_pred_mean, stddev_samp(x_pred) x_pred_std from pred_long group by all""",
    "x_mean x_std x_pred_mean x_pred_std",
)
def time_group_stats(spark, sf):
    return P.group_stats(V.pred_long(spark, sf, by=["row_key"]), ["row_key", "predicted_room"], ["x", "x_pred"])


@check(
    "angle_ev_stats",
    """select event_type perspective, angle, avg(value) score_mean, stddev_samp(value)/2 score_std from (select *, (json_extract_string(props,'$.k')::int%36*10) angle from events) group by all""",
    "score_mean score_std", 8,
)
def angle_ev_stats(spark, sf):
    e = V.table(spark, sf, "events").selectExpr("event_type perspective", f"cast({V.KNOB} as int)%36*10 angle", "value score")
    return P.group_stats(e, ["perspective", "angle"], ["score"], half=True)


@check(
    "epoch_curves",
    """select l_linenumber fold, l_returnflag params, month(l_shipdate)::int epoch, avg(l_discount) train_mean, stddev_samp(l_discount) train_std, avg(l_tax) val_mean, stddev_samp(l_tax) val_std
      from lineitem group by all""",
    "train_mean train_std val_mean val_std",
)
def epoch_curves(spark, sf):
    li = V.table(spark, sf, "lineitem").selectExpr("l_linenumber fold", "l_returnflag params", "month(l_shipdate) epoch", "l_discount train", "l_tax val")
    return P.group_stats(li, ["fold", "params", "epoch"], ["train", "val"])


@check("value_extrema_by", "select label, min(rate) lowest, max(rate) highest from units group by label", "lowest highest")
def value_extrema_by(spark, sf):
    return P.value_extrema_by(V.units(spark, sf), "label", "rate")


@check("median_by_size", 'select "size", median(r2) median from subsets group by 1', "median", 8)
def median_by_size(spark, sf):
    return P.median_by_size(V.subsets(spark, sf))


@check("participation_counts", 'select "size", cell, count(*) n from (select "size", unnest(cells) cell from subsets where not is_baseline) group by all')
def participation_counts(spark, sf):
    return P.participation_counts(V.subsets(spark, sf))


@check(
    "score_histogram",
    """select "size", bin, count(*) n from (select "size", least(floor(greatest(r2, 0)*20), 19)::int bin from subsets where not is_baseline and r2<=1) group by all""",
)
def score_histogram(spark, sf):
    return P.score_histogram(V.subsets(spark, sf), ["size"])


@check(
    "histogram",
    """with q as (select greatest(2*100.0::double, quantile_cont(value, 0.995)) hi from events)
      select b::int bin, (b+0.5)*hi/25 centre, count(value) n from q, (select unnest(range(25)) b) left join events on value between 0 and hi and case when value=hi then 24 else floor(value/(hi/25)) end = b group by all""",
    "centre",
)
def histogram(spark, sf):
    e = V.table(spark, sf, "events")
    hi = P.histogram_limit(e, "value", 100.0).first()["hi"]
    return P.histogram(e, "value", 0.0, hi, 25)


@check(
    "flag_intersections",
    """select case when not is_hd and not is_grid and not is_border then 'No_Class' else concat_ws(' & ', case when is_hd then 'is_hd' end, case when is_grid then 'is_grid' end, case when is_border then 'is_border' end) end combination,
      count(*) n from units group by all having count(*)>=50""",
)
def flag_intersections(spark, sf):
    return P.flag_intersections(V.units(spark, sf), ["is_hd", "is_grid", "is_border"], 50)


_ST = "case when is_hd then 'pass' else 'fail' end a, case when rate>1100 then 'pass' else 'fail' end b, case when is_grid then 'pass' else 'fail' end c, is_hd and rate>1100 and is_grid k"


@check(
    "filter_funnel",
    f"""with s as (select {_ST} from units), r as (select 'node' kind, 'hd' stage, a status, 'none' next_status, 'none' kept from s union all select 'node', 'rate', b, 'none', 'none' from s
        union all select 'node', 'grid', c, 'none', 'none' from s union all select 'flow', 'hd', a, b, k::varchar from s union all select 'flow', 'rate', b, c, k::varchar from s)
      select *, 100.0*n/(select count(*) from units) pct from (select kind, stage, status, next_status, kept, count(*) n from r group by all)""",
    "pct",
)
def filter_funnel(spark, sf):
    stages = {"hd": F.col("is_hd"), "rate": F.col("rate") > 1100, "grid": F.col("is_grid")}
    out = P.filter_funnel(V.units(spark, sf), stages)
    return out.withColumns({"next_status": F.coalesce("next_status", F.lit("none")), "kept": F.coalesce(F.col("kept").cast("string"), F.lit("none"))})


@check(
    "room_pair_separation",
    """with m as (select l_returnflag r, l_linestatus o, avg(l_discount) v from lineitem group by all), b as (select r, o, v from m union select o, r, v from m)
      select r room, max(v) filter (where o='A') to_0, max(v) filter (where o='N') to_1, max(v) filter (where o='R') to_2, max(v) filter (where o='F') to_3, max(v) filter (where o='O') to_4 from b group by r""",
    "to_0 to_1 to_2 to_3 to_4",
)
def room_pair_separation(spark, sf):
    return P.room_pair_separation(V.separation(spark, sf), ["A", "N", "R", "F", "O"])


@check("room_pair_stats", 'select room_pair, avg(rate) mean, stddev_samp(rate) std, count(*) n from separation group by all', "mean std", 8)
def room_pair_stats(spark, sf):
    return P.room_pair_stats(V.separation(spark, sf))


@check("offset_all_room", "select set_name, offset_no, avg(r2_pooled) r2, sqrt(avg(mse)) rmse from offset_scores where fold is null group by all", "r2 rmse")
def offset_all_room(spark, sf):
    scores = M.decoder_offset_metrics(scored(spark, sf), GROUPS).filter("fold is null")
    return P.offset_all_room(scores, ["set_name"])


@check(
    "axis_stretch",
    """select predicted_room room, var_pop(x_pred*0.6+y_pred*0.8) variance, max(x_pred*0.6+y_pred*0.8)-min(x_pred*0.6+y_pred*0.8) extent from pred_long group by all""",
    "variance extent",
)
def axis_stretch(spark, sf):
    return P.axis_stretch(V.pred_long(spark, sf).withColumnRenamed("predicted_room", "room"), ["room"], (3.0, 4.0), "x_pred", "y_pred")


define(
    "shade_nodes",
    """with b as (select least(min(x_pred), min(y_pred)) lo, greatest(max(x_pred), max(y_pred)) hi from pred_long),
      g as (select gx, gy, lo+gx*((hi-lo)/33) x, lo+gy*((hi-lo)/33) y, r.room from b, unnest(range(34)) t(gx), unnest(range(34)) u(gy), (select distinct room from boundary) r)
      select gx::int gx, gy::int gy, x, y, room from ("""
    + inside_sql("g", "gx, gy, x, y, g.room", "g.x", "g.y", "g.room")
    + ") where odd or border",
)


@check(
    "colour_field",
    """select n.gx, n.gy, n.x, n.y, n.room, f.fold, (n.x-min(n.x) over w)/(max(n.x) over w-min(n.x) over w) gradient, (a*n.x+b*n.y+f.tx)/(1+1e-9::double) u, (c*n.x+d*n.y+f.ty)/(1+1e-9::double) v
      from shade_nodes n join room_fit f on f.room=n.room window w as (partition by n.room, f.fold)""",
    "x y gradient u v",
)
def colour_field(spark, sf):
    nodes = R.room_grid(M.bbox(V.pred_long(spark, sf), (), "x_pred", "y_pred"), 34, V.POLYGONS)
    fits = room_fit(spark, sf)
    return P.colour_field(nodes.join(fits.select("room", "fold"), "room"), fits, ["room", "fold"])
