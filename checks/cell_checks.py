"""Cell pairs, clusters and ranked cell lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.map_checks import N, STEP, maps
from checks.registry import check, define
from checks.room_checks import lit_positions
from wayfield.operators import cells as C
from wayfield.operators import decoding as D
from wayfield.operators import folds as S
from wayfield.sources import views as V

# mean rate per cell and hour; blocks are days
define("hourly", 'select floor("timestamp"/86400)::bigint block, (floor("timestamp"/3600)::bigint%24) "hour", cell, avg(rate) rate from activity group by all')


def hourly(spark, sf):
    h = F.floor(F.col("timestamp") / 3600)
    return V.activity(spark, sf).groupBy(F.floor(F.col("timestamp") / 86400).alias("block"), F.pmod(h, F.lit(24)).alias("hour"), "cell").agg(F.avg("rate").alias("rate"))


@check(
    "cell_pair_join",
    """select a.block, a.cell::bigint cell_a, b.cell::bigint cell_b, count(*)::double n, sum(a.rate) sx, sum(b.rate) sy, sum(a.rate*b.rate) sxy
      from hourly a join hourly b on a.block=b.block and a."hour"=b."hour" and a.cell<=b.cell group by all""",
    "n sx sy sxy", 8,
)
def cell_pair_join(spark, sf):
    return C.pair_sums(hourly(spark, sf), ["block"], "hour", "cell", "rate").drop("sxx", "syy")


@check(
    "corr_by_block",
    """with c as (select a.block, a.cell::bigint cell_a, b.cell::bigint cell_b, count(*) n, corr(a.rate, b.rate) r
      from hourly a join hourly b on a.block=b.block and a."hour"=b."hour" and a.cell<=b.cell group by all)
      select block, cell_a, cell_b, case when n<2 or isnan(r) then 0 else coalesce(r, 0) end r from c""",
    "r",
)
def corr_by_block(spark, sf):
    return C.corr_by_block(hourly(spark, sf), ["block"], "hour")


define(
    "dense_hours",
    """select d.block, c.cell, h."hour", coalesce(x.rate, 0) rate from (select distinct block from hourly) d, (select distinct block, cell from hourly) c, (select unnest(range(24)) "hour") h
      left join hourly x on x.block=d.block and x.cell=c.cell and x."hour"=h."hour" where c.block=d.block""",
)


def _shift_sql(s: int) -> str:
    return f"""select a.block, a.cell a, b.cell b, {s} s, corr(a.rate, coalesce(l.rate, 0)) r from dense_hours a
      join (select distinct block, cell from hourly) b on b.block=a.block left join dense_hours l on l.block=a.block and l.cell=b.cell and l."hour"=a."hour"+{s} group by all"""


@check(
    "corr_phase_shift",
    f"""with c as ({' union all '.join(_shift_sql(s) for s in range(3))})
      select block, least(a, b)::bigint cell_a, greatest(a, b)::bigint cell_b, max(case when r is null or isnan(r) then 0 else r end) r from c group by 1, 2, 3""",
    "r",
)
def corr_phase_shift(spark, sf):
    return C.corr_phase_shift(hourly(spark, sf), ["block"], "hour", 24, 2)


define(
    "mean_maps",
    'select cell, bx, "by", avg(rate) v from binned group by all',
)
define(
    "smooth_means",
    """with k as (select i, exp(-i*i/8.0::double) w from unnest(range(-4, 5)) t(i)), n as (select sum(w) s from k)
      select m.cell, m.bx+a.i bx, m."by"+b.i "by", sum(m.v*a.w*b.w/(s*s)) v from mean_maps m, k a, k b, n
      where m.bx+a.i between 0 and 11 and m."by"+b.i between 0 and 11 group by all""",
)


@check(
    "corr_by_position",
    """with g as (select c.cell, x.bx, y."by", coalesce(m.v, 0) v from (select distinct cell from smooth_means) c, (select unnest(range(12)) bx) x, (select unnest(range(12)) "by") y
        left join smooth_means m on m.cell=c.cell and m.bx=x.bx and m."by"=y."by")
      select a.cell::bigint cell_a, b.cell::bigint cell_b, corr(a.v, b.v) r from g a join g b on a.bx=b.bx and a."by"=b."by" and a.cell<=b.cell group by all""",
    "r",
)
def corr_by_position(spark, sf):
    return C.corr_by_position(lit_positions(spark, sf).withColumn("_b", F.lit(1)), ["_b"], N).drop("_b")


@check(
    "corr_by_hd",
    """with t as (select cell, floor(((hd+15)%360)/30)::int ai, avg(rate) v from activity group by all),
      g as (select c.cell, i.ai, coalesce(v, 0) v from (select distinct cell from t) c, (select unnest(range(12)) ai) i left join t on t.cell=c.cell and t.ai=i.ai)
      select a.cell::bigint cell_a, b.cell::bigint cell_b, corr(a.v, b.v) r from g a join g b on a.ai=b.ai and a.cell<=b.cell group by all""",
    "r",
)
def corr_by_hd(spark, sf):
    return C.corr_by_hd(V.activity(spark, sf).withColumn("_b", F.lit(1)), ["_b"], 12).drop("_b")


define("vectors", "select vec_id cell, list_transform(embedding, lambda v: v::double) e from embeddings")


@check(
    "norm_clusters",
    """with recursive s as (select cell, e, list_transform(e, lambda v: case when v*v/list_max(list_transform(e, lambda w: w*w))>0.1::double then v else 0 end) kept,
        row_number() over (order by list_dot_product(e, e) desc, cell desc) k from vectors),
      st as (select cell, e, 0 label, 0::bigint k from vectors union all
        select cell, e, case when seed_free and n>=5 and most<100 and hit then most+1 else label end, k+1 from (
          select *, bool_or(cell=seed and label=0) over () seed_free, count(*) filter (where hit) over () n, max(label) over () most from (
            select st.cell, st.e, label, st.k, s.cell seed, label=0 and list_dot_product(st.e, s.kept)>list_dot_product(s.kept, s.kept)/2 hit from st join s on s.k=st.k+1)))
      select cell, label::int "cluster" from st where k=(select count(*) from vectors)""",
)
def norm_clusters(spark, sf):
    return C.norm_clusters(V.vectors(spark, sf), min_cells=5)


define("day_hours", 'select floor("timestamp"/86400)::bigint cell, floor("timestamp"/3600)::bigint%24 hr, avg(rate) rate from activity group by all')
define("day_corr", "select a.cell cell_a, b.cell cell_b, corr(a.rate, b.rate) r from day_hours a join day_hours b on a.hr=b.hr and a.cell<b.cell group by all")


@check(
    "merge_clusters",
    """with recursive st as (
        select cell_a, cell_b, r, floor(cell_a/3)::int la, floor(cell_b/3)::int lb, 0 k from day_corr union all
        select cell_a, cell_b, r, case when la=gone then keep else la end, case when lb=gone then keep else lb end, k+1 from st, (
          select ca keep, cb gone from (
            select m.ca, m.cb, m.m, greatest(x.m, y.m) top, least(x.m, y.m) low
            from (select least(la, lb) ca, greatest(la, lb) cb, avg(r) m from st group by all) m
            join (select la c, avg(r) m from st where la=lb group by la) x on x.c=m.ca join (select la c, avg(r) m from st where la=lb group by la) y on y.c=m.cb
            where m.ca<>m.cb) where (m/top>0.5 and low/top<0.5) or top<0.02 order by m desc, ca, cb limit 1) p),
      f as (select * from st where k=(select max(k) from st))
      select distinct cell, "cluster" from (select cell_a cell, la "cluster" from f union all select cell_b, lb from f)""",
)
def merge_clusters(spark, sf):
    """Cells are the days of the recording, three to a cluster; correlation over the hours of the day."""
    daily = V.activity(spark, sf).groupBy(
        F.floor(F.col("timestamp") / 86400).alias("cell"), F.pmod(F.floor(F.col("timestamp") / 3600), F.lit(24)).alias("hour")
    ).agg(F.avg("rate").alias("rate"))
    corr = C.corr_by_block(daily.withColumn("_b", F.lit(1)), ["_b"], "hour")
    clusters = daily.select("cell").distinct().select("cell", F.floor(F.col("cell") / 3).cast("int").alias("cluster"))
    return C.merge_clusters(corr, clusters, weak=0.02)


@check("latent_pca")
def latent_pca(spark, sf):
    return C.latent_pca(V.vectors(spark, sf))


# ridge regression on two features: normal equations solved by the adjugate of a 3 x 3 matrix
@check(
    "fold_decoder",
    """with d as (select offset_no, predicted_room source, fold, actual_room room, x, y, x_pred f1, y_pred f2 from pred_long),
      g as (select offset_no, source, room, fold, count(*)::double n, sum(f1) s1, sum(f2) s2, sum(f1*f1) s11, sum(f1*f2) s12, sum(f2*f2) s22,
        sum(x) x0, sum(f1*x) x1, sum(f2*x) x2, sum(y) y0, sum(f1*y) y1, sum(f2*y) y2 from d group by all),
      t as (select g.offset_no, g.source, g.room, f.fold, sum(n)+1e-3 a, sum(s1) b, sum(s2) c, sum(s11)+1e-3 e, sum(s12) h, sum(s22)+1e-3 k,
        sum(x0) x0, sum(x1) x1, sum(x2) x2, sum(y0) y0, sum(y1) y1, sum(y2) y2 from g join (select distinct offset_no, source, fold from g) f
        on f.offset_no=g.offset_no and f.source=g.source and f.fold<>g.fold group by g.offset_no, g.source, g.room, f.fold),
      i as (select *, e*k-h*h i0, c*h-b*k i1, b*h-c*e i2, a*k-c*c i3, b*c-a*h i4, a*e-b*b i5 from t),
      w as (select *, a*i0+b*i1+c*i2 det from i),
      p as (select d.*, w.room predicted_room, (i0*x0+i1*x1+i2*x2)/det+(i1*x0+i3*x1+i4*x2)/det*f1+(i2*x0+i4*x1+i5*x2)/det*f2-x ex,
        (i0*y0+i1*y1+i2*y2)/det+(i1*y0+i3*y1+i4*y2)/det*f1+(i2*y0+i4*y1+i5*y2)/det*f2-y ey
        from d join w on w.offset_no=d.offset_no and w.source=d.source and w.fold=d.fold)
      select offset_no, source, fold, room actual_room, predicted_room, count(*) n, sqrt(avg(ex^2+ey^2)) rmse from p group by all""",
    "rmse",
)
def fold_decoder(spark, sf):
    rows = V.pred_long(spark, sf).withColumnsRenamed({"actual_room": "room", "predicted_room": "source"})
    data = rows.select("row_key", "offset_no", "source", "fold", "room", "x", "y", F.col("x_pred").alias("f1"), F.col("y_pred").alias("f2"))
    out = D.fold_decoder(data, ["offset_no", "source"], ["f1", "f2"], ["x", "y"], row="row_key")
    return out.groupBy("offset_no", "source", "fold", "actual_room", "predicted_room").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.pow(F.col("x_pred") - F.col("x"), 2) + F.pow(F.col("y_pred") - F.col("y"), 2))).alias("rmse")
    )


@check(
    "loss_curves",
    """with c as (select set_name, fold epoch, avg((x_pred-x)^2+(y_pred-y)^2) loss from pred_long group by all)
      select c.*, best_epoch from c join (select set_name, arg_min(epoch, loss) best_epoch from c group by set_name) b on b.set_name=c.set_name""",
    "loss",
)
def loss_curves(spark, sf):
    p = V.pred_long(spark, sf).withColumn("mse", F.pow(F.col("x_pred") - F.col("x"), 2) + F.pow(F.col("y_pred") - F.col("y"), 2))
    return C.loss_curves(p, epoch="fold").withColumnRenamed("fold", "epoch")


@check(
    "rank_in_room",
    """select cell, room, floor(r+(t-1)/2)::int "rank" from (select cell, room, rank() over (partition by room order by score desc) r, count(*) over (partition by room, score) t from ranks)""",
)
def rank_in_room(spark, sf):
    return C.rank_in_room(V.ranks(spark, sf)).select("cell", "room", "rank")


@check(
    "low_mid_high_cells",
    """with m as (select user_id cell, avg(value) mean_rate from events group by user_id), o as (select *, row_number() over (order by mean_rate, cell)-1 i, count(*) over () n from m),
      r as (select *, row_number() over (order by abs(i-(3+n-4-1)/2), mean_rate, cell) k from o where i>=3 and i<n-4)
      select cell, mean_rate, 'low' kind from o where i<3 union all select cell, mean_rate, 'high' from o where i>=n-4 union all select cell, mean_rate, 'mid' from r where k<=5""",
    "mean_rate",
)
def low_mid_high_cells(spark, sf):
    e = V.table(spark, sf, "events").selectExpr("user_id cell", "value rate")
    return C.low_mid_high_cells(e, 12, 3, 4)


@check(
    "top_overlap",
    """with w as (select cell, max(score) filter (where room='A') a, max(score) filter (where room='B') b from ranks group by cell),
      r as (select *, row_number() over (order by a desc, cell)<=300 ia, row_number() over (order by b desc, cell)<=300 ib from w where a is not null and b is not null)
      select cell, a score_a, b score_b, case when ia and ib then 'both' when ia then 'a' when ib then 'b' else 'none' end overlap from r""",
    "score_a score_b",
)
def top_overlap(spark, sf):
    return C.top_overlap(V.ranks(spark, sf), "A", "B", 300)


@check(
    "top_n_threshold",
    """with r as (select *, row_number() over (partition by room order by score desc, cell) k from ranks)
      select room, cell, score, k<=50 is_top, avg(score) filter (where k in (50, 51)) over (partition by room) threshold from r""",
    "score threshold",
)
def top_n_threshold(spark, sf):
    return C.top_n_threshold(V.ranks(spark, sf), 50)


@check("limit_per_cluster", "select cell, cluster_label from (select vec_id cell, label cluster_label, row_number() over (partition by label order by vec_id) k from embeddings) where k<=7")
def limit_per_cluster(spark, sf):
    return C.limit_per_cluster(V.vectors(spark, sf), 7).select("cell", "cluster_label")


@check(
    "sample_per_room",
    """with p as (select distinct row_key, actual_room room from pred_long)
      select row_key, room from (select *, row_number() over (partition by room order by md5(concat_ws('|', 7, row_key)), row_key) r from p) where r<=100""",
)
def sample_per_room(spark, sf):
    p = V.pred_long(spark, sf).select("row_key", F.col("actual_room").alias("room")).distinct()
    return C.sample_per_room(p, 300, 3, seed=7)


@check(
    "peak_bin",
    """select cell, room, bx, "by", v peak from (select cell, room, bx, "by", "value" v, row_number() over (partition by cell, room order by "value" desc, "by", bx) k from cell_maps) where k=1""",
    "peak",
)
def peak_bin(spark, sf):
    return C.peak_bin(maps(spark, sf), ["cell", "room"])


@check(
    "first_groups",
    """select row_key, offset_no, fold, actual_room, predicted_room from pred_long where (fold, offset_no, actual_room, predicted_room) in
      (select fold, offset_no, actual_room, predicted_room from pred_long group by all order by 1, 2, 3, 4 limit 7)""",
)
def first_groups(spark, sf):
    p = V.pred_long(spark, sf).select("row_key", "offset_no", "fold", "actual_room", "predicted_room")
    return C.first_groups(p, ["fold", "offset_no", "actual_room", "predicted_room"], 7)


@check(
    "corr_by_block_labels",
    """with c as (select a.block, 'Cell_'||a.cell cell_a, 'Cell_'||b.cell cell_b, count(*) n, corr(a.rate, b.rate) r
      from hourly a join hourly b on a.block=b.block and a."hour"=b."hour" and 'Cell_'||a.cell<='Cell_'||b.cell group by all)
      select block, cell_a, cell_b, case when n<2 or isnan(r) then 0 else coalesce(r, 0) end r from c""",
    "r",
)
def corr_by_block_labels(spark, sf):
    """Cells named as in session tables."""
    return C.corr_by_block(hourly(spark, sf).withColumn("cell", F.concat(F.lit("Cell_"), "cell")), ["block"], "hour")


@check(
    "corr_by_hd_labels",
    """with t as (select cell, floor(((hd+15)%360)/30)::int ai, avg(rate) v from activity group by all),
      g as (select 'Cell_'||c.cell cell, i.ai, coalesce(v, 0) v from (select distinct cell from t) c, (select unnest(range(12)) ai) i left join t on t.cell=c.cell and t.ai=i.ai)
      select a.cell cell_a, b.cell cell_b, corr(a.v, b.v) r from g a join g b on a.ai=b.ai and a.cell<=b.cell group by all""",
    "r",
)
def corr_by_hd_labels(spark, sf):
    named = V.activity(spark, sf).withColumns({"_b": F.lit(1), "cell": F.concat(F.lit("Cell_"), "cell")})
    return C.corr_by_hd(named, ["_b"], 12).drop("_b")
