"""Spatial, polar and head-direction maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, define
from checks.room_checks import _ANGLES, inside_sql, lit_positions
from wayfield.operators import maps as M
from wayfield.operators import rooms as R
from wayfield.sources import views as V

N = 12  # nodes per axis over [0, 1]
STEP = "(1.0::double/11)"

define("spots", "select p.*, r.room from positions p join rooms r on p.ts>=r.t0 and p.ts<r.t1")
define("binned", f"select *, floor(x/{STEP})::int bx, floor(y/{STEP})::int \"by\" from spots where x>=0 and y>=0 and floor(x/{STEP})<=10 and floor(y/{STEP})<=10")
define("cell_maps", 'select cell, room, bx, "by", sum(spikes)/(count(*)*0.05::double) "value", count(*)*0.05::double occupancy from binned group by all')


def maps(spark, sf):
    return M.rate_map(lit_positions(spark, sf), ["cell", "room"], 0.05, N)


@check("rate_map", 'select * from cell_maps where occupancy>=0.08 and "value"*occupancy>=2', "value occupancy")
def rate_map(spark, sf):
    return M.rate_map(lit_positions(spark, sf), ["cell", "room"], 0.05, N, min_seconds=0.08, min_spikes=2)


define("err_rows", "select fold, predicted_room room, x, y, x_pred, y_pred from pred_long")


@check(
    "mse_map",
    f"""select room, floor(x/{STEP})::int bx, floor(y/{STEP})::int "by", avg(((x_pred-x)^2+(y_pred-y)^2)/4) "value" from err_rows
      where floor(x/{STEP}) between 0 and 10 and floor(y/{STEP}) between 0 and 10 group by all""",
    "value",
)
def mse_map(spark, sf):
    p = V.pred_long(spark, sf).withColumnRenamed("predicted_room", "room")
    return M.mse_map(p, ["room"], [("x", "x_pred"), ("y", "y_pred")], N)


define(
    "smooth_maps",
    """with k as (select i, exp(-i*i/8.0::double) w from unnest(range(-4, 5)) t(i)), n as (select sum(w) s from k)
      select m.cell, m.room, (m.bx+a.i)::int bx, (m."by"+b.i)::int "by", sum(m."value"*a.w*b.w/(s*s)) "value" from cell_maps m, k a, k b, n
      where m.bx+a.i between 0 and 11 and m."by"+b.i between 0 and 11 group by all""",
)


@check("smooth_map", "select * from smooth_maps", "value")
def smooth_map(spark, sf):
    return M.smooth_map(maps(spark, sf), ["cell", "room"], N)


def _mask_sql(shift: str, outside: str) -> str:
    src = f"""(select cell, room pr, bx, "by", "value", (bx+{shift})*{STEP} px, ("by"+{shift})*{STEP} py from cell_maps) m"""
    return f"""select cell, pr room, bx, "by", case when odd or border then "value" else {outside} end "value" from (
      {inside_sql(src, 'cell, pr, bx, "by", "value"', "px", "py", "pr").replace(f"group by cell", "group by px, py, cell")})"""


@check("mask_map", _mask_sql("0", "0"), "value")
def mask_map(spark, sf):
    return M.mask_map(maps(spark, sf).drop("occupancy"), V.POLYGONS, "room", N, 0.0, 1.0)


@check("mask_map_centres", _mask_sql("0.5::double", "null"), "value")
def mask_map_centres(spark, sf):
    return M.mask_map(maps(spark, sf).drop("occupancy"), V.POLYGONS, "room", N, 0.0, 1.0, at="centre")


define(
    "occ",
    """select *, n/sum(n) over (partition by room) share from (select room, floor(x*12)::int bx, floor(y*12)::int "by", count(*) n from spots
      where floor(x*12) between 0 and 11 and floor(y*12) between 0 and 11 group by all)""",
)


@check("occupancy", "select * exclude(n) from occ", "share", 8)
def occupancy(spark, sf):
    return M.occupancy(lit_positions(spark, sf), ["room"], 12)


@check("occupancy_weights", 'select row_id, share weight from spots s join occ o on o.room=s.room and floor(s.x*12)=bx and floor(s.y*12)=o."by"', "weight", 8)
def occupancy_weights(spark, sf):
    return M.occupancy_weights(lit_positions(spark, sf), ["room"], 12).select("row_id", "weight")


# three walls per frame: east, north, south-west
define(
    "walls3",
    """select row_id, cell, room, rate, spikes, unnest([0, 90, 200])::double angle, unnest([x, case when spikes=3 then null else y end, (x+y)/2]) d from spots""",
)
_W3 = [0.0, 90.0, 200.0]


def walls3(spark, sf):
    p = lit_positions(spark, sf)
    d = F.array(F.col("x"), F.when(F.col("spikes") != 3, F.col("y")), (F.col("x") + F.col("y")) / 2)
    return p.withColumn("distances", d)


def _polar(weight: str, agg: str) -> str:
    return f"""with w as (select *, coalesce({weight}, 0) u from walls3), n as (select *, u/sum(u) over (partition by row_id) w from w)
      select cell, floor(d/0.1)::int db, angle, {agg} "value", count(*) n_rows from n where d is not null and floor(d/0.1) between 0 and 9 group by all"""


define("polar_maps", _polar("exp(-d/0.1)", "sum(w*rate)/count(*)"))


@check("polar_map", "select * from polar_maps", "angle value")
def polar_map(spark, sf):
    return M.polar_map(walls3(spark, sf), ["cell"], "rate", _W3, 0.1, 1.0)


@check("polar_map_hz", _polar("1/(d+1e-5::double)", "sum(w*spikes)/(sum(w)*0.05)"), "angle value")
def polar_map_hz(spark, sf):
    return M.polar_map(walls3(spark, sf), ["cell"], "spikes", _W3, 0.1, 1.0, weighting="inv", dt=0.05)


@check("polar_map_uniform", _polar("(d<0.25)::int", "avg(rate)"), "angle value")
def polar_map_uniform(spark, sf):
    return M.polar_map(walls3(spark, sf), ["cell"], "rate", _W3, 0.1, 1.0, weighting="uniform_short")


@check(
    "smooth_polar",
    """with ka as (select j, exp(-j*j/2.0::double) w from unnest(range(-1, 2)) t(j)), kd as (select i, exp(-i*i/8.0::double) w from unnest(range(-2, 3)) t(i)),
      t as (select distinct cell, td, ta from polar_maps, unnest(range(10)) x(td), unnest(range(3)) z(ta)),
      n as (select cell, td, ta, i, j, kd.w/(select sum(w) from kd)*ka.w/(select sum(w) from ka) w, greatest(0, least(9, td+i)) sd, (ta+j+3)%3 sa from t, kd, ka),
      v as (select n.*, p."value" v from n left join polar_maps p on p.cell=n.cell and p.db=n.sd and p.angle=[0.0,90.0,200.0][n.sa+1])
      select cell, td::int db, [0.0,90.0,200.0][ta+1]::double angle, case when count(v)=15 then sum(w*v) end "value" from v group by all having count(v)>0""",
    "angle value",
)
def smooth_polar(spark, sf):
    p = M.polar_map(walls3(spark, sf), ["cell"], "rate", _W3, 0.1, 1.0)
    return M.smooth_polar(p, ["cell"], 10, _W3, (2.0, 1.0), (5, 3))


@check(
    "smooth_polar_median",
    """with t as (select distinct cell, td, ta from polar_maps, unnest(range(10)) x(td), unnest(range(3)) z(ta)),
      n as (select cell, td, ta, coalesce(p."value", 0) v, p."value" is not null hit from (select t.*, td+i sd, ta+j sa from t, unnest(range(-1, 2)) a(i), unnest(range(-1, 2)) b(j)) t
        left join polar_maps p using (cell) where false
        union all select t.cell, td, ta, coalesce(p."value", 0), p."value" is not null from (select t.*, td+i sd, ta+j sa from t, unnest(range(-1, 2)) a(i), unnest(range(-1, 2)) b(j)) t
        left join polar_maps p on p.cell=t.cell and p.db=sd and sa between 0 and 2 and p.angle=[0.0,90.0,200.0][sa+1])
      select cell, td::int db, [0.0,90.0,200.0][ta+1]::double angle, median(v) "value" from n group by all having bool_or(hit)""",
    "angle value",
)
def smooth_polar_median(spark, sf):
    p = M.polar_map(walls3(spark, sf), ["cell"], "rate", _W3, 0.1, 1.0)
    return M.smooth_polar(p, ["cell"], 10, _W3, size=(3, 3), method="median")


define("sector_maps", 'select cell, (floor(rate/100))::int db, (floor(hd/36)*36)::double angle, avg(spikes) "value" from positions group by all')


@check(
    "wrap_column",
    """select * from sector_maps union all select cell, db, angle+360, "value" from sector_maps where angle=0""", "angle value",
)
def wrap_column(spark, sf):
    p = V.positions(spark, sf).groupBy("cell", F.floor(F.col("rate") / 100).cast("int").alias("db"), (F.floor(F.col("hd") / 36) * 36).cast("double").alias("angle"))
    return M.wrap_column(p.agg(F.avg("spikes").alias("value")), ["cell"])


_A12 = [30.0 * i for i in range(12)]
define("tuning", 'select cell, (floor(hd/30+0.5)%12)::int ai, avg(rate) "value", count(*) n_rows from activity group by all')


@check("hd_tuning", "select * from tuning", "value")
def hd_tuning(spark, sf):
    return M.hd_tuning(V.activity(spark, sf), ["cell"], _A12)


@check(
    "hd_tuning_uneven",
    """select cell, ai, avg(rate) "value", count(*) n_rows from (select row_id, cell, rate, arg_min(i, abs(((hd-a+180)%360+360)%360-180)*1000+i*1e-6)::int ai from activity,
      (select unnest([0, 1, 2, 3]) i, unnest([10, 50, 130, 250])::double a) group by all) group by all""",
    "value",
)
def hd_tuning_uneven(spark, sf):
    return M.hd_tuning(V.activity(spark, sf), ["cell"], [10.0, 50.0, 130.0, 250.0])


@check(
    "smooth_hd",
    """select t.cell, ((t.ai+j+12)%12)::int ai, sum(t."value"*exp(-j*j/2.0::double))/(select sum(exp(-j*j/2.0::double)) from unnest(range(-2, 3)) u(j)) "value"
      from tuning t, unnest(range(-2, 3)) k(j) group by all having count(*)=5""",
    "value",
)
def smooth_hd(spark, sf):
    return M.smooth_hd(M.hd_tuning(V.activity(spark, sf), ["cell"], _A12), ["cell"], 12)


@check(
    "smooth_hd_median",
    """select t.cell, ((t.ai+j+12)%12)::int ai, median(t."value") "value" from tuning t, unnest(range(-1, 2)) k(j) group by all having count(*)=3""", "value",
)
def smooth_hd_median(spark, sf):
    return M.smooth_hd(M.hd_tuning(V.activity(spark, sf), ["cell"], _A12), ["cell"], 12, size=3, method="median")


@check("hd_corr_bins", 'select cell, floor(((hd+5)%360)/10)::int ai, avg(rate) "value" from activity group by all', "value")
def hd_corr_bins(spark, sf):
    return M.hd_sectors(V.activity(spark, sf), ["cell"], 36)


# coarse grid so that most bins have every heading: 3 nodes, 2 bins a side, 8 headings
_A8 = [45.0 * i for i in range(8)]
define(
    "field",
    """with f as (select room, floor(x/0.5)::int bx, floor(y/0.5)::int "by", (floor(hd/45+0.5)%8)::int ai, rate from spots where x<1 and y<1),
      t as (select room, bx, "by", ai, avg(rate) v, count(*) n from f group by all),
      s as (select room, bx, "by", (ai+j+8)%8 ai, sum(v*exp(-j*j/2.0::double))/(select sum(exp(-j*j/2.0::double)) from unnest(range(-2, 3)) u(j)) v from t, unnest(range(-2, 3)) k(j) group by all having count(*)=5),
      p as (select room, bx, "by", degrees(atan2(sum(v*sin(radians(ai*45))), sum(v*cos(radians(ai*45))))) pref from s group by all),
      m as (select s.room, s.bx, s."by", arg_min(v, abs(((ai*45-pref+180)%360+360)%360-180)) magnitude, any_value(pref) pref from s join p on p.room=s.room and p.bx=s.bx and p."by"=s."by" group by all),
      b as (select room, bx, "by", sum(n)*0.05>=30 ok from t group by all)
      select b.room, b.bx, b."by", case when ok and pref is not null then cos(radians(pref)) else 0 end u, case when ok and pref is not null then sin(radians(pref)) else 0 end v,
        case when ok and pref is not null then magnitude else 0 end magnitude from b left join m on m.room=b.room and m.bx=b.bx and m."by"=b."by" """,
)


def field(spark, sf):
    return M.vector_field(lit_positions(spark, sf), ["room"], _A8, 0.05, 3, 0.0, 1.0, min_seconds=30.0)


@check("vector_field", "select * from field", "u v magnitude")
def vector_field(spark, sf):
    return field(spark, sf)


@check(
    "smooth_field",
    """with t as (select distinct room, tx, ty from field, unnest([0, 1]) a(tx), unnest([0, 1]) b(ty)),
      n as (select t.*, greatest(0, least(1, tx+i)) sx, greatest(0, least(1, ty+j)) sy, exp(-(i*i+j*j)/2.0::double)/(select sum(exp(-(i*i+j*j)/2.0::double)) from unnest(range(-1,2)) p(i), unnest(range(-1,2)) q(j)) w
        from t, unnest(range(-1, 2)) p(i), unnest(range(-1, 2)) q(j)),
      s as (select n.room, tx, ty, sum(w*u) u, sum(w*v) v, sum(w*magnitude) magnitude from n join field f on f.room=n.room and f.bx=sx and f."by"=sy group by all)
      select room, tx::int bx, ty::int "by", case when sqrt(u*u+v*v)>1e-10 then u/sqrt(u*u+v*v) else u end u, case when sqrt(u*u+v*v)>1e-10 then v/sqrt(u*u+v*v) else v end v, magnitude from s""",
    "u v magnitude",
)
def smooth_field(spark, sf):
    return M.smooth_field(field(spark, sf), ["room"], 2, 1.0, 3)


@check("combine_rooms", """select cell, bx, "by", arg_max("value", case room when 'A' then 1 when 'B' then 2 else 3 end) "value" from cell_maps group by all""", "value")
def combine_rooms(spark, sf):
    return M.combine_rooms(maps(spark, sf), ["cell"], ["A", "B", "a"])


@check(
    "mean_p_map",
    'select room, bx, "by", avg(p) "value", count(*) n_rows from binned group by all having count(*)>=20', "value",
)
def mean_p_map(spark, sf):
    return M.mean_map(lit_positions(spark, sf), ["room"], "p", N, min_count=20)


# every pair of rooms of a cell; the key "cell" names both
define(
    "map_pairs",
    """select coalesce(a.cell, b.cell) cell, coalesce(a.bx, b.bx) bx, coalesce(a."by", b."by") "by", a."value" a, b."value" b
      from (select * replace (concat_ws(' ', cell, pair) as cell) from cell_maps, (select unnest(['A-B', 'A-a', 'B-a']) pair) where room=split_part(pair, '-', 1)) a
      full join (select * replace (concat_ws(' ', cell, pair) as cell) from cell_maps, (select unnest(['A-B', 'A-a', 'B-a']) pair) where room=split_part(pair, '-', 2)) b
        on a.cell=b.cell and a.bx=b.bx and a."by"=b."by" """,
)


def map_pairs(spark, sf):
    pairs = F.explode(F.array(*(F.lit(f"{a}-{b}") for a, b in V.PAIRS)))
    m = maps(spark, sf).withColumn("pair", pairs).withColumn("cell", F.concat_ws(" ", F.col("cell").cast("string"), "pair"))
    side = lambda i: m.filter(F.col("room") == F.get(F.split("pair", "-"), F.lit(i))).drop("pair")
    return M.paired_maps(side(0), side(1), ["cell"])


@check("map_correlation", "select cell, corr(a, b) correlation from map_pairs where a is not null and b is not null group by cell", "correlation")
def map_correlation(spark, sf):
    return M.map_correlation(map_pairs(spark, sf), ["cell"])


@check("jaccard", "select cell, count(*) filter (where a is not null and b is not null)/count(*) jaccard from map_pairs group by cell", "jaccard")
def jaccard(spark, sf):
    return M.jaccard(map_pairs(spark, sf), ["cell"])


define("map_dist", "select cell, coalesce(a/sum(a) over (partition by cell), 1e-10) p, coalesce(b/sum(b) over (partition by cell), 1e-10) q from map_pairs")


@check("map_kl", "select cell, sum(case when p>0 then p*ln(p/case when q=0 then 1e-10 else q end) else 0 end) kl from map_dist group by cell", "kl")
def map_kl(spark, sf):
    return M.map_kl(map_pairs(spark, sf), ["cell"])


@check(
    "map_js",
    """with s as (select cell, p/(sum(p) over w+(121-count(*) over w)*1e-10) p, q/(sum(q) over w+(121-count(*) over w)*1e-10) q from map_dist window w as (partition by cell))
      select cell, sqrt(sum(case when p>0 then p*ln(p/((p+q)/2)) else 0 end+case when q>0 then q*ln(q/((p+q)/2)) else 0 end)/2) js from s group by cell""",
    "js",
)
def map_js(spark, sf):
    return M.map_js(map_pairs(spark, sf), ["cell"], 121)


define(
    "map_emd",
    """with m as (select cell, 'x' axis, bx i, coalesce(a, 0) a, coalesce(b, 0) b from map_pairs union all select cell, 'y', "by", coalesce(a, 0), coalesce(b, 0) from map_pairs),
      g as (select c.cell, x.axis, u.i, coalesce(sum(a), 0) a, coalesce(sum(b), 0) b from (select distinct cell from map_pairs) c, unnest(['x','y']) x(axis), unnest(range(11)) u(i)
        left join m on m.cell=c.cell and m.axis=x.axis and m.i=u.i group by all),
      d as (select *, sum(a) over w/sum(a) over (partition by cell, axis)-sum(b) over w/sum(b) over (partition by cell, axis) gap from g window w as (partition by cell, axis order by i))
      select cell, sum(abs(gap)) filter (where axis='x') emd_x, sum(abs(gap)) filter (where axis='y') emd_y from d group by cell""",
)


@check("map_emd_marginal", "select *, sqrt(emd_x^2+emd_y^2) emd_bound from map_emd", "emd_x emd_y emd_bound")
def map_emd_marginal(spark, sf):
    return M.map_emd_marginal(map_pairs(spark, sf), ["cell"])


# mapped positions: true position to prediction
define("points", "select predicted_room room, x sx, y sy, x_pred tx, y_pred ty from pred_long")


def points(spark, sf):
    return V.pred_long(spark, sf).selectExpr("predicted_room room", "x sx", "y sy", "x_pred tx", "y_pred ty")


def _node(c: str) -> str:
    return f"least(11, greatest(0, ceil({c}/{STEP}-0.5)))::int"


@check(
    "bin_average_mapping",
    f"""select room, {_node('sx')} gx, {_node('sy')} gy, avg(sx) sx, avg(sy) sy, avg(tx) tx, avg(ty) ty, count(*) n_points from points
      group by 1, 2, 3 having count(*)>=5""",
    "sx sy tx ty",
)
def bin_average_mapping(spark, sf):
    return M.bin_average_mapping(points(spark, sf), ["room"], N, 0.0, 1.0, min_points=5)


@check(
    "snap_mapping",
    f"""select room, {_node('sx')}*{STEP} sx, {_node('sy')}*{STEP} sy, {_node('tx')}*{STEP} tx, {_node('ty')}*{STEP} ty, count(*) n from points group by 1, 2, 3, 4, 5""",
    "sx sy tx ty",
)
def snap_mapping(spark, sf):
    snapped = M.snap_mapping(points(spark, sf), N, 0.0, 1.0)
    return snapped.groupBy("room", "sx", "sy", "tx", "ty").agg(F.count(F.lit(1)).alias("n"))


define("nodes12", f"select gx::int gx, gy::int gy, gx*{STEP} nx, gy*{STEP} ny from unnest(range(12)) a(gx), unnest(range(12)) b(gy)")


@check(
    "kernel_mapping",
    """with w as (select room, gx, gy, exp(-0.5*((sx-nx)^2+(sy-ny)^2)/0.0016) w, sx, sy, tx, ty from points cross join nodes12 where (sx-nx)^2+(sy-ny)^2<=0.12^2)
      select room, gx, gy, sum(w*sx)/sum(w) sx, sum(w*sy)/sum(w) sy, sum(w*tx)/sum(w) tx, sum(w*ty)/sum(w) ty, count(*) n_points from w group by all having count(*)>=5 and sum(w)>=1e-3""",
    "sx sy tx ty",
)
def kernel_mapping(spark, sf):
    return M.kernel_mapping(points(spark, sf), ["room"], N, 0.0, 1.0, 0.04)


@check(
    "kernel_mapping_exact",
    """with n as (select gx::int gx, gy::int gy, gx/4.0::double nx, gy/4.0::double ny from unnest(range(5)) a(gx), unnest(range(5)) b(gy)),
      w as (select room, gx, gy, exp(-0.5*((sx-nx)^2+(sy-ny)^2)/0.01) w, tx, ty from points, n)
      select room, gx, gy, case when sum(w)>1e-3 then sum(w*tx)/sum(w) else 0 end tx, case when sum(w)>1e-3 then sum(w*ty)/sum(w) else 0 end ty from w group by all""",
    "tx ty",
)
def kernel_mapping_exact(spark, sf):
    return M.kernel_mapping_exact(points(spark, sf), ["room"], 5, 0.0, 1.0, 0.1)


define(
    "wall_nodes",
    f"""with g as (select n.*, r.room nr from nodes12 n, (select distinct room from boundary) r),
      i as ({inside_sql("g", "gx, gy, nx, ny, nr", "nx", "ny", "nr")})
      select a.nr room, a.gx bx, a.gy "by", min(sqrt((a.gx-b.gx)^2+(a.gy-b.gy)^2)) distance from i a left join i b on b.nr=a.nr and not (b.odd or b.border)
      where a.odd or a.border group by all""",
)
define(
    "border_best",
    """with q as (select m.cell, m.room, quantile_cont(m."value", 0.3) q from smooth_maps m join wall_nodes w on w.room=m.room and w.bx=m.bx and w."by"=m."by" where m."value">0 group by all),
      p as (select q.cell, w.room, w.distance, case when m."value">=q.q then m."value" else 0 end v from q join wall_nodes w on w.room=q.room
        left join smooth_maps m on m.cell=q.cell and m.room=w.room and m.bx=w.bx and m."by"=w."by"),
      s as (select cell, room, a start, b stop, count(*) filter (where distance>a and distance<=b)::double si, count(*)::double n, coalesce(sum(v) filter (where distance>a and distance<=b), 0) pi, sum(v) p
        from p, unnest(range(5)) x(a), unnest(range(5)) y(b) where b>a and b-a>=1 group by all),
      c as (select *, (pi*(n-si)-(p-pi)*si)/nullif(pi*(n-si)+(p-pi)*si, 0) score from s where si>0 and n>si and si/n<=0.5)
      select cell, room, score, start::int start, stop::int stop from (select *, row_number() over (partition by cell, room order by score desc, start, stop) rn from c where score is not null) where rn=1""",
)


def border_inputs(spark, sf):
    smooth = M.smooth_map(maps(spark, sf), ["cell", "room"], N)
    walls = M.wall_distances(smooth, V.POLYGONS, N, 0.0, 1.0)
    return smooth, walls


@check("border_score", "select * from border_best", "score")
def border_score(spark, sf):
    smooth, walls = border_inputs(spark, sf)
    return M.border_score(smooth, walls, ["cell"], 0.3, end=4, max_width=None, min_width=1)


define(
    "border_field",
    """select b.cell, b.room, w.bx, w."by", case when m."value">0 and m."value">=q.q then m."value" else 0 end v
      from border_best b join wall_nodes w on w.room=b.room and w.distance>b.start and w.distance<=b.stop
        left join smooth_maps m on m.cell=b.cell and m.room=b.room and m.bx=w.bx and m."by"=w."by"
        join (select m.cell, m.room, quantile_cont(m."value", 0.3) q from smooth_maps m join wall_nodes w on w.room=m.room and w.bx=m.bx and w."by"=m."by"
          where m."value">0 group by all) q on q.cell=b.cell and q.room=b.room""",
)


@check(
    "border_length",
    """with recursive f as (select *, max(v) over (partition by cell, room) peak,
        row_number() over (partition by cell, room order by v desc, "by", bx) k from border_field),
      strong as (select * from f where peak>0 and v>=0.3*peak),
      fill as (select cell, room, bx, "by" from strong where k=1 union
        select s.cell, s.room, s.bx, s."by" from fill join strong s on s.cell=fill.cell and s.room=fill.room and abs(s.bx-fill.bx)<=1 and abs(s."by"-fill."by")<=1)
      select a.cell, a.room, coalesce(c, 0)/n length_score from (select cell, room, count(*) n from f group by all) a
      left join (select cell, room, count(*) c from fill group by all) b on b.cell=a.cell and b.room=a.room""",
    "length_score",
)
def border_length(spark, sf):
    smooth, walls = border_inputs(spark, sf)
    scores = M.border_score(smooth, walls, ["cell"], 0.3, end=4, max_width=None, min_width=1)
    return M.border_length(smooth, walls, scores, ["cell"], 0.3)


@check(
    "polar_map_from_positions",
    """with w as (select *, exp(-distance/0.1) u from ray_distances), n as (select *, u/sum(u) over (partition by row_id) w from w)
      select room, floor(distance/0.1)::int db, angle, avg(w) "value", count(*) n_rows from n where floor(distance/0.1) between 0 and 11 group by all""",
    "angle value",
)
def polar_map_from_positions(spark, sf):
    rows = R.ray_distances(lit_positions(spark, sf), _ANGLES, V.POLYGONS).withColumn("unit", F.lit(1.0))
    return M.polar_map(rows, ["room"], "unit", _ANGLES, 0.1, 1.2)
