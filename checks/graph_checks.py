"""Neighbour joins and graph smoothness."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.affine_checks import room_fit
from checks.map_checks import map_pairs
from checks.registry import check, define
from wayfield.operators import affine as A
from wayfield.operators import graphs as G
from wayfield.operators import rooms as R
from wayfield.session import stored
from wayfield.sources import views as V

# points: positions of events, mapped to (hd, rate); groups: sessions modulo nothing, that is one per cell
define("gpoints", "select row_id id, cell, x sx, y sy, hd/360 tx, rate/400 ty from positions")


def gpoints(spark, sf):
    return V.positions(spark, sf).selectExpr("row_id id", "cell", "x sx", "y sy", "hd/360 tx", "rate/400 ty")


define("gnodes", "select gx::int gx, gy::int gy, gx/20.0::double x, gy/20.0::double y from (select unnest(range(21)) gx), (select unnest(range(21)) gy)")


def gnodes(spark, sf):
    # the grid of the unit square, where positions lie
    return R.grid_nodes(spark.range(1).select(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), 21)


@check(
    "near_points_join",
    "select cell, gx, gy, x, y from gnodes g, (select distinct cell from gpoints) c where exists (select 1 from gpoints p where p.cell=c.cell and (p.sx-g.x)^2+(p.sy-g.y)^2<0.02^2)", "x y",
)
def near_points_join(spark, sf):
    pts = gpoints(spark, sf).selectExpr("cell", "sx px", "sy py")
    nodes = pts.select("cell").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(440)))).selectExpr("cell", "cast(n div 21 as int) gx", "cast(n % 21 as int) gy")
    return G.near_points_join(nodes.withColumns({"x": F.expr("gx / 20D"), "y": F.expr("gy / 20D")}), pts, 0.02, ["cell"])


@check(
    "radius_join",
    "select gx, gy, id, sqrt((p.sx-g.x)^2+(p.sy-g.y)^2) distance from gnodes g join gpoints p on (p.sx-g.x)^2+(p.sy-g.y)^2<=0.03*0.03", "distance",
)
def radius_join(spark, sf):
    pts = gpoints(spark, sf).selectExpr("id", "sx px", "sy py")
    return G.radius_join(gnodes(spark, sf), pts, 0.03).select("gx", "gy", "id", "distance")


def _near(k: int) -> str:
    return f"""select cell, i, j, distance from (select a.cell, a.id i, b.id j, sqrt((a.sx-b.sx)^2+(a.sy-b.sy)^2) distance,
      row_number() over (partition by a.id order by sqrt((a.sx-b.sx)^2+(a.sy-b.sy)^2), b.id) k
      from gpoints a join gpoints b on a.cell=b.cell and a.id<>b.id) where k<={k}"""


define("gknn", _near(6))
# residuals are compared with the hundred nearest points
RESIDUAL_K = 100
define("gknn_wide", _near(RESIDUAL_K))


@check("knn_join", "select * from gknn", "distance", 9)
def knn_join(spark, sf):
    return G.knn_join(gpoints(spark, sf), 6, ["cell"], "sx", "sy")


def _edges(near: str) -> str:
    return f"""with w as (select k.cell, i, j, exp(-(distance*distance)/(2*s*s)) w from {near} k join (select cell, median(distance) s from {near} where distance>0 group by cell) m on m.cell=k.cell)
      select cell, i, j, sum(w) w from (select cell, i, j, w from w union all select cell, j, i, w from w) group by cell, i, j"""


def _degrees(edges: str) -> str:
    return f"select p.*, coalesce(d, 0) d, 1/(sqrt(coalesce(d, 0))+1e-8::double) s from gpoints p left join (select i, sum(w) d from {edges} group by i) e on e.i=p.id"


define("gedges", _edges("gknn"))
define("gdeg", _degrees("gedges"))
define("gedges_wide", _edges("gknn_wide"))
define("gdeg_wide", _degrees("gedges_wide"))
_SIG = ("sx", "sy", "tx", "ty")


def _energy(edges: str, deg: str, keys: str) -> str:
    own = ", ".join(f"sum(d*s*s*{c}*{c}) o_{c}" for c in _SIG)
    cross = ", ".join(f"sum(e.w*a.s*b.s*a.{c}*b.{c}) x_{c}" for c in _SIG)
    return f"""select {keys}, n, sqrt(f1+f2) fro, {', '.join(f"o_{c}-x_{c} e_{c}" for c in _SIG)} from (select {keys}, count(*) n, sum((d*s*s)^2) f1, {own} from {deg} group by {keys})
      join (select e.{keys}, sum((e.w*a.s*b.s)^2) f2, {cross} from {edges} e join {deg} a on a.id=e.i join {deg} b on b.id=e.j group by e.{keys}) using ({keys})"""


_LAP = "(e_tx-e_sx)/(fro*n) lap_x, (e_ty-e_sy)/(fro*n) lap_y, ((e_tx-e_sx)+(e_ty-e_sy))/(2*fro*n) lap"


@check("knn_laplacian", f"select *, {_LAP} from ({_energy('gedges', 'gdeg', 'cell')})", "fro e_sx e_sy e_tx e_ty lap_x lap_y lap")
def knn_laplacian(spark, sf):
    return G.knn_laplacian(gpoints(spark, sf), 6, ["cell"])


@check(
    "residual_energy",
    """with r as (select f.room, f.fold, g.id, g.tx-(a*g.sx+b*g.sy+f.tx) rx, g.ty-(c*g.sx+d*g.sy+f.ty) ry from gpoints g join room_fit f on true),
      g as (select d.cell, room, fold, d.id, d.d, rx, ry from gdeg_wide d join r on r.id=d.id)
      select cell, room, fold, n, o-x energy from (select cell, room, fold, count(*) n, sum(d*(rx^2+ry^2)) o from g group by all)
      join (select e.cell, a.room, a.fold, sum(w*(a.rx*b.rx+a.ry*b.ry)) x from gedges_wide e join g a on a.id=e.i join g b on b.id=e.j and b.room=a.room and b.fold=a.fold group by all)
        using (cell, room, fold)""",
    "energy",
)
def residual_energy(spark, sf):
    # a map per room and fold
    maps = room_fit(spark, sf).select("room", "fold", "a", "b", F.col("tx").alias("mx"), "c", "d", F.col("ty").alias("my"))
    return G.residual_energy(gpoints(spark, sf), stored(maps), RESIDUAL_K, ["cell"])


define("lattice", "select row_id id, cell, floor(x*40) sx, floor(y*40) sy, hd/10 tx, rate/10 ty from positions")


def lattice(spark, sf):
    return V.positions(spark, sf).selectExpr("row_id id", "cell", "cast(floor(x*40) as double) sx", "cast(floor(y*40) as double) sy", "hd/10 tx", "rate/10 ty")


define(
    "lattice_edges",
    """select a.cell, a.id i, b.j, m.w from lattice a, (select dx, dy, case when dx<>0 and dy<>0 then 1/sqrt(2) else 1 end w from (select unnest([-1, 0, 1]) dx), (select unnest([-1, 0, 1]) dy) where dx<>0 or dy<>0) m,
      (select cell, sx, sy, min(id) j from lattice group by all) b where b.cell=a.cell and b.sx=a.sx+m.dx and b.sy=a.sy+m.dy and a.id<>b.j""",
)


@check("grid_neighbour_join", "select * from lattice_edges", "w")
def grid_neighbour_join(spark, sf):
    return G.grid_neighbour_join(lattice(spark, sf), ["cell"], x="sx", y="sy")


define("lattice_sym", "select cell, i, j, least(sum(w)/2, 1) w from (select cell, i, j, w from lattice_edges union all select cell, j, i, w from lattice_edges) group by cell, i, j")
define("lattice_deg", "select p.*, coalesce(d, 0) d, 1/(sqrt(coalesce(d, 0))+1e-8::double) s from lattice p left join (select i, sum(w) d from lattice_sym group by i) e on e.i=p.id")


@check(
    "grid_laplacian",
    f"""select *, exp(-lap) lap_exp, e_source/greatest(e_target, 1e-12) lap_ratio, case when lap>-1 then 1/(1+lap) end lap_inv, e_target-e_source de, (e_target-e_source)/(e_source+1e-12::double) de_over_e
      from (select *, {_LAP}, e_sx+e_sy e_source, e_tx+e_ty e_target from ({_energy('lattice_sym', 'lattice_deg', 'cell')}))""",
    "fro e_sx e_sy e_tx e_ty lap_x lap_y lap e_source e_target lap_exp lap_ratio lap_inv de de_over_e",
)
def grid_laplacian(spark, sf):
    return G.grid_laplacian(lattice(spark, sf), ["cell"])


define("mbins", 'select bx, "by" from (select unnest(range(11)) bx), (select unnest(range(11)) "by")')
define(
    "mgraph",
    """with d as (select a.bx ax, a."by" ay, b.bx, b."by", sqrt((a.bx-b.bx)^2+(a."by"-b."by")^2) d from mbins a, mbins b),
      w as (select *, exp(-(d*d)/(2*(select median(d) from d)^2)) w from d), g as (select ax, ay, sum(w) g from w group by all)
      select w.ax, w.ay, w.bx, w."by", (case when w.ax=w.bx and w.ay=w."by" then g1.g else 0 end-w)/sqrt(g1.g*g2.g) l from w join g g1 on g1.ax=w.ax and g1.ay=w.ay join g g2 on g2.ax=w.bx and g2.ay=w."by" """,
)
_MLAP = """select a.cell, sum(l*(coalesce(a.b, 0)*coalesce(b.b, 0)-coalesce(a.a, 0)*coalesce(b.a, 0)))/((select sqrt(sum(l*l)) from mgraph)*121) laplacian
      from map_pairs a join mgraph g on g.ax=a.bx and g.ay=a."by" join map_pairs b on b.cell=a.cell and b.bx=g.bx and b."by"=g."by" group by a.cell"""


@check("map_laplacian", _MLAP, "laplacian")
def map_laplacian(spark, sf):
    return G.map_laplacian(map_pairs(spark, sf), ["cell"], 11)


@check(
    "map_stats",
    f"""select l.cell, laplacian, emd_x, emd_y, sqrt(emd_x^2+emd_y^2) emd_bound, k.kl, c.correlation, j.js from ({_MLAP}) l join map_emd e on e.cell=l.cell
      join (select cell, sum(case when p>0 then p*ln(p/case when q=0 then 1e-10 else q end) else 0 end) kl from map_dist group by cell) k on k.cell=l.cell
      join (select cell, corr(a, b) correlation from map_pairs where a is not null and b is not null group by cell) c on c.cell=l.cell
      join (select cell, sqrt(sum(case when p>0 then p*ln(p/((p+q)/2)) else 0 end+case when q>0 then q*ln(q/((p+q)/2)) else 0 end)/2) js from (
        select cell, p/(sum(p) over w+(121-count(*) over w)*1e-10) p, q/(sum(q) over w+(121-count(*) over w)*1e-10) q from map_dist window w as (partition by cell)) group by cell) j on j.cell=l.cell""",
    "laplacian emd_x emd_y emd_bound kl correlation js",
)
def map_stats(spark, sf):
    return G.map_stats(map_pairs(spark, sf), ["cell"], 11)
