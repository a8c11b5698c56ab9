"""Affine maps between rooms' predicted positions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from checks.registry import check, define
from checks.room_checks import inside_sql
from wayfield.operators import affine as A
from wayfield.operators import decoding as D
from wayfield.plans import mapping as P
from wayfield.session import stored
from wayfield.sources import views as V

KEYS = ["row_key", "offset_no", "fold"]
ROOM_NAMES = ["A", "B", "a"]

define(
    "wide_pred",
    "select row_key, offset_no, fold, min(actual_room) room, min(x) x, min(y) y, "
    + ", ".join(
        f"max(case when predicted_room='{r}' then {p} end) {p}_{r}{'2' if r == 'a' else ''}" for r in ROOM_NAMES for p in ("x_pred", "y_pred")
    )
    + " from pred_long group by row_key, offset_no, fold",
)
define(
    "pair_points",
    """select row_key, offset_no, fold, s source_room, t target_room, sx, sy, tx, ty from (
      select *, 'A' s, 'B' t, x_pred_A sx, y_pred_A sy, x_pred_B tx, y_pred_B ty from wide_pred where room in ('A','B')
      union all select *, 'A', 'a', x_pred_A, y_pred_A, x_pred_a2, y_pred_a2 from wide_pred where room in ('A','a')
      union all select *, 'B', 'a', x_pred_B, y_pred_B, x_pred_a2, y_pred_a2 from wide_pred where room in ('B','a'))""",
)
define(
    "kept_pairs",
    """with n as (select source_room, target_room from pair_points group by all having count(*)>=10),
      p as (select pair_points.* from pair_points join n using (source_room, target_room)),
      si as ("""
    + inside_sql("p", "row_key, offset_no, fold, source_room, target_room", "sx", "sy", "source_room")
    + "), ti as ("
    + inside_sql("p", "row_key, offset_no, fold, source_room, target_room", "tx", "ty", "target_room")
    + """)
      select p.* replace (sx-cs.cx as sx, sy-cs.cy as sy, tx-ct.cx as tx, ty-ct.cy as ty)
      from p join si using (row_key, offset_no, fold, source_room, target_room)
        join ti using (row_key, offset_no, fold, source_room, target_room)
        join centroids cs on cs.room=source_room join centroids ct on ct.room=target_room
      where si.odd and not si.border and ti.odd and not ti.border""",
)


def fit_sql(source: str, keys: str, sx: str, sy: str, tx: str, ty: str) -> str:
    return f"""select {keys}, n, (cxu*vy-cyu*cxy)/det a, (cyu*vx-cxu*cxy)/det b, mu-(cxu*vy-cyu*cxy)/det*mx-(cyu*vx-cxu*cxy)/det*my tx,
      (cxv*vy-cyv*cxy)/det c, (cyv*vx-cxv*cxy)/det d, mv-(cxv*vy-cyv*cxy)/det*mx-(cyv*vx-cxv*cxy)/det*my ty from (
      select *, case when vx*vy-cxy*cxy>1e-12*greatest(vx*vy, 1e-300) then vx*vy-cxy*cxy end det from (
        select {keys}, count(*) n, avg({sx}) mx, avg({sy}) my, avg({tx}) mu, avg({ty}) mv, var_pop({sx}) vx, var_pop({sy}) vy,
          covar_pop({sx},{sy}) cxy, covar_pop({sx},{tx}) cxu, covar_pop({sy},{tx}) cyu, covar_pop({sx},{ty}) cxv, covar_pop({sy},{ty}) cyv
        from {source} group by {keys}))"""


def decompose_sql(source: str) -> str:
    return f"""select *, a*d-b*c<0 reflection,
      case when a*d-b*c<0 then ((degrees(atan2(b+c,a-d))/2)%180+180)%180 else (degrees(atan2(c-b,a+d))%360+360)%360 end angle_deg,
      (sqrt((a+d)^2+(c-b)^2)+sqrt((a-d)^2+(b+c)^2))/2 max_eigenvalue,
      abs(sqrt((a+d)^2+(c-b)^2)-sqrt((a-d)^2+(b+c)^2))/2 min_eigenvalue from ({source})"""


define("pair_fit", fit_sql("kept_pairs", "source_room, target_room", "sx", "sy", "tx", "ty"))


def wide(spark, sf):
    """Prediction table, one row per frame: targets joined to the pivoted predictions by the same aggregate."""
    long = V.pred_long(spark, sf, by=["row_key"])
    name = D.column_suffixes(ROOM_NAMES)
    picks = [
        F.max(F.when(F.col("predicted_room") == r, F.col(p))).alias(f"{p}_{name[r]}") for r in ROOM_NAMES for p in ("x_pred", "y_pred")
    ]
    # the room is a key: numeric buffers alone keep the aggregate hash-based
    return long.groupBy(*KEYS, F.col("actual_room").alias("room")).agg(F.min("x").alias("x"), F.min("y").alias("y"), *picks)


@check(
    "mapping_stats",
    f"""with f as ({decompose_sql("select * from pair_fit")}),
      q as (select source_room, target_room, sum((k.tx-(a*sx+b*sy+f.tx))^2+(k.ty-(c*sx+d*sy+f.ty))^2) sse, count(*) n,
        count(*)*(var_pop(k.tx)+var_pop(k.ty)) sst from kept_pairs k join f using (source_room, target_room) group by all)
      select source_room, target_room, greatest(0, 1-sse/sst) affinity_r2, sqrt(sse/q.n)*100 rmse_cm, angle_deg, reflection,
        max_eigenvalue, min_eigenvalue from f join q using (source_room, target_room)""",
    "affinity_r2 rmse_cm angle_deg max_eigenvalue min_eigenvalue",
)
def mapping_stats(spark, sf):
    return P.mapping_stats(wide(spark, sf), V.PAIRS, V.POLYGONS, cm_per_unit=100.0)


# one map per part: from the lines' positions to their predictions
define("part_points", "select l_partkey cell, l_quantity/50 sx, l_extendedprice/105000 sy, l_discount*10 tx, l_tax*10 ty from lineitem")
define("part_fit", fit_sql("part_points", "cell", "sx", "sy", "tx", "ty"))
MAPS = "a b tx c d ty"


def part_points(spark, sf):
    return V.table(spark, sf, "lineitem").selectExpr(
        "l_partkey cell", "l_quantity/50 sx", "l_extendedprice/105000 sy", "l_discount*10 tx", "l_tax*10 ty"
    )


def part_fit(spark, sf):
    return A.fit_affine(part_points(spark, sf), ["cell"], ("sx", "sy"), ("tx", "ty")).drop("r2", "rmse")


define("room_points", "select predicted_room room, fold, x sx, y sy, x_pred tx, y_pred ty from pred_long")
define("room_fit", fit_sql("room_points", "room, fold", "sx", "sy", "tx", "ty"))


def room_points(spark, sf):
    return V.pred_long(spark, sf).selectExpr("predicted_room room", "fold", "x sx", "y sy", "x_pred tx", "y_pred ty")


def room_fit(spark, sf):
    return A.fit_affine(room_points(spark, sf), ["room", "fold"], ("sx", "sy"), ("tx", "ty"))


@check("fit_affine", "select * from part_fit", MAPS, 4)
def fit_affine(spark, sf):
    return part_fit(spark, sf)


@check(
    "fit_affine_rooms",
    """select f.*, greatest(0, 1-sse/sst) r2, sqrt(sse/f.n) rmse from room_fit f join (
      select p.room, p.fold, sum((p.tx-(a*sx+b*sy+f.tx))^2+(p.ty-(c*sx+d*sy+f.ty))^2) sse, count(*)*(var_pop(p.tx)+var_pop(p.ty)) sst
      from room_points p join room_fit f on f.room=p.room and f.fold=p.fold group by all) q on q.room=f.room and q.fold=f.fold""",
    MAPS + " r2 rmse",
)
def fit_affine_rooms(spark, sf):
    return room_fit(spark, sf)


@check(
    "apply_affine",
    """select l.l_orderkey ok, l.l_linenumber ln, l.l_partkey pk, l.l_suppkey sk, f.room, a*(l_quantity/50)+b*(l_extendedprice/105000)+tx x_map,
      c*(l_quantity/50)+d*(l_extendedprice/105000)+ty y_map from lineitem l join room_fit f on f.fold=l.l_linenumber%5+1""",
    "x_map y_map",
)
def apply_affine(spark, sf):
    pts = V.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey ok", "l_linenumber ln", "l_partkey pk", "l_suppkey sk", "l_quantity/50 x", "l_extendedprice/105000 y",
        "cast(l_linenumber%5+1 as int) fold",
    )
    joined = pts.join(stored(room_fit(spark, sf)), "fold")
    return A.apply_affine(joined).select("ok", "ln", "pk", "sk", "room", "x_map", "y_map")


@check(
    "apply_affine_inverse",
    """select row_key, offset_no, predicted_room, p.fold, (d*(x_pred-tx)-b*(y_pred-ty))/(a*d-b*c) x_map, (a*(y_pred-ty)-c*(x_pred-tx))/(a*d-b*c) y_map
      from pred_long p join room_fit f on f.room=predicted_room and f.fold=p.fold""",
    "x_map y_map",
)
def apply_affine_inverse(spark, sf):
    maps = stored(room_fit(spark, sf).withColumnRenamed("room", "predicted_room").drop("n", "r2", "rmse"))
    pts = V.pred_long(spark, sf).select("row_key", "offset_no", "predicted_room", "fold", "x_pred", "y_pred")
    out = A.apply_affine(pts.join(maps, ["predicted_room", "fold"]), "x_pred", "y_pred", inverse=True)
    return out.select("row_key", "offset_no", "predicted_room", "fold", "x_map", "y_map")


@check("decompose_affine", decompose_sql("select * from room_fit"), MAPS + " angle_deg max_eigenvalue min_eigenvalue")
def decompose_affine(spark, sf):
    return A.decompose_affine(room_fit(spark, sf).drop("r2", "rmse"))


@check(
    "affine_fit_quality",
    """select p.room, p.fold, count(*) n, median(sqrt((p.tx-(a*sx+b*sy+f.tx))^2+(p.ty-(c*sx+d*sy+f.ty))^2)) residual_median,
      sqrt(avg((p.tx-(a*sx+b*sy+f.tx))^2+(p.ty-(c*sx+d*sy+f.ty))^2))*100 rmse_cm
      from room_points p join room_fit f on f.room=p.room and f.fold=p.fold group by all""",
    "residual_median rmse_cm",
)
def affine_fit_quality(spark, sf):
    maps = stored(room_fit(spark, sf))
    pts = room_points(spark, sf).withColumnsRenamed({"tx": "ux", "ty": "uy"})
    med = A.median_residual(pts, maps, ["room", "fold"], ("sx", "sy"), ("ux", "uy"))
    return maps.select("room", "fold", "n", (F.col("rmse") * 100).alias("rmse_cm")).join(med, ["room", "fold"])


define(
    "fixed_sets",
    """select cell, case when s2>1e-12*s1 then 'unique' end fixed_case, (m22*tx-m12*ty)/det fixed_x, (m11*ty-m21*tx)/det fixed_y from (
      select *, (turn+flip)/2 s1, abs(det)/((turn+flip)/2) s2 from (
        select *, m11*m22-m12*m21 det, sqrt((m11+m22)^2+(m21-m12)^2) turn, sqrt((m11-m22)^2+(m12+m21)^2) flip from (
          select *, 1-a m11, -b m12, -c m21, 1-d m22 from part_fit)))""",
)


@check("fixed_set", "select * from fixed_sets", "fixed_x fixed_y", 3)
def fixed_set(spark, sf):
    return A.fixed_set(part_fit(spark, sf)).select("cell", "fixed_case", "fixed_x", "fixed_y")


@check(
    "is_identity",
    "select room, fold, sqrt((a-1)^2+b^2+c^2+(d-1)^2)<0.25 and sqrt(tx^2+ty^2)<0.1 is_identity from room_fit",
)
def is_identity(spark, sf):
    return room_fit(spark, sf).select("room", "fold", A.is_identity(tol_linear=0.25).alias("is_identity"))


@check(
    "affine_report",
    f"""select room, fold, is_identity, case when is_identity then 'all' else 'unique' end fixed_case, max_eigenvalue*min_eigenvalue area_scale,
      max_eigenvalue/min_eigenvalue anisotropy, sqrt(tx^2+ty^2) translation,
      case when is_identity then 'No remapping beyond noise.' else 'Remapping pivots around a stationary point.' end message
      from (select *, sqrt((a-1)^2+b^2+c^2+(d-1)^2)<0.1 and sqrt(tx^2+ty^2)<0.1 is_identity from ({decompose_sql("select * from room_fit")}))""",
    "area_scale anisotropy translation",
)
def affine_report(spark, sf):
    return A.affine_report(room_fit(spark, sf)).select(
        "room", "fold", "is_identity", "fixed_case", "area_scale", "anisotropy", "translation", "message"
    )


# a map of each kind per part, made from the means of its lines: turn by one radian, shift, mirror, glide, shear, identity by part % 6
define(
    "kind_maps",
    """select cell, cell%6 kind, case when cell%6=0 then cos(1) when cell%6 in (2, 3) then -1 else 1 end a,
      case cell%6 when 0 then -sin(1) when 4 then ux else 0 end b,
      case cell%6 when 0 then mx+my when 1 then ux when 2 then 2*mx when 3 then 2*mx when 4 then uy else 0 end tx,
      case when cell%6=0 then sin(1) else 0 end c, case when cell%6=0 then cos(1) else 1 end d,
      case cell%6 when 0 then my-mx when 1 then uy when 3 then uy+1 else 0 end ty
      from (select cell, avg(sx) mx, avg(sy) my, avg(tx) ux, avg(ty) uy from part_points group by cell)""",
)


def kind_maps(spark, sf):
    means = part_points(spark, sf).groupBy("cell").agg(F.avg("sx").alias("mx"), F.avg("sy").alias("my"), F.avg("tx").alias("ux"), F.avg("ty").alias("uy"))
    kind = F.col("cell") % 6

    def pick(other: float, **by_kind):
        out = F.lit(float(other))
        for k, v in by_kind.items():
            out = F.when(kind == int(k[1:]), F.lit(v)).otherwise(out)
        return out.cast("double")

    mx, my, ux, uy = (F.col(c) for c in ("mx", "my", "ux", "uy"))
    return means.select(
        "cell", kind.alias("kind"),
        pick(1, k0=math.cos(1), k2=-1, k3=-1).alias("a"), pick(0, k0=-math.sin(1), k4=ux).alias("b"),
        pick(0, k0=mx + my, k1=ux, k2=2 * mx, k3=2 * mx, k4=uy).alias("tx"),
        pick(0, k0=math.sin(1)).alias("c"), pick(1, k0=math.cos(1)).alias("d"), pick(0, k0=my - mx, k1=uy, k3=uy + 1).alias("ty"),
    )


def kinds_sql(tolerance: str) -> str:
    """Fixed points of ``kind_maps`` by rank: for rank 1 what is left of the shift off the larger column, and the larger row's line."""
    return f"""select *, case rank when 2 then 'unique' when 1 then case when off<{tolerance} then 'line' else 'none' end
        else case when sqrt(tx^2+ty^2)<{tolerance} then 'all' else 'translation' end end fixed_case,
      case when rank=2 then (m22*tx-m12*ty)/det when rank=1 and off<{tolerance} then r1*rb/(r1^2+r2^2) end fixed_x,
      case when rank=2 then (m11*ty-m21*tx)/det when rank=1 and off<{tolerance} then r2*rb/(r1^2+r2^2) end fixed_y,
      case when rank=1 and off<{tolerance} then -r2/sqrt(r1^2+r2^2) end dir_x, case when rank=1 and off<{tolerance} then r1/sqrt(r1^2+r2^2) end dir_y
      from (select *, case when m11=0 and m12=0 and m21=0 and m22=0 then 0 when abs(det)>1e-9 then 2 else 1 end rank,
        case when u1^2+u2^2>0 then abs(u1*ty-u2*tx)/sqrt(u1^2+u2^2) end off from (
        select *, m11*m22-m12*m21 det, m11^2+m21^2>=m12^2+m22^2 left_col, case when left_col then m11 else m12 end u1, case when left_col then m21 else m22 end u2,
          m11^2+m12^2>=m21^2+m22^2 top, case when top then m11 else m21 end r1, case when top then m12 else m22 end r2, case when top then tx else ty end rb
        from (select *, 1-a m11, -b m12, -c m21, 1-d m22 from kind_maps)))"""


@check(
    "fixed_set_kinds", f"select cell, kind, rank, fixed_case, fixed_x, fixed_y, dir_x, dir_y from ({kinds_sql('1e-6')})", "fixed_x fixed_y dir_x dir_y", 9,
)
def fixed_set_kinds(spark, sf):
    """Maps of every kind: turns, shifts, mirrors, glides, shears and the identity."""
    return A.fixed_set(kind_maps(spark, sf)).select("cell", "kind", "rank", "fixed_case", "fixed_x", "fixed_y", "dir_x", "dir_y")


_KIND_PARTS = f"""select k.*, q.reflection, q.angle_deg, q.max_eigenvalue*q.min_eigenvalue area_scale, sqrt(k.tx^2+k.ty^2) translation,
  sqrt((k.a-1)^2+k.b^2+k.c^2+(k.d-1)^2)<0.1 and sqrt(k.tx^2+k.ty^2)<0.1 is_identity
  from ({kinds_sql('1e-5')}) k join ({decompose_sql("select * from kind_maps")}) q on q.cell=k.cell"""


@check(
    "affine_report_kinds",
    f"""select cell, kind, is_identity, case when is_identity then 'all' else fixed_case end fixed_case, line_type, area_scale, translation,
      case when is_identity then 'No remapping beyond noise.' when line_type='reflection_axis' then 'Mirror remapping: axis is fixed pointwise.'
        when line_type='stationary_line' then 'Stationary line exists, but not a mirror flip.' when fixed_case='unique' then 'Remapping pivots around a stationary point.'
        when fixed_case='all' then 'No remapping.' else 'No simple invariant structure detected.' end message
      from (select *, case when not is_identity and fixed_case='line' then
        case when reflection and abs(dir_x*cos(radians(angle_deg))+dir_y*sin(radians(angle_deg)))>0.99 then 'reflection_axis' else 'stationary_line' end end line_type
        from ({_KIND_PARTS}))""",
    "area_scale translation", 9,
)
def affine_report_kinds(spark, sf):
    return A.affine_report(kind_maps(spark, sf)).select("cell", "kind", "is_identity", "fixed_case", "line_type", "area_scale", "translation", "message")


@check(
    "rotate_points",
    """select row_id, cos(radians(30))*(-x)-sin(radians(30))*y x_rot, sin(radians(30))*(-x)+cos(radians(30))*y y_rot from positions""",
    "x_rot y_rot",
)
def rotate_points(spark, sf):
    return A.rotate_points(V.positions(spark, sf), 30.0, reflect=True).select("row_id", "x_rot", "y_rot")


@check(
    "homogenise_physical",
    """select source_room, target_room, a, b, c, d, ct.cx+tx-(a*cs.cx+b*cs.cy) tx, ct.cy+ty-(c*cs.cx+d*cs.cy) ty
      from pair_fit join centroids cs on cs.room=source_room join centroids ct on ct.room=target_room""",
    MAPS,
)
def homogenise_physical(spark, sf):
    fits = P.mapping_fits(wide(spark, sf), V.PAIRS, V.POLYGONS)
    moved = A.to_physical(fits, P._centre("source_room", V.POLYGONS), P._centre("target_room", V.POLYGONS))
    return moved.select("source_room", "target_room", *A.MAP)
