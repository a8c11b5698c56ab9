"""Sessions with outlines of their own: five sessions (the folds), rooms of different size and place, room A without room a in the odd ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.affine_checks import decompose_sql, fit_sql, wide
from checks.map_checks import N, STEP, maps
from checks.registry import check, define
from checks.room_checks import _ANGLES, lit_positions
from wayfield.operators import outlines as O
from wayfield.plans import mapping as P
from wayfield.sources import views as V

define(
    "session_boundary",
    """select s session, room, vertex_no, x*(0.8+0.05*s)+0.02*s x, y*(1.1-0.04*s) y from boundary, unnest([1.0,2.0,3.0,4.0,5.0]::double[]) t(s)""",
)
define(
    "session_rings",
    """with e as (select session, room, x x1, y y1, coalesce(lead(x) over w, first_value(x) over w) x2, coalesce(lead(y) over w, first_value(y) over w) y2
        from session_boundary window w as (partition by session, room order by vertex_no rows between unbounded preceding and unbounded following))
      select session, room, 0 ring, x1, y1, x2, y2 from e
      union all select session, 'A', 1, x1, y1, x2, y2 from e where room='a' and session::int % 2 = 1""",
)
define(
    "session_centroids",
    """select session, room, sum((x1*y2-x2*y1)*(x1+x2))/(3*sum(x1*y2-x2*y1)) cx, sum((x1*y2-x2*y1)*(y1+y2))/(3*sum(x1*y2-x2*y1)) cy
      from session_rings where ring=0 group by session, room""",
)


def session_inside_sql(source: str, keep: str, x: str, y: str, session: str, room: str, edge: bool = False) -> str:
    """Rows of ``source`` with ``inside``: in the session's outline of the room and in none of its holes."""
    codes = f"""select {keep}, ring, count(*) filter (where (y1>{y})<>(y2>{y}) and {x}<(x2-x1)*({y}-y1)/(y2-y1)+x1)%2=1 odd,
        count(*) filter (where abs((x2-x1)*({y}-y1)-(y2-y1)*({x}-x1))<=1e-12*sqrt((x2-x1)^2+(y2-y1)^2)
          and {x} between least(x1,x2)-1e-12 and greatest(x1,x2)+1e-12 and {y} between least(y1,y2)-1e-12 and greatest(y1,y2)+1e-12)>0 border
        from {source} join session_rings e on e.room={room} and e.session={session} group by {keep}, ring"""
    names = ", ".join(k.split(" ")[-1].split(".")[-1] for k in keep.split(", "))
    outer, hole = ("odd or border", "odd and not border") if edge else ("odd and not border", "odd or border")
    return f"select {names}, bool_or(ring=0 and ({outer})) and not bool_or(ring>0 and ({hole})) inside from ({codes}) group by {names}"


def session_outlines(spark) -> O.Outlines:
    s = F.col("session")
    vertices = spark.createDataFrame([(p.name, i, float(x), float(y)) for p in V.POLYGONS for i, (x, y) in enumerate(p.vertices)], "room string, vertex_no int, x double, y double")
    every = vertices.crossJoin(spark.range(1, 6).select(F.col("id").cast("double").alias("session")))
    boundary = every.select("session", "room", "vertex_no", (F.col("x") * (0.8 + 0.05 * s) + 0.02 * s).alias("x"), (F.col("y") * (1.1 - 0.04 * s)).alias("y"))
    exclude = boundary.filter((F.col("room") == "A") & (s % 2 == 1)).select("session", "room", F.lit("a").alias("hole")).distinct()
    on = ["session", "room"]
    return O.index_outlines(O.ring_edges(boundary, on, exclude=exclude), on)


define(
    "session_pairs",
    """select row_key, offset_no, fold::double session, source_room, target_room, sx, sy, tx, ty from pair_points""",
)
define(
    "kept_session_pairs",
    f"""with n as (select session, source_room, target_room from session_pairs group by all having count(*)>=10),
      p as (select session_pairs.* from session_pairs join n using (session, source_room, target_room)),
      si as ({session_inside_sql("p", "p.row_key, p.offset_no, p.session, p.source_room, p.target_room", "p.sx", "p.sy", "p.session", "p.source_room")}),
      ti as ({session_inside_sql("p", "p.row_key, p.offset_no, p.session, p.source_room, p.target_room", "p.tx", "p.ty", "p.session", "p.target_room")})
      select p.* replace (sx-cs.cx as sx, sy-cs.cy as sy, tx-ct.cx as tx, ty-ct.cy as ty)
      from p join si using (row_key, offset_no, session, source_room, target_room) join ti using (row_key, offset_no, session, source_room, target_room)
        join session_centroids cs on cs.room=source_room and cs.session=p.session join session_centroids ct on ct.room=target_room and ct.session=p.session
      where si.inside and ti.inside""",
)
define("session_fit", fit_sql("kept_session_pairs", "session, source_room, target_room", "sx", "sy", "tx", "ty"))


@check(
    "mapping_stats_table",
    f"""with f as ({decompose_sql("select * from session_fit")}),
      q as (select session, source_room, target_room, sum((k.tx-(a*sx+b*sy+f.tx))^2+(k.ty-(c*sx+d*sy+f.ty))^2) sse, count(*) n,
        count(*)*(var_pop(k.tx)+var_pop(k.ty)) sst from kept_session_pairs k join f using (session, source_room, target_room) group by all)
      select session, source_room, target_room, greatest(0, 1-sse/sst) affinity_r2, sqrt(sse/q.n)*100 rmse_cm, angle_deg, reflection,
        max_eigenvalue, min_eigenvalue from f join q using (session, source_room, target_room)""",
    "affinity_r2 rmse_cm angle_deg max_eigenvalue min_eigenvalue",
)
def mapping_stats_table(spark, sf):
    frames = wide(spark, sf).withColumn("session", F.col("fold").cast("double"))
    return P.mapping_stats_table(frames, V.PAIRS, session_outlines(spark), ["session"], cm_per_unit=100.0)


def _mask_sql(shift: str, outside: str) -> str:
    src = f"""(select cell, s session, room pr, bx, "by", "value", (bx+{shift})*{STEP} px, ("by"+{shift})*{STEP} py
      from cell_maps, unnest([1.0,2.0,3.0,4.0,5.0]::double[]) t(s)) m"""
    inside = session_inside_sql(src, 'm.cell, m.session, m.pr, m.bx, m."by", m."value"', "m.px", "m.py", "m.session", "m.pr", True)
    return f"""select cell, session, pr room, bx, "by", case when inside then "value" else {outside} end "value" from ({inside})"""


def session_maps(spark, sf):
    sessions = F.explode(F.array(*[F.lit(float(s)) for s in range(1, 6)])).alias("session")
    return maps(spark, sf).select("cell", "room", "bx", "by", "value", sessions)


@check("mask_map_table", _mask_sql("0", "0"), "value")
def mask_map_table(spark, sf):
    return O.mask_map_table(session_maps(spark, sf), session_outlines(spark), N, 0.0, 1.0)


@check("mask_map_table_centres", _mask_sql("0.5::double", "null"), "value")
def mask_map_table_centres(spark, sf):
    return O.mask_map_table(session_maps(spark, sf), session_outlines(spark), N, 0.0, 1.0, at="centre")


@check(
    "ray_distance_table",
    f"""with p as (select row_id, (row_id % 5 + 1)::double session, room, x, y from lit_points),
      c as (select p.*, x1, y1, x2, y2, greatest(0, least(1, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/((x2-x1)^2+(y2-y1)^2))) f
          from p join session_rings e on e.room=p.room and e.session=p.session),
      snap as (select row_id, session, room, x, y, min_by({{'nx': x1+f*(x2-x1), 'ny': y1+f*(y2-y1)}}, sqrt((x-x1-f*(x2-x1))^2+(y-y1-f*(y2-y1))^2)) near,
        min(sqrt((x-x1-f*(x2-x1))^2+(y-y1-f*(y2-y1))^2)) gap from c group by all),
      flag as ({session_inside_sql("p", "p.row_id, p.session, p.room, p.x, p.y", "p.x", "p.y", "p.session", "p.room")}),
      start as (select s.row_id, s.session, s.room, case when inside or gap<=1e-12 then s.x when gap<=0.05 then near.nx+0.05*(cx-near.nx)/sqrt((cx-near.nx)^2+(cy-near.ny)^2) end sx,
          case when inside or gap<=1e-12 then s.y when gap<=0.05 then near.ny+0.05*(cy-near.ny)/sqrt((cx-near.nx)^2+(cy-near.ny)^2) end sy
        from snap s join flag f on f.row_id=s.row_id join session_centroids c on c.room=s.room and c.session=s.session),
      ray as (select *, cos(radians(angle)) dx, sin(radians(angle)) dy from (select *, unnest([0,45,90,135,180,225,270,315])::double angle from start)),
      hit as (select row_id, r.session, r.room, angle, ((x1-sx)*(y2-y1)-(y1-sy)*(x2-x1))/d t, ((x1-sx)*dy-(y1-sy)*dx)/d s from
        (select r.*, x1, x2, y1, y2, case when abs(dx*(y2-y1)-dy*(x2-x1))>1e-15 then dx*(y2-y1)-dy*(x2-x1) end d
          from ray r join session_rings e on e.room=r.room and e.session=r.session) r)
      select row_id, session, room, angle, coalesce(min(t) filter (where t>=0 and s between -1e-12 and 1+1e-12), -1) distance from hit group by all""",
    "distance",
)
def ray_distance_table(spark, sf):
    pts = lit_positions(spark, sf).select("row_id", (F.col("row_id") % 5 + 1).cast("double").alias("session"), "room", "x", "y")
    return O.ray_distance_table(pts, _ANGLES, session_outlines(spark)).drop("x", "y")
