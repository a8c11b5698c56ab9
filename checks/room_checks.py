"""Rooms in time and space: labels, outlines, grids and wall distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, define
from wayfield.operators import frames as FR
from wayfield.operators import metrics as M
from wayfield.operators import rooms as R
from wayfield.sources import views as V

define(
    "edges",
    """select room, vertex_no edge_no, x x1, y y1,
      coalesce(lead(x) over w, first_value(x) over w) x2, coalesce(lead(y) over w, first_value(y) over w) y2
      from boundary window w as (partition by room order by vertex_no rows between unbounded preceding and unbounded following)""",
)
define(
    "centroids",
    """select room, sum(x1*y2-x2*y1)/2 area, sum((x1*y2-x2*y1)*(x1+x2))/(3*sum(x1*y2-x2*y1)) cx,
      sum((x1*y2-x2*y1)*(y1+y2))/(3*sum(x1*y2-x2*y1)) cy from edges group by room""",
)


def inside_sql(source: str, keep: str, x: str, y: str, room: str) -> str:
    """Rows of ``source`` with ``odd`` crossing parity and the on-edge flag against the row's own room."""
    return f"""select {keep}, count(*) filter (where (y1>{y})<>(y2>{y}) and {x}<(x2-x1)*({y}-y1)/(y2-y1)+x1)%2=1 odd,
      count(*) filter (where abs((x2-x1)*({y}-y1)-(y2-y1)*({x}-x1))<=1e-12*sqrt((x2-x1)^2+(y2-y1)^2)
        and {x} between least(x1,x2)-1e-12 and greatest(x1,x2)+1e-12 and {y} between least(y1,y2)-1e-12 and greatest(y1,y2)+1e-12)>0 border
      from {source} join edges e on e.room={room} group by {keep}"""


@check(
    "assign_room",
    """select frame_id, session, ts, r.room from tracking t left join rooms r on t.ts>=r.t0 and t.ts<r.t1""", "ts",
)
def assign_room(spark, sf):
    return R.assign_room(V.tracking(spark, sf), V.ROOMS).select("frame_id", "session", "ts", "room")


def session_rooms(spark, sf):
    """Three equal parts of each session's own recording time."""
    span = V.tracking(spark, sf).groupBy("session").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    third = (F.col("hi") - F.col("lo")) / 3
    return span.select(
        "session",
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("ord"), F.lit(n).alias("room"), (F.col("lo") + third * i).alias("t0"), (F.col("lo") + third * (i + 1)).alias("t1"))
            for i, n in enumerate("ABa")
        ])).alias("r"),
    ).select("session", "r.*")


define(
    "session_rooms",
    """select session, i ord, ['A','B','a'][i+1] room, lo+(hi-lo)/3*i t0, lo+(hi-lo)/3*(i+1) t1 from (
      select session, min(ts) lo, max(ts) hi, unnest([0,1,2]) i from tracking group by session)""",
)


@check(
    "assign_session_room",
    """select frame_id, t.session, r.room from tracking t left join session_rooms r
      on t.session=r.session and t.ts>=r.t0 and t.ts<r.t1""",
)
def assign_session_room(spark, sf):
    out = R.assign_room_table(V.tracking(spark, sf), session_rooms(spark, sf), ["session"])
    return out.select("frame_id", "session", "room")


@check(
    "room_membership",
    "select frame_id, ts, r.room, r.idx room_index from tracking t join rooms r on t.ts>=r.t0 and t.ts<r.t1", "ts",
)
def room_membership(spark, sf):
    return R.room_membership(V.tracking(spark, sf), V.ROOMS).select("frame_id", "ts", "room", "room_index")


@check(
    "room_counts",
    """select r.room, r.idx room_index, count(t.ts) n_rows from rooms r left join tracking t on t.ts>=r.t0 and t.ts<r.t1
      group by all union all select 'never', 2, 0""",
)
def room_counts(spark, sf):
    return R.room_counts(V.tracking(spark, sf), [*V.ROOMS, R.Room("never", 2, 9e9, 9.1e9)])


@check("overall_time_range", "select session, min(t0) t_min, max(t1) t_max from session_rooms group by session", "t_min t_max")
def overall_time_range(spark, sf):
    return R.overall_time_range(session_rooms(spark, sf), ["session"])


define(
    "labelled",
    """select t.*, r.room from tracking t left join rooms r on t.ts>=r.t0 and t.ts<r.t1""",
)


@check(
    "transition_padding",
    """with m as (select *, lag(room) over w b, row_number() over w rn from labelled window w as (partition by session order by ts, frame_id)),
      c as (select session, ts from m where rn>1 and room is distinct from b)
      select frame_id, session, ts, room from labelled l where not exists
        (select 1 from c where c.session=l.session and abs(l.ts-c.ts)<=100000)""",
    "ts",
)
def transition_padding(spark, sf):
    labelled = R.assign_room(V.tracking(spark, sf), V.ROOMS)
    return R.transition_padding(labelled, 100000.0, ["session"], ties=["frame_id"]).select("frame_id", "session", "ts", "room")


define("pred_points", "select row_key, offset_no, fold, predicted_room room, x_pred x, y_pred y from pred_long")


def pred_points(spark, sf):
    return V.pred_long(spark, sf).selectExpr("row_key", "offset_no", "fold", "predicted_room room", "x_pred x", "y_pred y")


@check(
    "points_in_polygon",
    "select row_key, offset_no, room, x, y from ("
    + inside_sql("pred_points p", "row_key, offset_no, p.room, x, y", "p.x", "p.y", "p.room")
    + ") where odd and not border",
    "x y",
)
def points_in_polygon(spark, sf):
    return R.points_in_polygon(pred_points(spark, sf), V.POLYGONS).drop("fold")


@check(
    "points_covered_by_polygon",
    "select row_key, offset_no, room, x, y from ("
    + inside_sql("pred_points p", "row_key, offset_no, p.room, x, y", "p.x", "p.y", "p.room")
    + ") where odd or border",
    "x y",
)
def points_covered_by_polygon(spark, sf):
    return R.points_in_polygon(pred_points(spark, sf), V.POLYGONS, edge=True).drop("fold")


# every order's lines, in a fixed order, are the vertices of one outline
define(
    "order_boundary",
    """select l_orderkey room, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate)::int vertex_no,
      l_quantity/50 x, l_extendedprice/105000 y from lineitem""",
)
define(
    "order_edges",
    """select room, vertex_no edge_no, x x1, y y1, coalesce(lead(x) over w, first_value(x) over w) x2,
      coalesce(lead(y) over w, first_value(y) over w) y2 from order_boundary
      window w as (partition by room order by vertex_no rows between unbounded preceding and unbounded following)""",
)


def order_outlines(spark, sf):
    b = V.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey room", "struct(l_linenumber, l_partkey, l_suppkey, l_shipdate) vertex_no",
        "l_quantity/50 x", "l_extendedprice/105000 y",
    )
    return R.outline_table(b, ["room"])


@check(
    "polygon_area_centroid",
    """select room, n_vertices, a/2 area, case when abs(a)>1e-12 then sx/(3*a) end cx, case when abs(a)>1e-12 then sy/(3*a) end cy from (
      select room, count(*)::int n_vertices, sum(x1*y2-x2*y1) a, sum((x1*y2-x2*y1)*(x1+x2)) sx, sum((x1*y2-x2*y1)*(y1+y2)) sy
      from order_edges group by room)""",
    "area cx cy", 5,
)
def polygon_area_centroid(spark, sf):
    return R.polygon_area_centroid(order_outlines(spark, sf), ["room"])


@check(
    "densify_boundary",
    """select room, edge_no-1 edge_no, step, x1+(x2-x1)*step/5.0::double x, y1+(y2-y1)*step/5.0::double y
      from (select *, unnest([0,1,2,3,4]) step from order_edges)""",
    "x y", 7,
)
def densify_boundary(spark, sf):
    return R.densify_boundary(order_outlines(spark, sf), ["room"], 5)


@check(
    "points_in_outline_table",
    """select l.l_orderkey room, l.l_linenumber ln, l.l_partkey pk, l.l_suppkey sk, l.l_shipdate::date::varchar ship,
        count(*) filter (where (y1>l_tax*10)<>(y2>l_tax*10) and l_discount*8<(x2-x1)*(l_tax*10-y1)/(y2-y1)+x1)%2=1
          and not count(*) filter (where abs((x2-x1)*(l_tax*10-y1)-(y2-y1)*(l_discount*8-x1))<=1e-12*sqrt((x2-x1)^2+(y2-y1)^2)
            and l_discount*8 between least(x1,x2)-1e-12 and greatest(x1,x2)+1e-12 and l_tax*10 between least(y1,y2)-1e-12 and greatest(y1,y2)+1e-12)>0 inside
      from lineitem l join order_edges e on e.room=l.l_orderkey group by 1,2,3,4,5,l_discount,l_tax,l_quantity,l_extendedprice""",
)
def points_in_outline_table(spark, sf):
    pts = V.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey room", "l_linenumber ln", "l_partkey pk", "l_suppkey sk", "cast(cast(l_shipdate as date) as string) ship",
        "l_discount*8 x", "l_tax*10 y",
    )
    return R.points_in_polygon_table(pts, order_outlines(spark, sf), ["room"]).drop("x", "y")


@check(
    "room_grid",
    """with b as (select least(min(x_pred), min(y_pred)) lo, greatest(max(x_pred), max(y_pred)) hi from pred_long),
      g as (select gx, gy, lo+gx*((hi-lo)/33) x, lo+gy*((hi-lo)/33) y, r.room from b, unnest(range(34)) t(gx), unnest(range(34)) u(gy),
        (select distinct room from boundary) r)
      select gx::int gx, gy::int gy, x, y, room from ("""
    + inside_sql("g", "gx, gy, x, y, g.room", "g.x", "g.y", "g.room")
    + ") where odd or border",
    "x y",
)
def room_grid(spark, sf):
    return R.room_grid(M.bbox(V.pred_long(spark, sf), (), "x_pred", "y_pred"), 34, V.POLYGONS)


@check(
    "polygon_holes",
    f"""with p as (select concat_ws(' ', row_key, predicted_room) row_key, offset_no, 'A' pr, x_pred px, y_pred py from pred_long),
      f as (select e.room, row_key, offset_no, i.* exclude(row_key, offset_no) from (select 1) e0, (select 'A' room) e,
        ({inside_sql("p", "row_key, offset_no", "px", "py", "pr")}) i),
      h as ({inside_sql("(select *, 'a' hr from p) p", "row_key, offset_no", "px", "py", "hr")})
      select f.row_key, f.offset_no from f join h using (row_key, offset_no) where (f.odd or f.border) and not (h.odd and not h.border)""",
)
def polygon_holes(spark, sf):
    a, _, hole = V.POLYGONS
    p = pred_points(spark, sf).withColumn("row_key", F.concat_ws(" ", "row_key", "room"))
    return p.filter(R.in_room_without_holes("x", "y", a, [hole])).select("row_key", "offset_no")


_ANGLES = [0.0, 45.0, 90.0, 135.0, 180.0, 225.0, 270.0, 315.0]

define(
    "lit_points",
    """select row_id, r.room, x, y from positions p join rooms r on p.ts>=r.t0 and p.ts<r.t1""",
)
define(
    "ray_distances",
    """with snap as (
        select row_id, p.room, p.x, p.y, min_by({'nx': x1+f*(x2-x1), 'ny': y1+f*(y2-y1)},
          sqrt((p.x-x1-f*(x2-x1))^2+(p.y-y1-f*(y2-y1))^2)) near,
          min(sqrt((p.x-x1-f*(x2-x1))^2+(p.y-y1-f*(y2-y1))^2)) gap
        from (select l.*, x1, y1, x2, y2, greatest(0, least(1, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/((x2-x1)^2+(y2-y1)^2))) f
          from lit_points l join edges e on e.room=l.room) p group by all),
      flag as ("""
    + inside_sql("lit_points p", "row_id, p.room, x, y", "p.x", "p.y", "p.room")
    + """),
      start as (
        select s.row_id, s.room, case when odd or border then s.x when gap<=0.05 then near.nx+0.05*(cx-near.nx)/sqrt((cx-near.nx)^2+(cy-near.ny)^2) end sx,
          case when odd or border then s.y when gap<=0.05 then near.ny+0.05*(cy-near.ny)/sqrt((cx-near.nx)^2+(cy-near.ny)^2) end sy
        from snap s join flag f on f.row_id=s.row_id join centroids c on c.room=s.room),
      ray as (select *, cos(radians(angle)) dx, sin(radians(angle)) dy from
        (select *, unnest([0,45,90,135,180,225,270,315])::double angle from start)),
      hit as (select r.row_id, r.room, angle, ((x1-sx)*(y2-y1)-(y1-sy)*(x2-x1))/d t, ((x1-sx)*dy-(y1-sy)*dx)/d s from
        (select r.*, x1, x2, y1, y2, case when abs(dx*(y2-y1)-dy*(x2-x1))>1e-15 then dx*(y2-y1)-dy*(x2-x1) end d
          from ray r join edges e on e.room=r.room) r)
      select row_id, room, angle, coalesce(min(t) filter (where t>=0 and s between -1e-12 and 1+1e-12), -1) distance
      from hit group by all""",
)


def lit_positions(spark, sf):
    return R.assign_room(V.positions(spark, sf), V.ROOMS).filter("room is not null")


@check("ray_distance", "select * from ray_distances", "distance")
def ray_distance(spark, sf):
    pts = lit_positions(spark, sf).select("row_id", "room", "x", "y")
    return R.ray_distance(pts, _ANGLES, V.POLYGONS).drop("x", "y")
