"""Angles and circular statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, define
from wayfield.functions import angles as G
from wayfield.operators import circular as C
from wayfield.sources import views as V

def _mod(a: str, p: str) -> str:
    return f"((({a})%{p}+{p})%{p})"


@check(
    "wrap_angle",
    f"""select row_id, {_mod('a+180', '360')}-180 half_open, {_mod('a', '360')} positive, {_mod('a+30', '60')}-30 sixty
      from (select row_id, hd*5-700 a from activity)""",
    "half_open positive sixty",
)
def wrap_angle(spark, sf):
    a = V.activity(spark, sf).select("row_id", (F.col("hd") * 5 - 700).alias("a"))
    return a.select(
        "row_id", G.wrap_angle("a").alias("half_open"), G.wrap_angle("a", symmetric=False).alias("positive"), G.wrap_angle("a", 60.0).alias("sixty")
    )


@check("angle_difference", f"select row_id, {_mod('hd-rate+180', '360')}-180 diff from activity", "diff")
def angle_difference(spark, sf):
    return V.activity(spark, sf).select("row_id", G.angle_difference("hd", "rate").alias("diff"))


@check(
    "circular_stats",
    f"""select cell, {_mod('degrees(atan2(sum(rate*sin(radians(hd))), sum(rate*cos(radians(hd)))))+180', '360')}-180 circ_mean,
      degrees(sqrt(-2*ln(sqrt(avg(cos(radians(hd)))^2+avg(sin(radians(hd)))^2)))) circ_std,
      1-sqrt(avg(cos(radians(hd)))^2+avg(sin(radians(hd)))^2) circ_var from activity group by cell""",
    "circ_mean circ_std circ_var",
)
def circular_stats(spark, sf):
    return C.circular_stats(V.activity(spark, sf), ["cell"], "hd", "rate")


@check(
    "circular_mean",
    f"""select spikes, {_mod('degrees(atan2(sum(sin(radians(hd))), sum(cos(radians(hd)))))', '360')} mean from activity group by spikes""", "mean",
)
def circular_mean(spark, sf):
    return V.activity(spark, sf).groupBy("spikes").agg(G.circular_mean("hd", symmetric=False).alias("mean"))


@check(
    "circular_std",
    """select spikes, degrees(sqrt(-2*ln(sqrt(avg(cos(2*radians(hd)))^2+avg(sin(2*radians(hd)))^2)))) std from activity group by spikes""", "std",
)
def circular_std(spark, sf):
    return V.activity(spark, sf).groupBy("spikes").agg(G.circular_std("hd", 180.0).alias("std"))


@check(
    "circular_variance",
    "select spikes, 1-sqrt(avg(cos(radians(hd)))^2+avg(sin(radians(hd)))^2) var from activity group by spikes", "var",
)
def circular_variance(spark, sf):
    return V.activity(spark, sf).groupBy("spikes").agg(G.circular_variance("hd").alias("var"))


@check(
    "rayleigh_vector",
    """select cell, sqrt(x^2+y^2) rv_length, degrees(atan2(y, x)) rv_angle from (
      select cell, sum(abs(r)*cos(radians(hd+case when r<0 then 180 else 0 end)))/sum(abs(r)) x, sum(abs(r)*sin(radians(hd+case when r<0 then 180 else 0 end)))/sum(abs(r)) y
      from (select *, rate-60 r from activity) group by cell)""",
    "rv_length rv_angle",
)
def rayleigh_vector(spark, sf):
    a = V.activity(spark, sf).withColumn("r", F.col("rate") - 60)
    return C.rayleigh_vector(a, ["cell"], "r", "hd")


@check(
    "rayleigh",
    f"""select cell, sqrt(x^2+y^2)/m rayleigh_r, {_mod('degrees(atan2(y, x))', '360')} rayleigh_angle from (
      select cell, sum(v*cos(radians(hd))) x, sum(v*sin(radians(hd))) y, sum(v) m from (select *, greatest(rate-60, 0) v from activity) group by cell)""",
    "rayleigh_r rayleigh_angle",
)
def rayleigh(spark, sf):
    a = V.activity(spark, sf).withColumn("r", F.col("rate") - 60)
    return C.rayleigh(a, ["cell"], "r", "hd")


# a polar map per cell: value by 50-wide rate ring and 36-degree sector
define("polar_small", 'select cell, floor(rate/50)::int db, (floor(hd/36)*36)::double angle, avg(spikes) "value" from activity group by all')


def polar_small(spark, sf):
    return V.activity(spark, sf).groupBy(
        "cell", F.floor(F.col("rate") / 50).cast("int").alias("db"), (F.floor(F.col("hd") / 36) * 36).cast("double").alias("angle")
    ).agg(F.avg("spikes").alias("value"))


@check(
    "rayleigh_stats",
    f"""with k as (select *, row_number() over (partition by cell order by "value" desc, db, angle) rn from polar_small),
      p as (select cell, "value" peak_value, db peak_distance, angle peak_angle from k where rn=1),
      r as (select m.cell, sum("value"*cos(radians(angle))) x, sum("value"*sin(radians(angle))) y, sum("value") w from polar_small m join p on p.cell=m.cell and p.peak_distance=m.db group by m.cell),
      a as (select cell, angle, sum("value") v from polar_small group by all),
      c as (select cell, sum(v*cos(radians(angle))) x, sum(v*sin(radians(angle))) y, sum(v) w, max(v) peak_collapsed from a group by cell)
      select p.*, sqrt(r.x^2+r.y^2)/r.w peak_r, {_mod('degrees(atan2(r.y, r.x))', '360')} peak_angle_rv, sqrt(c.x^2+c.y^2)/c.w collapsed_r,
        {_mod('degrees(atan2(c.y, c.x))', '360')} collapsed_angle, peak_collapsed from p join r on r.cell=p.cell join c on c.cell=p.cell""",
    "peak_value peak_angle peak_r peak_angle_rv collapsed_r collapsed_angle peak_collapsed",
)
def rayleigh_stats(spark, sf):
    return C.rayleigh_stats(polar_small(spark, sf), ["cell"])


@check(
    "polar_to_xy",
    """select row_id, angle, x+d*cos(radians(angle-hd)) px, y+d*sin(radians(angle-hd)) py from (
      select *, unnest([0, 90, 200])::double angle, unnest([rate/500, p, rate/1000]) d from positions)""",
    "px py",
)
def polar_to_xy(spark, sf):
    p = V.positions(spark, sf).withColumns({"Ego_0": F.col("rate") / 500, "Ego_90": F.col("p"), "Ego_200": F.col("rate") / 1000})
    return C.polar_to_xy(p, {"Ego_0": 0, "Ego_90": 90, "Ego_200": 200}, hd="hd", keep=["row_id"])


@check(
    "gradient01",
    """with h as (select cell, (max(x)-min(x))/2 mx, (max(y)-min(y))/2 my from positions group by cell),
      g as (select row_id, p.cell, sqrt((x-mx)^2+(y-my)^2) g, x from positions p join h on h.cell=p.cell)
      select row_id, (g-min(g) over (partition by cell))/(max(g) over (partition by cell)-min(g) over (partition by cell)) radial,
        least(1, greatest(0, (x-0.1)/0.4)) fixed from g""",
    "radial fixed",
)
def gradient01(spark, sf):
    p = V.positions(spark, sf)
    r = C.gradient01(p, "radial", ["cell"], out="radial")
    return C.gradient01(r, "horizontal", bounds=(0.1, 0.5), out="fixed").select("row_id", "radial", "fixed")


@check(
    "threshold_value",
    """select cell, 'absolute' kind, 0.9 threshold from polar_small group by cell
      union all select cell, 'percent', 0.9*max("value") filter (where "value">0) from polar_small group by cell
      union all select cell, 'mean', avg("value") filter (where "value">0) from polar_small group by cell
      union all select cell, 'percentile', quantile_cont("value", 0.9) filter (where "value">0) from polar_small group by cell""",
    "threshold",
)
def threshold_value(spark, sf):
    maps = polar_small(spark, sf)
    parts = [C.threshold_value(maps, ["cell"], k, 0.9).withColumn("kind", F.lit(k)) for k in ("absolute", "percent", "mean", "percentile")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@check(
    "log_ratio_map",
    """select a.cell, a.db, a.angle, case when b."value"<>0 and a."value"/b."value">0 then ln(a."value"/b."value") end log_ratio
      from polar_small a join (select (cell+1)%12 cell, db, angle, "value" from polar_small) b on a.cell=b.cell and a.db=b.db and a.angle=b.angle""",
    "angle log_ratio",
)
def log_ratio_map(spark, sf):
    m = polar_small(spark, sf)
    return C.log_ratio_map(m, m.withColumn("cell", ((F.col("cell") + 1) % 12).cast("int")), ["cell", "db", "angle"])


@check(
    "minmax_map",
    """select cell, db, angle, case when mx>mn then ("value"-mn)/(mx-mn) else "value" end "value" from
      (select *, min("value") over (partition by cell) mn, max("value") over (partition by cell) mx from polar_small)""",
    'angle value',
)
def minmax_map(spark, sf):
    return C.minmax_map(polar_small(spark, sf), ["cell"])


define(
    "wall_true",
    """select row_id, r.room, case when spikes=4 then -1 else x end "Allo_0", p "Allo_90" from positions q join rooms r on q.ts>=r.t0 and q.ts<r.t1""",
)
define("wall_calc", """select row_id, y "Allo_0", case when cell=3 then -1 else x*0.9 end "Allo_90" from positions""")


def wall_true(spark, sf):
    from wayfield.operators.rooms import assign_room

    p = assign_room(V.positions(spark, sf), V.ROOMS).filter("room is not null")
    return p.select("row_id", "room", F.when(F.col("spikes") == 4, F.lit(-1.0)).otherwise(F.col("x")).alias("Allo_0"), F.col("p").alias("Allo_90"))


def wall_calc(spark, sf):
    return V.positions(spark, sf).select("row_id", F.col("y").alias("Allo_0"), F.when(F.col("cell") == 3, F.lit(-1.0)).otherwise(F.col("x") * 0.9).alias("Allo_90"))


@check(
    "polar_error",
    """with l as (select t.row_id, room, 0.0::double angle, t."Allo_0" t, c."Allo_0" c from wall_true t join wall_calc c on t.row_id=c.row_id
        union all select t.row_id, room, 90.0, t."Allo_90", c."Allo_90" from wall_true t join wall_calc c on t.row_id=c.row_id)
      select coalesce(room, 'all') room, coalesce(angle, -1.0) angle, count(*) n, avg(abs(c-t)) mae, sqrt(avg((c-t)^2)) rmse, grouping(room, angle)::int "level"
      from l where t>=0 and c>=0 group by grouping sets ((), (angle), (room), (room, angle))""",
    "angle mae rmse",
)
def polar_error(spark, sf):
    return C.polar_error(wall_true(spark, sf), wall_calc(spark, sf), ["row_id"], "room", {"Allo_0": 0, "Allo_90": 90})


@check(
    "sentinel_counts",
    """select room, sum(("Allo_0"<0)::int+("Allo_90"<0)::int)::bigint n_negative, 100.0*sum(("Allo_0"<0)::int+("Allo_90"<0)::int)/(2*count(*)) pct_negative
      from wall_true group by room""",
    "pct_negative",
)
def sentinel_counts(spark, sf):
    return C.sentinel_counts(wall_true(spark, sf), ["room"], ["Allo_0", "Allo_90"])
