"""Filters, reshaping, validation, joins and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.affine_checks import KEYS, ROOM_NAMES, wide
from checks.registry import check, define
from wayfield.operators import decoding as D
from wayfield.operators import frames as FR
from wayfield.operators import rooms as R
from wayfield.session import shared_folder
from wayfield.sources import tables as T
from wayfield.sources import views as V


@check("scan_table", "select event_id, user_id, event_type, value from events", "value")
def scan_table(spark, sf):
    return T.scan_table(spark, f"{sf}/events.parquet", columns=["event_id", "user_id", "event_type", "value"])


@check(
    "write_table",
    "select o_orderstatus status, o_orderkey, o_totalprice from orders union all select o_orderstatus, o_orderkey, o_totalprice from orders where o_orderstatus='F'",
    "o_totalprice",
)
def write_table(spark, sf):
    """Overwrite, then append one status; partitioned by status."""
    path = f"{shared_folder(spark)}/write-table-{uuid.uuid4().hex}"
    rows = V.table(spark, sf, "orders").selectExpr("o_orderstatus status", "o_orderkey", "o_totalprice")
    T.write_table(rows, path, overwrite=True, partition_by=["status"])
    T.write_table(rows.filter("status = 'F'"), path, partition_by=["status"])
    return T.scan_table(spark, path, rows.schema)


@check("collect_files", "select 'part.parquet' file, count(*) n from part union all select 'partsupp.parquet', 0 where false")
def collect_files(spark, sf):
    rows = T.collect_files(spark, sf, r"part\.parquet", glob="part*.parquet")
    return rows.groupBy(F.element_at(F.split("_source_file", "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("n"))


@check("find_stats_files", "select 'orders.parquet' file, o_orderstatus status, count(*) n from orders group by all")
def find_stats_files(spark, sf):
    rows = T.stats_files(spark, sf, "orders.parquet", parents=[sf.rstrip("/").rsplit("/", 1)[-1]])
    return rows.groupBy(F.element_at(F.split("_source_file", "/"), -1).alias("file"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@check(
    "stream_split",
    """select frame_id, s stream, case s when 'PC_HeadPos' then x else y end x, case s when 'PC_HeadPos' then y else x end y,
      case s when 'PC_HeadPos' then p end p, (case s when 'PC_HeadPos' then interp else 0 end)::double interp, case s when 'PC_HeadPos' then v_provided end v_provided
      from (select *, unnest(['PC_HeadPos','TC_HeadPos']) s from tracking)""",
    "x y p interp v_provided",
)
def stream_split(spark, sf):
    t = V.tracking(spark, sf)
    cols = {"PC_HeadPos.X": "x", "PC_HeadPos.Y": "y", "PC_HeadPos.P": "p", "PC_HeadPos.Int": "interp", "TC_HeadPos.X": "y", "TC_HeadPos.Y": "x", "PC_V": "v_provided", "EC_HeadPos.X": "x"}
    w = t.select("session", "frame_id", "ts", *[F.col(c).alias(n) for n, c in cols.items()])
    return T.stream_split(w).drop("session", "ts")


@check("time_range_filter", "select frame_id, ts from tracking where ts between 86400 and 864000", "ts")
def time_range_filter(spark, sf):
    return FR.time_range_filter(V.tracking(spark, sf), 86400, 864000).select("frame_id", "ts")


@check("time_range_half_open", "select frame_id, ts from tracking where ts>=86400 and ts<864000", "ts")
def time_range_half_open(spark, sf):
    return FR.time_range_filter(V.tracking(spark, sf), 86400, 864000, closed=False).select("frame_id", "ts")


@check("filter_by_labels", "select cell, label from units where label in ('Brand#11','Brand#12','Brand#13') and is_hd")
def filter_by_labels(spark, sf):
    wanted = {"label": ["Brand#11", "Brand#12", "Brand#13"], "is_hd": True}
    return FR.filter_by_labels(V.units(spark, sf), wanted).select("cell", "label")


@check("filter_label_counts", "select count(*) filter (where is_hd and is_grid) n_active, count(*) n_total from units")
def filter_label_counts(spark, sf):
    return FR.label_counts(V.units(spark, sf), {"is_hd": True, "is_grid": True})


@check(
    "include_exclude_filter",
    "select cell, label, rate, 'out' list from units where label not in ('Brand#11', 'Brand#12') and rate between 905 and 1400 union all select cell, label, rate, 'in' from units where label in ('Brand#11', 'Brand#13') and label<>'Brand#13' and rate between 905 and 1400",
    "rate",
)
def include_exclude_filter(spark, sf):
    out = FR.include_exclude_filter(V.units(spark, sf), (), ("Brand#11", "Brand#12"), 905.0, 1400.0).withColumn("list", F.lit("out"))
    into = FR.include_exclude_filter(V.units(spark, sf), ("Brand#11", "Brand#13"), ("Brand#13",), 905.0, 1400.0).withColumn("list", F.lit("in"))
    return out.unionByName(into).select("cell", "label", "rate", "list")


@check("drop_incomplete", "select frame_id, x, y from tracking where x is not null and y is not null", "x y")
def drop_incomplete(spark, sf):
    return FR.drop_incomplete(V.tracking(spark, sf), ["x", "y", "not_here"]).select("frame_id", "x", "y")


@check(
    "room_filter",
    """select 'both' "mode", count(*) n from pred_long where actual_room in ('A','a') union all
      select 'source', count(*) from pred_long where actual_room='A' union all select 'target', count(*) from pred_long where actual_room='a'""",
)
def room_filter(spark, sf):
    p = V.pred_long(spark, sf)
    parts = [
        FR.room_filter(p, "A", "a", m, "actual_room").groupBy(F.lit(m).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
        for m in ("both", "source", "target")
    ]
    return FR.union_by_name(*parts)


@check(
    "prediction_columns",
    "select row_key, offset_no, x_pred_B best_x, x x_shared from wide_pred", "best_x x_shared",
)
def prediction_columns(spark, sf):
    w = wide(spark, sf).withColumn("x_pred", F.col("x"))
    return w.select("row_key", "offset_no", D.best_prediction(w, "x", "B").alias("best_x"), D.best_prediction(w, "x", "Z").alias("x_shared"))


@check(
    "melt_predictions",
    """select row_key, offset_no, fold, unnest(['x_pred','y_pred']) pred_col, unnest([x_pred,y_pred]) "value", predicted_room
      from pred_long""",
    "value",
)
def melt_predictions(spark, sf):
    return D.melt_predictions(V.pred_long(spark, sf), [*KEYS, "predicted_room", "not_here"], D.prediction_columns(["x", "y"]))


@check(
    "pivot_predictions",
    "select row_key, offset_no, fold, x_pred_A, y_pred_A, x_pred_B, y_pred_B, x_pred_a2, y_pred_a2 from wide_pred",
    "x_pred_A y_pred_A x_pred_B y_pred_B x_pred_a2 y_pred_a2",
)
def pivot_predictions(spark, sf):
    wide = D.pivot_predictions(V.pred_keyed(spark, sf, by=V.ROW), [*V.ROW, *KEYS[1:]], ROOM_NAMES, "offset_no")
    return wide.selectExpr(V.ROW_KEY, "* except (" + ", ".join(V.ROW) + ")")


@check(
    "target_pred_join",
    """select t.row_key, t.offset_no, t.fold, t.x, t.y, p.x_pred_A, p.y_pred_A from (
        select row_key, offset_no, fold, min(x) x, min(y) y from pred_long group by all) t
      full join (select row_key, offset_no, fold, x_pred_A, y_pred_A from wide_pred where room<>'B') p using (row_key, offset_no, fold)""",
    "x y x_pred_A y_pred_A",
)
def target_pred_join(spark, sf):
    p = V.pred_long(spark, sf, by=KEYS)
    wide_a = D.pivot_predictions(p.filter("actual_room <> 'B'"), KEYS, ["A"], "row_key")
    return D.target_pred_join(D.first_targets(p, KEYS, ["x", "y"], "row_key"), wide_a, KEYS)


@check("set_filter", "select row_key, offset_no, predicted_room, actual_room, x from pred_long where set_name='test'", "x")
def set_filter(spark, sf):
    return D.test_rows(V.pred_long(spark, sf)).select("row_key", "offset_no", "predicted_room", "actual_room", "x")


@check(
    "normalise_room",
    """select event_id, case when r is null then null when position('''' in r)>0 and upper(r[1:1])||lower(r[2:])=r then lower(replace(r,'''','')) else r end room
      from (select event_id, case event_type when 'signup' then null when 'error' then 'A''' when 'click' then 'B' when 'view' then 'aB''' else 'C''' end r from events)""",
)
def normalise_room(spark, sf):
    e = V.table(spark, sf, "events").selectExpr(
        "event_id", "case event_type when 'signup' then null when 'error' then \"A'\" when 'click' then 'B' when 'view' then \"aB'\" else \"C'\" end r"
    )
    return e.select("event_id", FR.normalise_room("r").alias("room"))


@check(
    "normalise_room_list",
    """select user_id, '['||string_agg(distinct case event_type when 'error' then 'a' else event_type end, ',' order by case event_type when 'error' then 'a' else event_type end)||']' rooms
      from events group by user_id""",
)
def normalise_room_list(spark, sf):
    e = V.table(spark, sf, "events").selectExpr("user_id", "case event_type when 'error' then \"A'\" else event_type end r")
    lists = e.groupBy("user_id").agg(F.array_sort(F.transform(F.collect_set("r"), FR.normalise_room)).alias("r"))
    return lists.select("user_id", FR.normalise_rooms("r").alias("rooms"))


@check(
    "scale_positions",
    """with b as (select session, least(min(x),min(y)) lo, greatest(max(x),max(y)) hi from tracking group by session)
      select frame_id, (x-lo)/(hi-lo) x_unit, x x_back, y*(1/(hi-lo)) y_scaled, x/(1/(hi-lo)) x_unscaled from tracking join b using (session)""",
    "x_unit x_back y_scaled x_unscaled",
)
def scale_positions(spark, sf):
    t = V.tracking(spark, sf)
    s = t.join(FR.minmax_scaler(t, ["x", "y"], ["session"]), "session")
    k, b = F.col("scale"), F.col("offset")
    unit = FR.scale_positions("x", k, b)
    return s.select(
        "frame_id", unit.alias("x_unit"), FR.scale_positions(unit, k, b, reverse=True).alias("x_back"),
        FR.scale_positions("y", k, scale_only=True).alias("y_scaled"), FR.scale_positions("x", k, reverse=True, scale_only=True).alias("x_unscaled"),
    )


@check("rmse_to_cm", "select fold, sqrt(avg((x-x_pred)^2))*100 rmse_x, avg(x) mean_x from pred_long group by fold", "rmse_x mean_x")
def rmse_to_cm(spark, sf):
    t = V.pred_long(spark, sf).groupBy("fold").agg(F.sqrt(F.avg(F.pow(F.col("x") - F.col("x_pred"), 2))).alias("rmse_x"), F.avg("x").alias("mean_x"))
    return FR.rmse_to_cm(t, 100.0)


@check(
    "validate_table",
    """select session, count(*) n_rows, count(*) filter (where ts is null) missing_times, count(*)-count(distinct ts) duplicate_times,
      count(*) filter (where ts<b)=0 is_monotonic, 2 n_cell_columns, 1 n_empty_cells
      from (select *, lag(ts) over (partition by session order by frame_id) b from tracking) group by session""",
)
def validate_table(spark, sf):
    t = V.tracking(spark, sf).withColumns({"Cell_1": F.col("x"), "Cell_2": F.lit(float("nan"))})
    return FR.validate_table(t, ["session"], required=["ts", "x", "y"])


@check(
    "row_finite_mask",
    """select stream, count(*) n_total, count(*) filter (where x is null or y is null) n_dropped,
      100.0*count(*) filter (where x is null or y is null)/count(*) pct_dropped from tracking group by stream""",
    "pct_dropped",
)
def row_finite_mask(spark, sf):
    return FR.finite_report(V.tracking(spark, sf), ["x", "y"], ["stream"])


@check("deg2rad", "select row_id, radians(hd) hd from activity", "hd")
def deg2rad(spark, sf):
    return FR.heading_radians(V.activity(spark, sf).select("row_id", "hd"))


@check("select_by_rooms", "select distinct actual_room room from pred_long where actual_room in ('a','A','Z')")
def select_by_rooms(spark, sf):
    return FR.select_by_rooms(V.pred_long(spark, sf).withColumnRenamed("actual_room", "room"), ["a", "A", "Z"])


@check(
    "union_by_name",
    "select p_partkey cell, p_size size, null::double rate from part union all select p_partkey, null, p_retailprice from part", "size rate",
)
def union_by_name(spark, sf):
    p = V.table(spark, sf, "part")
    return FR.union_by_name(p.selectExpr("p_partkey cell", "cast(p_size as double) size"), p.selectExpr("p_retailprice rate", "p_partkey cell"))


@check("except_rows", "select event_id from events where user_id not in (select user_id from events where value>480)")
def except_rows(spark, sf):
    e = V.table(spark, sf, "events")
    return FR.except_rows(e, e.filter("value > 480"), ["user_id"]).select("event_id")


@check("common_ids", "select o_custkey id from orders intersect select c_custkey from customer where c_acctbal>0")
def common_ids(spark, sf):
    o = V.table(spark, sf, "orders").selectExpr("o_custkey id")
    return FR.common_ids(o, V.table(spark, sf, "customer").filter("c_acctbal > 0").selectExpr("c_custkey id"), ["id"])


define(
    "angle_tables",
    "select row_id id, x real_d, y calc_d from positions",
)


@check("align_by_id", "select frame_id, ts, rate from tracking join (select row_id frame_id, rate from activity where rate>100) using (frame_id)", "ts rate")
def align_by_id(spark, sf):
    a = V.activity(spark, sf).filter("rate > 100").selectExpr("row_id frame_id", "rate")
    return FR.align_by_id(V.tracking(spark, sf).select("frame_id", "ts"), a, ["frame_id"])


@check("split_membership", "select frame_id, stream from tracking where ts in (select timestamp from activity where spikes=4)")
def split_membership(spark, sf):
    split = V.activity(spark, sf).filter("spikes = 4").selectExpr("timestamp ts")
    return FR.split_membership(V.tracking(spark, sf), split, ["ts"]).select("frame_id", "stream")


@check("count_lookup", "select actual_room, set_name, count(distinct fold) n_folds, count(distinct offset_no) n_offsets, count(*) n from pred_long group by all")
def count_lookup(spark, sf):
    return FR.count_lookup(V.pred_long(spark, sf), ["actual_room", "set_name"], {"fold": "n_folds", "offset_no": "n_offsets"})


@check("merge_latent", "select row_key, offset_no, fold, x_pred_A, (l_discount*3) PC1 from wide_pred join (select row_key rk, l_discount from (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, datediff('day', date '1990-01-01', cast(l_shipdate as date))) row_key, l_discount from lineitem)) on rk=row_key", "x_pred_A PC1")
def merge_latent(spark, sf):
    p = V.pred_long(spark, sf, by=KEYS)
    latent = V.table(spark, sf, "lineitem").selectExpr(
        "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string),"
        " cast(datediff(cast(l_shipdate as date), date'1990-01-01') as string)) row_key",
        "l_linenumber", "l_discount*3 PC1", "explode(array(0, 1)) offset_no",
    ).selectExpr("row_key", "offset_no", "cast((l_linenumber + offset_no) % 5 + 1 as int) fold", "PC1")
    return FR.align_by_id(D.pivot_predictions(p, KEYS, ["A"], "row_key").drop("y_pred_A"), latent, KEYS)


@check("distinct_groups", "select distinct fold, offset_no, actual_room from pred_long")
def distinct_groups(spark, sf):
    return FR.distinct_groups(V.pred_long(spark, sf), ["fold", "offset_no", "actual_room"])


@check("param_grid", "select flag, brand, n from (select distinct p_brand brand from part), (select unnest(['A', 'N', null]) flag), (select unnest([1, 2, 3]) n)")
def param_grid(spark, sf):
    brands = V.table(spark, sf, "part").select(F.col("p_brand").alias("brand"))
    return FR.param_grid(brands, {"flag": ["A", "N", None], "n": [1, 2, 3]}, ["flag"])


@check("skip_list", "select distinct fold, offset_no, predicted_room from pred_long except select fold, offset_no, predicted_room from pred_long where x_pred>1.095")
def skip_list(spark, sf):
    p = V.pred_long(spark, sf)
    grid = FR.distinct_groups(p, ["fold", "offset_no", "predicted_room"])
    return FR.skip_list(grid, p.filter("x_pred > 1.095"), ["fold", "offset_no", "predicted_room"])


@check(
    "missing_pairs",
    """select * from (select distinct l_partkey supp from lineitem), (select unnest(range(1,8))::int fold), (select unnest([0,1])::int offset_no)
      except select l_partkey, l_linenumber, (l_quantity>25)::int from lineitem""",
)
def missing_pairs(spark, sf):
    li = V.table(spark, sf, "lineitem").selectExpr("l_partkey supp", "l_linenumber fold", "int(l_quantity > 25) offset_no")
    return FR.missing_pairs(li, ["supp"], 7, [0, 1])


@check(
    "training_plan",
    """select step, fold, offset_no from (select distinct case when actual_room in ('A','B') then 'A+B' else actual_room end step from pred_long),
      (select unnest(range(1,11))::int fold), (select unnest([0,1,2])::int offset_no)
      except select case when actual_room in ('A','B') then 'A+B' else actual_room end, fold, offset_no from pred_long where set_name='test'""",
)
def training_plan(spark, sf):
    p = V.pred_long(spark, sf).withColumnRenamed("actual_room", "room")
    done = p.filter("set_name = 'test'").withColumn("step", F.when(F.col("room").isin("A", "B"), "A+B").otherwise(F.col("room")))
    return FR.training_plan(10, [0, 1, 2], ["A", "B"], p.select("room"), done)


@check("sort_keys", "select row_key, offset_no, fold, x from wide_pred", "x")
def sort_keys(spark, sf):
    return FR.sort_keys(wide(spark, sf).select(*KEYS, "x"))


@check(
    "room_order",
    """select distinct l_shipmode room, (case l_shipmode when 'RAIL' then 1 when 'AIR' then 2 else 3 end)::int room_rank, length(l_shipmode)::int room_length
      from (select event_type l_shipmode from events)""",
)
def room_order(spark, sf):
    rooms = V.table(spark, sf, "events").selectExpr("event_type room").distinct()
    return FR.room_order(rooms, ["RAIL", "AIR"])


@check(
    "columns_long",
    """select row_id, 'cell' kind, 'Cell_'||i label, cast(null as double) angle, case i when 1 then rate else spikes::double end "value" from activity, unnest([1, 2]) t(i)
      union all select row_id, 'allo', cast(null as varchar), a, hd+a from activity, unnest([-90.0, 0.0, 45.5]::double[]) t(a)""",
    "value angle",
)
def columns_long(spark, sf):
    """A session table as recorded, a column per cell and per angle to a wall, made long."""
    wide = V.activity(spark, sf).select(
        "row_id", F.col("rate").alias("Cell_1"), F.col("spikes").cast("double").alias("Cell_2"), *[(F.col("hd") + a).alias(f"Allo_{a:g}") for a in (-90.0, 0.0, 45.5)]
    )
    cells = T.columns_long(wide, "Cell", ["row_id"]).select("row_id", F.lit("cell").alias("kind"), "label", F.lit(None).cast("double").alias("angle"), "value")
    walls = T.columns_long(wide, "Allo_", ["row_id"], "angle", angle=True)
    return cells.unionByName(walls.select("row_id", F.lit("allo").alias("kind"), F.lit(None).cast("string").alias("label"), "angle", "value"))
