"""Tracking, activity, prediction and room tables laid over the generic test tables.

Every view is a plain projection of a parquet scan (rows fan out with ``explode`` where one row stands for several
predictions), so filters and column choices of a query reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.operators.rooms import Polygon, Room

# The recording starts 2024-01-01 00:00 UTC; times are seconds from there.
EPOCH_MICROS = 1704067200000000
SEC = f"(unix_micros(cast(ts as timestamp)) - {EPOCH_MICROS}) / 1e6D"
KNOB = "get_json_object(props, '$.k')"

# Room intervals in seconds (day 10 to 11 belongs to no room) and room outlines.
ROOMS = [Room("A", 0, 0.0, 864000.0), Room("B", 1, 950400.0, 1728000.0), Room("a", 0, 1728000.0, 2592000.0)]
POLYGONS = [
    Polygon("A", [(-0.05, -0.05), (0.95, -0.05), (0.95, 0.95), (-0.05, 0.95)]),
    Polygon("B", [(0.0, 0.0), (1.0, 0.1), (0.9, 1.1), (0.1, 0.9)]),
    Polygon("a", [(0.1, 0.0), (1.1, 0.3), (0.6, 1.1)]),
]
PAIRS = [("A", "B"), ("A", "a"), ("B", "a")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking_frames(table(spark, sf_dir, "events"))


def tracking_frames(events: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Tracking frames of an event table or stream; ``extra`` adds expressions over the events."""
    return events.selectExpr(
        "user_id session",
        "concat(case user_id % 3 when 0 then 'PC' when 1 then 'TC' else 'EC' end, '_HeadPos') stream",
        "event_id frame_id",
        f"{SEC} ts",
        "case when event_type = 'signup' then null else value end x",
        f"case when event_type = 'signup' then null else cast({KNOB} as double) end y",
        f"cast({KNOB} as double) / 100 p",
        "case when event_type = 'error' then 1 else 0 end interp",
        "value / 10 v_provided",
        *(extra or []),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id row_id",
        f"{SEC} timestamp",
        "cast(user_id % 12 as int) cell",
        "value rate",
        f"cast(cast({KNOB} as int) % 5 as int) spikes",
        f"cast({KNOB} as double) * 3.6D hd",
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey cell", "p_brand label", "p_type subtype", "p_retailprice rate",
        "p_size % 2 = 0 is_hd", "p_size % 3 = 0 is_grid", "p_size % 5 = 0 is_border",
    )


#: The five numbers that name a row of predictions, and their text.
ROW = ["row_order", "row_line", "row_part", "row_supplier", "row_day"]
ROW_TEXT = f"concat_ws('-', {', '.join(f'cast({c} as string)' for c in ROW)})"
ROW_KEY = f"{ROW_TEXT} row_key"
#: Frames that a task holds when they are dealt by key.
FRAMES_PER_TASK = 250_000


def pred_long(spark: SparkSession, sf_dir: str, by: Sequence[str] = ()) -> DataFrame:
    return _predictions(_frames(spark, sf_dir), [ROW_KEY], by)


def pred_keyed(spark: SparkSession, sf_dir: str, by: Sequence[str] = ()) -> DataFrame:
    """``pred_long`` with the numbers of ``ROW`` in place of ``row_key``: cheaper to hash, shuffle and compare than a text."""
    return _predictions(_frames(spark, sf_dir), ROW, by)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey row_order", "l_linenumber row_line", "l_partkey row_part", "l_suppkey row_supplier",
        "datediff(cast(l_shipdate as date), date'1990-01-01') row_day",
        "case l_returnflag when 'A' then 'A' when 'N' then 'a' else 'B' end actual_room",
        "case when l_linestatus = 'O' then 'test' else 'train' end set_name",
        "l_quantity / 50 x",
        "l_extendedprice / 105000 y",
        "l_discount",
        "l_tax",
    )


def _dealt(rows: DataFrame, by: Sequence[str], frames: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-frames.count() // FRAMES_PER_TASK))
    # the numbers travel, and the text is made again behind the shuffle: Spark knows the two as one
    return rows.repartition(tasks, *[F.expr(ROW_TEXT) if c == "row_key" else F.col(c) for c in by])


def _predictions(frames: DataFrame, row: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A row per frame, offset and decoder.

    ``by``: frames are dealt to tasks by these columns before they fan out, so that steps grouped or joined by them (and more columns)
    shuffle frames and not predictions. The number of tasks grows with the frames, as what a task makes of them is several times larger.
    """
    early = bool(by) and {*by} <= {"row_key", *frames.columns}
    rows = (_dealt(frames, by, frames) if early else frames).selectExpr("*", "explode(array(0, 1)) offset_no")
    rows = rows.selectExpr("*", "cast((row_line + offset_no) % 5 + 1 as int) fold")
    if by and not early:
        rows = _dealt(rows, by, frames)
    decoders = (
        "inline(array(named_struct('predicted_room', 'A', 'ca', 1D, 'cb', 0D),"
        " named_struct('predicted_room', 'B', 'ca', 0.8D, 'cb', 0.2D),"
        " named_struct('predicted_room', 'a', 'ca', 0.9D, 'cb', -0.1D)))"
    )
    return rows.selectExpr("*", decoders).selectExpr(
        *row,
        "offset_no",
        "fold",
        "actual_room",
        "predicted_room",
        "set_name",
        "x",
        "y",
        "x*ca + y*cb + (l_discount-0.05D)*2 + offset_no*0.01D x_pred",
        "y*ca - x*cb + (l_tax-0.04D)*3 - offset_no*0.01D y_pred",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id cell", "label cluster_label", "embedding")


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .selectExpr(
            "p_partkey", "p_retailprice", "p_size",
            "inline(array(named_struct('room', 'A', 'm', 1D), named_struct('room', 'B', 'm', -0.5D),"
            " named_struct('room', 'a', 'm', 0.25D)))",
        )
        .selectExpr("p_partkey cell", "room", "p_retailprice*m + p_size score")
    )


def subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("subset_id"))
        .agg(
            F.collect_list("l_partkey").alias("cells"),
            F.count(F.lit(1)).cast("int").alias("size"),
            (F.avg("l_discount") * 10).alias("r2"),
        )
        .withColumn("is_baseline", F.col("subset_id") % 10 == 0)
    )


def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat(l_returnflag, '_', l_linestatus) room_pair", "l_discount rate"
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a position, a heading, a cell and its rate, for the map operators."""
    return (
        table(spark, sf_dir, "events")
        .filter("event_type <> 'signup'")
        .selectExpr(
            "event_id row_id", f"{SEC} ts", "user_id session", "cast(user_id % 12 as int) cell",
            "value / 500 x", f"cast({KNOB} as double) / 100 y",
            f"cast({KNOB} as double) * 3.6D hd", "value rate",
            f"cast(cast({KNOB} as int) % 5 as int) spikes", f"cast({KNOB} as double) / 100 p",
        )
    )
