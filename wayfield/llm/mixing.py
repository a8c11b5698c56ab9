"""Sources mixed to target weights by pivotal dependent rounding.

A source's target comes from its weight, is at most ``most`` times its size, and what is cut off goes to the other sources
by weight (the fixed point is a common level: target = min(most x size, level x weight)). Every document of a source is
wanted target / size times: the whole part of that number is given, the fraction is decided by pairs. A pair moves mass
(fraction x size) from one to the other, in a random direction that keeps the expectation, until one of them is whole.
So the words taken change by nothing until the last document of a source is rounded: a source misses its target by less
than one document.

Documents are dealt to chunks of a source by a hash of the id. Each chunk leaves one fraction at most; these are paired
again in groups of ``fan`` chunks, level by level, until one document of a source is left, which its own fraction decides.
Every random number is a hash of seed and id: runs agree, whatever the partitions and lost executors.

Repeated rows (equal id, source and size) are one unit and get the same number of copies. Sources are ordered by code
point, null last; a null text has size 0 and takes nothing; a table without words takes nothing.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from wayfield.llm.store import written

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n_units -> with target. One row per source goes through one task, as in any ranking of sources."""
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").isNull(), "source")) - 1
    out = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int")))
    out = out.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("wanted", F.lit(share) * F.sum("source_size").over(every))
    by_level = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    full_before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("level", (F.col("wanted") - full_before) / weight_left)
    # sources in order of cap / weight are full as long as the level of the rest lies above theirs
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)
    return out.withColumn("target", F.coalesce(F.least(F.col("cap"), level["level"] * F.col("weight")), F.col("cap"))).drop("wanted", "level", "cap")


def _pairs(last: bool):
    def run(units: pa.Table) -> pa.Table:
        units = units.sort_by([("draw", "ascending"), ("id", "ascending"), ("size", "ascending")])
        part, mass, draw = units["part"].to_pylist(), units["mass"].to_pylist(), units["draw"].to_pylist()
        held = -1
        for i in range(len(part)):
            if not 0.0 < part[i] < 1.0:
                continue
            if held < 0:
                held = i
                continue
            a, b, sa, sb = part[held], part[i], mass[held], mass[i]
            give, take = min(a * sa, (1.0 - b) * sb), min(b * sb, (1.0 - a) * sa)
            if (draw[i] & 0xFFFFFFFFFFFF) / float(1 << 48) * (give + take) < take:
                if a * sa <= (1.0 - b) * sb:
                    part[held], part[i] = 0.0, min(1.0, b + give / sb)
                else:
                    part[held], part[i] = max(0.0, a - give / sa), 1.0
            elif b * sb <= (1.0 - a) * sa:
                part[held], part[i] = min(1.0, a + take / sa), 0.0
            else:
                part[held], part[i] = 1.0, max(0.0, b - take / sb)
            held = next((k for k in (held, i) if 0.0 < part[k] < 1.0), -1)
        if last and held >= 0:
            part[held] = float((draw[held] >> 8 & 0xFFFFFFFFFFFF) / float(1 << 48) < part[held])
        return units.set_column(units.schema.get_field_index("part"), "part", pa.array(part, type=pa.float64()))

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, chunk_rows: int = 2000, fan: int = 16, seed: int = 11) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies."""
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(text).alias("size")), "sizes")
    plan = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")), weights, share, most), "targets")
    chunks = plan.agg(F.max(F.ceil(F.col("n_rows") / chunk_rows))).first()[0] or 1
    units = rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    joined = units.alias("u").join(plan.alias("p"), F.expr("u.source <=> p.source"))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = joined.select(
        "u.*", "source_size", "target", F.floor(wanted).alias("copies"), F.when(F.col("size") > 0, wanted - F.floor(wanted)).otherwise(0.0).alias("part"),
        (F.col("size") * F.col("n")).cast("double").alias("mass"), F.xxhash64(F.lit(seed), F.col("u.id")).alias("draw"),
        F.pmod(F.xxhash64(F.lit(seed + 1), F.col("u.id")), F.ceil(F.col("n_rows") / chunk_rows)).alias("chunk"),
    )
    done = []
    for level in range(1 + max(0, math.ceil(math.log(chunks, fan) - 1e-9))):
        if level:
            units = units.withColumn("chunk", F.floor(F.col("chunk") / fan))
        last = fan**level >= chunks
        units = written(units.groupBy("source", "chunk").applyInArrow(_pairs(last), units.schema), f"level{level}")
        done.append(units.filter("part = 0 or part = 1"))
        units = units.filter("part > 0 and part < 1")
    decided = done[0]
    for more in done[1:]:
        decided = decided.unionByName(more)
    decided = decided.select(F.struct("id", "source", "size").alias("k"), "source_size", "target", (F.col("copies") + F.col("part")).cast("long").alias("copies"))
    return rows.join(decided, F.expr("id <=> k.id and source <=> k.source and size = k.size")).select(F.col("id").alias(id_col), F.col("source").alias(source), "size", "source_size", "target", "copies")
