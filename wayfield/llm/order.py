"""Row numbers inside groups of any size: rows are dealt by ranges of (group, order), so a large group spreads over many tasks.

A group that goes on in the next range continues its count there; the table of such continuations has a row per range at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfield.llm.store import written


def run_starts(columns: list[pa.Array]) -> np.ndarray:
    """Where any of the columns differs from the row before; the first row counts as a start. Nulls are equal."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = False
    for column in columns:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's place in its run of equal keys; the first column is the key."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0)
        starts = run_starts([key])
        place = np.arange(batch.num_rows)
        place -= np.repeat(place[starts], np.diff(np.append(starts, batch.num_rows)))
        head = key[0].as_py()
        carried = seen if last is not None and last[0] == head else 0
        first = starts[1] if len(starts) > 1 else batch.num_rows
        place[:first] += carried
        last, seen = (key[-1].as_py(),), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "n"])


def numbered(rows: DataFrame, key: str, order: list[str], name: str = "numbered", within: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``n``: 0, 1, ... inside each ``key`` in the order given, nulls first; written, so it is worked out once.

    Rows that are equal in key and order columns share a task, which streams them, ordered by the columns ``within``. A column called ``n`` or ``part`` is replaced.
    """
    rows = rows.select(key, *[c for c in rows.columns if c not in (key, "n", "part")])
    sort = [F.col(c).asc_nulls_first() for c in (key, *order)]
    ranges = rows.repartitionByRange(*sort).sortWithinPartitions(*sort, *(F.col(c).asc_nulls_first() for c in within)).withColumn("part", F.spark_partition_id())
    ranges = written(ranges.mapInArrow(_count, f"{_ddl(ranges)}, n long"), name)
    runs = ranges.groupBy(key, "part").agg(F.count(F.lit(1)).alias("run_rows"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    goes_on = written(runs.withColumn("before", F.sum("run_rows").over(before)).filter("before > 0").select(F.col(key).alias("key_r"), F.col("part").alias("part_r"), "before"), f"{name}-runs")
    out = ranges.join(goes_on, F.expr(f"part = part_r and `{key}` <=> key_r"), "left")
    return out.withColumn("n", F.col("n") + F.coalesce("before", F.lit(0))).drop("key_r", "part_r", "before", "part")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
