"""Reading and writing session tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfield.functions.numeric import finite

# The source prefixes of tracking streams.
SOURCE_PREFIXES = ("TC_", "PC_", "EC_")


def scan_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A session table from CSV (schema required) or parquet; NaN becomes missing."""
    if str(path).rstrip("/").endswith((".csv", ".csv.gz")):
        if schema is None:
            raise ValueError("a CSV scan needs a schema: inferring one reads the whole table twice")
        df = spark.read.schema(schema).csv(path, header=True)
    else:
        df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    df = df.select(*columns) if columns else df
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite(c) for c in floating}) if floating else df


def write_table(df: DataFrame, path: str, overwrite: bool = False, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite, or append to, a table. CSV files carry a header each."""
    writer = df.write.mode("overwrite" if overwrite else "append").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def collect_files(
    spark: SparkSession, folder: str, pattern: str, schema: T.StructType | str | None = None, fmt: str = "parquet",
    glob: str | None = None, parents: Sequence[str] | None = None, skip_unreadable: bool = False,
) -> DataFrame:
    """Rows of every file below ``folder`` whose name matches the regular expression, with ``_source_file``.

    ``glob`` narrows the listing itself; ``parents`` keeps files directly inside folders of these names. An
    unreadable file is an error unless ``skip_unreadable``.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", skip_unreadable)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV scan needs a schema")
        reader = reader.option("header", True)
    elif fmt == "parquet":
        reader = reader.option("mergeSchema", schema is None)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(fmt).load(folder)
    path = F.col("_metadata.file_path")
    out = df.select("*", path.alias("_source_file")).filter(F.element_at(F.split("_source_file", "/"), -1).rlike(f"^(?:{pattern})$"))
    if parents:
        out = out.filter(F.get(F.split("_source_file", "/"), F.size(F.split("_source_file", "/")) - 2).isin(list(parents)))
    return out


def skipped_files(
    spark: SparkSession, folder: str, pattern: str, schema: T.StructType | str, fmt: str = "parquet", glob: str | None = None, parents: Sequence[str] | None = None
) -> DataFrame:
    """``_source_file`` of every file that ``collect_files`` matches and, with ``skip_unreadable``, takes no row from: unreadable ones, and empty ones."""
    listed = collect_files(spark, folder, pattern, None, "binaryFile", glob, parents).select("_source_file")
    read = collect_files(spark, folder, pattern, schema, fmt, glob, parents, skip_unreadable=True)
    return listed.join(read.select("_source_file").distinct(), "_source_file", "left_anti")


def stats_files(spark: SparkSession, folder: str, name: str, schema: T.StructType | str | None = None, fmt: str = "parquet", parents: Sequence[str] | None = None) -> DataFrame:
    """All files of one name below a folder, optionally only under listed parent folders, as one table."""
    import re

    return collect_files(spark, folder, re.escape(name), schema, fmt, glob=name, parents=parents)


def stream_names(columns: Sequence[str]) -> list[str]:
    """Streams of a wide tracking table: prefixes of ``*.X`` columns that also have ``*.Y``."""
    names = {c[:-2] for c in columns if c.endswith(".X") and c.startswith(SOURCE_PREFIXES)}
    return sorted(n for n in names if f"{n}.Y" in columns)


def stream_split(wide: DataFrame, ids: Sequence[str] = ("session", "frame_id", "ts")) -> DataFrame:
    """Wide to long tracking: one row per frame and stream; absent P, Int and V columns give missing, 0 and missing."""
    have = set(wide.columns)

    def value(name: str, default) -> F.Column:
        return finite(F.col(f"`{name}`")) if name in have else F.lit(default).cast("double")

    packed = []
    for s in stream_names(wide.columns):
        packed.append(
            F.struct(
                F.lit(s).alias("stream"),
                value(f"{s}.X", None).alias("x"), value(f"{s}.Y", None).alias("y"), value(f"{s}.P", None).alias("p"),
                value(f"{s}.Int", 0.0).alias("interp"), value(f"{s[:2]}_V", None).alias("v_provided"),
            )
        )
    if not packed:
        raise ValueError("no stream columns")
    return wide.select(*ids, F.explode(F.array(*packed)).alias("_s")).select(*ids, "_s.*")


def columns_long(wide: DataFrame, prefix: str, ids: Sequence[str], label: str = "label", value: str = "value", angle: bool = False) -> DataFrame:
    """Wide to long over the columns of one prefix (``Cell``, ``Allo_``, ``Ego_``): a row per frame and column.

    The label is the column's name, or with ``angle`` the number behind the prefix, in degrees. Missing values stay as rows.
    """
    names = [c for c in wide.columns if c.startswith(prefix) and c not in ids]
    if not names:
        raise ValueError(f"no column begins with {prefix}")
    packed = [F.struct((F.lit(float(c.removeprefix(prefix))) if angle else F.lit(c)).alias(label), finite(F.col(f"`{c}`")).alias(value)) for c in names]
    return wide.select(*ids, F.explode(F.array(*packed)).alias("_s")).select(*ids, "_s.*")
