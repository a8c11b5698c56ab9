"""Tables and files in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import mmap
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from wayfield.session import shared_folder


_MADE: list[str] = []


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder of its own for one call; it stays until ``release``."""
    _MADE.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Remove the folders that this session's calls made (from the ``since``-th on), once their results have been used."""
    for folder in [f for f in _MADE[since:] if f not in keep]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _MADE.remove(folder)


def made() -> int:
    """How many folders there are now; a mark for ``release``."""
    return len(_MADE)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: evaluated once, and still there when an executor is lost."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI, as tasks reach it."""
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def put(folder: str, name: str, data: bytes | memoryview) -> str:
    """Write one file under a name of this attempt only: a repeated task never shares a file with the first."""
    fs, path = open_store(folder)
    fs.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{path}/{name}") as out:
        out.write(data)
    return name


def mapped(folder: str, name: str) -> np.ndarray:
    """A file's bytes, memory-mapped: in place where the store is a mounted folder, else through an unlinked local copy."""
    fs, path = open_store(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(f"{path}/{name}", "rb") as file:
            return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), dtype=np.uint8)
    with tempfile.TemporaryFile() as copy, fs.open_input_stream(f"{path}/{name}") as source:
        while part := source.read(1 << 20):
            copy.write(part)
        copy.flush()
        return np.frombuffer(mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ), dtype=np.uint8)


def crc_rest(key: Column, by: int) -> Column:
    """crc32 of a key's text, modulo ``by``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by
