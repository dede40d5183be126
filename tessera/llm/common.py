"""What the corpus operators share: shared folder, table reading, group counts, raw column buffers."""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words, as a Java and RE2 class: space, and the controls 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACES = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir or the context's own checkpoint folder names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder.rstrip("/")


def goes_at_end(spark: SparkSession, place: str) -> str:
    """``place``, which is deleted when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return place


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """What is ``stored`` inside goes at the end of the block, but for what is kept."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for frame in _SCOPES.pop():
            dropped(frame)


def stored(frame: DataFrame, keep: bool = False) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again; the table goes when the application ends, or with the ``scratch`` block around it unless it is to ``keep``."""
    spark = frame.sparkSession
    place = goes_at_end(spark, f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}")
    frame.write.parquet(place)
    found = spark.read.schema(frame.schema).parquet(place)
    if _SCOPES and not keep:
        _SCOPES[-1].append(found)
    return found


def dropped(frame: DataFrame) -> None:
    """Delete a ``stored`` table that nothing reads any more."""
    spark = frame.sparkSession
    for file in frame.inputFiles()[:1]:
        place = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if place.getName().startswith("tessera-"):
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def give_back() -> None:
    """Give free memory back to the system; a Python worker waits for its next task with it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def group_count(frame: DataFrame, text: Column, group_mb: float) -> int:
    """How many groups of about ``group_mb`` MB the texts make; one pass over the column's lengths."""
    total = frame.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(1, math.ceil(total / (group_mb * 1e6)))


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as (bytes, offsets), nulls as empty; no copy where the column is one chunk."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if len(column) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return text, ends - ends[0]
