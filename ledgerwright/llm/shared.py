"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in the contracts that say "[^\x20\x09-\x0D]+".
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new temporary one where that is unset and Spark is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return str(found).rstrip("/")


def cut(df: DataFrame, *partition: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: its lineage ends there and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition:
        writer = writer.partitionBy(*partition)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, part: str = "") -> None:
    """Delete what :func:`cut` has written for ``df``, or one partition folder of it, once nothing reads it any more."""
    spark = df.sparkSession
    for root in {re.match(r".*/cut-[0-9a-f]{32}", f)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{part}".rstrip("/"))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_key(id_column: str = "doc_id", text_column: str = "text") -> list:
    """A join key that tells rows with one id and different texts apart; equal rows share it and have equal results."""
    return [F.col(id_column), F.coalesce(F.xxhash64(text_column), F.lit(0)).alias("text_hash")]


def word_count(text: str):
    """Number of runs of non-space characters; 0 for null."""
    return F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(F.array_remove(F.split(F.col(text), SPACES), ""))).cast("long")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow string column after one another, and the n + 1 offsets of the texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def code_points(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Like :func:`utf8`, in code points (uint32)."""
    raw, at = utf8(column)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = (raw & 0xC0) != 0x80
    counted = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(starts, out=counted[1:])
    return points, counted[at]


def small_batches(batches, rows: int = 512, size: int = 8 << 20):
    """Arrow batches cut so that none holds more than ``rows`` rows or, beyond one row, about ``size`` bytes; at the end free memory goes back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(rows, int(batch.num_rows * size / max(1, batch.nbytes))))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)
    give_back()


def give_back() -> None:
    """Return free memory to the system: Python workers live on after their task, beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
