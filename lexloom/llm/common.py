"""Shared plumbing: where intermediate tables live and how Arrow batches reach numpy."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.skew import spread_join

__all__ = ["SLICE_BYTES", "new_path", "read_table", "remove", "shared_dir", "slices", "spread_join", "tidy", "utf8", "written"]

#: Texts are worked on in slices of about so many bytes, to bound a worker's memory.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch, at most, while a table is written.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, and where that is unset (tests), a temporary one is made and kept in the session; on a cluster an
    unset one is an error, as no folder of one machine will do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.lexloom.local.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.lexloom.local.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexloom-{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of ours that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """While a table is written, rows go to Python in batches of at most BATCH_ROWS, so that batches of whole texts, of two in a
    row where pairs are confirmed, stay small on both sides."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with _short_batches(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def tidy(rows):
    """A function of Arrow batches that gives memory back to the system when a task has run, as idle workers live on beside the
    JVM of their executor."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(parts)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and where each row begins (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer row is alone."""
    low, n = 0, len(at) - 1
    while low < n:
        high = int(np.searchsorted(at, at[low] + limit, side="right")) - 1
        high = min(n, max(low + 1, high))
        yield low, high
        low = high
