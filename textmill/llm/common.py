"""Shared plumbing of the training-data operators: shared storage, size-checked broadcasts, row keys.

Everything that outlives one task goes to the folder in ``spark.checkpoint.dir`` (see `textmill.storage`).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, fresh_path, materialize, shared_dir

__all__ = ["bounded_batches", "broadcast_if_small", "doc_key", "fresh_path", "materialize", "open_fs", "release", "shared_dir", "table"]


#: Bytes and rows of an Arrow batch that goes to a Python worker.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4000


def bounded_batches(spark: SparkSession) -> None:
    """Keep what a Python worker holds at a time small, unless the session asks for still less."""
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower()
    if not size.rstrip("b").isdigit() or not 0 < int(size.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release() -> None:
    """At a task's end: give memory that the worker no longer uses back to the system, as workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def open_fs(uri: str):
    """(filesystem, path) of a URI in the shared folder, for byte-range IO inside tasks."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two never-null columns (k1, k2) that stand for a row in joins.

    Rows with the same pair have the same id and the same text, hence the same result, so repeated rows
    and null ids need no special path.
    """
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k1"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull()).alias("k2"),
    ]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
