"""Shared storage of a job: written tables cut the lineage of iterative operators, so a lost executor costs a re-read.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only on one machine (master ``local[...]``) a temporary
folder takes its place where that is unset.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Rows and bytes up to which a frame may be broadcast. Both are measured first, each time.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/textmill/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write as Parquet to the shared folder and read back."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is still there, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _width(df: DataFrame):
    """Bytes of a row: fixed types by their size, text and nested columns by their content."""
    wide = [f.name for f in df.schema if isinstance(f.dataType, StringType | BinaryType)]
    nested = [f.name for f in df.schema if isinstance(f.dataType, ArrayType | MapType | StructType)]
    total = F.lit(8 * len(df.columns) + 16).cast("long")
    for c in wide:
        total = total + F.coalesce(F.octet_length(c), F.lit(0))
    if nested:
        total = total + F.octet_length(F.to_json(F.struct(*nested)))
    return total


def measured(df: DataFrame, most: int = BROADCAST_ROWS) -> tuple[int, int]:
    """(rows, bytes) of a frame that is cheap to read, counted up to ``most`` + 1 rows."""
    n, b = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(_width(df)), F.lit(0))).head()
    return n, b


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    n, b = measured(df, rows)
    return n <= rows and b <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if a measurement shows at most ``rows`` rows and ``size`` bytes; else the join shuffles."""
    return F.broadcast(df) if fits_broadcast(df, rows, size) else df.hint("merge")


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """``df`` with its rows' numbers from 1 in the order of some columns (rows that tie are numbered at will): sorted by range, numbered
    within each range, and moved on by what the ranges before hold, one row a range."""
    ranges = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranges.withColumn("_k", own).join(broadcast_if_small(base), "_part").withColumn(name, (F.col("_k") + F.col("_base")).cast("long")).drop("_part", "_k", "_base")
