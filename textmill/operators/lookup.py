"""Tables that are stored for reading by key: rows of few keys come from the files and pages that hold them, not from a scan.

Rows are dealt to folders by a checksum of the key, a partition column that Spark prunes before it opens a file; within a file they are
sorted by key, so that the pushed key filter skips row groups and pages by their bounds. A hot key's rows are spread over
SALT files of its folder, so no task writes them all. Many keys are joined instead.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..storage import fresh_path

#: Keys up to which a look-up is a pushed filter; they are in the plan. More are joined.
KEYS = 2000
ROWS_PER_BUCKET, MOST_BUCKETS = 200_000, 4096
#: Files that a folder's rows, and so a hot key's, are spread over, and rows of a table that is not worth it.
SALT, ROWS_PER_FILE = 8, 5000


class Lookup:
    """A stored table and the column that it is read by. ``path`` is its folder; a lost reader opens it again by the same arguments."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema, buckets: int):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.columns = [f.name for f in schema]
        self._all = spark.read.schema(StructType([*schema.fields, StructField("_bucket", IntegerType())])).parquet(path)

    @classmethod
    def write(cls, rows: DataFrame, key: str, label: str, count: int | None = None) -> Lookup:
        """Store ``rows`` by ``key`` (a string column, no nulls). ``count``: how many there are, if that is known."""
        spark = rows.sparkSession
        n = rows.count() if count is None else count
        buckets = max(1, min(MOST_BUCKETS, -(-n // ROWS_PER_BUCKET)))
        salt = SALT if n > ROWS_PER_FILE else 1
        rest = [c for c in rows.columns if c != key]
        dealt = rows.withColumn("_bucket", _bucket(F.col(key), buckets)).withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(salt)) if rest else F.lit(0))
        path = fresh_path(spark, label)
        dealt = dealt.repartition(buckets * salt, "_bucket", "_salt").drop("_salt").sortWithinPartitions("_bucket", key)
        dealt.write.partitionBy("_bucket").option("parquet.page.row.count.limit", 2000).parquet(path)
        return cls(spark, path, key, rows.schema, buckets)

    def all(self) -> DataFrame:
        return self._all.select(*self.columns)

    def of(self, keys: list[str]) -> DataFrame:
        """The rows of at most KEYS keys, by pruned folders and a pushed filter."""
        if len(keys) > KEYS:
            raise ValueError(f"more than {KEYS} keys; join instead")
        _push_long_lists(self.spark)
        buckets = sorted({zlib.crc32(k.encode()) % self.buckets for k in keys})
        return self._all.where(F.col("_bucket").isin(buckets) & F.col(self.key).isin(list(keys))).select(*self.columns)

    def of_frame(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys in ``keys`` (one column of the key's name), however many: a look-up if they are few, else a join."""
        some = few(keys)
        if some is not None:
            return self.of(some)
        return self.all().join(keys.select(self.key).distinct().hint("merge"), self.key, "left_semi")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(key.cast("binary")), F.lit(buckets)).cast("int")


def _push_long_lists(spark: SparkSession) -> None:
    """Push key lists as lists, not only their bounds, unless the session already asks for longer ones."""
    name = "spark.sql.parquet.pushdown.inFilterThreshold"
    if int(spark.conf.get(name, "10")) < KEYS:
        spark.conf.set(name, str(KEYS))


def few(keys: DataFrame, most: int | None = None) -> list[str] | None:
    """The distinct keys (first column) if there are at most ``most`` (KEYS), else None; never more than that reach the driver."""
    most = KEYS if most is None else most
    got = keys.where(F.col(keys.columns[0]).isNotNull()).distinct().limit(most + 1).collect()
    return None if len(got) > most else [r[0] for r in got]
