"""A stored catalog in buckets of path hashes, of which a scan or a delete rewrites those alone that it has rows for.

What a bucket becomes is written beside the others first, below a hidden name, and then moved into its place; buckets without rows left are
removed. Stored and new rows are dealt by bucket and joined where they meet, so a text is shuffled and written once. Readers of the table see a bucket's old or new files, or none while it is moved.
One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from siftwell.operators import catalog as C
from siftwell.store import remove

BUCKETS = 256
#: Whether a join deals rows that are dealt by some of its keys again by all of them.
BY_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """rows with their bucket, dealt by it. Rows without a path share one."""
    return rows.withColumn("bucket", F.coalesce(_bucket(buckets), F.lit(0))).repartition("bucket")


def create(rows: DataFrame, uri: str, buckets: int = BUCKETS) -> DataFrame:
    """Write rows (path and others) as a new table. Rows without a path share a bucket."""
    _dealt(rows, buckets).write.partitionBy("bucket").option("compression", "zstd").parquet(uri)
    spark = rows.sparkSession
    spark.createDataFrame([(buckets, rows.schema.json())], "buckets int, columns string").coalesce(1).write.parquet(f"{uri}/_buckets")
    return read(spark, uri)


def _all(spark: SparkSession, uri: str) -> tuple[DataFrame, int]:
    told = spark.read.parquet(f"{uri}/_buckets").first()
    return spark.read.schema(StructType.fromJson(json.loads(told["columns"])).add("bucket", IntegerType())).parquet(uri), told["buckets"]


def read(spark: SparkSession, uri: str) -> DataFrame:
    return _all(spark, uri)[0].drop("bucket")


def _replace(stored: DataFrame, keys: DataFrame, uri: str, buckets: int, change) -> list[int]:
    """Rewrite the buckets of keys (path) by change(their stored rows, dealt by bucket); which they were."""
    spark = stored.sparkSession
    touched = sorted(r[0] for r in keys.where("path is not null").select(_bucket(buckets).alias("bucket")).distinct().collect())  # as many as buckets at most
    if not touched:
        return []
    before = stored.where(F.col("bucket").isin(touched))
    staged, by_all = f"{uri}/_staged-{uuid.uuid4().hex}", spark.conf.get(BY_ALL_KEYS)
    spark.conf.set(BY_ALL_KEYS, "false")
    try:
        change(_dealt(before.drop("bucket"), buckets)).write.partitionBy("bucket").option("compression", "zstd").parquet(staged)
    finally:
        spark.conf.set(BY_ALL_KEYS, by_all)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(uri).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for b in touched:
        remove(spark, f"{uri}/bucket={b}")
        if fs.exists(at(f"{staged}/bucket={b}")) and not fs.rename(at(f"{staged}/bucket={b}"), at(f"{uri}/bucket={b}")):
            raise OSError(f"bucket {b} could not be moved from {staged} to {uri}")
    remove(spark, staged)
    return touched


def upsert(spark: SparkSession, uri: str, scanned: DataFrame, keeps: tuple[str, ...] = ("doc_id", "created_at", "synopsis")) -> list[int]:
    """catalog.upsert() of scanned rows (path and others) into the table, in their buckets alone; which these were. Rows without a path are left out."""
    stored, buckets = _all(spark, uri)
    rows = scanned.where("path is not null")
    return _replace(stored, rows, uri, buckets, lambda before: C.upsert(before, _dealt(rows, buckets), keeps, ("bucket",)))


def delete(spark: SparkSession, uri: str, gone: DataFrame) -> list[int]:
    """Delete the rows of the paths of gone from the table, in their buckets alone; which these were."""
    stored, buckets = _all(spark, uri)
    return _replace(stored, gone, uri, buckets, lambda before: before.join(_dealt(gone.select("path").distinct(), buckets), ["bucket", "path"], "left_anti").select(*before.columns))
