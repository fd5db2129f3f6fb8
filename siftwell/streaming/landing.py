"""Landing folders: files that are only ever added become records by Structured Streaming.

The file source remembers paths, so an edited file is not read again; folders whose files change are for
sources.files.changed, which compares times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.sources.files import EXTENSIONS, MOST_BYTES, extension, extracted

FILE = "path string, modificationTime timestamp, length long, content binary"


def landing(spark: SparkSession, root: str, extensions: list[str] | None = None, files_per_batch: int = 1000) -> DataFrame:
    """A stream of records of the files below root, of the extensions or without one; the content of larger files than the limit is not read, and their records tell so."""

    def files(size: Column, content: Column) -> DataFrame:
        stream = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(root)
        path = F.regexp_replace("path", "^file:/+", "/")
        chosen = stream.where(size).select(
            path.alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"), extension(path).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), content.alias("content")
        )
        return chosen.where(F.col("ext").isin(extensions or EXTENSIONS) | (F.col("ext") == ""))

    length = F.col("length")
    return extracted(files(length <= MOST_BYTES, F.col("content")).unionByName(files(length > MOST_BYTES, F.lit(None).cast("binary"))))


def ingest_available(stream: DataFrame, store: str, checkpoint: str) -> int:
    """Write what the stream has now below store and stop; returns the number of batches.

    Each batch has a folder of its own that is replaced whole, so a batch repeated after a failure does no harm.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] > 0 for p in query.recentProgress)


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The records of all batches."""
    return spark.read.parquet(store).drop("batch")
