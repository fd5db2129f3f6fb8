"""Where intermediate tables go, below the folder that driver and executors share; what tables are read, and whether their files have changed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; only a local[...] session, whose executors are threads of the driver, may go without that setting."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="siftwell-")
        root = _own[sc.applicationId]
    return f"{root.rstrip('/')}/siftwell/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows, written to a new shared folder and read from there."""
    uri = shared_folder(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(uri)
    return rows.sparkSession.read.schema(rows.schema).parquet(uri)


def plan_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, by its plan; nothing runs. Leaves that cannot tell their size (more than an exabyte) are left out."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def files_key(spark: SparkSession, path: str) -> str:
    """What tells the state of a table's files: it changes when one is added, removed, or written again. A listing; no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    of = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    n, size, last, mix = files.agg(F.count("*"), F.sum("length"), F.unix_micros(F.max("modificationTime")), F.sum(of)).first()
    return f"{n}-{size}-{last}-{mix}"


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
