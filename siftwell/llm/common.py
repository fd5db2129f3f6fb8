"""What the operators share: words, the shared scratch folder, and storage that executors write to."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}
#: Bytes of what a plan reads for which its table gets a file, if it is to have few, and the least files for each core.
FILE_BYTES, CORE_FILES = 4 << 20, 2
#: Whether a query's shuffles are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) UTF-8 words between the ASCII space characters 0x20 and 0x09-0x0D; null has none."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: spark.checkpoint.dir.

    Only a local session, whose executors are threads of the driver, may go without that setting; it gets
    a temporary folder. On a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_roots.setdefault(spark.sparkContext.applicationId, "")
        if not root:
            root = _own_roots[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="siftwell-")
    return as_uri(root)


def as_uri(path: str) -> str:
    if "://" in path:
        return path.rstrip("/")
    return "file://" + path.removeprefix("file:").rstrip("/")


def scratch(spark: SparkSession, name: str, kept: list[str] | None = None) -> str:
    """A new folder's URI below the shared root; kept: a list that notes it, for release()."""
    uri = f"{shared_root(spark)}/siftwell/{name}-{uuid.uuid4().hex}"
    if kept is not None:
        kept.append(uri)
    return uri


def materialise(df: DataFrame, name: str, kept: list[str] | None = None, few: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    The shuffles of the job are deleted with its end, as nothing reads them again; else they stay until the driver collects garbage.
    few: partitions are written together, in a file for each FILE_BYTES that the plan reads, CORE_FILES for each core at least. For each file
    Hadoop starts several processes where it lacks its native library, so a small table in hundreds of files takes longer than its rows.
    """
    spark, uri = df.sparkSession, scratch(df.sparkSession, name, kept)
    if few:
        df = df.coalesce(max(CORE_FILES * spark.sparkContext.defaultParallelism, -(-_bytes_read(df) // FILE_BYTES)))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(uri)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(uri)


def release(spark: SparkSession, uris: list[str]) -> None:
    """Delete scratch folders that no later plan reads."""
    jvm = spark.sparkContext._jvm
    while uris:
        path = jvm.org.apache.hadoop.fs.Path(uris.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def storage(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system (local, HDFS, S3, GCS) and path of a URI, for code on executors."""
    return pafs.FileSystem.from_uri(uri)


def commit_file(uri: str, write) -> None:
    """Call write(stream) on a file of this attempt's own, then move it into place.

    A repeated or speculative attempt writes the same bytes and replaces the file whole, so readers never
    see part of one.
    """
    fs, path = storage(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(own, compression=None) as out:
        write(out)
    fs.move(own, path)


def _bytes_read(df: DataFrame) -> int:
    """Of the tables that df reads, by its plan alone: nothing runs. Leaves that cannot tell their size (more than an exabyte) are left out."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def parts(df: DataFrame, size: int) -> int:
    """Partitions for a shuffle of whole texts: one for about size bytes of the tables that df reads, or the session's setting if more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-_bytes_read(df) // size))
