"""A walk of directories as tasks: the folders of a level are listed on executors, and those in them are the next level.

Folders that cannot be read are rows of their own and do not end the walk. Any file system that pyarrow opens by URI is walked;
paths without a scheme are local, for folders that all executors mount.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.store import shared_folder

FOUND = "kind string, path string, size long, mtime timestamp, error string"


def _entries(path: str) -> list[tuple]:
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    try:
        system, at = pafs.FileSystem.from_uri(path) if scheme else (pafs.LocalFileSystem(), path)
        infos = system.get_file_info(pafs.FileSelector(at, recursive=False))
    except (OSError, pa.ArrowInvalid) as e:
        return [("error", path, None, None, type(e).__name__)]
    local, base, out = isinstance(system, pafs.LocalFileSystem), path.rstrip("/"), []
    for i in infos:
        own = f"{base}/{i.base_name}"
        if i.type == pafs.FileType.Directory:
            if not (local and os.path.islink(i.path)):  # else a link to a folder above would be walked for ever
                out.append(("folder", own, None, None, None))
        elif i.type == pafs.FileType.File:
            out.append(("file", own, i.size, i.mtime, None))
        else:
            out.append(("error", own, None, None, "neither a file nor a folder"))
    return out


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("kind", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("error", pa.string())])
    for b in batches:
        for path in b.column(0).to_pylist():
            rows = _entries(path)
            for a in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 10_000], strict=True), schema, strict=True)], schema=schema)


def walk(roots: DataFrame, hidden: bool = False, ignored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Files (path, size, mtime) below roots (path), and errors (path, error); a root that is no folder is an error.

    Folders and files whose name begins with a dot are left out unless hidden; the folders of ignored (path) are not entered, nor are links
    to folders. Roots that hold each other give their files once. Null roots are left out.
    """
    spark, levels = roots.sparkSession, []
    frontier = roots.where("path is not null").select(F.when(F.col("path") == "/", "/").otherwise(F.rtrim(F.col("path"), F.lit("/"))).alias("path")).distinct()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    seen = None
    while not frontier.isEmpty():
        uri = shared_folder(spark, "walk")
        frontier.repartition(tasks, "path").mapInArrow(_list, FOUND).write.parquet(uri)
        found = spark.read.schema(FOUND).parquet(uri)
        if not hidden:
            found = found.where("kind = 'error' or substring_index(path, '/', -1) not like '.%'")
        levels.append(found)
        seen = frontier if seen is None else seen.unionByName(frontier)
        frontier = found.where("kind = 'folder'").select("path").join(seen, "path", "left_anti")
        if ignored is not None:
            frontier = frontier.join(ignored.select(F.rtrim(F.col("path"), F.lit("/")).alias("path")), "path", "left_anti")
    every = spark.createDataFrame([], FOUND) if not levels else levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.where("kind = 'file'").select("path", "size", "mtime").distinct(), every.where("kind = 'error'").select("path", "error").distinct()
