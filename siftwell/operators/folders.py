"""Which folders of a table hold which paths: ignored folders, roots of scans and purges as joins.

A path is taken apart into the folders above it and these are joined on equality, so no row is tested against each folder.
Folders near the root hold very many paths: both sides are salted, so their rows are many tasks' matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def ancestors(path: Column) -> Column:
    """The path and every folder above it, without final slashes; the root of all is ""."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def containing(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """paths with root: the longest of folders (path) that is the row's path or holds it, without a final slash; null if none does, or without a path."""
    known = folders.where("path is not null").select(F.rtrim(F.col("path"), F.lit("/")).alias("root")).distinct()
    known = known.select("root", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    apart = paths.where("path is not null").select("path").distinct().select("path", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(ancestors(F.col("path"))).alias("root"))
    held = apart.join(known, ["root", "salt"]).groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(held, "path", "left").select(*paths.columns, "root")


def outside(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """paths that no folder holds, nor is one: what is left of a listing without ignored folders, or of a catalog after a purge. Rows without a path stay."""
    return paths.join(_held(paths, folders), "path", "left_anti").select(*paths.columns)


def inside(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """paths that a folder holds, or is."""
    return paths.join(_held(paths, folders), "path", "left_semi").select(*paths.columns)


def _held(paths: DataFrame, folders: DataFrame) -> DataFrame:
    return containing(paths.select("path").distinct(), folders).where("root is not null").select("path")


def hidden(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths with hidden: whether a component below the longest root that holds the path begins with a dot; without a root, any component."""
    rest = F.when(F.col("root").isNull(), F.col("path")).otherwise(F.expr("substring(path, length(root) + 1)"))
    return containing(paths, roots).withColumn("hidden", rest.rlike(r"(^|/)\.[^/]")).drop("root")
