"""Versioned snapshots of a catalog's tables: numbered folders of Parquet tables, of which the newest few are kept."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DONE = "_COMPLETE"
NAME = re.compile(r"[A-Za-z0-9_]+")


def _folder(spark: SparkSession, uri: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _numbers(spark: SparkSession, uri: str) -> dict[int, bool]:
    """Number of each snapshot's folder -> whether it was completed."""
    fs, path = _folder(spark, uri)
    if not fs.exists(path):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return {int(n[1:]): fs.exists(_folder(spark, f"{uri}/{n}/{DONE}")[1]) for n in names if re.fullmatch(r"v\d+", n)}


def versions(spark: SparkSession, uri: str) -> list[int]:
    """Complete snapshots, oldest first."""
    return sorted(n for n, done in _numbers(spark, uri).items() if done)


def save(spark: SparkSession, uri: str, tables: dict[str, DataFrame], keep: int = 3) -> int:
    """Write the tables as the next version, mark it complete, then delete all but the newest keep complete ones.

    The tables may read an earlier version: that is deleted only after they are written. One writer at a time.
    """
    if keep < 1 or not tables or not all(NAME.fullmatch(t) for t in tables):
        raise ValueError("name the tables with letters, digits and underscores, and keep one version at least")
    number = max(_numbers(spark, uri), default=0) + 1
    for name, df in tables.items():
        df.write.parquet(f"{uri}/v{number}/{name}")
    fs, mark = _folder(spark, f"{uri}/v{number}/{DONE}")
    fs.create(mark, True).close()
    for old in versions(spark, uri)[:-keep]:
        fs.delete(_folder(spark, f"{uri}/v{old}")[1], True)
    return number


def load(spark: SparkSession, uri: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a complete version, the newest by default."""
    complete = versions(spark, uri)
    if not complete or version is not None and version not in complete:
        raise ValueError(f"no complete snapshot {'' if version is None else version} below {uri}")
    at = f"{uri}/v{complete[-1] if version is None else version}"
    fs, path = _folder(spark, at)
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
    return {n: spark.read.parquet(f"{at}/{n}") for n in names}
