"""Discovery of files, and their conversion to extractor records.

The listing is a binaryFile scan without its content, so walks, hidden folders, ignored folders, blacklists and the
modification delta are column expressions and joins before any byte is read. Extraction reads the content of
what is left, a file at a time, in mapInPandas; a file that cannot be read becomes a row with its error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.catalog import EXTENSIONS
from siftwell.sources.extractors import FIELDS, classify, extract

RECORD = "path string, name string, file_ext string, size_bytes long, modified_at timestamp, title string, author string, subject string, description string, text string, snippet string, doc_type string, success boolean, error string"
#: Files beyond this size are listed with an error instead of being read into one row.
MOST_BYTES = 512 << 20


def extension(path: Column) -> Column:
    """Lower-cased suffix of the last path component; none: empty. A leading dot starts no suffix."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, root, rel, name, ext, size, modified_at) of all files below the roots; a file below two belongs to the longest."""
    out = None
    for root in dict.fromkeys(r.rstrip("/") for r in roots):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        at = F.regexp_replace("path", "^file:/+", "/")
        plain = F.lit("/" + root.removeprefix("file:").lstrip("/") if "://" not in root or root.startswith("file:") else root)
        one = found.select(at.alias("path"), plain.alias("root"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no roots")
    out = out.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"), F.first("size").alias("size"), F.first("modified_at").alias("modified_at"))
    rel = F.expr("substring(path, length(root) + 2)")
    return out.select("path", "root", rel.alias("rel"), F.element_at(F.split("path", "/"), -1).alias("name"), extension(F.col("path")).alias("ext"), "size", "modified_at")


def types(names: list[str], known: dict[str, list[str]]) -> list[str]:
    """Extensions of named types, without repeats, in order."""
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown types: {', '.join(unknown)}")
    return list(dict.fromkeys(e for n in names for e in known[n]))


def scannable(files: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Files of the extensions, or without one, no component of whose path below the root starts with a dot."""
    return files.where((F.col("ext").isin(extensions or EXTENSIONS) | (F.col("ext") == "")) & ~F.col("rel").rlike(r"(^|/)\."))


def without_folders(files: DataFrame, ignored: list[str]) -> DataFrame:
    """Files not at or below any of the folders: one conjunction, as long as the user's own list."""
    for folder in dict.fromkeys(f.rstrip("/") for f in ignored):
        files = files.where((F.col("path") != folder) & ~F.startswith("path", F.lit(folder + "/")))
    return files


def without_paths(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files whose path is not in listed (path)."""
    return files.join(listed.select("path").distinct(), "path", "left_anti")


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that known (path, modified_at) lacks or has an older or no time for."""
    before = known.groupBy("path").agg(F.max("modified_at").alias("_before"))
    return files.join(before, "path", "left").where("_before is null or modified_at is null or _before < modified_at").drop("_before")


def smallest_first(files: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = files.orderBy(F.coalesce("size", F.lit(0)), "path")
    return ordered if limit is None else ordered.limit(limit)


def records(spark: SparkSession, roots: list[str], files: DataFrame) -> DataFrame:
    """RECORD of each of files: content is read below the roots and joined to the chosen paths on the scan's side."""
    content = None
    for root in dict.fromkeys(r.rstrip("/") for r in roots):
        one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= MOST_BYTES)
        one = one.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
        content = one if content is None else content.unionByName(one)
    chosen = files.select("path", "name", "ext", "size", "modified_at").join(content.dropDuplicates(["path"]) if len(roots) > 1 else content, "path", "left")
    return extracted(chosen)


def extracted(chosen: DataFrame) -> DataFrame:
    """RECORD of (path, name, ext, size, modified_at, content); null content is an error, an unknown type is success = false."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                if r.content is None:
                    got = {"success": False, "error": "not readable or too large"}
                else:
                    data = bytes(r.content)
                    kind = r.ext or classify(data)
                    got = extract(kind, data, r.name) if kind else {"success": False, "error": "not a document"}
                rows.append((r.path, r.name, r.ext, r.size, r.modified_at, *(got.get(f) for f in FIELDS)))
            yield pd.DataFrame(rows, columns=["path", "name", "file_ext", "size_bytes", "modified_at", *FIELDS])

    return chosen.select("path", "name", "ext", "size", "modified_at", "content").mapInPandas(run, RECORD)
