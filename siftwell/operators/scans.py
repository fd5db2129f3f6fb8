"""What a scan leaves behind: automatic tags, log rows, failure lists and blacklists; deletes that feed them. All set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import with_keywords
from siftwell.operators.catalog import EXTENSIONS

# Extensions whose files are tagged as code, as diagram and as markup.
CODE = "json yml yaml py sh js css rs c h cpp hpp cc go java ts tsx jsx rb php toml".split()
DIAGRAM = "vsdx vsdm vsd vss vst drawio dio puml plantuml mmd svg vdx".split()
MARKUP = "xml xhtml sgml sgm docbook dbk svg vdx rss atom opml rst adoc asciidoc tex latex".split()
# Scanned extensions that have no keywords as tags, besides code; modes of a delete.
PLAIN = "txt md html ini conf cfg log lst puml plantuml mmd vsd vss vst".split()
MODES = ("db_only", "blacklist", "delete_file")

KEYWORD_TYPES = [e for e in EXTENSIONS if e not in (*PLAIN, *CODE)]


def auto_tags(files: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, tag) of files (doc_id, rel, ext, title, text): extension, folders of rel over two characters, kinds, and keywords.

    rel is the path below the root. Keywords, at most so many, are taken of document formats only; plain text and code have none.
    A null ext counts as none, null texts have no words.
    """
    # an inner explode would have Spark infer a filter on its array and push it below with_keywords(), whose steps it then repeats for each element of one another
    return with_auto_tags(files, most).select("doc_id", F.explode_outer("auto_tags").alias("tag")).where("tag is not null")


def with_auto_tags(files: DataFrame, most: int = 5) -> DataFrame:
    """files (rel, ext, title, text and others) with the array auto_tags: see auto_tags(). A projection, nothing is shuffled."""
    ext = F.lower(F.coalesce("ext", F.lit("")))
    words = ext.isin(KEYWORD_TYPES)
    rows = with_keywords(files.withColumns({"_title": F.when(words, F.col("title")), "_text": F.when(words, F.col("text"))}), "_text", "_title", most, "_keywords")
    folders = F.filter(F.transform(F.slice(F.split("rel", "/"), 1, F.greatest(F.size(F.split("rel", "/")) - 1, F.lit(0))), F.lower), lambda x: F.length(x) > 2)
    kinds = [F.when(ext.isin(of), F.lit(name)) for name, of in (("code", CODE), ("diagram", DIAGRAM), ("markup", MARKUP))]
    all_ = F.array_distinct(F.concat(F.array(F.nullif(ext, F.lit("")), *kinds), F.coalesce(folders, F.array().cast("array<string>")), "_keywords"))
    return rows.withColumn("auto_tags", F.filter(all_, lambda x: x.isNotNull() & (x != ""))).drop("_title", "_text", "_keywords")


def scan_log(found: DataFrame, stored: DataFrame, records: DataFrame) -> DataFrame:
    """One row (scanned_at, docs_found, docs_added, docs_updated, docs_failed) of a scan: files found, and its records by whether stored had their path."""
    known = stored.select("path", F.lit(True).alias("_known")).distinct()
    got = records.select("path", "success").join(known, "path", "left").agg(
        F.count_if(F.col("success") & F.col("_known").isNull()).alias("docs_added"), F.count_if(F.col("success") & F.col("_known")).alias("docs_updated"), F.count_if(~F.coalesce("success", F.lit(False))).alias("docs_failed")
    )
    total = found.agg(F.count("*").alias("docs_found"))
    return total.join(F.broadcast(got)).select(F.current_timestamp().alias("scanned_at"), "docs_found", "docs_added", "docs_updated", "docs_failed")  # a row each


def failures(records: DataFrame) -> DataFrame:
    """(path, reason, listed_at) of records that failed: what a scan adds to the blacklist."""
    return listed(records.where(~F.coalesce("success", F.lit(False))).select("path", F.coalesce("error", F.lit("extraction failed")).alias("reason")))


def without_text(records: DataFrame) -> DataFrame:
    """(path, reason, listed_at) of records that have a name and no text: to be read again once a reader or character recognition is at hand."""
    return listed(records.where("success and doc_type = 'metadata'").select("path", F.concat(F.lit("no text: "), F.coalesce("file_ext", F.lit(""))).alias("reason")))


def listed(rows: DataFrame) -> DataFrame:
    return rows.select("path", "reason", F.current_timestamp().alias("listed_at"))


def add_listed(blacklist: DataFrame, fresh: DataFrame) -> DataFrame:
    """blacklist and fresh (path, reason, listed_at), a row for each path; an entry that stands keeps its reason."""
    first = F.min(F.struct("_new", "listed_at", "reason")).alias("x")
    both = blacklist.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return both.groupBy("path").agg(first).select("path", "x.reason", "x.listed_at")


def rescannable(files: DataFrame, pii_blacklist: DataFrame) -> DataFrame:
    """Files that a scan of single files may read: those listed for personal data are refused, other blacklisted ones are tried again."""
    return files.join(pii_blacklist.select("path").distinct(), "path", "left_anti")


def after_rescan(blacklist: DataFrame, records: DataFrame) -> DataFrame:
    """The blacklist once files were tried again: those that could be read leave it, those that could not are listed with their new reason."""
    return add_listed(blacklist.join(records.select("path").distinct(), "path", "left_anti"), failures(records))


def by_path(documents: DataFrame, path: str) -> DataFrame:
    """The document of a path: the filter reaches the scan."""
    return documents.where(F.col("path") == path)


def delete_paths(documents: DataFrame, blacklist: DataFrame, paths: DataFrame, mode: str = "db_only") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, blacklist, doomed) after paths (path) go by one of MODES; paths that no document has change nothing.

    doomed (path) are the files that delete_file tells the host to remove, and none in the other modes.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    gone = documents.select("path").join(paths.select("path").distinct(), "path", "left_semi").distinct()
    rest = documents.join(paths.select("path").distinct(), "path", "left_anti")
    if mode == "blacklist":
        blacklist = add_listed(blacklist, listed(gone.withColumn("reason", F.lit("removed by a user"))))
    return rest, blacklist, gone if mode == "delete_file" else gone.limit(0)


def size_label(size: Column) -> Column:
    """1.5GB, 1.5MB, 12KB or 12B, ties to even; null: a question mark."""
    unit = lambda power, digits: F.format_string(f"%.{digits}f", F.bround(size / float(1 << power), digits))
    return F.when(size.isNull(), F.lit("?")).when(size >= 1 << 30, F.concat(unit(30, 1), F.lit("GB"))).when(size >= 1 << 20, F.concat(unit(20, 1), F.lit("MB"))).when(size >= 1024, F.concat(unit(10, 0), F.lit("KB"))).otherwise(F.concat(size.cast("string"), F.lit("B")))


def group_labels(groups: DataFrame, documents: DataFrame) -> DataFrame:
    """(group_id, label) of groups (group_id, doc_id[, similarity]) by title and size of the first document: exact groups, or near ones if there is a similarity."""
    near = "similarity" in groups.columns
    each = groups.groupBy("group_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), *([F.max("similarity").alias("similarity")] if near else []))
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("name", F.lit("")), F.lit("Unknown"))
    short = F.concat(F.lit('"'), F.when(F.length(title) > 55, F.concat(F.substring(title, 1, 52), F.lit("…"))).otherwise(title), F.lit('"'))
    tail = F.format_string("  [similarity %.1f%%  × %d docs]", F.bround(F.col("similarity") * 100, 1), "n") if near else F.format_string("  [%s × %d copies]", size_label(F.col("size")), "n")
    return each.join(documents.select("doc_id", "title", "name", "size"), "doc_id").select("group_id", F.concat(short, tail).alias("label"))


def keep_one(documents: DataFrame, groups: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """documents with one of each group (group_id, doc_id): those in keep (group_id, doc_id), or the smallest id where keep is not given.

    With keep, a group that it does not name, or names by a document of another, stays whole.
    """
    if keep is None:
        chosen = groups.groupBy("group_id").agg(F.min("doc_id").alias("_keep"))
    else:
        chosen = keep.join(groups.select("group_id", "doc_id"), ["group_id", "doc_id"], "left_semi").groupBy("group_id").agg(F.min("doc_id").alias("_keep"))
    doomed = groups.join(chosen, "group_id").where("doc_id != _keep").select("doc_id").distinct()
    return documents.join(doomed, "doc_id", "left_anti")
