"""A stored library of documents and its commands: scan, rescan, embed, duplicates, remove, search and passages.

A library is a folder: documents in buckets of path hashes (sources.buckets), a keyword index in segments (operators.segments), and versions of
the tables of tags, listed paths, embeddings and scans (sources.snapshots). A scan writes the index and the tables first and the documents last,
so that one that failed is done again by the next: what it would have stored still counts as new. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import EN_STOPWORDS
from siftwell.operators import catalog as C
from siftwell.operators import dedup as D
from siftwell.operators import folders as O
from siftwell.operators import models as M
from siftwell.operators import passages as P
from siftwell.operators import scans as N
from siftwell.operators import search as S
from siftwell.operators import segments
from siftwell.sources import buckets, files, snapshots
from siftwell.store import shared_folder

Embedder = Callable[[list[str]], list[list[float]]]

DOCUMENTS = (
    "doc_id long, path string, name string, ext string, title string, author string, subject string, description string, content string, content_snippet string, "
    "size long, modified_at timestamp, created_at timestamp, updated_at timestamp, synopsis string"
)
TABLES = {
    "tags": "doc_id long, tag string, source string",
    "blacklist": "path string, reason string, listed_at timestamp",
    "pii_blacklist": "path string, reason string",
    "embeddings": "doc_id long, embedding array<float>, model string, updated_at timestamp",
    "scans": "scanned_at timestamp, docs_found long, docs_added long, docs_updated long, docs_failed long",
}


def create(spark: SparkSession, uri: str, parts: int = buckets.BUCKETS) -> None:
    """An empty library in a new folder; parts: buckets of the documents."""
    buckets.create(spark.createDataFrame([], DOCUMENTS), f"{uri}/documents", parts)
    for name, schema in TABLES.items():
        _save(spark, uri, name, spark.createDataFrame([], schema))


def _save(spark: SparkSession, uri: str, name: str, rows: DataFrame) -> None:
    snapshots.save(spark, f"{uri}/{name}", {name: rows})


def table(spark: SparkSession, uri: str, name: str) -> DataFrame:
    """One of TABLES, or documents."""
    return buckets.read(spark, f"{uri}/documents") if name == "documents" else snapshots.load(spark, f"{uri}/{name}")[name]


def scan(spark: SparkSession, uri: str, roots: list[str], extensions: list[str] | None = None, ignored: DataFrame | None = None, again: bool = False, limit: int | None = None) -> DataFrame:
    """Read what is new or newer below the roots, or all of it again; the scan's row of the log.

    Hidden paths, other extensions, the folders of ignored (path) and blacklisted paths are left out; with a limit the smallest files are read.
    """
    found = files.scannable(files.listing(spark, roots), extensions)
    if ignored is not None:
        found = O.outside(found, ignored)
    for listed in ("blacklist", "pii_blacklist"):
        found = files.without_paths(found, table(spark, uri, listed))
    if not again:
        found = files.changed(found, table(spark, uri, "documents").select("path", "modified_at"))
    if limit is not None:
        found = files.smallest_first(found, limit)
    return add(spark, uri, found, files.records(spark, roots, found))


def rescan(spark: SparkSession, uri: str, roots: list[str], paths: DataFrame) -> DataFrame:
    """Read the files of paths (path) below the roots again, blacklisted ones too, but for those listed for personal data; the scan's row of the log."""
    found = files.listing(spark, roots).join(paths.select("path").distinct(), "path", "left_semi")
    found = N.rescannable(found, table(spark, uri, "pii_blacklist"))
    return add(spark, uri, found, files.records(spark, roots, found), retry=True)


def _written(rows: DataFrame, name: str) -> DataFrame:
    uri = shared_folder(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(uri)
    return rows.sparkSession.read.schema(rows.schema).parquet(uri)


def add(spark: SparkSession, uri: str, found: DataFrame, records: DataFrame, retry: bool = False) -> DataFrame:
    """Store files.RECORD rows of found (path, rel and others); the row of the log that tells what was found, added, updated and failed.

    A path that is stored keeps its id, time of creation and synopsis; its automatic tags are made anew and those of users stay. Records that failed come on the
    blacklist; with retry those that could be read leave it. Repeated paths count once, rows without a path are left out. Without records only the log grows.
    """
    found = _written(found.where("path is not null").select("path", "rel").dropDuplicates(["path"]), "found")
    stored = table(spark, uri, "documents")
    last = stored.agg(F.max("doc_id")).first()[0] or 0
    users = table(spark, uri, "tags").where("source = 'user'").groupBy("doc_id").agg(F.collect_set("tag").alias("_users"))
    known = stored.select("path", F.col("doc_id").alias("_id")).join(users.withColumnRenamed("doc_id", "_id"), "_id", "left")
    # texts are shuffled once, by path, and written with all that follows from it; ids are given once, by this job
    got = records.where("path is not null").dropDuplicates(["path"]).join(known, "path", "left").join(found.withColumn("_found", F.lit(True)), "path", "left")
    got = N.with_auto_tags(got.withColumn("ext", F.col("file_ext"))).drop("ext", "rel")
    none = F.array().cast("array<string>")
    got = got.withColumns({
        "_id": F.coalesce("_id", F.monotonically_increasing_id() + last + 1), "_at": F.current_timestamp(), "_users": F.coalesce("_users", none), "auto_tags": F.when(F.col("_found"), F.col("auto_tags")).otherwise(none),
    }).drop("_found")
    got = _written(got, "records")
    if got.isEmpty():
        log = _written(N.scan_log(found, stored, got), "log")
        _save(spark, uri, "scans", table(spark, uri, "scans").unionByName(log))
        return log
    rows = got.where("success")
    tagged = F.sort_array(F.array_distinct(F.concat("_users", F.transform("auto_tags", C.short_tag)))).alias("tags")
    fresh = rows.select(F.col("_id").alias("doc_id"), F.explode_outer("auto_tags").alias("tag"))  # a document without tags loses those it had
    now = F.col("_at")
    rows = rows.select(
        F.col("_id").alias("doc_id"), "path", "name", F.col("file_ext").alias("ext"), "title", "author", "subject", "description", F.col("text").alias("content"),
        F.col("snippet").alias("content_snippet"), F.col("size_bytes").alias("size"), "modified_at", now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("string").alias("synopsis"), tagged,
    )
    log = _written(N.scan_log(found, stored, got), "log")
    tags = C.regenerate_tags(table(spark, uri, "tags"), fresh).where("tag is not null")
    _save(spark, uri, "tags", tags)
    segments.commit(spark, f"{uri}/index", _searched(rows))
    before = table(spark, uri, "blacklist")
    _save(spark, uri, "blacklist", N.after_rescan(before, got) if retry else N.add_listed(before, N.failures(got)))
    buckets.upsert(spark, f"{uri}/documents", rows.drop("tags"))
    _save(spark, uri, "scans", table(spark, uri, "scans").unionByName(log))
    return log


def _searchable(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """What is indexed of documents, and told of results: the searched columns, tags as an array."""
    own = tags.groupBy("doc_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return _searched(rows.join(own, "doc_id", "left"))


def _searched(rows: DataFrame) -> DataFrame:
    """The same of documents with their tags."""
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("author", "subject", "description", "content")]
    return rows.select("doc_id", "name", "title", "path", *texts, F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def remove(spark: SparkSession, uri: str, paths: DataFrame, mode: str = "db_only") -> DataFrame:
    """Delete the documents of paths (path) by one of scans.MODES; doomed (path), the files that the host is to remove."""
    stored = table(spark, uri, "documents")
    gone = _written(stored.join(paths.select("path").distinct(), "path", "left_semi").select("doc_id", "path"), "gone")
    _, blacklist, doomed = N.delete_paths(stored, table(spark, uri, "blacklist"), gone, mode)
    if mode == "blacklist":
        _save(spark, uri, "blacklist", blacklist)
    doomed = _written(doomed, "doomed")
    buckets.delete(spark, f"{uri}/documents", gone)
    for name in ("tags", "embeddings"):
        _save(spark, uri, name, C.delete_by_id(table(spark, uri, name), gone))
    if snapshots.versions(spark, f"{uri}/index/versions"):
        segments.commit(spark, f"{uri}/index", _searchable(stored.limit(0), table(spark, uri, "tags")), gone)
    return doomed


def embed(spark: SparkSession, uri: str, embedder: Embedder, model: str) -> int:
    """Embed the documents that have no vector of the model, or an older one than themselves; how many. The embedder is called once for each."""
    documents, before = table(spark, uri, "documents"), table(spark, uri, "embeddings")
    made = _written(M.embed_stale(documents, before, embedder, model), "embedded")
    _save(spark, uri, "embeddings", M.merge_embeddings(before, made))
    return made.count()


def duplicates(spark: SparkSession, uri: str, near: float | None = None, model: str | None = None) -> DataFrame:
    """(group_id, doc_id, path, label): documents of equal content, or with near those whose vectors of the model are as similar as that."""
    documents = table(spark, uri, "documents")
    if near is None:
        groups = D.exact_duplicates(documents.where("content != ''").select("doc_id", "size", "content")).select("group_id", "doc_id")
    else:
        vectors = table(spark, uri, "embeddings")
        vectors = vectors if model is None else vectors.where(F.col("model") == model)
        owned = vectors.join(documents.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "embedding")
        groups = D.near_duplicate_groups(owned, near).withColumnRenamed("id", "doc_id")
    labels = N.group_labels(groups, documents)
    return groups.select("group_id", "doc_id").join(labels, "group_id").join(documents.select("doc_id", "path"), "doc_id").select("group_id", "doc_id", "path", "label")


def search(spark: SparkSession, uri: str, query: str = "", mode: str = "both", embedder: Embedder | None = None, model: str | None = None, stopwords: tuple[str, ...] = EN_STOPWORDS, **how) -> S.Found:
    """search.search() over the library: its keyword index, and its vectors of the model for the query as the embedder sees it. how: offset, limit, letter and others."""
    tags, vectors = table(spark, uri, "tags"), table(spark, uri, "embeddings")
    vectors = vectors if model is None else vectors.where(F.col("model") == model)
    catalog = _searchable(table(spark, uri, "documents"), tags)
    vectors = vectors.join(catalog.select("doc_id"), "doc_id", "left_semi")
    return S.search(catalog, segments.read(spark, f"{uri}/index"), vectors, tags, query, mode, embed=embedder, stopwords=stopwords, **how)


def passages(spark: SparkSession, uri: str, doc_id: int, query: str, mode: str = "keyword", embedder: Embedder | None = None) -> DataFrame:
    """passages.passages() of a stored document, by the lines of its text; none of types whose text is no prose."""
    own = table(spark, uri, "documents").where((F.col("doc_id") == doc_id) & P.is_prose(F.coalesce("ext", F.lit(""))))
    return P.passages(P.line_units(own, text_col="content"), query, mode, embedder)
