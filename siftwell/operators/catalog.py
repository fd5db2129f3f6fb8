"""Facets, tags, mutations and incremental scans of a catalog, as set operations between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions.text import index_letter

# Extensions that are scanned by default.
EXTENSIONS = (
    "pdf docx pptx xlsx odt ods odp ott ots otp vsdx vsdm vsd vss vst drawio dio epub mobi azw azw3 djvu djv eml rtf csv tsv txt md html "
    "ini conf cfg log lst puml plantuml mmd xml xhtml sgml sgm docbook dbk svg vdx rss atom opml rst adoc asciidoc tex latex json yml yaml "
    "py sh js css rs c h cpp hpp cc go java ts tsx jsx rb php toml"
).split()


def stats(documents: DataFrame, tags: DataFrame, embeddings: DataFrame) -> DataFrame:
    one = documents.agg(F.count("*").alias("documents"))
    two = tags.agg(F.countDistinct("tag").alias("tags"))
    three = embeddings.agg(F.count("*").alias("embedded"))
    return one.join(F.broadcast(two)).join(F.broadcast(three))  # a row each


def cache_key(rows: DataFrame, updated: str = "updated_at") -> DataFrame:
    """(last, n): one row, the newest update and the number of rows; what was made from rows is out of date when either has changed."""
    return rows.agg(F.max(updated).alias("last"), F.count("*").alias("n"))


def tag_cloud(tags: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.lower("tag"), "tag").limit(most)


def letters(documents: DataFrame) -> DataFrame:
    return documents.select(index_letter(F.col("title")).alias("letter")).where("letter is not null").distinct()


def type_report(files: DataFrame) -> DataFrame:
    """(ext, n, percent, mb) of scannable extensions, with one row for the others and one for all."""
    ext = F.when(F.col("ext").isin(EXTENSIONS), F.col("ext")).otherwise("(unscannable)")
    grouped = files.rollup(ext.alias("ext")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    # the total is the row without an extension: one row, joined back for the shares
    total = files.agg(F.count("*").alias("all_n"))
    return grouped.join(F.broadcast(total)).select(F.coalesce("ext", F.lit("(total)")).alias("ext"), "n", F.round(100.0 * F.col("n") / F.col("all_n"), 2).alias("percent"), F.round(F.col("bytes") / 1048576, 4).alias("mb"))


def scan_delta(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files (path, mtime) that are new, or newer than stored (path, mtime); an unknown time counts as new."""
    old = stored.select(F.col("path").alias("_path"), F.col("mtime").alias("_mtime"))
    skip = F.col("_mtime").isNotNull() & F.col("mtime").isNotNull() & (F.col("_mtime") >= F.col("mtime"))
    return files.join(old, F.col("path") == F.col("_path"), "left").where(~F.coalesce(skip, F.lit(False))).drop("_path", "_mtime")


def stale_embeddings(documents: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Documents without a vector, with an older one, or with one of another model."""
    have = embeddings.select(F.col("doc_id").alias("_id"), F.col("model").alias("_model"), F.col("updated_at").alias("_at"))
    stale = F.col("_id").isNull() | (F.col("_at") < F.col("updated_at")) | (F.col("_model") != model)
    return documents.join(have, F.col("doc_id") == F.col("_id"), "left").where(stale).drop("_id", "_model", "_at")


def upsert(stored: DataFrame, scanned: DataFrame, keeps: tuple[str, ...] = ("doc_id", "created_at", "synopsis"), also: tuple[str, ...] = ()) -> DataFrame:
    """The next snapshot by path: scanned rows win, but for the columns in keeps where stored has a value. also: columns that follow from the path and that both are dealt by."""
    a, b = stored.alias("a"), scanned.alias("b")
    cols = []
    for c in stored.columns:
        order = [f"a.{c}", f"b.{c}"] if c in keeps else [f"b.{c}", f"a.{c}"]
        cols.append(F.coalesce(*[F.col(x) for x in order if x[0] == "a" or c in scanned.columns]).alias(c))
    same = F.col("a.path") == F.col("b.path")
    for c in also:
        same = (F.col(f"a.{c}") == F.col(f"b.{c}")) & same
    return a.join(b, same, "full_outer").select(*cols)


def delete_by_id(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("doc_id"), "doc_id", "left_anti")


def under(path: Column, prefix: str) -> Column:
    prefix = prefix.rstrip("/")
    return (path == prefix) | path.startswith(prefix + "/")


def purge_prefix(documents: DataFrame, prefix: str) -> DataFrame:
    return documents.where(~under(F.col("path"), prefix))


def hidden_below(path: Column, roots: list[str]) -> Column:
    """Whether a component below the longest root that holds the path begins with a dot; without a root, any component."""
    out = path.rlike(r"(^|/)\.[^/]")
    for root in sorted({r.rstrip("/") for r in roots}, key=len):
        out = F.when(under(path, root), F.substring(path, F.lit(len(root) + 1), F.length(path)).rlike(r"(^|/)\.[^/]")).otherwise(out)
    return out


def add_tags(tags: DataFrame, ids: DataFrame, text: str, source: str = "user") -> DataFrame:
    """tags with those in text (comma-separated, trimmed, lower) for ids; an existing tag keeps its source."""
    new = sorted({t.strip().lower() for t in text.split(",")} - {""})
    rows = ids.select("doc_id", F.explode(F.array(*[F.lit(t) for t in new])).alias("tag"), F.lit(source).alias("source"))
    fresh = rows.distinct().join(tags.select("doc_id", "tag"), ["doc_id", "tag"], "left_anti").select("doc_id", "tag", "source")
    return tags.select("doc_id", "tag", "source").unionByName(fresh)


def remove_tag(tags: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    gone = ids.select("doc_id", F.lit(tag.strip().lower()).alias("tag"))
    return tags.join(gone, ["doc_id", "tag"], "left_anti")


def short_tag(tag: Column) -> Column:
    """An automatic tag as it is stored."""
    return F.substring(F.lower(tag), 1, 50)


def regenerate_tags(tags: DataFrame, fresh: DataFrame) -> DataFrame:
    """Automatic tags of the documents in fresh (doc_id, tag) are replaced; tags of users stay."""
    ids = fresh.select("doc_id").distinct()
    stays = tags.where("source = 'user'").unionByName(tags.where("source != 'user'").join(ids, "doc_id", "left_anti"))
    new = fresh.select("doc_id", short_tag(F.col("tag")).alias("tag"), F.lit("auto").alias("source")).distinct()
    return stays.unionByName(new.join(stays.select("doc_id", "tag"), ["doc_id", "tag"], "left_anti"))


def searchable(documents: DataFrame, tags: DataFrame) -> DataFrame:
    """The seven searched columns of each document, its tags joined in order."""
    joined = tags.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("tag")), " ").alias("tags"))
    return documents.join(joined, "doc_id", "left").withColumn("tags", F.coalesce("tags", F.lit("")))


def path_state(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, state): present if listed, missing if something else in its folder is, else unmounted."""
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    files = listing.select("path", F.lit(True).alias("here")).distinct()
    dirs = listing.select(folder("path").alias("dir"), F.lit(True).alias("busy")).distinct()
    found = paths.join(files, "path", "left").withColumn("dir", folder("path")).join(dirs, "dir", "left")
    return found.select("path", F.when(F.col("here"), "present").when(F.col("busy"), "missing").otherwise("unmounted").alias("state"))


def eta(samples: DataFrame, by: list[str], window: int = 50) -> DataFrame:
    """samples (t seconds, n done, total, and the columns in by, which tell one job from another) with the seconds left at the rate of the last window samples."""
    if not by:
        raise ValueError("eta needs a column that tells one job from another")
    w = W.partitionBy(*by).orderBy("t", "n").rowsBetween(-(window - 1), 0)
    t0, n0 = F.first("t").over(w), F.first("n").over(w)
    rate = (F.col("n") - n0) / F.nullif(F.col("t") - t0, F.lit(0))
    return samples.withColumn("eta", F.when(rate > 0, (F.col("total") - F.col("n")) / rate))
