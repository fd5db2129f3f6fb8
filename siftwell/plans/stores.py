"""The registered queries of stored indexes, vectors, folder tables and buckets, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import library as L
from siftwell.functions import text as T
from siftwell.operators import catalog as C
from siftwell.operators import dedup as D
from siftwell.operators import folders as O
from siftwell.operators import pii_scan as I
from siftwell.operators import search as S
from siftwell.operators import segments, trigrams
from siftwell.operators import vectors as V
from siftwell.plans.queries import CATALOG_SQL, COSINE_SQL, MODEL, _pii_sql, _query_vector, bm25, bm25_sql, catalog, table, vectors
from siftwell.sources import buckets
from siftwell.store import shared_folder

QUERY = "tion"


def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cache_key(table(spark, sf_dir, "events"), "ts").select(F.unix_micros(F.col("last").cast("timestamp")).alias("last"), "n")


def bm25_after_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of a table of some documents, then of the same table with all of them: the second answer."""
    own, docs = shared_folder(spark, "rewritten"), table(spark, sf_dir, "documents")
    docs.where("n_chars % 2 = 0").write.parquet(f"{own}/documents.parquet")
    bm25(QUERY)(spark, own).count()
    docs.write.mode("overwrite").parquet(f"{own}/documents.parquet")
    return bm25(QUERY)(spark, own)


def _poor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()


def bm25_segments(compacted: bool) -> Callable[[SparkSession, str], DataFrame]:
    """An index after documents came, changed and went, compacted or not."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        uri, c = shared_folder(spark, "segments"), catalog(spark, sf_dir)
        first = c.where("size % 3 = 0")
        segments.commit(spark, uri, first.withColumn("content", F.when(F.array_contains("tags", "en"), "older tion words").otherwise(F.col("content"))))
        segments.commit(spark, uri, c.where("size % 3 != 0"))
        segments.commit(spark, uri, first.where(F.array_contains("tags", "en")), _poor(spark, sf_dir))
        # those that came again in the same commit stay, and go now
        segments.commit(spark, uri, c.limit(0), _poor(spark, sf_dir))
        if compacted:
            segments.compact(spark, uri)
        return S.keyword_scores(segments.read(spark, uri), QUERY).where(F.col("score") > S.KEYWORD_FLOOR).select("doc_id", F.round("score", 6).alias("score"))

    return run


def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return trigrams.containing(trigrams.write_trigrams(docs, shared_folder(spark, "trigrams")), docs, "S the").select("doc_id")


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a model: those of label 0 are of another than MODEL."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.when(F.col("label") == 0, "model-b").otherwise(MODEL).alias("model"))


def _asked(given: DataFrame) -> DataFrame:
    return given.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vec")


def semantic_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.scores(V.packed(vectors(spark, sf_dir)), _query_vector(spark, sf_dir)).where(F.col("score") >= S.SEMANTIC_FLOOR).select("doc_id", F.round("score", 6).alias("score"))
    return found.orderBy(F.desc("score"), "doc_id").limit(50)


def vector_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector of the model whose id 20 divides, the ten nearest of the model."""
    given = V.packed(_owned(spark, sf_dir), model=MODEL)
    return V.exact_topk(given, _asked(given), 10).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    given = V.packed(_owned(spark, sf_dir), model=MODEL)
    return given, V.topk(V.write_vector_index(given, shared_folder(spark, "vectors")), _asked(given), 10)


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir)[1].select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, found = _indexed(spark, sf_dir)
    return V.recall(found, V.exact_topk(given, _asked(given), 10))


def near_dup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.near_duplicate_classes(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 0.45)


def near_dup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.document_duplicates(catalog(spark, sf_dir).select("doc_id", "name", "path"), _owned(spark, sf_dir), 0.45, MODEL)


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, and their languages, by the number of their documents."""
    d = table(spark, sf_dir, "documents")
    high = d.groupBy("source").count().where("count % 4 = 0").select(F.concat(F.lit("/"), "source").alias("path"))
    low = d.groupBy("source", "lang").count().where("count % 4 = 1").select(F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/")).alias("path"))
    return high.unionByName(low)


def containing_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.containing(catalog(spark, sf_dir).select("doc_id", "path"), _folders(spark, sf_dir))


def outside_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.outside(catalog(spark, sf_dir).select("doc_id", "path"), _folders(spark, sf_dir)).select("doc_id")


def hidden_below_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below hidden folders, of which those of some sources are roots."""
    path = F.concat(F.lit("/."), "source", F.when(F.col("doc_id") % 3 == 0, "/.git/").otherwise("/"), F.col("doc_id").cast("string"))
    d = table(spark, sf_dir, "documents")
    roots = d.groupBy("source").count().where("count % 2 = 0").select(F.concat(F.lit("/."), "source").alias("path"))
    return O.hidden(d.select("doc_id", path.alias("path")), roots).select("doc_id", "hidden")


def bucket_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri, c = shared_folder(spark, "bucketed"), catalog(spark, sf_dir)
    old = c.where(F.array_contains("tags", "en")).select("path", "doc_id", F.lit("old").alias("title"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("synopsis"))
    buckets.create(old, uri, 16)
    buckets.upsert(spark, uri, c.where("size % 2 = 0").select("path", (F.col("doc_id") + 1_000_000).alias("doc_id"), "title"))
    return buckets.read(spark, uri)


def bucket_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri, c = shared_folder(spark, "bucketed"), catalog(spark, sf_dir).select("doc_id", "path")
    buckets.create(c, uri, 16)
    buckets.delete(spark, uri, c.join(_poor(spark, sf_dir), "doc_id", "left_semi"))
    return buckets.read(spark, uri)


#: A text with each kind of personal data, and what is found in it; some have none that is valid.
PLANTED = (
    ("is 123-45-6789 here", "SSN", "123-45-6789"), ("SSN: 123456789 ok", "SSN", "SSN: 123456789"), ("pay 4111 1111 1111 1111 now", "Credit Card", "4111 1111 1111 1111"),
    ("passport: AB1234567 x", "Passport Number", "passport: AB1234567"), ("born 1/2/1990 in", "Date of Birth", "born 1/2/1990"), ("patient id #12345 x", "Medical Record Number", "patient id #12345"),
    ("driver's license: X1234567 x", "Driver License", "driver's license: X1234567"), ("see 021000021 end", "Bank Routing Number", "021000021"), ("acct no: 1234 x", "Bank Account Number", "acct no: 1234"),
    ("666-12-3456 and 000-12-3456", None, None), ("pay 4111 1111 1111 1112 now", None, None), ("see 131000021 end", None, None),
)


def pii_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of PLANTED, dealt by id, with the source and language of the document."""
    text = F.concat_ws(" ", F.element_at(F.array(*[F.lit(p[0]) for p in PLANTED]), (F.col("doc_id") % len(PLANTED) + 1).cast("int")), "source", "lang")
    return I.scan_pii(table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.name", "h.match")


def pii_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a purge of titles and the first 800 characters leaves, and the paths on the blacklist after it."""
    c = catalog(spark, sf_dir).select("doc_id", "path", F.col("title").alias("description"), F.substring("content", 1, 800).alias("content_snippet"))
    listed = c.join(_poor(spark, sf_dir), "doc_id", "left_semi").select("path", F.lit("listed").alias("reason"))
    left, after = I.purge_listed(c, listed)
    return left.select("path", F.lit("left").alias("reason")).unionByName(after)


def office_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as office programs write them, of each document's source and language."""
    title = F.concat(F.element_at(F.array(*[F.lit(a) for a, _ in TITLED]), (F.col("doc_id") % len(TITLED) + 1).cast("int")), "source", F.lit(" in "), "lang", F.element_at(F.array(*[F.lit(b) for _, b in TITLED]), (F.col("doc_id") % len(TITLED) + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_title(title).alias("title"))


TITLED = (("Microsoft Word - ", ".docx"), ("", " "), ("Microsoft PowerPoint - reports/", ".PPT"), ("  Microsoft Office Excel -  ", ".xls"), ("Microsoft Word - Microsoft Word - ", ".txt"))


def mail_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senders made of each document's source and language, one with a comma in its quoted name, and a bare address."""
    field = F.concat(F.lit('"'), "source", F.lit(", "), "lang", F.lit('" <'), F.col("doc_id").cast("string"), F.lit("@x.org>,  "), "lang", F.lit("@y.org , <z@z.org>,lang@z.org ("), "source", F.lit(")"))
    return table(spark, sf_dir, "documents").select("doc_id", T.format_addresses(field).alias("shown"), T.first_sender(field).alias("author"))


def library_after_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library after a scan of some documents under other titles, and one of all, in which those without quality failed: what is stored, and what is listed."""
    uri, c = shared_folder(spark, "library"), catalog(spark, sf_dir)
    L.create(spark, uri, 16)
    made = c.join(_poor(spark, sf_dir).withColumn("poor", F.lit(True)), "doc_id", "left").select(
        "path", "name", F.lit("txt").alias("file_ext"), F.col("size").cast("long").alias("size_bytes"), F.lit(None).cast("timestamp").alias("modified_at"), "title", *[F.lit(None).cast("string").alias(x) for x in ("author", "subject", "description")],
        F.col("content").alias("text"), F.substring("content", 1, 800).alias("snippet"), F.lit("txt").alias("doc_type"), F.col("poor").isNull().alias("success"), F.when(F.col("poor"), "poor").alias("error"),
    )
    found = c.select("path", F.expr("substring(path, 2)").alias("rel"))
    L.add(spark, uri, found.join(made.where("size_bytes % 2 = 0"), "path", "left_semi"), made.where("size_bytes % 2 = 0").withColumns({"title": F.lit("old"), "success": F.lit(True)}))
    L.add(spark, uri, found, made)
    tags = L.table(spark, uri, "tags").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("tag")), " ").alias("tags"))
    kept = L.table(spark, uri, "documents").join(tags, "doc_id").select("path", "title", "tags", F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(L.table(spark, uri, "blacklist").select("path", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("tags"), "reason"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        cache_key, bm25_after_rewrite, trigram_search, semantic_packed, vector_topk_exact, vector_topk, vector_index_recall, near_dup_classes, near_dup_documents,
        containing_folder, outside_folders, hidden_below_roots, bucket_upsert, bucket_delete, pii_patterns, pii_blacklist, office_titles, mail_addresses, library_after_scans,
    )
} | {"bm25_segments": bm25_segments(False), "bm25_compacted": bm25_segments(True)}

_KEPT_SQL = bm25_sql(QUERY).replace("FROM c)", "FROM c WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))")
_FOLDERS_SQL = """f AS (SELECT '/' || source AS root FROM documents GROUP BY source HAVING count(*) % 4 = 0 UNION SELECT '/' || source || '/' || lang FROM documents GROUP BY source, lang HAVING count(*) % 4 = 1)"""
_CLASSES_SQL = """WITH RECURSIVE v AS ({}), p AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id WHERE list_cosine_similarity(x.e, y.e) >= 0.45),
    r AS (SELECT id AS n, id AS l FROM v UNION SELECT p.b, r.l FROM r JOIN p ON r.n = p.a), g AS (SELECT n AS id, min(l) AS class_id FROM r GROUP BY n), k AS (SELECT a AS id, count(*) AS links FROM p GROUP BY a)"""
_ALL_SQL, _OWN_SQL = ("SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings" + x for x in ("", " WHERE label <> 0 AND vec_id IN (SELECT doc_id FROM documents)"))

ORACLE_SQL: dict[str, str] = {
    "office_titles": """SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN 'Microsoft Word - ' || source || ' in ' || lang || '.txt' ELSE source || ' in ' || lang END AS title FROM documents""",
    "mail_addresses": """SELECT doc_id, source || ', ' || lang || ' <' || doc_id || '@x.org>, ' || lang || '@y.org, z@z.org, ' || source || ' <lang@z.org>' AS shown, source || ', ' || lang AS author FROM documents""",
    "library_after_scans": f"""WITH {CATALOG_SQL}, p AS (SELECT doc_id FROM labels WHERE quality = 0),
    r AS (SELECT path, tags, CASE WHEN doc_id IN (FROM p) THEN 'old' ELSE title END AS title, doc_id IN (FROM p) AS poor, size FROM c)
    SELECT path, title, array_to_string(list_sort(list_distinct(list_filter(['txt', lower(split_part(path, '/', 2)), lower(split_part(path, '/', 3))], lambda x: length(x) > 2))), ' ') AS tags, NULL AS reason FROM r WHERE NOT poor OR size % 2 = 0
    UNION ALL SELECT path, NULL, NULL, 'poor' FROM r WHERE poor""",
    "cache_key": "SELECT epoch_us(max(ts)) AS last, count(*) AS n FROM events",
    "bm25_after_rewrite": bm25_sql(QUERY),
    "bm25_segments": _KEPT_SQL,
    "bm25_compacted": _KEPT_SQL,
    "trigram_search": "SELECT doc_id FROM documents WHERE contains(lower(text), 's the')",
    "semantic_packed": f"WITH {COSINE_SQL} SELECT doc_id, round(sem, 6) AS score FROM v WHERE sem >= 0.3 ORDER BY score DESC, doc_id LIMIT 50",
    "vector_topk_exact": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE label <> 0), s AS (SELECT q.id AS qid, v.id AS doc_id, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM v q JOIN v ON q.id % 20 = 0),
    k AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, score FROM s) SELECT qid, doc_id, rank, round(score, 6) AS score FROM k WHERE rank <= 10""",
    "near_dup_classes": f"{_CLASSES_SQL.format(_ALL_SQL)} SELECT g.id, class_id, coalesce(links, 0) AS links FROM g LEFT JOIN k ON k.id = g.id",
    "near_dup_documents": _CLASSES_SQL.format(_OWN_SQL) + f", {CATALOG_SQL} SELECT doc_id, name, path, class_id, links FROM c JOIN g ON g.id = doc_id JOIN k ON k.id = doc_id",
    "containing_folder": f"WITH {CATALOG_SQL}, {_FOLDERS_SQL} SELECT doc_id, c.path, max_by(root, length(root)) AS root FROM c LEFT JOIN f ON c.path = root OR starts_with(c.path, root || '/') GROUP BY doc_id, c.path",
    "outside_folders": f"WITH {CATALOG_SQL}, {_FOLDERS_SQL} SELECT doc_id FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE c.path = root OR starts_with(c.path, root || '/'))",
    "hidden_below_roots": "SELECT doc_id, doc_id % 3 = 0 OR source NOT IN (SELECT source FROM documents GROUP BY source HAVING count(*) % 2 = 0) AS hidden FROM documents",
    "bucket_upsert": f"""WITH {CATALOG_SQL} SELECT path, CASE WHEN 'en' IN tags THEN doc_id ELSE doc_id + 1000000 END AS doc_id, CASE WHEN size % 2 = 0 THEN title ELSE 'old' END AS title, CASE WHEN 'en' IN tags THEN 's' || doc_id END AS synopsis
    FROM c WHERE 'en' IN tags OR size % 2 = 0""",
    "bucket_delete": f"WITH {CATALOG_SQL} SELECT doc_id, path FROM c WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "pii_patterns": "WITH p AS (SELECT unnest(range(12)) AS k, unnest([" + ", ".join("NULL" if n is None else f"'{n}'" for _, n, _ in PLANTED) + "]) AS name, unnest([" + ", ".join("NULL" if m is None else "'" + m.replace("'", "''") + "'" for *_, m in PLANTED) + "]) AS match) SELECT doc_id, name, match FROM documents JOIN p ON k = doc_id % 12 WHERE name IS NOT NULL",
    "pii_blacklist": f"WITH {CATALOG_SQL}, s AS (SELECT doc_id, path, concat_ws(' ', title, substr(content, 1, 800)) AS text FROM c), " + _pii_sql("").replace("FROM documents", "FROM s").removeprefix("WITH ") + """, n AS (SELECT doc_id, string_agg(name, ', ' ORDER BY name) AS reason FROM found GROUP BY doc_id),
    b AS (SELECT path FROM s WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))
    SELECT path, 'listed' AS reason FROM b UNION ALL SELECT path, reason FROM s JOIN n USING (doc_id) WHERE path NOT IN (FROM b) UNION ALL SELECT path, 'left' FROM s WHERE doc_id NOT IN (SELECT doc_id FROM n) AND path NOT IN (FROM b)""",
}
