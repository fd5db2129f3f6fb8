"""A keyword index that documents are added to, changed in and deleted from, without building it again.

Every commit is a segment: the packed postings of the documents that came, and the ids that are gone, which are those deleted
and those that came again. A row of a segment counts unless a later one has its document among the gone. Which segments there
are, the number of documents and their mean length are a version (sources.snapshots), complete or not there at all, so a failed commit
leaves nothing that a search sees. compact() makes one segment of all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import search as S
from siftwell.sources import snapshots
from siftwell.store import remove, written

#: What a segment consists of; each is a table with a folder for each segment.
SCHEMAS = {
    "postings": S.PACKED.format("long") + ", seq long, head int",
    "gone": "doc_id long, seq long",
}
#: Numbers of blocks that a commit has for its own; compact() keeps the blocks and their numbers.
SEGMENT_BLOCKS = S.TASK_BLOCKS << 24


def _segments(spark: SparkSession, uri: str) -> tuple[list[int], int]:
    """The numbers of the newest version's segments, and its heads."""
    if not snapshots.versions(spark, f"{uri}/versions"):
        return [], 0
    rows = snapshots.load(spark, f"{uri}/versions")["segments"].collect()  # a row for each commit since the last compaction
    return sorted(r["seq"] for r in rows), rows[0]["heads"]


def _part(spark: SparkSession, uri: str, segments: list[int], part: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[part]).option("basePath", f"{uri}/{part}").parquet(*[f"{uri}/{part}/seq={n}" for n in segments])


def _against(rows: DataFrame, gone: DataFrame, how: str) -> DataFrame:
    upto = gone.groupBy(F.col("doc_id").alias("_id")).agg(F.max("seq").alias("_seq"))
    return rows.join(upto, (F.col("doc_id") == F.col("_id")) & (F.col("seq") < F.col("_seq")), how)


def _live(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (doc_id, seq and others) that no later segment has among its gone."""
    return _against(rows, gone, "left_anti")


def _dead(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The others."""
    return _against(rows, gone, "left_semi")


def _write(spark: SparkSession, uri: str, seq: int, heads: int, postings: DataFrame, gone: DataFrame, dealt: bool = True) -> None:
    """Write a segment. What a failed attempt at the same number left is overwritten: no version names it."""
    S.write_postings(postings, f"{uri}/postings/seq={seq}", heads, "overwrite", dealt)
    gone.withColumn("doc_id", F.col("doc_id").cast("long")).write.mode("overwrite").parquet(f"{uri}/gone/seq={seq}")


def _save(spark: SparkSession, uri: str, segments: list[int], heads: int, source: str | None) -> int:
    docs = _live(S.documents_of(_part(spark, uri, segments, "postings")), _part(spark, uri, segments, "gone"))
    totals = docs.agg(F.count("*").alias("N"), F.avg("len").alias("avgdl")).withColumn("source", F.lit(source).cast("string"))
    named = spark.createDataFrame([(n, heads) for n in segments], "seq long, heads int")
    return snapshots.save(spark, f"{uri}/versions", {"segments": named, "totals": totals})


def commit(spark: SparkSession, uri: str, rows: DataFrame, deleted: DataFrame | None = None, source: str | None = None) -> int:
    """Add the documents of rows (a catalog), in place of those that have their ids, and delete those with the ids of deleted (doc_id); the new version's number.

    source: what the index is now a state of, such as store.files_key(); see source_of(). An id that is both in rows and deleted is there
    afterwards. Unknown ids do no harm, rows may be empty, a null id is indexed but cannot be changed or deleted. One writer at a time.
    """
    segments, heads = _segments(spark, uri)
    heads, seq = heads or S.heads_for(rows), max(segments, default=0) + 1
    ids = rows.select("doc_id") if deleted is None else rows.select("doc_id").unionByName(deleted.select("doc_id"))
    packed = S.packed(rows.withColumn("doc_id", F.col("doc_id").cast("long"))).withColumn("block", F.col("block") + F.lit(seq * SEGMENT_BLOCKS))
    _write(spark, uri, seq, heads, packed, ids.where("doc_id is not null").distinct(), not S.direct(rows))
    return _save(spark, uri, [*segments, seq], heads, source)


def read(spark: SparkSession, uri: str) -> S.Index:
    """The index of the newest version, for search.keyword_scores()."""
    segments, heads = _segments(spark, uri)
    totals = snapshots.load(spark, f"{uri}/versions")["totals"]
    rows = _part(spark, uri, segments, "postings")
    docs = _live(S.documents_of(rows), _part(spark, uri, segments, "gone"))
    return S.Index(S.unpacked(rows), docs.drop("seq"), totals.select("N", "avgdl"), heads)


def source_of(spark: SparkSession, uri: str) -> str | None:
    """What the newest version is a state of; without a version none."""
    return snapshots.load(spark, f"{uri}/versions")["totals"].first()["source"] if snapshots.versions(spark, f"{uri}/versions") else None


def compact(spark: SparkSession, uri: str) -> int:
    """Make one segment of all, without what is gone; the new version's number. Older versions keep their segments until they are dropped, then vacuum() deletes these."""
    segments, heads = _segments(spark, uri)
    seq, gone, rows = segments[-1] + 1, _part(spark, uri, segments, "gone"), _part(spark, uri, segments, "postings")
    dead = written(_marks(_dead(S.documents_of(rows), gone)), "dead")
    _write(spark, uri, seq, heads, _without(rows.drop("seq", "head"), dead), gone.drop("seq").limit(0))
    return _save(spark, uri, [seq], heads, source_of(spark, uri))


def _marks(dead: DataFrame) -> DataFrame:
    """(block, words): a bit for each place in a block, set for the dead documents (block, at)."""
    word, bit = (F.col("at") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, at)").alias("bit")
    words = dead.select("block", word, bit).groupBy("block", "w").agg(F.bit_or("bit").alias("bits"))
    found = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"), F.max("w").alias("last"))
    return found.select("block", F.transform(F.sequence(F.lit(0), "last"), lambda w: F.coalesce(F.col("m")[w], F.lit(0).cast("long"))).alias("words"))


def _without(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """Packed rows without the tokens of dead documents (_marks). The list of a block's documents keeps their places, without a length."""
    gone = lambda at: F.call_function("shiftright", F.get("words", F.shiftright(at, 6)), at).bitwiseAND(F.lit(1)) == 1  # noqa: E731 - null beyond the last mark; shifts of a long count by the last six bits
    held = rows.join(dead, "block", "left")
    kept = F.when(F.col("words").isNull(), F.arrays_zip("at", "places")).otherwise(F.filter(F.arrays_zip("at", "places"), lambda x: ~F.coalesce(gone(x["at"]), F.lit(False))))
    lens = F.when(F.col("words").isNull(), F.col("lens")).otherwise(F.transform("lens", lambda n, i: F.when(~F.coalesce(gone(i), F.lit(False)), n)))
    cut = held.withColumn("kept", kept).withColumns({"lens": lens, "at": F.col("kept.at"), "places": F.col("kept.places")})
    return cut.where("term is null or size(at) > 0").select(*rows.columns)


def vacuum(spark: SparkSession, uri: str) -> list[int]:
    """Delete the segments that no version names; their numbers. No writer may be at work."""
    named = {r["seq"] for n in snapshots.versions(spark, f"{uri}/versions") for r in snapshots.load(spark, f"{uri}/versions", n)["segments"].collect()}
    old = sorted({n for part in SCHEMAS for n in _numbers(spark, f"{uri}/{part}")} - named)
    for n in old:
        for part in SCHEMAS:
            remove(spark, f"{uri}/{part}/seq={n}")
    return old


def _numbers(spark: SparkSession, uri: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    names = [s.getPath().getName() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    return [int(n.removeprefix("seq=")) for n in names if n.startswith("seq=")]
