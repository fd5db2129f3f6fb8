"""The corpus pipeline: quality classifier, SimHash near-duplicates, decontamination, mixing, token records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import decontam, mixing, nearcopies, quality, records
from siftwell.llm.common import materialise, release, scratch
from siftwell.llm.queries import table, tokenizer_path
from siftwell.session import ship



def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, kept: list[str] | None = None) -> DataFrame:
    """Documents whose perplexity the quality classifier accepts.

    Null and empty texts go. Rows without an id stay, as their verdict cannot be told from those of others; if rows repeat an id, all of
    them go if one is rejected. Long texts count whole, other columns are passed on, an empty table gives no rows.
    """
    ship(spark)
    inner: list[str] = []
    judged = quality.classify(docs, table(spark, sf_dir, "labels"), kept=inner)
    rejected = materialise(judged.where("not kept").select("doc_id", "kept"), "rejected", kept, few=True)
    release(spark, inner)
    return quality.keep_good(docs, rejected)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, kept: list[str] | None = None) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates: a Jaccard similarity of five-word shingles of 0.8 or more.

    Of rows that repeat one id in a group one stays. Rows without an id are thinned too, and stay only where no row of their group has one.
    Null, empty and wordless texts are one group. Long texts count whole, other columns are passed on, an empty table gives no rows.
    """
    ship(spark)
    return nearcopies.distinct_documents(docs, shingle=5, radius=4, kept=kept)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, kept: list[str] | None = None) -> DataFrame:
    """Documents without a window of the benchmark.

    If rows repeat an id, all of them go if one has a hit. Rows without an id stay, null and empty texts too: they have no words.
    Long texts count whole, other columns are passed on, an empty table gives no rows and an empty benchmark rejects none.
    """
    ship(spark)
    return decontam.remove_documents(docs, decontam.contamination(docs, table(spark, sf_dir, "benchmark"), kept=kept), kept=kept)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, kept: list[str] | None = None) -> DataFrame:
    """Documents as often as the mix takes them.

    Rows that repeat an id take the largest of their copies each; rows without an id stay once. Null and empty texts weigh nothing and are
    taken as any other. Long texts count whole, other columns are passed on, an empty table gives no rows.
    """
    ship(spark)
    inner: list[str] = []
    rated = mixing.mixing_rates(docs, table(spark, sf_dir, "labels"), kept=inner)
    copies = materialise(rated.select("doc_id", "copies"), "copies", kept, few=True)
    release(spark, inner)
    return mixing.take_copies(docs, copies)


def records_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, kept: list[str] | None = None) -> DataFrame:
    """Token records of all documents, as read back from their files: (doc_id, start, n_tokens, ids_crc32).

    Every row has a record, also repeated ones; null ids come first, null and empty texts have the end alone. An empty table gives no rows.
    """
    ship(spark)
    uri = scratch(spark, "records", kept)
    manifest = records.write_records(docs, uri, tokenizer_path(), end_id=2)
    return records.read_records(spark, uri, manifest).drop("ids")


STAGES: list[tuple[str, Callable[..., DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token records", records_stage),
]

#: SQL cannot express the stages; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again. A stage's scratch folders, and the input that it had from the one before, are deleted when it is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        uri, kept = scratch(spark, name.replace(" ", "-")), []
        stage(spark, docs, sf_dir, kept).write.parquet(uri)
        docs = spark.read.parquet(uri)
        release(spark, kept + before)
        before = [uri]
    return docs
