"""Substring search by trigrams: postings of every three characters, intersected, then verified on the texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.search import SLICES, head_of, heads_for


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case; none of a shorter or null one."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(F.lower(text), F.lit("")), F.lit("(?s)(?=(...))"), F.lit(1)))


@dataclass
class Trigrams:
    """Written postings (gram, doc_id, head) and the number of their folders."""

    postings: DataFrame
    heads: int


def write_trigrams(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text") -> Trigrams:
    """Write the postings of docs, in folders by gram and sorted by it."""
    rows, heads = docs.select(F.col(id_col).alias("doc_id"), F.explode(grams(F.col(text_col))).alias("gram")), heads_for(docs)
    dealt = rows.withColumn("head", head_of(F.col("gram"), heads)).repartition("head", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)))
    dealt.sortWithinPartitions("head", "gram", "doc_id").write.partitionBy("head").parquet(f"{uri}/postings")
    docs.sparkSession.createDataFrame([(heads,)], "heads int").coalesce(1).write.parquet(f"{uri}/heads")
    return read_trigrams(docs.sparkSession, uri)


def read_trigrams(spark: SparkSession, uri: str) -> Trigrams:
    return Trigrams(spark.read.parquet(f"{uri}/postings"), spark.read.parquet(f"{uri}/heads").first()["heads"])


def containing(index: Trigrams, docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text contains query, case ignored. A query of under three characters has no trigram and tests every text."""
    found = F.contains(F.lower(F.col(text_col)), F.lower(F.lit(query)))
    wanted = sorted({query.lower()[i : i + 3] for i in range(len(query) - 2)})
    if not wanted:
        return docs.where(found)
    own = [(F.col("gram") == g) & (F.col("head") == head_of(F.lit(g), index.heads)) for g in wanted]
    any_of = own[0]
    for test in own[1:]:
        any_of = any_of | test
    hits = index.postings.where(any_of).groupBy("doc_id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted))
    return docs.join(hits.select(F.col("doc_id").alias("_hit")), F.col(id_col) == F.col("_hit"), "left_semi").where(found)
