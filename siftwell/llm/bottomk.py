"""MinHash near-duplicates by bottom-k sketches of one hash function.

A text's sketch is the K smallest hashes of its distinct shingles (all of them, if they are fewer). The K smallest of two sketches'
union are a sample of the union of both sets, and the part that lies in both sketches estimates their Jaccard similarity. A
pair of similarity 0.85 falls below LEAST of K with a chance under one in a million; for sets that their sketches hold whole the estimate is exact.

Inverted lists find the pairs: two sketches that reach the estimate share one of their len - ceil(len * LEAST / K) + 1 rarest values, so
a text stands in the lists of those alone, and values of very many texts are seldom among them. Lists with the same smallest member are one
group, in which sketches are compared breadth first (grouping); what they link are the candidates, again in groups, and there whole sets
of shingles decide.

Texts with equal sets are one node throughout, and each node's text travels once or, in groups of several blocks, a bounded number of times
unless clusters remain apart (see grouping).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialise, release
from siftwell.llm.grouping import Similar, jaccard, similar_links
from siftwell.llm.nearcopies import MARK, marked
from siftwell.llm.simhash import components, shingle_hashes

#: Values of a sketch, and how many of the union's must be common for a pair to be a candidate.
K, LEAST = 64, 38
#: Sketches, and shingles of whole sets, that a task compares at once.
SKETCHES, SHINGLES = 8_000, 1_500_000
#: What a row's set of shingles is told by: a hash of 128 bits of all of them.
SKETCHED = "row long, doc_id long, text string, n_shingles long, set_id binary, sketch array<long>"


def sketch(found: np.ndarray) -> np.ndarray:
    """The K smallest of distinct ascending hashes."""
    return found[:K]


def estimated(p: int, q: int) -> Similar:
    """Sketches of sets that may have a Jaccard similarity of p/q: LEAST of the union sketch's K values are common, or p/q of it where it is the whole union."""

    def similar(own: np.ndarray, flat: np.ndarray, n: np.ndarray, room: np.ndarray) -> np.ndarray:
        room[own] = np.arange(1, len(own) + 1)
        rank, start = room[flat].astype(np.int64), np.cumsum(n) - n
        room[own] = 0
        common = rank > 0
        running = np.cumsum(common)
        before = (running - common)[start]
        # a common value's place in the union: its places in both, less the common values that were counted twice
        place = rank + np.arange(1, len(flat) + 1) - np.repeat(start, n) - (running - np.repeat(before, n))
        met = np.add.reduceat(common & (place <= K), start, dtype=np.int64)
        union = n + len(own) - np.add.reduceat(common, start, dtype=np.int64)
        whole = (n < K) & (len(own) < K) & (union <= K)
        return np.where(whole, met * q >= p * union, met * K >= LEAST * np.minimum(union, K))

    return similar


def sketched(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """SKETCHED for every row of docs; null and wordless texts have no shingles and an empty sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                sets = [np.unique(shingle_hashes(t, shingle)) for t in part.column(2).to_pylist()]
                ids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array([sketch(s).view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], ["row", "doc_id", "text", "n_shingles", "set_id", "sketch"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SKETCHED)


def listed(nodes: DataFrame) -> DataFrame:
    """(root, node) long: the members of inverted lists, gathered by the smallest member of each; nodes: (node, sketch)."""
    values = nodes.select("node", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = values.join(often, "value").groupBy("node").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
    # values of no other text are the rarest and take the first places
    places = F.col("size") - F.ceil(F.col("size") * LEAST / K) + 1 - (F.col("size") - F.size("shared"))
    rare = shared.where(places > 0).select("node", F.explode(F.slice("shared", F.lit(1), places.cast("int"))).alias("x")).select("node", "x.value")
    lists = rare.groupBy("value").agg(F.min("node").alias("root"), F.count("*").alias("n")).where("n > 1").select("value", "root")
    return rare.join(lists, "value").select("root", "node").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text", kept: list[str] | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs; component_id is the smallest doc_id reachable over links.

    Two rows are linked if the Jaccard similarity of their sets of distinct shingles is similarity (a fraction of 0.8 or more, below which
    LEAST would lose pairs) or more. A text of fewer words is one shingle. Null, empty and wordless texts have no shingle and are linked
    with nothing. Equal texts and repeated rows share a set. A null id gets its component's id and never names one,
    unless the component has no other. An empty table gives no rows; other columns are not read; texts of any length count whole.
    """
    p, q = similarity
    if 5 * p < 4 * q:
        raise ValueError("similarity must be 0.8 or more")
    spark, inner = docs.sparkSession, []
    rows = materialise(sketched(docs, shingle, id_col, text_col), "sketched", inner)
    sets = materialise(rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("weight"), F.first("sketch").alias("sketch")), "sets", inner)
    nodes = sets.select("node", "sketch")
    lists = materialise(listed(nodes).withColumn("weight", F.lit(1).cast("long")), "lists", inner)
    alike = similar_links(lists, lambda chosen: chosen.join(nodes, "node"), "sketch", lambda x: np.asarray(x, np.int64).view(np.uint64), estimated(p, q), SKETCHES, "alike", inner)
    groups = materialise(components(alike, inner).join(sets.select("node", "weight"), "node"), "groups", inner)

    def texts(chosen: DataFrame) -> DataFrame:
        found = marked(rows.select("row", "text"), "row", chosen.withColumnRenamed("node", "row"), "texts", inner)
        return found.select(*[F.col(f"{MARK}.{'row' if c == 'node' else c}").alias(c) for c in chosen.columns], "text")

    links = similar_links(groups, texts, "text", lambda t: np.unique(shingle_hashes(t, shingle)), jaccard(p, q), SHINGLES, "linked", inner)
    rooted = sets.select("set_id", "node", "least").join(components(links, inner), "node", "left")
    named = rooted.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(named.join(least, "root").select("set_id", "component_id"), "classes", kept)
    own = materialise(rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("set_id")), "own", kept)
    release(spark, inner)
    linked = own.where("set_id is not null").join(classes, "set_id").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(own.where("set_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
