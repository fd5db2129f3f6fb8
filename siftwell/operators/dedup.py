"""Exact duplicates by size and digest; near-duplicates by cosine of vectors; connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.store import shared_folder

#: Pivots that deal vectors out grow with the square root of their number, between these; they are collected.
LEAST_PIVOTS, MOST_PIVOTS = 64, 4096
#: Vectors of a cell that a task holds as residents, and as visitors; residents that are multiplied at once, and pairs that are looked at.
SLICE, BLOCK, PIECE = 20_000, 128, 1 << 17
#: All vectors as one cell are so many slices at least, if these are not smaller than SMALL.
LEAST_BLOCKS, SMALL = 4, 2_000


def exact_duplicates(files: DataFrame, content: str = "content") -> DataFrame:
    """(group_id, doc_id, size): files of equal content. files: doc_id, size, and content.

    Only files that share their size are hashed; files without a size are left out. group_id is the smallest
    id of the group.
    """
    shared = files.where("size is not null").groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")
    hashed = files.join(shared, "size", "left_semi").select("doc_id", "size", F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    groups = hashed.groupBy("digest", "size").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return hashed.join(groups, ["digest", "size"]).select("group_id", "doc_id", "size")


def duplicate_summary(groups: DataFrame) -> DataFrame:
    each = groups.groupBy("group_id").agg((F.count("*") - 1).alias("extra"), F.first("size").alias("size"))
    return each.agg(F.count("*").alias("groups"), F.coalesce(F.sum("extra"), F.lit(0)).alias("redundant"), F.coalesce(F.sum(F.col("extra") * F.col("size")), F.lit(0)).alias("recoverable_bytes"))


def _rows_of(batch: pa.RecordBatch) -> np.ndarray:
    """The embeddings of a batch, all of one length, as float64; NaN for a null in one."""
    values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(batch.num_rows, -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each row's least linked row, known so far) after the links of i and j."""
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


def _tiles(vectors: DataFrame, threshold: float, pivots: int | None) -> tuple[DataFrame | None, bool]:
    """Rows (cell, r, v, id, embedding, weight, lives, visits), the groups of which hold every pair that is near enough once; whether there is one cell alone."""
    given = vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding", "weight")
    n = given.count()
    blocks = max(-(-n // SLICE), min(LEAST_BLOCKS, -(-n // SMALL)))
    most = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(n))) if pivots is None else pivots
    one = most == 1 or (pivots is None and blocks <= LEAST_BLOCKS)
    chosen = given.select("embedding").orderBy(F.xxhash64("id")).limit(1 if one else most).collect()
    if not chosen:
        return None, True
    dim = len(chosen[0][0])
    given = given.where((F.size("embedding") == dim) & F.exists("embedding", lambda x: x != 0))
    p = _unit(np.array([r[0] for r in chosen if len(r[0]) == dim], float))
    reach = float(np.arccos(np.clip(threshold, -1, 1)))
    if not one and pivots is None:
        between = np.arccos(np.clip(p @ p.T, -1, 1))
        np.fill_diagonal(between, np.pi)
        one = float((between <= between.min(1, keepdims=True) + 2 * reach).sum(1).mean()) >= blocks
    if one:
        placed = given.withColumns({"cell": F.lit(0), "s": F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long"))})
        lives = F.expr(f"transform(sequence(s, {blocks - 1}L), v -> struct(s as r, v as v, true as lives, v = s as visits))")
        visits = F.expr("transform(if(s > 0, sequence(0L, s - 1), array()), r -> struct(r as r, s as v, false as lives, true as visits))")
        return placed.select("cell", "id", "embedding", "weight", F.inline(F.concat(lives, visits))), True

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):  # MOST_PIVOTS copies of each at most
                part = b.slice(a, 256)
                angle = np.arccos(np.clip(_unit(_rows_of(part)) @ p.T, -1, 1))
                home = angle.argmin(1)
                row, cell = np.nonzero(angle <= angle.min(1, keepdims=True) + 2 * reach + 1e-9)
                for c in range(0, len(row), 8192):
                    r, k = row[c : c + 8192], cell[c : c + 8192]
                    at = pa.array(r)
                    yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(home[r] == k), *(part.column(x).take(at) for x in ("id", "embedding", "weight"))], ["cell", "home", "id", "embedding", "weight"])

    kind = dict(given.dtypes)["embedding"]
    dealt = given.mapInArrow(deal, f"cell int, home boolean, id long, embedding {kind}, weight long")
    slices = lambda n: F.greatest(F.ceil(n / SLICE), F.lit(1)).cast("long")
    sizes = dealt.groupBy("cell").agg(slices(F.sum(F.col("home").cast("long"))).alias("rs"), slices(F.count("*")).alias("vs"))
    placed = dealt.join(F.broadcast(sizes), "cell").withColumns({"r0": F.pmod(F.xxhash64("id"), "rs"), "v0": F.pmod(F.xxhash64("id", F.lit(1)), "vs")})
    # a resident goes to all slices of visitors, a visitor to all slices of residents; where both meet, it is one row
    lives = F.expr("transform(if(home, sequence(0L, vs - 1), array()), v -> struct(r0 as r, v as v, true as lives, v = v0 as visits))")
    visits = F.expr("transform(filter(sequence(0L, rs - 1), r -> not home or r != r0), r -> struct(r as r, v0 as v, false as lives, true as visits))")
    return placed.select("cell", "id", "embedding", "weight", F.inline(F.concat(lives, visits))), False


def _linked(vectors: DataFrame, threshold: float, pivots: int | None, pairs: bool) -> DataFrame:
    """Pairs (a, b, similarity); or for each vector and task that found links of it, (a, b, links, similarity): the least one it is connected with there,
    the weight of those it is linked to, and its largest cosine. vectors: id, embedding, weight."""
    schema = "a long, b long, similarity double" if pairs else "a long, b long, links long, similarity double"
    dealt, one = _tiles(vectors, threshold, pivots)
    if dealt is None:
        return vectors.sparkSession.createDataFrame([], schema)

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, parts = {x: [] for x in ("id", "weight", "lives", "visits")}, []
        for b in batches:
            for x, held in cols.items():
                held.append(b.column(x).to_numpy(zero_copy_only=False))
            parts.append(_rows_of(b))
        ids, weight, lives, visits = (np.concatenate(c) for c in cols.values())
        order = np.argsort(ids, kind="stable")
        ids, weight, lives, visits, m = ids[order], weight[order], lives[order], visits[order], np.concatenate(parts)[order]
        parts.clear()
        norm = np.linalg.norm(m, axis=1)
        own, seen = np.flatnonzero(lives), np.flatnonzero(visits)
        # one product in single precision finds all that may be near enough; those are computed again in double precision
        short = (m / np.maximum(norm, 1e-300)[:, None]).astype(np.float32)
        margin = np.float32(threshold - (m.shape[1] + 8) * 2.0**-23)
        asked, whole = short[seen].T.copy(), one and key[1].as_py() != key[2].as_py()
        label, links, best = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf)
        for a in range(0, len(own), BLOCK):
            block = own[a : a + BLOCK]
            near = np.flatnonzero((short[block] @ asked).ravel() >= margin)
            for c in range(0, len(near), PIECE):
                at = near[c : c + PIECE]
                i, j = block[at // len(seen)], seen[at % len(seen)]
                ahead = ids[i] != ids[j] if whole else ids[i] < ids[j]
                i, j = i[ahead], j[ahead]
                sim = np.einsum("ij,ij->i", m[i], m[j]) / (norm[i] * norm[j])
                good = sim >= threshold
                i, j, sim = i[good], j[good], sim[good]
                if not len(i):
                    continue
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.array(sim)], ["a", "b", "similarity"])
                else:
                    label = _joined(label, i, j)
                    for x, y in ((i, j), (j, i)):
                        np.add.at(links, x, weight[y])
                        np.maximum.at(best, x, sim)
        at = np.flatnonzero(links)
        if not pairs and len(at):
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[label[at]]), pa.array(links[at]), pa.array(best[at])], ["a", "b", "links", "similarity"])

    return dealt.groupBy("cell", "r", "v").applyInArrow(meet, schema)


def near_duplicate_pairs(vectors: DataFrame, threshold: float = 0.97, pivots: int | None = None) -> DataFrame:
    """(a, b, similarity), a < b, for every pair with cosine of threshold or more. vectors: id, embedding.

    Each vector lives in the cell of its nearest pivot and visits every cell where, by the triangle inequality on
    angles, one that lives there can be near enough; so every pair meets in the cell of its smaller id, once.
    The residents and the visitors of a cell are dealt to slices, and a task multiplies a slice of each in blocks.
    Where pivots would send a vector to more cells than there are slices of all vectors, as at thresholds that are far from 1, all
    are one cell, and each two slices of it meet once. Zero vectors are near nothing.
    """
    return _linked(vectors.select("id", "embedding", F.lit(1).cast("long").alias("weight")), threshold, pivots, True)


def _settled(df: DataFrame) -> DataFrame:
    """df, written below the shared folder; computed once, where a checkpoint computes its last stage twice."""
    uri = shared_folder(df.sparkSession, "settled")
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node of each connected component.

    Every round a node takes the smallest label among its neighbours and then its label's label, so labels
    halve their distance; each round is written.
    """
    edges = _settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = _settled(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).withColumnRenamed("a", "node"))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        new = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("l", "m").alias("l"))
        jump = labels.select(F.col("node").alias("l"), F.col("l").alias("ll"))
        new = _settled(new.join(jump, "l", "left").select("node", F.least("l", F.coalesce("ll", "l")).alias("l")))
        changed = new.join(labels.withColumnRenamed("l", "before"), "node").where("l != before").limit(1).count()
        labels = new
        if not changed:
            return labels.select("node", F.col("l").alias("component"))


def _classes(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, rep), representatives (rep, copies, near) of equal vectors, and what links tell of those that have some (rep, component, others, similarity).

    Links are counted, and connected as far as one task sees, where they are found, so a group of many near copies costs rows for its vectors and tasks, not for its pairs.
    """
    given = vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding")
    reps = _settled(given.groupBy("embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("near", F.exists("embedding", lambda x: x != 0)))
    rows = _settled(given.join(reps.select("embedding", "rep"), "embedding").select("id", "rep"))
    found = _settled(_linked(reps.select(F.col("rep").alias("id"), "embedding", F.col("copies").alias("weight")), threshold, None, False))
    told = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"), F.max("similarity").alias("similarity"))
    return rows, reps.drop("embedding"), told.join(components(found.where("a != b")).withColumnRenamed("node", "rep"), "rep", "left")


def near_duplicate_classes(vectors: DataFrame, threshold: float = 0.97) -> DataFrame:
    """(id, class_id, links) for each vector: the smallest id reachable over links, and to how many rows a vector is linked.

    Equal vectors are one throughout, so copies cost a row each and no pairs. Zero vectors are linked with nothing, equal ones included; null ones are left
    out. Repeated ids are rows of their own.
    """
    rows, reps, linked = _classes(vectors, threshold)
    told = reps.join(linked, "rep", "left")
    told = told.select("rep", "near", F.coalesce("component", "rep").alias("class_id"), F.when(F.col("near"), F.col("copies") - 1 + F.coalesce("others", F.lit(0))).otherwise(0).alias("links"))
    return rows.join(told, "rep").select("id", F.when(F.col("near"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"), "links")


def near_duplicate_groups(vectors: DataFrame, threshold: float = 0.97) -> DataFrame:
    """(group_id, id, similarity): groups of vectors that links connect; similarity is the group's largest, 1 where it has copies."""
    rows, reps, linked = _classes(vectors, threshold)
    known = reps.where("near").join(linked, "rep", "left").withColumn("group_id", F.coalesce("component", "rep"))
    best = known.groupBy("group_id").agg(F.max(F.greatest("similarity", F.when(F.col("copies") > 1, 1.0))).alias("similarity")).where("similarity is not null")
    return rows.join(known.select("rep", "group_id"), "rep").join(best, "group_id").select("group_id", "id", "similarity")


def document_duplicates(documents: DataFrame, vectors: DataFrame, threshold: float = 0.97, model: str | None = None) -> DataFrame:
    """The columns of documents (doc_id and others) with class_id and links, of those that have a vector (doc_id, embedding, and model if that is asked for) and are linked."""
    chosen = vectors if model is None else vectors.where(F.col("model") == model)
    owned = documents.select("doc_id").join(chosen.select("doc_id", "embedding"), "doc_id").select(F.col("doc_id").alias("id"), "embedding")
    found = near_duplicate_classes(owned, threshold).where("links > 0").withColumnRenamed("id", "doc_id")
    return documents.join(found, "doc_id")
