"""Vectors packed as float32 with their norms, an inverted file of them, and searches of many queries at once.

The inverted file is fitted on SAMPLE vectors: cells by spherical k-means, a scale for each dimension by which a unit vector's difference from
its cell's centre is a code of one signed byte, and how many cells a search must look into to reach REACH of the nearest. Every vector is in the file. A search sends each query to its nearest cells, takes the best codes
there and computes the cosines of these from the whole vectors. exact_topk() compares queries and vectors in blocks instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors that the cells are fitted on, at most, and the cells.
SAMPLE, MOST_CELLS, ROUNDS = 8192, 1024, 10
#: Of a search's own probes: the share of the TRIED sample vectors' nearest others whose cells they reach.
REACH, TRIED, NEAREST = 0.97, 512, 10
#: Vectors and queries that meet in one task, about, and queries that are multiplied at once.
SLICE, BLOCK = 20_000, 64
#: Decimal places of cosines; results that tie there are ordered by id.
PLACES = 9


def _bytes_of(lists: pa.Array) -> pa.Array:
    """float32 little-endian of each list of numbers; null for a null list and one with a null in it."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values = lists.flatten()
    at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    holes = np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False))
    none = lists.is_null().to_numpy(zero_copy_only=False).copy()
    none[np.searchsorted(at, holes, "right") - 1] = True
    data = values.cast(pa.float32()).fill_null(0).to_numpy(zero_copy_only=False).astype("<f4")
    return pa.array([None if n else data[a:b].tobytes() for n, a, b in zip(none, at[:-1], at[1:], strict=True)], pa.binary())


def _matrix(vecs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), "<f4").reshape(-1, dim).astype(np.float64)


def _packing(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for lists in batches:
        yield _bytes_of(lists)


def pack(embedding: Column) -> Column:
    """An array of numbers as float32 bytes."""
    return F.arrow_udf(_packing, "binary")(embedding)


def unpack(vec: Column, dim: int) -> Column:
    """Packed bytes as an array<float>; null if they are not dim numbers."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([np.frombuffer(x, "<f4") if x is not None and len(x) == 4 * dim else None for x in b.to_pylist()], pa.list_(pa.float32()))

    return F.arrow_udf(run, "array<float>")(vec)


def packed(vectors: DataFrame, dim: int | None = None, model: str | None = None) -> DataFrame:
    """(doc_id, vec, norm) of vectors (doc_id, embedding, and model if that is asked for): those of the model, of dim numbers.

    Null vectors, those with a null in them and of another length are left out; dim is that of the smallest id's vector, if it is not given. A zero vector has norm 0.
    """
    chosen = vectors if model is None else vectors.where(F.col("model") == model)
    if dim is None:
        first = chosen.where("embedding is not null").agg(F.min_by(F.size("embedding"), "doc_id")).first()[0]
        dim = first or 0
    rows = chosen.select("doc_id", pack(F.col("embedding").cast("array<float>")).alias("vec")).where(F.octet_length("vec") == 4 * dim)

    def norms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(np.linalg.norm(_matrix(b.to_pylist(), dim), axis=1) if dim else np.zeros(len(b)), pa.float64())

    return rows.withColumn("norm", F.arrow_udf(norms, "double")("vec"))


def scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(doc_id, score) of packed vectors against one query: cosines, 0 for a zero vector or query."""
    q = np.asarray(query, "<f4").astype(np.float64)
    size = float(np.linalg.norm(q))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vecs, norm in batches:
            below = norm.to_numpy(zero_copy_only=False) * size
            dot = _matrix(vecs.to_pylist(), len(q)) @ q
            yield pa.array(np.divide(dot, below, out=np.zeros(len(dot)), where=below > 0))

    return vectors.where(F.octet_length("vec") == 4 * len(q)).select("doc_id", F.arrow_udf(run, "double")("vec", "norm").alias("score"))


@dataclass
class VectorIndex:
    """rows: (doc_id, cell, code, norm, vec), written; centres: float64, a unit vector for each cell; scale: of codes, by dimension; probes: cells of a search."""

    rows: DataFrame
    centres: np.ndarray
    scale: np.ndarray
    probes: int


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def fit(sample: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and scale from unit vectors; the first centres are spread evenly over them."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        home = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        full = np.linalg.norm(sums, axis=1) > 1e-12
        centres = np.where(full[:, None], _units(sums), centres)
    rest = sample - centres[(sample @ centres.T).argmax(1)]
    return centres, np.maximum(np.abs(rest).max(0) / 127, 1e-12)


def probes_for(sample: np.ndarray, centres: np.ndarray) -> int:
    """Cells, in the order of a vector's nearest, among which are those of REACH of its nearest in the sample."""
    tried = sample[:TRIED]
    cos = tried @ sample.T
    np.fill_diagonal(cos, -2)
    near = np.argsort(-cos, axis=1, kind="stable")[:, : min(NEAREST, len(sample) - 1)]
    if not near.size:
        return 1
    home, order = (sample @ centres.T).argmax(1), np.argsort(-(tried @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    return int(np.quantile(np.take_along_axis(place, home[near], 1), REACH, method="higher")) + 1


def write_vector_index(vectors: DataFrame, uri: str, cells: int | None = None) -> VectorIndex:
    """Write the inverted file of packed vectors. cells: by default the square root of their number, MOST_CELLS at most. Zero vectors are left out: they are near nothing."""
    given = vectors.where("norm > 0")
    n = given.count()
    few = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()
    dim = len(few[0]["vec"]) // 4 if few else 1
    sample = _units(_matrix([r["vec"] for r in few], dim))
    cells = min(cells or min(MOST_CELLS, max(1, math.isqrt(n))), max(1, len(few)))
    centres, scale = fit(sample, cells) if few else (np.zeros((1, 1)), np.ones(1))
    probes = probes_for(sample, centres) if few else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _units(_matrix(b.column("vec").to_pylist(), dim))
            home = (unit @ centres.T).argmax(1)
            code = np.clip(np.rint((unit - centres[home]) / scale), -127, 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(home.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), b.column("norm"), b.column("vec")], ["doc_id", "cell", "code", "norm", "vec"])

    coded = given.select(F.col("doc_id").cast("long").alias("doc_id"), "norm", "vec").mapInArrow(run, "doc_id long, cell int, code binary, norm double, vec binary")
    coded.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(16))).sortWithinPartitions("cell", "doc_id").write.parquet(f"{uri}/rows")
    spark = vectors.sparkSession
    spark.createDataFrame([(i, c.tobytes()) for i, c in enumerate(centres)] + [(-1, scale.tobytes()), (-2, np.array([probes], float).tobytes())], "cell int, numbers binary").coalesce(1).write.parquet(f"{uri}/cells")
    return read_vector_index(spark, uri)


def read_vector_index(spark: SparkSession, uri: str) -> VectorIndex:
    rows = sorted(spark.read.parquet(f"{uri}/cells").collect())  # MOST_CELLS rows and two
    numbers = [np.frombuffer(r["numbers"]) for r in rows]
    return VectorIndex(spark.read.parquet(f"{uri}/rows"), np.stack(numbers[2:]), numbers[1], int(numbers[0][0]))


def _best(found: DataFrame, score: str, k: int) -> DataFrame:
    """The k best of each query's rows, with their rank."""
    w = W.partitionBy("qid").orderBy(F.desc(score), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _first(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, by row and then by score; of equal ones the first columns. Entries of -inf are none."""
    if k < near.shape[1]:
        row, at = np.nonzero((near >= np.partition(near, -k, axis=1)[:, -k, None]) & (near > -np.inf))
    else:
        row, at = np.nonzero(near > -np.inf)
    by = np.lexsort((-near[row, at], row))
    row, at = row[by], at[by]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], at[keep]


def _shards(residents: DataFrame) -> tuple[DataFrame, dict[int, list[int]]]:
    """residents (cell, doc_id, data) with shard; the shards of each cell. A shard has SLICE rows or fewer about: some whole cells, or a part of one by id."""
    at, held, shards, first = 0, 0, {}, []
    for cell, n in sorted(tuple(r) for r in residents.groupBy("cell").count().collect()):  # MOST_CELLS rows at most
        parts = -(-n // SLICE)
        if held and held + n > SLICE:
            at, held = at + 1, 0
        shards[cell] = list(range(at, at + parts))
        first.append((cell, at, parts))
        at, held = (at + parts, 0) if parts > 1 else (at, held + n)
    of = residents.sparkSession.createDataFrame(first, "cell int, first long, parts long")
    placed = residents.join(F.broadcast(of), "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("doc_id"), "parts"))
    return placed.select("shard", "cell", "doc_id", "data"), shards


def _meet(residents: DataFrame, queries: DataFrame, dim: int, cells: Callable[[np.ndarray], np.ndarray], data: Callable[[np.ndarray, list], np.ndarray], k: int, places: int | None = None) -> DataFrame:
    """(qid, doc_id, score): the k best residents (cell, doc_id, data) in each shard for each of queries (qid, vec).

    cells tells the cells that a query looks into, data makes vectors of residents. A query goes once to each shard that has some of its cells, and gets k rows of each at most. Queries of a shard are dealt by their ids.
    """
    placed, shards = _shards(residents)
    # fewer queries than BLOCK in a task would not pay for reading the shard
    many = max(1, math.ceil(queries.count() / SLICE))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = max((x[-1] for x in shards.values()), default=-1) + 1
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                goes = np.zeros((part.num_rows, last), bool)
                for i, found in enumerate(cells(_matrix(part.column("vec").to_pylist(), dim)).tolist()):
                    goes[i, [x for c in found for x in shards.get(c, ())]] = True
                row, shard = np.nonzero(goes)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(shard), part.column("qid").take(at), part.column("vec").take(at)], ["shard", "qid", "vec"])

    sent = queries.select("qid", "vec").mapInArrow(send, "shard long, qid long, vec binary").withColumn("v", F.pmod(F.xxhash64("qid"), F.lit(many)))
    left = placed.withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))))

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("qid", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])
        if not len(own) or not len(asked):
            return schema.empty_table()
        ids, cell = own["doc_id"].to_numpy(), own["cell"].to_numpy()
        by = np.lexsort((ids, cell))
        ids, cell = ids[by], cell[by]
        vecs = data(cell, own["data"].take(pa.array(by)).to_pylist())
        begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        end = np.r_[begin[1:], len(cell)]
        by_id, out = np.argsort(ids, kind="stable"), []
        for a in range(0, len(asked), BLOCK):
            part = asked.slice(a, BLOCK)
            q = _matrix(part["vec"].to_pylist(), dim)
            into = cells(q)
            q, near = _units(q), np.full((len(part), len(ids)), -np.inf)
            for x, y in zip(begin.tolist(), end.tolist(), strict=True):
                looks = (into == cell[x]).any(1)
                if looks.any():
                    near[looks, x:y] = q[looks] @ vecs[x:y].T
            if places is not None:
                near = np.round(near, places, out=near)
            row, at = _first(near[:, by_id], k)
            out.append(pa.table({"qid": part["qid"].to_numpy()[row], "doc_id": ids[by_id[at]], "score": near[row, by_id[at]]}))
        return pa.concat_tables(out).cast(schema)

    return left.groupBy("shard", "v").cogroup(sent.groupBy("shard", "v")).applyInArrow(run, "qid long, doc_id long, score double")


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, dim: int | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): for each of queries (qid, vec) the k packed vectors of the largest cosine, compared with all of them.

    A zero vector or query has cosine 0. Ties at PLACES go by id. dim: numbers of a vector, by default those of any.
    """
    if dim is None:
        some = vectors.select(F.octet_length("vec")).first()
        dim = some[0] // 4 if some else 1
    rows = vectors.select(F.lit(0).alias("cell"), F.col("doc_id").cast("long").alias("doc_id"), F.col("vec").alias("data"))
    asked = queries.where(F.octet_length("vec") == 4 * dim).select(F.col("qid").cast("long").alias("qid"), "vec")
    found = _meet(rows, asked, dim, lambda q: np.zeros((len(q), 1), int), lambda _, vecs: _units(_matrix(vecs, dim)), k, PLACES)
    return _best(found, "score", k)


def topk(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, again: int = 10) -> DataFrame:
    """(qid, doc_id, score, rank): for each of queries (qid, vec) k vectors of large cosines, by the inverted file.

    probes: cells that a query looks into, by default the index's; the again * k best codes of those are compared by their whole vectors.
    Queries of another length, or of zeros, find nothing.
    """
    centres, scale = index.centres, index.scale
    cells, dim = centres.shape
    probes = min(cells, probes or index.probes)

    def nearest(q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]

    def decoded(cell: np.ndarray, codes: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(codes), np.int8).reshape(-1, dim) * scale + centres[cell]

    asked = queries.where(F.octet_length("vec") == 4 * dim).select(F.col("qid").cast("long").alias("qid"), "vec")
    some = _best(_meet(index.rows.select("cell", "doc_id", F.col("code").alias("data")), asked, dim, nearest, decoded, again * k), "score", again * k).select("qid", "doc_id")

    def cosines(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array(np.round((_units(_matrix(a.to_pylist(), dim)) * _units(_matrix(b.to_pylist(), dim))).sum(1), PLACES))

    met = some.join(index.rows.select("doc_id", F.col("vec").alias("own")), "doc_id").join(asked, "qid")
    zero = F.lit(bytes(4 * dim))
    return _best(met.where(F.col("vec") != zero).select("qid", "doc_id", F.arrow_udf(cosines, "double")("vec", "own").alias("score")), "score", k)


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(queries, wanted, found, recall): one row; how many of wanted (qid, doc_id, score) a search found, where equal scores stand for each other."""
    last = wanted.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    hits = found.join(last, "qid").where(F.col("score") >= F.col("least")).groupBy("qid").agg(F.count("*").alias("hits"))
    each = last.join(hits, "qid", "left").select("n", F.least(F.coalesce("hits", F.lit(0)), "n").alias("hits"))
    return each.agg(F.count("*").alias("queries"), F.sum("n").alias("wanted"), F.sum("hits").alias("found"), F.round(F.sum("hits") / F.sum("n"), 3).alias("recall"))
