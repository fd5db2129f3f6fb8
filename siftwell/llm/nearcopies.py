"""Near copies by shingle similarity: candidates from SimHash balls and min-hash bands, verified by Jaccard.

Texts with one set of shingles are one set throughout. Two sets are candidates if their SimHash fingerprints lie
within the radius or one of BANDS keys, each of ROWS min-hashes, is the same: a pair of Jaccard similarity 0.8 is
missed with a chance of (1 - 0.8**ROWS)**BANDS, about 5 in a million. Candidates are joined by star links, never all pairs,
into groups; a group's sets are then compared exactly, and only those of similarity LEAST or more are linked.
A group of more than BLOCK sets is dealt into blocks, and what stays apart there is compared across them (grouping), so no task holds
more than about two blocks and no link of the group is left out.

Texts are not shuffled to learn what becomes of them: verdicts on rows are written as a file for each stretch of
consecutive rows, and whoever reads the rows reads the files of their stretches (marked()). Only the texts of groups travel, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import commit_file, materialise, release, scratch, storage
from siftwell.llm.grouping import jaccard, similar_links
from siftwell.llm.simhash import components, fingerprint_many, links, shingle_hashes

ROWS, BANDS = 6, 40
#: The least similarity of linked sets, as a fraction.
LEAST = (4, 5)
BLOCK = 500
#: A column of docs' own rows; their columns may have any other names.
ROW = "__siftwell_row"
#: What marked() adds: the marks of a row.
MARK = "__siftwell_mark"
#: A row's number without these last bits is its stretch, whose marks are one file.
STRETCH_BITS = 16
#: Shingles that are min-hashed at once.
PIECE = 2048
FACTORS = np.random.default_rng(42).integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)


def _read_marks(uri: str, stretch: int, schema: pa.Schema) -> pa.Table:
    """The marks of a stretch, ascending by row; without a file it has none."""
    fs, path = storage(f"{uri}/{stretch % 997:03d}/{stretch}")
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return schema.empty_table()
    with fs.open_input_stream(path, compression=None) as f:
        return pa.ipc.open_stream(f).read_all()


def marked(rows: DataFrame, number: str, marks: DataFrame, name: str, kept: list[str] | None = None) -> DataFrame:
    """The rows that marks (row and other columns, all long and not null; no row twice) has, with its columns in the struct MARK.

    rows is not shuffled; number is its column of row numbers. The marks are written below the shared folder before this returns.
    """
    spark = rows.sparkSession
    uri, cols = scratch(spark, name, kept), marks.columns
    schema = pa.schema([(c, pa.int64()) for c in cols])

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pa.Table.from_pandas(pdf[cols].sort_values("row"), schema, preserve_index=False)

        def into(out) -> None:
            with pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(own)

        commit_file(f"{uri}/{key[0] % 997:03d}/{key[0]}", into)
        return pd.DataFrame({"n": [len(own)]})

    marks.groupBy(F.shiftright("row", STRETCH_BITS).alias("__siftwell_stretch")).applyInPandas(write, "n long").agg(F.sum("n")).collect()

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held: dict[int, pa.Table] = {}
        for b in batches:
            own = b.to_numpy(zero_copy_only=False)
            held = {s: held[s] if s in held else _read_marks(uri, s, schema) for s in np.unique(own >> STRETCH_BITS).tolist()}
            every = pa.concat_tables(held.values()) if held else schema.empty_table()
            known = every["row"].to_numpy()
            at = np.searchsorted(known, own)
            none = at == len(known)
            none[~none] = known[at[~none]] != own[~none]
            taken = every.take(pa.array(at, pa.int64(), mask=none))
            yield pa.StructArray.from_arrays([c.combine_chunks() for c in taken.columns], cols, mask=pa.array(none))

    # not deterministic, so that Spark does not call it once for the condition and again for the columns
    udf = F.arrow_udf(find, ", ".join(f"{c} long" for c in cols)).asNondeterministic()
    return rows.withColumn(MARK, udf(number)).where(F.col(MARK).isNotNull())


def band_keys(found: np.ndarray) -> list[int]:
    """BANDS keys of a set of shingle hashes, signed; none of an empty set, which equals other empty sets only."""
    if not len(found):
        return []
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(FACTORS), np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(short), PIECE):
        least = np.minimum(least, (short[a : a + PIECE, None] * FACTORS).min(0))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """(row, doc_id, set_id, fp, bands) for every row of rows (row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                hashes = [shingle_hashes(t, shingle) for t in part.column(2).to_pylist()]
                sets = [np.unique(h) for h in hashes]
                ids = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                cols = [part.column(0), part.column(1), pa.array(ids), pa.array(fingerprint_many(hashes).view(np.int64)), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "set_id", "fp", "bands"])

    return rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "row long, doc_id long, set_id long, fp long, bands array<long>")


def candidate_groups(heads: DataFrame, radius: int, kept: list[str] | None = None) -> DataFrame:
    """(node, root): the sets of heads (set_id, fp, bands) that have candidates, and their group."""
    keyed = heads.select("set_id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("set_id").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    by_band = keyed.join(shared, "key").select(F.col("set_id").alias("a"), "b")
    by_fp = materialise(heads.groupBy("fp").agg(F.min("set_id").alias("least")), "by-fp", kept, few=True)
    same = heads.join(by_fp, "fp").select(F.col("set_id").alias("a"), F.col("least").alias("b"))
    to = lambda c: by_fp.select(F.col("fp").alias(c), F.col("least").alias(c + "_set"))
    balls = links(by_fp.select("fp"), radius, kept).join(to("a"), "a").join(to("b"), "b").select(F.col("a_set").alias("a"), F.col("b_set").alias("b"))
    return components(by_band.unionByName(same).unionByName(balls).where("a != b"), kept)


def distinct_documents(docs: DataFrame, shingle: int = 5, radius: int = 4, kept: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """docs with one row of each component of near copies: that with the smallest id.

    Null, empty and wordless texts equal each other and nothing else. An empty table gives no rows; texts of any length count whole.
    """
    given = materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows", kept)
    spark, early = docs.sparkSession, []  # early: deleted when the heads are written
    inner: list[str] = []  # deleted once it is known which rows stay
    rows = given.select(F.col(ROW).alias("row"), "doc_id", "text")
    found = materialise(sketches(rows, shingle), "sketches", early)
    classes = materialise(found.groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")), "classes", inner, few=True)
    heads = materialise(marked(found, "row", classes.select("least.row"), "head-marks", early).drop(MARK), "heads", inner)
    release(spark, early)
    groups = materialise(candidate_groups(heads.where("size(bands) > 0"), radius, inner), "groups", inner, few=True)
    members = materialise(groups.withColumn("weight", F.lit(1).cast("long")), "members", inner, few=True)

    def texts(chosen: DataFrame) -> DataFrame:
        marks = chosen.join(heads.select(F.col("set_id").alias("node"), "row"), "node")
        return marked(rows.select("row", "text"), "row", marks, "group-marks", inner).select(*[f"{MARK}.{c}" for c in chosen.columns], "text")

    found = similar_links(members, texts, "text", lambda t: np.unique(shingle_hashes(t, shingle)), jaccard(*LEAST), block, "linked", inner)
    linked = components(found, inner)
    rooted = classes.join(linked.withColumnRenamed("node", "set_id"), "set_id", "left")
    stay = rooted.groupBy(F.coalesce("root", "set_id").alias("root")).agg(F.min("least").alias("least")).select("least.row")
    thinned = marked(given, ROW, stay, "stay", kept).select(*docs.columns)
    release(spark, inner)
    return thinned
