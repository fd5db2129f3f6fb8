"""Merkle manifests of datasets: a tree of fan-out 16 for each group of rows, and one over the groups' roots.

A group's leaves are numbered in order and dealt into aligned blocks of some whole levels. A task walks the tree of
a block recursively in postorder: a call returns its subtree's digest and, while the calls unwind, appends each child's siblings to the
leaves below it. Block roots are the nodes of the next traversal, and so on until every group has one; the groups' roots then go the same way.
Proofs come down as they went up: a traversal of a level is given what its blocks' roots have above them.

Digests are 32 bytes in columns and hashed as hexadecimal text. A proof is the siblings' digests one after the other, and its steps are two bytes a level:
the place in the run, and the run's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftwell.llm.common import materialise

FAN = 16
#: Levels that a task walks; its block has FAN to their power leaves.
LEVELS = 3
LOCAL_BITS = 33
#: What a proof tells of a node: siblings and steps up to the dataset's root, its group's root and that.
ABOVE = ("proof", "steps", "root", "top")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(digests: list[bytes]) -> bytes:
    """Of a run of nodes: SHA-256 of their hexadecimal digests, concatenated."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def height(n: int) -> int:
    """Levels over n nodes; none over one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def walk(digests: list[bytes], n: int, levels: int = LEVELS, proofs: list[list[bytes]] | None = None, steps: list[bytearray] | None = None) -> bytes:
    """The root of a block, of levels at most, of a group of n nodes. proofs and steps, one for each node of the block, are appended to, nearest level first."""

    def visit(lo: int, hi: int, level: int) -> bytes:
        if not level:
            return digests[lo]
        wide = FAN ** (level - 1)
        runs = [(a, min(a + wide, hi)) for a in range(lo, hi, wide)]
        children = [visit(a, b, level - 1) for a, b in runs]
        if proofs is not None:
            for j, (a, b) in enumerate(runs):
                siblings = b"".join(children[:j] + children[j + 1 :])
                for i in range(a, b):
                    proofs[i].append(siblings)
                    steps[i] += bytes((j, len(children)))
        return digest_of(children)

    return visit(0, len(digests), min(height(n), levels))


def folded(leaf: bytes, proof: bytes, steps: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    node, at = leaf, 0
    for j, n in zip(steps[::2], steps[1::2], strict=True):
        run = [proof[at + 32 * i : at + 32 * i + 32] for i in range(n - 1)]
        node, at = digest_of([*run[:j], node, *run[j:]]), at + 32 * (n - 1)
    return node


def field(value: Column) -> Column:
    """A column's part of a leaf: "-" for null, else the value's bytes in UTF-8, ":" and the value; numbers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in fields]), 256))


def numbered(rows: DataFrame, order: list[str], name: str, kept: list[str] | None) -> DataFrame:
    """rows (grp and others; written) with i, the number of each in its group by order, and n, the group's rows; written.

    Rows are dealt by range over group, order and their place in rows, so that neither a large group nor rows that repeat are one task's matter;
    what is counted on are the rows of a group in a partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["grp", *[F.col(c).asc_nulls_first() for c in order], "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = materialise(dealt.withColumn("at", F.monotonically_increasing_id()).drop("tie"), f"{name}-sorted", kept)
    part, local = F.shiftright("at", LOCAL_BITS), F.col("at").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    stretches = placed.groupBy("grp", part.alias("part")).agg(F.count("*").alias("c"), F.min(local).alias("first"))
    own = W.partitionBy("grp")
    starts = stretches.select("grp", "part", F.sum("c").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("before"), "first", F.sum("c").over(own).alias("n"))
    met = placed.withColumns({"part": part, "local": local}).join(starts, ["grp", "part"])
    return materialise(met.select(*rows.columns, (F.coalesce("before", F.lit(0)) + F.col("local") - F.col("first")).alias("i"), "n"), f"{name}-numbered", kept)


def _blocks(nodes: DataFrame, levels: int) -> GroupedData:
    return nodes.withColumn("block", F.shiftright("i", levels * (FAN - 1).bit_length())).groupBy("grp", "block")


def climbed(leaves: DataFrame, levels: int, name: str, kept: list[str] | None) -> list[DataFrame]:
    """Nodes (grp, i, n, digest): leaves, those some levels up, and so on to one node for each group, each written."""

    def run(key: tuple, nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("i")
        n = nodes["n"][0].as_py()
        digest = walk(nodes["digest"].to_pylist(), n, levels)
        return pa.table({"grp": [key[0].as_py()], "i": [key[1].as_py()], "n": [-(-n // FAN**levels)], "digest": pa.array([digest], pa.binary())})

    stages = [leaves.select("grp", "i", "n", "digest")]
    while True:
        stages.append(materialise(_blocks(stages[-1], levels).applyInArrow(run, "grp string, i long, n long, digest binary"), f"{name}-{len(stages)}", kept))
        if stages[-1].where("n > 1").isEmpty():
            return stages


def proved(leaves: DataFrame, stages: list[DataFrame], above: DataFrame, levels: int, name: str, kept: list[str] | None) -> DataFrame:
    """leaves with what ABOVE tells of each: above has it for each group's root; stages are of climbed(leaves)."""

    def run(nodes: pa.Table, up: pa.Table) -> pa.Table:
        nodes, up = nodes.drop_columns(["block"]).sort_by("i"), up.to_pylist()
        if not len(nodes):
            return pa.Table.from_batches([], pa.schema([*nodes.schema, *[(c, pa.binary()) for c in ABOVE]]))
        proofs, steps = [[] for _ in range(len(nodes))], [bytearray() for _ in range(len(nodes))]
        walk(nodes["digest"].to_pylist(), nodes["n"][0].as_py(), levels, proofs, steps)
        own = {"proof": [b"".join(p) + up[0]["proof"] for p in proofs], "steps": [bytes(s) + up[0]["steps"] for s in steps]}
        for c in ABOVE:
            nodes = nodes.append_column(c, pa.array(own.get(c) or [up[0][c]] * len(nodes), pa.binary()))
        return nodes

    down = above.withColumn("i", F.lit(0).cast("long"))
    for k in range(len(stages) - 2, -1, -1):
        own = leaves if k == 0 else stages[k]
        out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields] + [f"{c} binary" for c in ABOVE])
        met = _blocks(own, levels).cogroup(down.select("grp", F.col("i").alias("block"), *ABOVE).groupBy("grp", "block")).applyInArrow(run, out)
        down = met if k == 0 else materialise(met, f"{name}-down-{k}", kept)
    return down


def manifest(leaves: DataFrame, order: list[str], kept: list[str] | None = None, levels: int = LEVELS) -> DataFrame:
    """leaves (grp string not null, digest binary, and columns of their own; written) with i, n, proof, steps, root (the group's) and top (the dataset's).

    Leaves stand in each group by order, null first, and where that ties by digest: equal rows are leaves of their own with one digest. Groups stand by name, bytewise.
    A group of one leaf has that as its root, and so has a dataset of one group. An empty table gives no rows.
    """
    own = numbered(leaves, [*order, "digest"], "leaves", kept)
    stages = climbed(own, levels, "tree", kept)
    roots = numbered(stages[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"], "roots", kept)
    over = climbed(roots, levels, "over", kept)
    none = F.lit(b"").cast("binary")
    summit = over[-1].select("grp", none.alias("proof"), none.alias("steps"), F.col("digest").alias("root"), F.col("digest").alias("top"))
    groups = materialise(proved(roots, over, summit, levels, "over", kept).select(F.col("name").alias("grp"), "proof", "steps", F.col("digest").alias("root"), "top"), "proofs", kept)
    return proved(own, stages, groups, levels, "tree", kept)


def dataset_proofs(docs: DataFrame, kept: list[str] | None = None, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "source", id_col: str = "doc_id", text_col: str = "text", tampered_of: int = 5, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, steps, tampered, folded_root, verified) for every row of docs; digests are 32 bytes.

    A leaf is the digest of the fields; sources are groups, a null one comes first. tampered is the leaf after the text's A-Z were lower-cased, for
    ids whose crc32 of their decimal digits tampered_of divides, else null; folded_root is what it, or else the leaf, gives with the leaf's siblings.
    Null ids come first in their source and are not tampered with. Null and empty texts differ. Repeated rows are leaves of their own. Texts of any
    length count whole; other columns are not read; an empty table gives no rows.
    """
    low = F.translate(F.col(text_col), *LETTERS)
    changed = F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % tampered_of == 0, leaf_of([low if c == text_col else F.col(c) for c in fields]))
    # the null group is "", which no other can be
    group = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col)))
    leaves = materialise(docs.select(group.alias("grp"), F.col(id_col).cast("long").alias("doc_id"), leaf_of([F.col(c) for c in fields]).alias("digest"), changed.alias("tampered")), "digests", kept)
    found = manifest(leaves, ["doc_id"], kept, levels).select("doc_id", F.col("digest").alias("leaf"), F.col("root").alias("subroot"), F.col("top").alias("root"), "proof", "steps", "tampered")

    def fold(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for leaf, proof, steps in batches:
            yield pa.array([folded(*x) for x in zip(leaf.to_pylist(), proof.to_pylist(), steps.to_pylist(), strict=True)], pa.binary())

    checked = found.withColumn("folded_root", F.arrow_udf(fold, "binary")(F.coalesce("tampered", "leaf"), "proof", "steps"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
