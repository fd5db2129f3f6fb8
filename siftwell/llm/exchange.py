"""Sharded count joins: many batches of sorted 64-bit keys meet in a tree of hash ranges, and each gets values back.

A batch splits its keys by their first bits into FAN cells. A node of the tree gathers the cells of one range
from about FAN batches, adds up equal keys, splits the union by the next bits and sends it on to the next level, until
one group is left. A batch makes FAN cells however many batches there are, a node reads about as many keys as
one batch has, and the number of levels grows with the logarithm of the batches: rows grow with the input, never with its
square, and no node grows at all. The unions shrink on the way, as copies and frequent keys are added up early.

Values travel back the same way: a node keeps the rank of every child's key in its union, so what comes down is a
list of values in the union's order. Every level is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import commit_file, materialise, scratch, storage

FAN_BITS = 7
FAN = 1 << FAN_BITS

#: Cells on their way up: node (grp, prefix) gathers them; child is the batch or the group that sent one.
CELL = "grp long, prefix long, child long, n long, keys binary, counts binary"
#: What a node writes. kind 0: a cell for the next level; 1: ranks of a child's keys, in keys; 2: the union at the root; 3: values for a child.
MADE = "kind int, grp long, prefix long, child long, n long, keys binary, counts binary"
#: Values on their way down, in pieces by range: of the node (grp, prefix), or of batch grp where prefix is 0 at the end.
VALUES = "grp long, prefix long, piece long, vals binary"


def pack(a: np.ndarray, kind: str) -> bytes:
    """Byte planes, compressed: planes of zeros cost nothing."""
    a = np.ascontiguousarray(a, kind)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes()) if len(a) else b""


def unpack(data: bytes, kind: str) -> np.ndarray:
    if not data:
        return np.empty(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, as their differences."""
    return pack(np.diff(keys, prepend=keys.dtype.type(0)), "<u8")


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def levels_of(batches: int) -> list[tuple[int, int, int]]:
    """Of each level from 1 on: its groups, the bits by which keys are split for it, and all bits up to it."""
    groups, bits = -(-batches // FAN), FAN_BITS
    out = [(max(1, groups), bits, bits)]
    while groups > 1:
        own = (min(groups, FAN) - 1).bit_length()
        groups, bits = -(-groups // FAN), bits + own
        out.append((groups, own, bits))
    return out


def group_of(child: int, level: int, groups: int) -> int:
    """The group at a level that a child's keys go to; groups hold about FAN children."""
    return (((child + level) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32) % groups


def split(keys: np.ndarray, counts: np.ndarray, level: int, prefix: int, child: int, batches: int) -> list[tuple]:
    """Cells of a sorted list for the nodes of a level, by the level's bits."""
    groups, own, bits = levels_of(batches)[level - 1]
    digit = (keys >> np.uint64(64 - bits)) & np.uint64((1 << own) - 1)
    at = np.searchsorted(digit, np.arange((1 << own) + 1, dtype=np.uint64))
    group = group_of(child, level, groups)
    return [(group, prefix << own | d, child, int(at[d + 1] - at[d]), pack_keys(keys[at[d] : at[d + 1]]), pack(counts[at[d] : at[d + 1]], "<u8")) for d in np.flatnonzero(np.diff(at)).tolist()]


def merge(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The union of the rows' keys, the sums of their counts, and of each row the ranks of its keys."""
    lists = [unpack_keys(x) for x in pdf["keys"]]
    union, slot = np.unique(np.concatenate(lists), return_inverse=True)
    sums = np.bincount(slot, np.concatenate([unpack(x, "<u8") for x in pdf["counts"]]).astype(np.float64), len(union))
    ends = np.cumsum([len(x) for x in lists])
    return union, np.rint(sums).astype(np.uint64), np.split(slot, ends[:-1])


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """An Arrow batch of rows of a schema of int, long and binary columns."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    cols = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _node(level: int, batches: int, last: Callable[[tuple, pd.DataFrame], list[tuple]] | None) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """What a node of a level does: last at the root, otherwise it splits its union for the next level."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if last:
            return _frame(last(key, pdf), MADE)
        union, sums, ranks = merge(pdf)
        rows = [(0, *x) for x in split(union, sums, level + 1, int(key[1]), int(key[0]), batches)]
        rows += [(1, key[0], key[1], c, len(r), pack(r, "<u4"), b"") for c, r in zip(pdf["child"], ranks, strict=True)]
        return _frame(rows, MADE)

    return run


def _down(bits: int, kind: str) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What a node that was split by so many bits does with its values: its children's go to them."""

    def run(ranks: pd.DataFrame, vals: pd.DataFrame) -> pd.DataFrame:
        own = np.concatenate([unpack(v, kind) for v in vals.sort_values("piece")["vals"]])
        rows = [(c, int(p) >> bits, int(p) & (1 << bits) - 1, pack(own[unpack(r, "<u4")], kind)) for p, c, r in zip(ranks["prefix"], ranks["child"], ranks["keys"], strict=True)]
        return _frame(rows, VALUES)

    return run


class Tree:
    """A tree over some cells (CELL, of level 1). totals() or roots() climbs it, answers() comes back down."""

    def __init__(self, cells: DataFrame, batches: int, name: str, kept: list[str] | None):
        self.batches, self.name, self.kept = batches, name, kept
        self.plan = levels_of(batches)
        self.levels = len(self.plan)
        self.ranks: dict[int, DataFrame] = {}
        self.cells = cells

    def _climb(self, last: Callable[[tuple, pd.DataFrame], list[tuple]]) -> DataFrame:
        """Written rows (MADE) of the last level."""
        cells = self.cells
        for level in range(1, self.levels + 1):
            run = _node(level, self.batches, last if level == self.levels else None)
            cells = cells.repartition(shards(cells, self.batches), "grp", "prefix")
            made = materialise(cells.groupBy("grp", "prefix").applyInPandas(run, MADE), f"{self.name}-{level}", self.kept)
            self.ranks[level] = made.where("kind = 1").select("grp", "prefix", "child", "keys")
            cells = made.where("kind = 0").drop("kind")
        return made

    def totals(self, measure: Callable[[np.ndarray, np.ndarray], tuple[int, int]]) -> tuple[DataFrame, int, int]:
        """Values (VALUES) of the last level's children: the sums of their keys' counts ('<u8'); and the sums of the two measures of every root's keys and counts."""

        own = self.plan[-1][1]

        def last(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
            union, sums, ranks = merge(pdf)
            rows = [(3, c, int(key[1]) >> own, int(key[1]) & (1 << own) - 1, 0, pack(sums[r], "<u8"), b"") for c, r in zip(pdf["child"], ranks, strict=True)]
            one, two = measure(union, sums)
            return [*rows, (2, one, two, 0, 0, b"", b"")]

        made = self._climb(last)
        found = made.where("kind = 2").agg(F.sum("grp"), F.sum("prefix")).first()
        return made.where("kind = 3").select("grp", "prefix", F.col("child").alias("piece"), F.col("keys").alias("vals")), found[0] or 0, found[1] or 0

    def roots(self) -> DataFrame:
        """(prefix, keys, counts): the unions at the root by hash range, packed."""

        def last(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
            union, sums, ranks = merge(pdf)
            rows = [(1, key[0], key[1], c, len(r), pack(r, "<u4"), b"") for c, r in zip(pdf["child"], ranks, strict=True)]
            return [*rows, (2, 0, key[1], 0, len(union), pack_keys(union), pack(sums, "<u8"))]

        return self._climb(last).where("kind = 2").select("prefix", "keys", "counts")

    @staticmethod
    def union(row: dict) -> tuple[np.ndarray, np.ndarray]:
        """The keys and counts of a row of roots()."""
        return unpack_keys(row["keys"]), unpack(row["counts"], "<u8")

    def answers(self, values: DataFrame, kind: str, level: int, kept: list[str] | None) -> str:
        """Write the values of every batch's keys, in ascending order of the keys, below the returned URI (see answer()).

        values (VALUES) belong to the nodes of a level, or to the batches if it is 0; kind is their type. kept notes the
        answers alone; what the tree itself wrote can then be deleted.
        """
        while level:
            run = _down(self.plan[level - 1][1], kind)
            values = self.ranks[level].groupBy("grp", "prefix").cogroup(values.groupBy("grp", "prefix")).applyInPandas(run, VALUES)
            values = materialise(values, f"{self.name}-down-{level}", self.kept)
            level -= 1
        return deliver(values, kind, self.batches, f"{self.name}-answers", kept)


def shards(df: DataFrame, batches: int) -> int:
    """Partitions for what batches send: a task gets about as much as eight batches sent."""
    return max(batches // 8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def deliver(values: DataFrame, kind: str, batches: int, name: str, kept: list[str] | None = None) -> str:
    """Write a file for each batch grp of values (VALUES), its pieces in order, below the returned URI: see answer()."""
    uri = scratch(values.sparkSession, name, kept)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.concatenate([unpack(v, kind) for v in pdf.sort_values("piece")["vals"]])
        batch = int(pdf["grp"].iloc[0])
        commit_file(f"{uri}/{batch % 997:03d}/{batch}", lambda out: out.write(pack(own, kind)))
        return pd.DataFrame({"batch": [batch], "n": [len(own)]})

    values = values.repartition(shards(values, batches), "grp")
    values.groupBy("grp").applyInPandas(write, "batch long, n long").agg(F.sum("n")).collect()
    return uri


def answer(uri: str, batch: int, kind: str) -> np.ndarray:
    """The values that deliver() wrote for a batch; on executors. A batch without keys has none."""
    fs, path = storage(f"{uri}/{batch % 997:03d}/{batch}")
    with fs.open_input_stream(path, compression=None) as f:
        return unpack(f.read(), kind)


def map_rows(df: DataFrame, fn: Callable[[dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn over each row of df as a dict; for rows that are batches themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from fn(b.slice(i, 1).to_pylist()[0])

    return df.mapInArrow(run, schema)
