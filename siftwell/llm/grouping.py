"""Which members of candidate groups are similar: links that connect what all similar pairs of a group connect.

A group is dealt into blocks of bounded weight, and a block is searched breadth first: a member reached is compared with those
not reached yet, so near copies of one text take about one pass. A group of one block is then done. Of a larger one

1. a few members stand for each cluster found so far and are dealt and compared in the same way, as long as that joins clusters;
2. members outside the group's largest cluster go to all of its blocks and are compared with every member of another cluster.

Any similar pair that clusters do not hold yet has a member outside the largest one, so step 2 finds a link for it, and a group that
one cluster covers ends before it: work is that of the group plus its blocks times the members outside, never all pairs of a large
cluster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialise
from siftwell.llm.simhash import components

#: Members that stand for a cluster.
STANDING = 4
PAIRS = "a long, b long"

#: own, flat, n, room -> which of the sets that stand in flat one after the other, of n codes each, own is similar to. room has a zero
#: for each code, and again after the call.
Similar = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def jaccard(p: int, q: int) -> Similar:
    """Sets with a Jaccard similarity of p/q or more."""

    def similar(own: np.ndarray, flat: np.ndarray, n: np.ndarray, room: np.ndarray) -> np.ndarray:
        room[own] = 1
        shared = np.add.reduceat(room[flat] > 0, np.cumsum(n) - n, dtype=np.int64)
        room[own] = 0
        return shared * (p + q) >= p * (n + len(own))

    return similar


class Sets:
    """Non-empty sets of numbers with codes 0, 1, ... that ascend with the numbers."""

    def __init__(self, sets: list[np.ndarray], similar: Similar):
        self.sizes, self.similar = np.array([len(s) for s in sets], np.int64), similar
        self.codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        ends = np.cumsum(self.sizes)
        self.own = [self.codes[b - n : b] for b, n in zip(ends.tolist(), self.sizes.tolist(), strict=True)]
        self.room = np.zeros(int(self.codes.max()) + 1, np.int32)

    def links(self) -> list[tuple[int, int]]:
        """(later, earlier) index pairs that connect what similar pairs connect, breadth first."""
        left, flat, out, queue = np.arange(len(self.sizes)), self.codes, [], []
        while len(left):
            if not queue:
                queue.append(int(left[0]))
                flat, left = flat[self.sizes[left[0]] :], left[1:]
                continue
            i, n = queue.pop(), self.sizes[left]
            near = self.similar(self.own[i], flat, n, self.room)
            if near.any():
                found = left[near].tolist()
                out += [(j, i) for j in found]
                queue += found
                flat, left = flat[np.repeat(~near, n)], left[~near]
        return out

    def across(self, odd: np.ndarray, home: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
        """(i, j) for each i of odd and each other label that a similar j of home has, one j for a label."""
        if not len(home):
            return []
        flat, n, out = np.concatenate([self.own[j] for j in home]), self.sizes[home], []
        for i in odd.tolist():
            near = home[self.similar(self.own[i], flat, n, self.room) & (labels[home] != labels[i])]
            out += [(i, j) for j in near[np.unique(labels[near], return_index=True)[1]].tolist()]
        return out


def _spans(keys: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True))


def _block_links(rows: DataFrame, payload: str, decode: Callable, similar: Similar, bins: int) -> DataFrame:
    """Links inside blocks of rows (root, node, g, i, payload); groups of one block share tasks, of which there are bins."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["root", "node"])
        nodes, out = pdf["node"].to_numpy(np.int64), []
        for a, b in _spans(pdf["root"].to_numpy(np.int64)):
            if b - a > 1:
                found = np.array(Sets([decode(x) for x in pdf[payload].iloc[a:b]], similar).links(), np.int64).reshape(-1, 2)
                out.append(nodes[a:b][found])
        pairs = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    small = F.col("g") == 1
    task = [F.when(small, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root")).alias("u"), F.when(small, -1).otherwise(F.col("i")).alias("v")]
    return rows.select("root", "node", payload, *task).groupBy("u", "v").applyInPandas(run, PAIRS)


def _across_links(rows: DataFrame, payload: str, decode: Callable, similar: Similar) -> DataFrame:
    """Links between clusters of rows (root, node, g, i, label, odd, payload): odd ones are compared with all blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, at_home = pdf["node"].to_numpy(np.int64), pdf["home"].to_numpy(bool)
        sets = Sets([decode(x) for x in pdf[payload]], similar)
        found = np.array(sets.across(np.flatnonzero(pdf["odd"] == 1), np.flatnonzero(at_home), pdf["label"].to_numpy(np.int64)), np.int64).reshape(-1, 2)
        pairs = nodes[found]
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    block = F.explode(F.when(F.col("odd") == 1, F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).otherwise(F.array("i"))).alias("j")
    dealt = rows.select("root", "node", payload, "label", "odd", "i", block).withColumn("home", F.col("i") == F.col("j")).drop("i")
    return dealt.groupBy("root", "j").applyInPandas(run, PAIRS)


def _placed(members: DataFrame, limit: int, salt: int) -> DataFrame:
    """members with g, the blocks of their group, and i, the block of each."""
    sizes = members.groupBy("root").agg(F.ceil(F.sum("weight") / limit).cast("long").alias("g"))
    return members.join(sizes, "root").select("root", "node", "weight", "g", F.pmod(F.xxhash64("node", F.lit(salt)), F.col("g")).alias("i"))


def similar_links(members: DataFrame, fetch: Callable[[DataFrame], DataFrame], payload: str, decode: Callable, similar: Similar, limit: int, name: str, kept: list[str] | None) -> DataFrame:
    """(a, b) long: links between nodes that connect, in each group, what its similar pairs connect.

    members: (root, node, weight) long, written; a node may be in several groups, once in each. fetch adds the column payload to rows of
    nodes, decode makes a non-empty ascending array of it. A block has about limit in weight, a single heavier member is one.
    """
    spark = members.sparkSession
    total = members.agg(F.sum("weight")).first()[0] or 0
    bins = max(-(-total // limit), int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = materialise(_placed(members, limit, 0), f"{name}-placed", kept, few=True)
    found = materialise(_block_links(fetch(placed.drop("weight")), payload, decode, similar, bins), f"{name}-links", kept)
    large = placed.where("g > 1")
    if large.isEmpty():
        return found
    links, rounds = found, 0
    while True:
        # the clusters of each large group; a node of several groups is in the same one everywhere
        clusters = components(links, kept).withColumnRenamed("root", "cluster")
        labelled = materialise(large.join(clusters, "node", "left").withColumn("label", F.coalesce("cluster", "node")).drop("cluster"), f"{name}-clusters", kept, few=True)
        rounds += 1
        standing = [F.min_by(F.struct("node", "weight"), F.xxhash64("node", F.lit(rounds * STANDING + j))).alias(f"s{j}") for j in range(STANDING)]
        several = labelled.groupBy("root").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("root")
        each = labelled.join(several, "root", "left_semi").groupBy("root", "label").agg(*standing).select("root", F.explode(F.array_distinct(F.array(*[f"s{j}" for j in range(STANDING)]))).alias("s"))
        stand = materialise(_placed(each.select("root", "s.node", "s.weight"), limit, rounds), f"{name}-standing", kept, few=True)
        if stand.isEmpty():
            return links
        more = _block_links(fetch(stand.drop("weight")), payload, decode, similar, bins).join(clusters.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), "a", "left").join(clusters.select(F.col("node").alias("b"), F.col("cluster").alias("cb")), "b", "left")
        more = materialise(more.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), f"{name}-more", kept, few=True)
        if more.isEmpty():
            break
        links = links.unionByName(more)
    counts = labelled.groupBy("root", "label").agg(F.count("*").alias("n"))
    largest = counts.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count("*").alias("k")).where("k > 1").drop("k")
    rows = labelled.join(largest, "root").select("root", "node", "g", "i", "label", (F.col("label") != F.col("most")).cast("long").alias("odd"))
    return links.unionByName(materialise(_across_links(fetch(rows), payload, decode, similar), f"{name}-across", kept))
