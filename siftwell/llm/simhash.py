"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within an even radius R differ at R bits or fewer exactly if the balls of radius R/2
around them share a variant. Every distinct fingerprint therefore emits all variants within R/2 bits, and
those that meet at a variant are linked, each to the smallest there: a star, never all pairs.

The exchange is by the variants' first k bits. A fingerprint reaches a prefix within R/2 bits of its own, and
what lies below the prefix follows from both, so the shuffle carries one row per fingerprint and prefix and
the task of a prefix makes the variants itself. k grows with the logarithm of the number of fingerprints. A prefix that more
than HOT fingerprints reach, since theirs are alike, is dealt again by its next bits, as often as it takes; inside a task the same
step repeats until a piece fits in memory.

Copies with equal fingerprints are one fingerprint throughout; components are found by alternating stars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialise, release, words

BITS, SEED = 64, 42
#: Shingles whose bits are counted at once, and variants that are sorted at once.
CHUNK, PIECE = 400_000, 2_000_000
#: Fingerprints of one prefix in one task, at most, and the bits by which a hotter one is dealt again. DEALT bits are enough: within two bits of as many there are fewer
#: than HOT fingerprints.
HOT, DEAL_BITS, DEALT = 50_000, 4, 60


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every run of size words, space-joined, repeats included; fewer words: of all of them; none: empty."""
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    data, h = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= size:
        return np.array([h(data, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(ws) - size + 1].tolist()
    return np.array([h(data[s:e], SEED) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def _bit_counts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, at, axis=0, dtype=np.int32)


def fingerprint_many(hashes: list[np.ndarray]) -> np.ndarray:
    """A fingerprint for each array of hashes: a bit is 1 if it is in over half of them; none: 0."""
    out = np.zeros(len(hashes), np.uint64)
    full = [i for i, h in enumerate(hashes) if 0 < len(h) <= CHUNK]
    while full:
        n, held = 0, []
        while full and n + len(hashes[full[-1]]) <= CHUNK:
            held.append(full.pop())
            n += len(hashes[held[-1]])
        sizes = np.array([len(hashes[i]) for i in held])
        counts = _bit_counts(np.concatenate([hashes[i] for i in held]), np.cumsum(sizes) - sizes)
        out[held] = np.packbits(counts * 2 > sizes[:, None], axis=1).view(">u8").ravel()
    for i, h in enumerate(hashes):
        if len(h) > CHUNK:
            counts = sum(_bit_counts(h[a : a + CHUNK], np.array([0]))[0].astype(np.int64) for a in range(0, len(h), CHUNK))
            out[i] = np.packbits(counts * 2 > len(h)).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row of docs; null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                fp = fingerprint_many([shingle_hashes(t, shingle) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _flips(bits: int, n: int) -> np.ndarray:
    """Masks of at most n of the low bits."""
    return np.array([sum(1 << b for b in c) for k in range(n + 1) for c in combinations(range(bits), k)], np.uint64)


def _stars(low: np.ndarray, own: np.ndarray, left: np.ndarray, bits: int, masks: dict) -> list[np.ndarray]:
    """(fingerprint, another) index pairs that link all fingerprints whose balls meet below this prefix."""
    if len(own) < 2:
        return []
    size = sum(int((left == r).sum()) * sum(math.comb(bits, k) for k in range(r + 1)) for r in range(int(left.max()) + 1))
    if size > PIECE and bits > 4:
        out, top = [], low >> np.uint64(bits - 4)
        rest = low & np.uint64((1 << (bits - 4)) - 1)
        for c in range(16):
            d = np.bitwise_count(top ^ np.uint64(c)).astype(np.int64)
            near = d <= left
            out += _stars(rest[near], own[near], (left - d)[near], bits - 4, masks)
        return out
    variants, who = [], []
    for r in range(int(left.max()) + 1):
        at = np.flatnonzero(left == r)
        if len(at):
            if (bits, r) not in masks:
                masks[bits, r] = _flips(bits, r)
            variants.append((low[at, None] ^ masks[bits, r]).ravel())
            who.append(np.repeat(own[at], len(masks[bits, r])))
    v, w = np.concatenate(variants), np.concatenate(who)
    ordered = np.sort(v)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return []
    slot = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
    met = shared[slot] == v
    slot, w = slot[met], w[met]
    first = np.full(len(shared), np.iinfo(np.int64).max)
    np.minimum.at(first, slot, w)
    pairs = np.stack([w, first[slot]], 1)
    return [np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)]


def ball_links(fps: np.ndarray, prefix: int, k: int, radius: int) -> np.ndarray:
    """(fingerprint, smallest of its component here) for those of fps whose balls meet below this prefix of k bits."""
    own = np.sort(fps.view(np.uint64))
    left = radius // 2 - np.bitwise_count((own >> np.uint64(BITS - k)) ^ np.uint64(prefix)).astype(np.int64)
    low = own & np.uint64((1 << (BITS - k)) - 1)
    found = _stars(low, np.arange(len(own)), left, BITS - k, {})
    if not found:
        return np.empty((0, 2), np.uint64)
    pairs = np.unique(np.concatenate(found), axis=0)
    pairs = pairs[np.bitwise_count(own[pairs[:, 0]] ^ own[pairs[:, 1]]) <= radius]
    root = np.arange(len(own))
    while True:
        least = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, pairs[:, 0], least)
        np.minimum.at(new, pairs[:, 1], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(own)))
    return np.stack([own[moved], own[root[moved]]], 1)


def links(distinct: DataFrame, radius: int = 4, kept: list[str] | None = None, hot_at: int = HOT) -> DataFrame:
    """(a, b) long: links that connect what fingerprints (column fp, distinct) within radius bits connect."""
    if radius % 2:
        raise ValueError("the radius must be even")
    n, half = distinct.count(), radius // 2
    ball = sum(math.comb(BITS, i) for i in range(half + 1))
    k = min(40, max(6, math.ceil(math.log2(max(n, 1) * ball / 1_000_000))))
    masks = [int(m) for m in _flips(k, half)]
    flips = F.explode(F.array(*[F.lit(m) for m in masks])).alias("m")
    spread = distinct.select("fp", flips).select(F.lit(k).alias("k"), F.shiftrightunsigned("fp", BITS - k).bitwiseXOR(F.col("m")).alias("prefix"), (half - F.bit_count("m")).alias("left"), "fp")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = ball_links(pdf["fp"].to_numpy(np.int64), int(key[1]), int(key[0]), radius).view(np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    done = None
    while True:
        hot = materialise(spread.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > hot_at).select("prefix"), "hot-prefixes", kept, few=True)
        some = k + DEAL_BITS <= DEALT and not hot.isEmpty()
        cold = spread.join(hot, "prefix", "left_anti") if some else spread
        done = cold if done is None else done.unionByName(cold)
        if not some:
            return done.groupBy("k", "prefix").applyInPandas(run, "a long, b long")
        # One more row for each way to spend what is left of the radius on the next bits.
        more = [(m, m.bit_count()) for m in map(int, _flips(DEAL_BITS, half))]
        dealt = spread.join(hot, "prefix", "left_semi").select("fp", "prefix", "left", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(n).alias("n")) for m, n in more])).alias("x")).where("x.n <= left")
        k += DEAL_BITS
        own = F.shiftrightunsigned("fp", BITS - k).bitwiseAND(F.lit((1 << DEAL_BITS) - 1)).bitwiseXOR(F.col("x.m"))
        spread = materialise(dealt.select(F.lit(k).alias("k"), (F.shiftleft("prefix", DEAL_BITS) + own).alias("prefix"), (F.col("left") - F.col("x.n")).cast("int").alias("left"), "fp"), "dealt", kept)


def components(edges: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """(node, root) long for every node of edges (a, b): root is one node of its component, the same for all.

    Alternating large-star and small-star rounds; each round's edges are written to the shared folder.
    Neighbours' minima are aggregated before they are joined, so a node with very many edges is spread by
    map-side aggregation and by skew-join splitting. Self-loops and repeats are allowed.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(df: DataFrame, large: bool, name: str, into: list[str]) -> DataFrame:
        inner: list[str] = []
        both = df.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(df.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name + "-min", inner, few=True)
        met = both.join(least, "u")
        if large:
            out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        done = materialise(out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name, into, few=True)
        release(df.sparkSession, inner)
        return done

    last: list[str] = []  # the folder of edges; a round deletes those before it
    edges = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", last, few=True)
    before = state(edges)
    while before[0]:
        large, small = [], []
        edges = star(star(edges, True, "large", large), False, "small", small)
        release(edges.sparkSession, last + large)
        last = small
        now = state(edges)
        if now == before:
            break
        before = now
    if kept is not None:
        kept += last
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", kept: list[str] | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest doc_id reachable over links.

    Null, empty and wordless texts have fingerprint 0 and are linked like any other. Equal texts and repeated
    rows share a fingerprint. A null id gets its component's id and never names one, unless the component has no
    other. An empty table gives no rows; other columns are not read; texts of any length count whole.
    """
    fps = materialise(fingerprints(docs, shingle, id_col, text_col), "fps", kept)
    classes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes", kept, few=True)
    found = components(links(classes.select("fp"), radius, kept), kept)
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    alone = rooted.where("root is null").select("fp", F.col("least").alias("component_id"))
    linked = materialise(rooted.where("root is not null"), "linked", kept, few=True)
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(alone.unionByName(linked.join(least, "root").select("fp", "component_id")), "named", kept, few=True)
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
