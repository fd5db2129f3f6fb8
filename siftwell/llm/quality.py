"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text, and perplexity thresholds.

The model is over the bytes of texts, order 5 (five bytes are exactly one 40-bit key), and of all trusted documents with
an even id hash. Everything is a join of counts sharded by n-gram hash; no part of the model is collected or broadcast:
1. Texts become batches of a few megabytes, written once to the shared folder.
2. The distinct n-grams of each batch, with their counts in trusted text, meet those of all others (exchange.py).
3. Each n-gram that occurs anywhere gets its smoothed probability by aggregations and joins, order by order: continuation
   counts from the n-grams one longer, discounts from the counts of counts, the mass left over from the sums by context.
4. The probabilities come back to the batches that asked for them, which add them up by document.

A document is rejected if its perplexity is over a high quantile, by language, of trusted documents that were not trained on,
or under a low quantile of those that were: endless repetition is too easy. A language's quantiles are drawn towards those of all
languages by SHRINK documents, at every size. Every perplexity counts some bytes of average trusted text along with the
document's own, so that short texts, whose raw perplexities spread widely, are judged by the same thresholds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftwell.llm.common import materialise, release
from siftwell.llm.exchange import CELL, VALUES, Tree, answer, batch_of, deliver, map_rows, pack, shards, split

ORDER = 5
#: The quantiles of trusted perplexity that bound it: of documents not trained on, and of those trained on.
HIGH, LOW = 0.999, 0.001
#: Bytes of average trusted text that count along with every document.
PRIOR_BYTES = 400
#: Documents by which a language's quantiles are drawn towards those of all; steps of log perplexity that quantiles are told in.
SHRINK, GRID = 100, 10_000
#: Bytes of a batch, about; a longer text is cut into stretches, which know the bytes before them.
BATCH_BYTES = 8_000_000
#: Bytes of a batch whose n-grams are made distinct at a time: all of them at once would be many times the batch.
PIECE = 1 << 18
PAD = b"\n" * (ORDER - 1)
#: A bijection of 64-bit numbers that spreads n-grams over hash ranges.
MIX = np.uint64(0x9E3779B97F4A7C15)
UNMIX = np.uint64(pow(int(MIX), -1, 1 << 64))
#: Log probabilities travel as whole steps of 1 / STEPS, which the sums of documents do not feel.
STEPS = 1 << 20
#: Roles of rows: the model is trained on them, thresholds are taken from them, neither.
TRAINED, APART, OTHER = 1, 2, 0

ENCODED = "batch long, rows array<long>, doc_ids array<long>, langs array<string>, sizes array<long>, data binary"
SCORED = "row long, doc_id long, lang string, n_bytes long, log_prob double, role long"


def ngram_keys(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Packed n-grams that end at each byte from the order-th on."""
    keys = np.zeros(len(data) - order + 1, np.uint64)
    for i in range(order):
        keys <<= np.uint64(8)
        keys |= data[i : len(data) - order + 1 + i]
    return keys


def encode(docs: DataFrame) -> DataFrame:
    """Batches of docs as ENCODED. data: of each stretch the ORDER - 1 bytes before it and its own, compressed; rows: one number for all stretches of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, count, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple] = []

        def row() -> pa.RecordBatch:
            rows, ids, langs, sizes, data = map(list, zip(*held, strict=True))
            cols = [[part << 32 | made], [rows], [ids], [langs], [sizes], [zstandard.ZstdCompressor(level=3).compress(b"".join(data))]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in ENCODED.split(", ")])

        for b in batches:
            for doc_id, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = PAD + (text.as_py() or "").encode("utf-8", "replace")
                for a in range(0, max(1, len(text) - len(PAD)), BATCH_BYTES):
                    part_of = text[a : a + BATCH_BYTES + len(PAD)]
                    held.append((part << 40 | count, doc_id, lang, len(part_of) - len(PAD), part_of))
                    size += len(part_of)
                    if size >= BATCH_BYTES:
                        yield row()
                        made, size, held = made + 1, 0, []
                count += 1
        if held:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), "text")
    return rows.mapInArrow(run, ENCODED)


class Batch:
    """A row of ENCODED: the n-gram at each byte, as a slot of the distinct ones, which ascend by hash."""

    def __init__(self, row: dict):
        self.sizes = np.array(row["sizes"], np.int64)
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8)
        self.slot, self.keys = np.empty(0, np.int32), np.empty(0, np.uint64)
        if self.sizes.sum():
            ends = np.cumsum(self.sizes + len(PAD))
            across = np.zeros(len(data) - ORDER + 2, np.int8)  # n-grams that cross into the next stretch are left out
            np.add.at(across, ends[:-1] - len(PAD), 1)
            np.add.at(across, ends[:-1], -1)
            inside = np.cumsum(across[:-1], dtype=np.int8) == 0
            slot, found = np.empty(int(self.sizes.sum()), np.int32), []
            for a in range(0, len(inside), PIECE):
                code, own = pd.factorize(ngram_keys(data[a : a + PIECE + ORDER - 1])[inside[a : a + PIECE]] * MIX)
                n = found[-1][1] if found else 0
                slot[n : n + len(code)] = code
                found.append((own, n + len(code)))
            self.keys, self.slot, n = np.unique(np.concatenate([own for own, _ in found])), slot, 0
            for own, end in found:
                slot[n:end] = np.searchsorted(self.keys, own)[slot[n:end]]
                n = end

    def counts(self, role: np.ndarray) -> np.ndarray:
        """Of the keys, in what the model is trained on."""
        own, out = np.repeat(role == TRAINED, self.sizes), np.zeros(len(self.keys), np.int64)
        for a in range(0, len(own), PIECE):
            out += np.bincount(self.slot[a : a + PIECE][own[a : a + PIECE]], minlength=len(out))
        return out

    def log_probs(self, values: np.ndarray) -> np.ndarray:
        """Of each stretch, given the log probabilities of the keys."""
        out = np.zeros(len(self.sizes))
        some = np.flatnonzero(self.sizes)
        starts = np.cumsum(self.sizes)[some] - self.sizes[some]
        i = 0
        while i < len(some):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + PIECE)))
            own = values[self.slot[starts[i] : starts[j] if j < len(some) else None]]
            out[some[i:j]] = np.add.reduceat(own, starts[i:j] - starts[i])
            i = j
        return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that some label calls good, and none bad or toxic."""
    ok = labels.select(F.col("doc_id").cast("long").alias("doc_id"), ((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("ok"))
    return ok.where("doc_id is not null").groupBy("doc_id").agg(F.min("ok").alias("ok")).where("ok").select("doc_id")


def roles(encoded: DataFrame, trusted: DataFrame, batches: int, kept: list[str] | None) -> str:
    """Delivers the roles of each batch's stretches. Trusted documents with an even id hash are trained on; the others never are, so thresholds have documents of their own at every size."""
    known = trusted.select(F.col("doc_id").alias("id"), F.when(F.xxhash64("doc_id") % 2 == 0, TRAINED).otherwise(APART).alias("role"))
    each = encoded.select("batch", F.posexplode("doc_ids").alias("i", "id"))
    with_id = each.where("id is not null").join(known, "id", "left").select("batch", "i", F.coalesce("role", F.lit(OTHER)).alias("role"))
    joined = with_id.unionByName(each.where("id is null").select("batch", "i", F.lit(OTHER).alias("role")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"grp": [int(pdf["batch"].iloc[0])], "prefix": [0], "piece": [0], "vals": [pack(pdf.sort_values("i")["role"].to_numpy(), "<u1")]})

    joined = joined.repartition(shards(joined, batches), "batch")
    return deliver(joined.groupBy("batch").applyInPandas(run, VALUES), "<u1", batches, "roles", kept)


def smoothed(grams: DataFrame, kept: list[str] | None = None, order: int = ORDER) -> DataFrame:
    """grams (k, c, ...) with log_prob: of every n-gram k, also of those that training text has not (c = 0).

    Interpolated modified Kneser-Ney: of each order, (c - D(c) + left * p(shorter)) / whole, with the sum of counts after a context,
    whole, and of their discounts, left; the shorter one's p alone after contexts that training text has not.
    Counts of shorter n-grams are the distinct bytes before them.
    """
    tables = {order: grams}
    for n in range(order - 1, 0, -1):
        shorter = F.col("k").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("k")
        tables[n] = materialise(tables[n + 1].groupBy(shorter).agg(F.sum((F.col("c") > 0).cast("long")).alias("c")), f"grams-{n}", kept, few=True)
    times = None
    for n, t in tables.items():
        own = t.agg(*[F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]).withColumn("n", F.lit(n))
        times = own if times is None else times.unionByName(own)
    discounts = {}
    for r in times.collect():
        t = [max(1.0, float(r[f"n{i}"] or 0)) for i in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1])
        discounts[r["n"]] = np.clip([1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2]], 0.05, [0.95, 1.9, 2.8]).tolist()
    lower = None
    for n in range(1, order + 1):
        one, two, more = (F.lit(x) for x in discounts[n])
        c = F.col("c")
        taken = F.when(c == 0, 0.0).when(c == 1, one).when(c == 2, two).otherwise(more)
        after = tables[n].groupBy(F.shiftright("k", 8).alias("ctx")).agg(F.sum("c").alias("whole"), F.sum(taken).alias("left"))
        joined = tables[n].withColumn("ctx", F.shiftright("k", 8)).join(after, "ctx")
        if n > 1:
            joined = joined.withColumn("short", F.col("k").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))).join(lower, "short")
        else:
            joined = joined.withColumn("below", F.lit(1 / 256))
        p = F.when(F.col("whole") > 0, (c - taken + F.col("left") * F.col("below")) / F.col("whole")).otherwise(F.col("below"))
        if n == order:
            return joined.select(*grams.columns, F.log(p).alias("log_prob"))
        lower = materialise(joined.select(F.col("k").alias("short"), p.alias("below")), f"below-{n}", kept, few=True)


def scores(docs: DataFrame, trusted: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """SCORED for every row of docs, written: bytes, log probability under the model of trusted (doc_id), and role."""
    inner: list[str] = []  # written for the model alone, or for the scores alone
    late: list[str] = []
    encoded = materialise(encode(docs), "texts", late)
    batches = encoded.select("batch").count()
    own = roles(encoded, trusted, batches, late)

    def cells(row: dict) -> Iterator[pa.RecordBatch]:
        b = Batch(row)
        yield batch_of(split(b.keys, b.counts(answer(own, row["batch"], "<u1")), 1, 0, row["batch"], batches), CELL)

    tree = Tree(map_rows(encoded, cells, CELL), batches, "grams", inner)

    def unpacked(row: dict) -> Iterator[pa.RecordBatch]:
        keys, counts = Tree.union(row)
        yield pa.RecordBatch.from_pydict({"prefix": np.full(len(keys), row["prefix"]), "k": (keys * UNMIX).view(np.int64), "c": counts.view(np.int64)})

    grams = materialise(map_rows(tree.roots(), unpacked, "prefix long, k long, c long"), "grams-5", inner)

    def values(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf["k"].to_numpy().view(np.uint64) * MIX)
        return pd.DataFrame({"grp": [0], "prefix": [int(pdf["prefix"].iloc[0])], "piece": [0], "vals": [pack(np.rint(-STEPS * pdf["log_prob"].to_numpy()[order]), "<u4")]})

    asked = smoothed(grams, inner)
    asked = asked.repartition(shards(asked, batches), "prefix").groupBy("prefix").applyInPandas(values, VALUES)
    found = tree.answers(asked, "<u4", tree.levels, late)
    release(docs.sparkSession, inner)

    def score(row: dict) -> Iterator[pa.RecordBatch]:
        b = Batch(row)
        log_probs = b.log_probs(answer(found, row["batch"], "<u4") / -STEPS if len(b.keys) else np.empty(0))
        role = answer(own, row["batch"], "<u1").astype(np.int64)
        yield pa.RecordBatch.from_pydict({"row": pa.array(row["rows"], pa.int64()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "lang": pa.array(row["langs"], pa.string()), "n_bytes": b.sizes, "log_prob": log_probs, "role": role})

    each = map_rows(encoded, score, SCORED)
    # The stretches of one row are few and have one id, language and role.
    whole = each.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("lang").alias("lang"), F.sum("n_bytes").alias("n_bytes"), F.sum("log_prob").alias("log_prob"), F.first("role").alias("role"))
    done = materialise(whole, "perplexities", kept, few=True)
    release(docs.sparkSession, late)
    return done


def quantile(bins: DataFrame, by: list[str], q: float) -> DataFrame:
    """(by..., n, value): the least bin whose share of rows up to it is q or more. bins (by..., bin, n): a bounded number for each value of by."""
    run = W.partitionBy(*by, F.lit(0)).orderBy("bin")
    up_to = bins.withColumn("below", F.sum("n").over(run)).withColumn("all", F.sum("n").over(W.partitionBy(*by, F.lit(0))))
    return up_to.where(F.col("below") >= q * F.col("all")).groupBy(*by).agg(F.max("all").alias("n"), F.min("bin").alias("value"))


def thresholds(scored: DataFrame, role: int, q: float, edge: Callable[[Column], Column], shrink: float, name: str, kept: list[str] | None) -> tuple[DataFrame, Column]:
    """(of, name) log perplexities by language, written, and that of all languages; scored has lang, role and x, the log perplexity. edge: floor or ceil."""
    bins = scored.where(F.col("x").isNotNull() & (F.col("role") == role)).groupBy("lang", edge(F.col("x") * GRID).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = materialise(bins, f"bins-{name}", kept, few=True)
    every = quantile(bins.groupBy("bin").agg(F.sum("n").alias("n")), [], q).first()
    every = F.lit(every["value"] if every else None).cast("double")
    drawn = (F.col("n") * F.col("value") + shrink * every) / (F.col("n") + shrink) / GRID
    return materialise(quantile(bins, ["lang"], q).select(F.col("lang").alias("of"), drawn.alias("own")), f"thresholds-{name}", kept, few=True), every / GRID


def classify(docs: DataFrame, labels: DataFrame, high: float = HIGH, low: float = LOW, shrink: float = SHRINK, kept: list[str] | None = None) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, drawn_perplexity, low, high, kept) for every row of docs.

    perplexity is the text's own; drawn_perplexity that of the text with PRIOR_BYTES of average trusted text. kept is false if the drawn one is over
    high or under low, the language's thresholds. Null and empty texts have neither and are rejected.
    Without trusted documents nothing else is; a threshold that no document was set aside for is null and rejects nothing. A language without
    trusted documents has the thresholds of all. A null language is one of its own, as an empty one. Repeated rows, also of one id, are judged each;
    rows without an id are judged and never trained on. An empty table gives no rows; other columns are not read; texts of any length count whole.
    """
    scored = scores(docs, trusted_ids(labels), kept)
    sums = scored.where(F.col("role") == APART).agg(F.sum("log_prob"), F.sum("n_bytes")).first()
    prior = PRIOR_BYTES if sums[1] else 0
    x = -(F.col("log_prob") + prior * (sums[0] / sums[1] if prior else 0.0)) / (F.col("n_bytes") + prior)
    scored = scored.withColumn("x", F.when(F.col("n_bytes") > 0, x))
    judged = scored
    for name, role, q, edge in (("high", APART, high, F.ceil), ("low", TRAINED, low, F.floor)):
        own, every = thresholds(scored, role, q, edge, shrink, name, kept)
        judged = judged.join(own, F.col("lang") == F.col("of"), "left").withColumn(name, F.coalesce("own", every)).drop("of", "own")
    bad = (F.col("x") > F.col("high")) | (F.col("x") < F.col("low"))
    judged = judged.withColumn("kept", (F.col("n_bytes") > 0) & ~F.coalesce(bad, F.lit(False)))
    plain = F.when(F.col("n_bytes") > 0, -F.col("log_prob") / F.col("n_bytes"))
    return judged.select("doc_id", "lang", "n_bytes", F.exp(plain).alias("perplexity"), F.exp("x").alias("drawn_perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"), "kept")


def keep_good(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """docs without those that judged (classify(docs, ...)) rejects; rows with a null id stay."""
    bad = judged.where("not kept").select(F.col("doc_id").alias("__siftwell_id")).distinct()
    return docs.join(bad, F.col("doc_id") == F.col("__siftwell_id"), "left_anti")
