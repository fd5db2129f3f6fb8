"""Mixing to target weights with soft domain membership.

A softmax classifier, fitted on a bounded sample of a labelled table, gives every document a posterior over
domains. Rates r >= 0, the expected copies of each document, are then fitted so that the expected tokens of
each domain, the sum over documents of rate * tokens * posterior, meet the targets in least squares; of the rates
that do, those nearest to 1, by tokens. The fit steps along the residuals, scaled by an inverse Gram matrix, and
projects the rates to 0 or more. A step needs the residuals and that matrix, as large as the number of domains; a
document's rate follows from its posterior and the sum of the scaled residuals so far, so each pass over the posteriors
recomputes it, and a lost executor loses nothing.
"""

from __future__ import annotations

import operator
import re
import warnings
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialise

#: The classifier's documented bound: labelled documents that it is fitted on, at most; and its hashed features.
SAMPLE_DOCS, BUCKETS = 6000, 1 << 18
STEPS, RIDGE = 120, 3.0
#: Shares of tokens that the mix should have, by domain.
TARGETS = {"good": 0.94, "poor": 0.05, "toxic": 0.01}
#: Rounds after which fit_rates() raises. The largest residual, and its share of the target.
ROUNDS, CLOSE, NEAR = 1000, 1e-5, 1e-3
#: Weight of the rates' distance from 1 against the residuals, the slope at which steps end, and the gradient mapping at which rates are the least squares.
FIRM, STILL, LEAST = 1e-8, 1e-10, 1e-8
#: Distinct words whose features a worker keeps; when full it starts anew.
CACHE = 500_000

#: Bytes as their kinds: lower-case letters and what is not ASCII, upper-case letters, digits; marks stay.
KIND = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


class _Shapes(dict):
    """Bucket of a word's kinds with runs squeezed, by the kinds."""

    def __missing__(self, kinds: bytes) -> int:
        found = xxhash.xxh32_intdigest(re.sub(rb"(.)\1+", rb"\1", kinds)[:24], 2) % BUCKETS
        if len(kinds) <= 64:
            if len(self) > CACHE:
                self.clear()
            self[kinds] = found
        return found


class _Features(dict):
    """Buckets of the bare lower-cased word and of its shape, by the word."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        found = xxhash.xxh32_intdigest(word.lower().strip(b".,;:!?"), 1) % BUCKETS, _shapes[word.translate(KIND)]
        if len(word) <= 64:
            if len(self) > CACHE:
                self.clear()
            self[word] = found
        return found


_shapes, _features = _Shapes(), _Features()


def features(text: str | None) -> tuple[np.ndarray, int]:
    """Distinct buckets of a text's words and shapes, and of words that repeat the one before; the number of words."""
    ws = text.encode("utf-8", "replace").split() if text else []
    if not ws:
        return np.empty(0, np.int64), 0
    found = set(chain.from_iterable(map(_features.__getitem__, set(ws))))
    repeats = sum(map(operator.eq, ws, islice(ws, 1, None)))
    found.update(BUCKETS + i for i in range(5) if repeats * 10 > len(ws) * i * 2 and repeats)
    return np.fromiter(found, np.int64, len(found)), len(ws)


class Softmax:
    """Weights by feature and domain. fit() uses features that three or more of its documents have."""

    def __init__(self, domains: list[str], bias: np.ndarray, weights: np.ndarray):
        self.domains, self.bias, self.weights = domains, bias, weights

    @classmethod
    def fit(cls, rows: list[tuple[str, np.ndarray]], domains: list[str]) -> Softmax:
        sizes = np.array([len(x) for _, x in rows], np.int64)
        at = np.concatenate([np.empty(0, np.int64), *(x for _, x in rows)])
        common = np.bincount(at, minlength=BUCKETS + 8) >= 3
        use = common[at]
        doc, at = np.repeat(np.arange(len(rows)), sizes)[use], at[use]
        names, at = np.unique(at, return_inverse=True)
        y = np.array([[d == own for d in domains] for own, _ in rows], float).reshape(len(rows), len(domains))
        w, b = np.zeros((len(names), len(domains))), np.log(y.sum(0) + 1) - np.log(y.sum() + len(domains))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, STEPS + 1 if len(names) else 1):
            z = b + np.stack([np.bincount(doc, w[at, k], len(rows)) for k in range(len(domains))], 1)
            p = np.exp(z - z.max(1, keepdims=True))
            gap = p / p.sum(1, keepdims=True) - y
            g = np.stack([np.bincount(at, gap[doc, k], len(names)) for k in range(len(domains))], 1) + RIDGE * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            b -= 0.5 * gap.mean(0)
        full = np.zeros((BUCKETS + 8, len(domains)), np.float32)
        full[names] = w
        return cls(domains, b, full)

    def posteriors(self, found: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(x) for x in found])
        z = np.zeros((len(found), len(self.domains)))
        if sizes.sum():
            some = np.flatnonzero(sizes)
            z[some] = np.add.reduceat(self.weights[np.concatenate(found)], (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.float64)
        z += self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic if any label says so, else poor if any says so, else good; rows without an id are left out."""
    by_doc = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    return by_doc.select("doc_id", F.when(F.col("t") == 1, "toxic").when(F.col("q") == 0, "poor").otherwise("good").alias("domain"))


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], sample_docs: int = SAMPLE_DOCS) -> Softmax:
    """Fitted on documents with a domain in labelled (doc_id, domain): at most sample_docs, in the order of their ids' hashes.

    Of rows that repeat an id one is taken. What is collected is sample_docs lists of at most BUCKETS features, whatever the texts' lengths.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(labelled.where(F.col("domain").isin(domains)), "doc_id")
    sample = docs.sparkSession.createDataFrame([tuple(r) for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(sample_docs).collect()], "doc_id long, domain string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "domain", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.sort(features(t)[0]) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "domain", "found"])

    found = rows.mapInArrow(run, "doc_id long, domain string, found array<long>").groupBy("doc_id", "domain").agg(F.min("found").alias("found")).select("domain", "found").collect()
    return Softmax.fit(sorted(((r[0], np.array(sorted(r[1]), np.int64)) for r in found), key=lambda r: (r[0], r[1].tobytes())), domains)


def posteriors(docs: DataFrame, model: Softmax) -> DataFrame:
    """(doc_id, n_tokens, p array) for every row of docs; a token is a word. Null and empty texts have none."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x domains, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                found = [features(t) for t in part.column(1).to_pylist()]
                p = held.value.posteriors([x for x, _ in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in found], pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def rates(p: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """The rates of posteriors after a pull, the sum of the scaled residuals so far: one less its share, 0 at least."""
    return np.maximum(0, 1 - p @ pull)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def fit_rates(soft: DataFrame, targets: list[float], rounds: int = ROUNDS) -> np.ndarray:
    """The pull that rates() needs. soft: posteriors(), materialised.

    Each residual is scaled by the inverse Gram matrix of the documents whose rates are above 0, so that the speed does not
    depend on the shares of domains; a step that does not lower the objective is halved. It ends when every target
    is met to CLOSE, and to NEAR of itself. If no rates meet the targets the answer is their least squares, and a warning tells the residuals: these are
    reached where a projected gradient step of length 1 moves the rates, in the mean square by tokens, by LEAST at most. If neither is reached it raises.
    """
    k = len(targets)
    goal = np.array(targets) / sum(targets)
    bound = np.where(goal > 0, np.minimum(CLOSE, NEAR * goal), CLOSE)
    total = float(soft.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return np.zeros(k)

    def measure(pull: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """The residuals, the Gram matrix and the objective at a pull."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = np.zeros(k + k * k + 1)
            for b in batches:
                if b.num_rows:
                    p, n = _matrix(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
                    rate = rates(p, pull)
                    s += np.concatenate([(rate * n) @ p, ((p * (n * (rate > 0))[:, None]).T @ p).ravel(), [n @ rate**2]])
            yield pa.RecordBatch.from_arrays([pa.array([list(s)], pa.list_(pa.float64()))], ["s"])

        found = soft.select("n_tokens", "p").mapInArrow(run, "s array<double>").agg(*[F.sum(F.col("s")[i]) for i in range(k + k * k + 1)]).first()
        s = np.array(found, float) / total
        return s[:k] - goal, s[k:-1].reshape(k, k), float(s[-1] / 2 + pull @ goal + FIRM / 2 * pull @ pull)

    def moved(pull: np.ndarray, gap: np.ndarray) -> float:
        """How far a projected gradient step from a pull moves the rates."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = 0.0
            for b in batches:
                if b.num_rows:
                    p = _matrix(b.column(1))
                    rate = rates(p, pull)
                    s += b.column(0).to_numpy(zero_copy_only=False) @ (rate - np.maximum(0, rate - p @ gap)) ** 2
            yield pa.RecordBatch.from_arrays([pa.array([float(s)])], ["s"])

        return float(np.sqrt(soft.select("n_tokens", "p").mapInArrow(run, "s double").agg(F.sum("s")).first()[0] / total))

    pull, step, size = np.zeros(k), np.zeros(k), 1.0
    gap, gram, height = measure(pull)
    for _ in range(rounds):
        slope = gap - FIRM * pull
        if (np.abs(gap) <= bound).all():
            return pull
        # what rates above 0 move is known from the Gram matrix; only where that is little are those at 0 looked at
        if np.abs(slope).max() <= STILL or (gap @ gram @ gap <= LEAST**2 and moved(pull, gap) <= LEAST):
            warnings.warn(f"mixing: no rates meet the targets {goal.tolist()}; these are the least squares, with residuals {gap.tolist()}", stacklevel=2)
            return pull
        if size == 1:
            step = np.linalg.solve(gram + FIRM * np.eye(k), slope)
        now = measure(pull + size * step)
        if now[2] <= height - 1e-4 * size * (slope @ step) + 1e-15 * abs(height):
            pull, size, (gap, gram, height) = pull + size * step, 1.0, now
        else:
            size /= 2
    raise RuntimeError(f"mixing: residuals {gap.tolist()} after {rounds} rounds, neither met nor the least squares")


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, sample_docs: int = SAMPLE_DOCS, kept: list[str] | None = None) -> DataFrame:
    """(doc_id, n_tokens, posterior map, rate, copies) for every row of docs.

    copies rounds the rate up or down by a hash of the id, so that its expectation is the rate; a document without
    words has its rate and copies as any other. Null ids share one rounding. Repeated rows count each. With no
    labelled documents all posteriors are equal. An empty table gives no rows.
    """
    targets = TARGETS if targets is None else targets
    names = list(targets)
    model = fit_classifier(docs, domains_of(labels), names, sample_docs)
    soft = materialise(posteriors(docs, model), "posteriors", kept)
    pull = fit_rates(soft, list(targets.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rate = rates(_matrix(b.column(2)), pull)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rate)], ["doc_id", "n_tokens", "p", "rate"])

    rated = soft.mapInArrow(run, "doc_id long, n_tokens long, p array<double>, rate double")
    u = F.shiftrightunsigned(F.xxhash64(F.lit("mixing"), F.coalesce(F.col("doc_id"), F.lit(-1))), 11) / F.lit(float(1 << 53))
    copies = (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return rated.select("doc_id", "n_tokens", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), "p").alias("posterior"), "rate", copies.alias("copies"))


def take_copies(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """docs with each row repeated copies times; rows without an id stay once. Repeated ids take the largest of their copies."""
    by_id = rated.where("doc_id is not null").groupBy(F.col("doc_id").alias("__siftwell_id")).agg(F.max("copies").alias("__siftwell_n"))
    joined = docs.join(by_id, F.col("doc_id") == F.col("__siftwell_id"), "left").withColumn("__siftwell_n", F.coalesce("__siftwell_n", F.lit(1))).where("__siftwell_n > 0")
    return joined.withColumn("__siftwell_i", F.explode(F.sequence(F.lit(1), F.col("__siftwell_n").cast("int")))).select(*docs.columns)
