"""Language-model scoring by a weighted backoff automaton over word trigrams.

The model, with counts c of training texts and every text followed by one end:
    q(w)        = (c(w) + 1/2) / (N + (V + 1) / 2)          N tokens, V distinct ones; one more event for all others
    p(w | v)    = (c(v w) + MU * q(w)) / (c(v) + MU)
    p(w | u v)  = (c(u v w) + MU3 * p(w | v)) / (c(u v) + MU3)   for bigrams u v seen LEAST_SEEN times or more
Each sums to one over w. As an automaton: the empty state, a state for each training word and for a text's
beginning, and one for each such bigram. A state has an arc for each event seen after it, with its log10 probability, to
the longest state that ends there, and a failure arc to the next shorter state with the log10 of the mass left over. A traversal
goes left to right and carries the state: at a token it takes failure arcs until the state has an arc, adding weights.

Counting and scoring are joins whose size follows the corpus (exchange.py): nothing of the model is broadcast or collected.
1. Texts become batches of word numbers with the words' 64-bit hashes, written once to the shared folder.
2. The hashes of each batch's distinct words and bigrams meet those of all others and come back with their totals.
3. The same for trigrams that follow a bigram seen LEAST_SEEN times.
4. Each batch builds the part of the automaton that its texts can reach, and runs it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialise, release, words
from siftwell.llm.exchange import CELL, Tree, answer, batch_of, map_rows, pack, split, unpack

MU, MU3 = 400.0, 20.0
#: How often a bigram is seen in training texts to be a state.
LEAST_SEEN = 2
#: Tokens of a batch, at least; a text is never cut.
BATCH_TOKENS = 1_500_000
#: Tokens that a traversal makes in a row; longer texts are stretches that are traversed at once.
STRETCH = 256
#: Hashes of the end of a text and of its beginning. Hashes of words are odd, of bigrams and trigrams even.
END, BEGIN = np.uint64(1), np.uint64(3)

ENCODED = "batch long, doc_ids array<long>, held array<boolean>, sizes array<long>, tokens binary, vocab binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def is_held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text leaves 1 modulo 5; rows without an id are training rows."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Batches of docs as ENCODED: word numbers (0: end of text), and the hash of each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, sizes, held = [], [], []

        def row() -> pa.RecordBatch:
            found = pa.array(held, pa.binary()).dictionary_encode()
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, found.dictionary.to_pylist()), np.uint64, len(found.dictionary))
            vocab = np.maximum(hashes, np.uint64(5)) | np.uint64(1)
            vocab[0] = END  # every text is led by "\n" here, which is no word, and followed by it in the tokens
            tokens = np.append(found.indices.to_numpy()[1:], np.int32(0))
            cols = [[part << 32 | made], [ids], [[is_held_out(i) for i in ids]], [sizes], [pack(tokens, "<u4")], [vocab.tobytes()]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in ENCODED.split(", ")])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ws = words(text.as_py())
                ids.append(doc_id)
                sizes.append(len(ws) + 1)
                held.append(b"\n")
                held += ws
                if len(held) >= BATCH_TOKENS:
                    yield row()
                    made, ids, sizes, held = made + 1, [], [], []
        if ids:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ENCODED)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Even hashes of pairs of hashes."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) & ~np.uint64(1)


class Batch:
    """A row of ENCODED: tokens, the word before each (n: a text's beginning), and the bigram that ends at each."""

    def __init__(self, row: dict):
        self.doc_ids, self.held, self.sizes = row["doc_ids"], np.array(row["held"], bool), np.array(row["sizes"], np.int64)
        self.tokens = unpack(row["tokens"], "<u4").astype(np.int64)
        self.vocab = np.append(np.frombuffer(row["vocab"], np.uint64), BEGIN)
        self.n = len(self.vocab) - 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(~self.held, self.sizes)
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.starts] = self.n
        self.bigram, self.pairs = pd.factorize(self.before * (self.n + 1) + self.tokens)
        self.head, self.tail = self.pairs // (self.n + 1), self.pairs % (self.n + 1)
        self.pair_keys = _mix(self.vocab[self.head], self.vocab[self.tail])

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending hashes of words and bigrams, and their training counts."""
        keys = np.concatenate([self.vocab[:-1], self.pair_keys])
        counts = np.concatenate([np.bincount(self.tokens[self.train], minlength=self.n), np.bincount(self.bigram[self.train], minlength=len(self.pairs))])
        order = np.argsort(keys)
        return keys[order], counts[order]

    def learn_first(self, totals: np.ndarray) -> None:
        """Takes the totals of first(), in its order."""
        back = np.empty(len(totals), np.int64)
        back[np.argsort(np.concatenate([self.vocab[:-1], self.pair_keys]))] = totals
        self.count, self.pair_count = back[: self.n], back[self.n :]
        # Trigrams: tokens whose two words before are a bigram seen often enough; slots are those of the bigram before.
        context = np.empty_like(self.bigram)
        context[1:] = self.bigram[:-1]
        context[self.starts] = -1
        self.is_state = (self.pair_count >= LEAST_SEEN) & (self.tail != 0)
        self.deep = np.flatnonzero((context >= 0) & self.is_state[context])
        self.trigram, triples = pd.factorize(context[self.deep] * (self.n + 1) + self.tokens[self.deep])
        self.triple_head, self.triple_tail = triples // (self.n + 1), triples % (self.n + 1)
        self.triple_pair = np.empty(len(triples), np.int64)  # the bigram of a trigram's last two words
        self.triple_pair[self.trigram] = self.bigram[self.deep]
        self.triple_keys = _mix(self.pair_keys[self.triple_head] | np.uint64(1), self.vocab[self.triple_tail])

    def second(self) -> tuple[np.ndarray, np.ndarray]:
        """first() of trigrams."""
        counts = np.bincount(self.trigram[self.train[self.deep]], minlength=len(self.triple_keys))
        order = np.argsort(self.triple_keys)
        return self.triple_keys[order], counts[order]

    def learn_second(self, totals: np.ndarray) -> None:
        self.triple_count = np.empty(len(totals), np.int64)
        self.triple_count[np.argsort(self.triple_keys)] = totals

    def automaton(self, total: int, distinct: int, mu: float, mu3: float) -> BackoffAutomaton:
        """What texts of this batch can reach of the automaton. States: 0 is empty, 1 + a word's number (n: the beginning), n + 2 + a bigram's slot."""
        q = (self.count + 0.5) / (total + 0.5 * (distinct + 1))
        seen = np.append(self.count, self.count[0])  # every text has one beginning and one end
        word_state = np.where(seen > 0, np.arange(self.n + 1) + 1, 0)
        pair_state = np.where(self.is_state, np.arange(len(self.pairs)) + self.n + 2, word_state[self.tail])
        two = (self.pair_count + mu * q[self.tail]) / (seen[self.head] + mu)
        whole = self.pair_count[self.triple_head]
        three = (self.triple_count + mu3 * two[self.triple_pair]) / (whole + mu3)
        weight = np.log10(np.concatenate([q, np.maximum(two, 1e-300), np.maximum(three, 1e-300)]))
        to = np.concatenate([word_state[: self.n], pair_state, pair_state[self.triple_pair]])
        arcs = np.full((3, len(self.tokens)), -1)
        arcs[0] = self.tokens
        arcs[1] = np.where(self.pair_count > 0, np.arange(len(self.pairs)) + self.n, -1)[self.bigram]
        arcs[2, self.deep] = np.where(self.triple_count > 0, np.arange(len(whole)) + self.n + len(self.pairs), -1)[self.trigram]
        depth = np.repeat([0, 1, 2], [1, self.n + 1, len(self.pairs)])
        fail_to = np.concatenate([np.zeros(self.n + 2, np.int64), word_state[self.tail]])
        fail = np.concatenate([[0.0], np.log10(mu / (seen + mu)), np.log10(mu3 / (self.pair_count + mu3))])
        return BackoffAutomaton(arcs, weight, to, depth, fail_to, fail, self.n + 1)


class BackoffAutomaton:
    """Arcs with a weight and the state that each leads to, and a failure arc for each state but 0, the empty one.

    The words of a state of depth d are the d before the token that is read, so the arcs out of it are held by depth and
    token: arcs[d, i] is the arc for token i out of a state of depth d, or -1. The empty state has one for every token.
    """

    def __init__(self, arcs: np.ndarray, weight: np.ndarray, to: np.ndarray, depth: np.ndarray, fail_to: np.ndarray, fail: np.ndarray, start: int):
        self.arcs, self.weight, self.to, self.depth, self.fail_to, self.fail, self.start = arcs, weight, to, depth, fail_to, fail, start

    def traverse(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The log10 probability of each text, a run of tokens.

        Texts step along together, each carrying its state. A long text is stretches of STRETCH tokens: each begins two tokens
        early, without weight, after which the state is the same as that of a traversal from the text's beginning.
        """
        n = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(sizes)), n)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRETCH
        early = np.where(begin > 0, 2, 0)
        size = np.minimum(sizes[text] - begin, STRETCH) + early
        order = np.argsort(-size, kind="stable")
        left, begin, early = np.sort(size), (starts[text] + begin - early)[order], early[order]
        state, score = np.where(early > 0, 0, self.start), np.zeros(len(text))
        for t in range(int(size.max(initial=0))):
            at = np.arange(len(text) - int(np.searchsorted(left, t, "right")))  # stretches that have a token here
            while len(at):
                own = state[at]
                arc = self.arcs[self.depth[own], begin[at] + t]
                hit = arc >= 0
                go, stay, arc = at[hit], at[~hit], arc[hit]
                score[go] += self.weight[arc]
                state[go] = self.to[arc]
                own = own[~hit]
                score[stay] += self.fail[own]
                state[stay] = self.fail_to[own]
                at = stay
            if t < 2:
                score[early > 0] = 0
        return np.bincount(text[order], score, len(sizes))


def _cells(encoded: DataFrame, batches: int, firsts: str | None) -> DataFrame:
    """Cells (CELL) of every batch's words and bigrams, or of its trigrams, given the answers on those."""

    def cells(row: dict) -> Iterator[pa.RecordBatch]:
        batch = Batch(row)
        if firsts is not None:
            batch.learn_first(answer(firsts, row["batch"], "<u8"))
        keys, counts = batch.first() if firsts is None else batch.second()
        yield batch_of(split(keys, counts, 1, 0, row["batch"], batches), CELL)

    return map_rows(encoded, cells, CELL)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu: float = MU, mu3: float = MU3, kept: list[str] | None = None) -> DataFrame:
    """SCORES for every row of docs: log10 probabilities of whole texts under q (base_score) and the automaton (score).

    Training rows are all those that are not held out. Null and empty texts are an end alone. Repeated rows
    train and are scored each. Where no row trains, q is 1 for each token and both scores are 0. An empty
    table gives no rows; other columns are not read. A text's tokens are never cut: one of many million is a batch of its own.
    """
    encoded = materialise(encode(docs, id_col, text_col), "encoded", kept)
    batches = encoded.select("batch").count()

    def measure(keys: np.ndarray, sums: np.ndarray) -> tuple[int, int]:
        word = (keys & np.uint64(1)).astype(bool)
        return int(sums[word].sum()), int((sums[word] > 0).sum())

    inner: list[str] = []
    tree = Tree(_cells(encoded, batches, None), batches, "lm-bigrams", inner)
    values, total, distinct = tree.totals(measure)
    firsts = tree.answers(values, "<u8", tree.levels - 1, kept)
    release(docs.sparkSession, inner)
    tree = Tree(_cells(encoded, batches, firsts), batches, "lm-trigrams", inner)
    seconds = tree.answers(tree.totals(measure)[0], "<u8", tree.levels - 1, kept)
    release(docs.sparkSession, inner)

    def score(row: dict) -> Iterator[pa.RecordBatch]:
        b = Batch(row)
        b.learn_first(answer(firsts, row["batch"], "<u8"))
        b.learn_second(answer(seconds, row["batch"], "<u8") if len(b.triple_keys) else np.empty(0, np.int64))
        q = np.log10((b.count + 0.5) / (total + 0.5 * (distinct + 1)))
        add = np.add.reduceat
        cols = {
            "doc_id": pa.array(b.doc_ids, pa.int64()),
            "held_out": pa.array(b.held),
            "n_tokens": pa.array(b.sizes),
            "n_known": pa.array(add((b.count > 0)[b.tokens].astype(np.int64), b.starts)),
            "train_tokens": pa.array([total] * len(b.sizes), pa.int64()),
            "base_score": pa.array(add(q[b.tokens], b.starts)),
            "score": pa.array(b.automaton(total, distinct, mu, mu3).traverse(b.starts, b.sizes)),
        }
        yield pa.RecordBatch.from_pydict(cols)

    return map_rows(encoded, score, SCORES)
