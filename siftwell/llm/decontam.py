"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training windows.

A window's hash is a polynomial over word numbers, computed for all windows of a batch at once; every hit is
verified word by word. The texts are scanned once, however large the benchmark is: up to a stated number of windows the set itself
is broadcast, and hits are verified where they are found. Beyond it a bitmap of the windows' hashes is broadcast, which has a largest size; windows
that it lets through are written beside the numbers of their rows, and joins with the benchmark's windows verify them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.llm.common import materialise

#: Windows whose set is broadcast (10 words each: about 100 MB at most).
MOST_WINDOWS = 500_000
#: Bits of the bitmap for each window of a larger benchmark, and the most bits there are (32 MB): of 32 bits a window, 1 in 250 others passes by chance; beyond 8 million windows more do.
BITS_A_WINDOW, MOST_BITS = 32, 1 << 28
#: Bits of a piece that Spark's bitmap functions make, tasks that the candidates of one window are dealt to, words whose hashes a task holds.
PIECE_BITS, SALTS, HELD_WORDS = 32_768, 16, 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of words: digits, letters and all bytes of non-ASCII characters; A-Z become a-z, the rest spaces.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCHEMA = "doc_id long, text_hash long, n_words long, spans array<struct<start:long,end:long>>, item_ids array<string>"


def plain_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TABLE).split() if text else []


class WindowSet:
    """The windows of some items, by number of words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int):
        self.number: dict[bytes, int] = {}
        self.items: dict[tuple[bytes, ...], list[str]] = {}
        for item, ws in items:
            size = min(n, len(ws))
            for i in range(len(ws) - size + 1 if size else 0):
                own = self.items.setdefault(tuple(ws[i : i + size]), [])
                if item not in own:
                    own.append(item)
        for w in {w for ws in self.items for w in ws}:
            self.number[w] = len(self.number) + 1
        self.hashes = {k: np.unique([self._hash(ws) for ws in self.items if len(ws) == k]) for k in {len(ws) for ws in self.items}}

    def _hash(self, ws: tuple[bytes, ...]) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for w in ws:
            h = h * BASE + np.uint64(self.number[w])
        return h[0]

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """Of each text: its number of words, the runs of hit words [start, end), the items found."""
        all_words = [plain_words(t) for t in texts]
        sizes = np.array([len(ws) for ws in all_words], np.int64)
        starts = np.cumsum(sizes) - sizes
        get, total = self.number.get, int(sizes.sum())
        ids = np.fromiter((get(w, 0) for ws in all_words for w in ws), np.uint64, total)
        doc = np.repeat(np.arange(len(texts)), sizes)
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        hits: dict[int, list[tuple[int, int, list[str]]]] = {}
        for k, hashes in self.hashes.items():
            n = total - k + 1
            if n <= 0:
                continue
            known = np.flatnonzero((unknown[k:] == unknown[:-k]) & (doc[:n] == doc[k - 1 :]))
            h = np.zeros(len(known), np.uint64)
            for j in range(k):
                h = h * BASE + ids[known + j]
            for at in known[np.isin(h, hashes)].tolist():
                d = int(doc[at])
                i = at - int(starts[d])
                if own := self.items.get(tuple(all_words[d][i : i + k])):
                    hits.setdefault(d, []).append((i, i + k, own))
        for d, ws in enumerate(all_words):
            runs: list[tuple[int, int]] = []
            for a, b, _ in sorted(hits.get(d, []), key=lambda x: x[:2]):
                if runs and a <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
                else:
                    runs.append((a, b))
            yield len(ws), runs, sorted({x for *_, own in hits.get(d, []) for x in own})


class Hashes:
    """Hashes of words, and of runs of them, that are the same in every task."""

    def __init__(self):
        self.of: dict[bytes, int] = {}

    def words(self, ws: Iterator[bytes], total: int) -> np.ndarray:
        if len(self.of) > HELD_WORDS:
            self.of.clear()
        return np.fromiter(map(self._word, ws), np.uint64, total)

    def _word(self, w: bytes) -> int:
        h = self.of.get(w)
        if h is None:
            h = self.of[w] = xxhash.xxh64_intdigest(w)
        return h

    @staticmethod
    def runs(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """Of the k words from each place of at."""
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h = h * BASE + words[at + j]
        return h


def _item_words(benchmark: DataFrame) -> DataFrame:
    """(item_id, words) of items with words: their words in a row with a space between; a null id is "None"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b" ".join(plain_words(t)).decode() for t in b.column(1).to_pylist()], pa.string())], ["item_id", "words"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("None")).alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id string, words string").where("words != ''")


def _windows(items: DataFrame, n: int) -> DataFrame:
    """(item_id, size, hash, words) of the windows of items (item_id, words), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = text.encode().split()
                k = min(n, len(ws))
                own = hashes.words(iter(ws), len(ws))
                for a in range(0, len(ws) - k + 1, 10_000):
                    at = np.arange(a, min(a + 10_000, len(ws) - k + 1))
                    cols = [pa.array([item] * len(at), pa.string()), pa.array([k] * len(at), pa.int32()), pa.array(hashes.runs(own, at, k).view(np.int64)), pa.array([b" ".join(ws[i : i + k]).decode() for i in at.tolist()], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, ["item_id", "size", "hash", "words"])

    return items.mapInArrow(run, "item_id string, size int, hash long, words string").distinct()


def _places(hash_: Column, bits: int) -> list[Column]:
    """The two bits of a hash in a bitmap of bits, a power of two."""
    return [F.shiftrightunsigned(hash_, 32).bitwiseAND(F.lit(bits - 1)), hash_.bitwiseAND(F.lit(bits - 1))]


def _bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a bitmap of the windows' hashes: pieces are aggregated, and no more bytes than bits / 8 come to the driver."""
    at = windows.select(F.explode(F.array(*_places(F.col("hash"), bits))).alias("at")).select((F.col("at") + 1).alias("at"))
    made = at.groupBy(F.bitmap_bucket_number("at").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("set"))
    out = np.zeros(bits // 8, np.uint8)
    for r in made.toLocalIterator():
        a = (r["piece"] - 1) * PIECE_BITS // 8
        out[a : a + PIECE_BITS // 8] = np.frombuffer(bytes(r["set"]), np.uint8)
    return out


SIFTED = "row long, doc_id long, text_hash long, n_words long, start long, size int, hash long, words string"


def _sifted(rows: DataFrame, held: Broadcast, sizes: list[int]) -> DataFrame:
    """SIFTED of rows (row, doc_id, text_hash, text): one with n_words for each, and one without for each window that the bitmap lets through."""
    names = [f.split()[0] for f in SIFTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bitmap = Hashes(), held.value
        mask = np.uint64(len(bitmap) * 8 - 1)
        schema = pa.schema(list(zip(names, [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.string()], strict=True)))

        def is_set(at: np.ndarray) -> np.ndarray:
            return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                texts = [plain_words(t) for t in part.column("text").to_pylist()]
                lengths = np.array([len(ws) for ws in texts], np.int64)
                starts, total = np.cumsum(lengths) - lengths, int(lengths.sum())
                empty = [pa.nulls(len(texts), f.type) for f in list(schema)[4:]]
                yield pa.RecordBatch.from_arrays([*(part.column(c).cast(pa.int64()) for c in names[:3]), pa.array(lengths), *empty], schema=schema)
                own = hashes.words((w for ws in texts for w in ws), total)
                doc, row = np.repeat(np.arange(len(texts)), lengths), part.column("row").to_pylist()
                for k in sizes:
                    n = total - k + 1
                    if n <= 0:
                        continue
                    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
                    h = hashes.runs(own, at, k)
                    passed = np.flatnonzero(is_set((h >> np.uint64(32)) & mask) & is_set(h & mask))
                    for c in range(0, len(passed), 10_000):
                        some = passed[c : c + 10_000]
                        d = doc[at[some]]
                        first = (at[some] - starts[d]).tolist()
                        said = [b" ".join(texts[x][i : i + k]).decode() for x, i in zip(d.tolist(), first, strict=True)]
                        none = [pa.nulls(len(some), pa.int64())] * 3
                        yield pa.RecordBatch.from_arrays([pa.array([row[x] for x in d.tolist()], pa.int64()), *none, pa.array(first, pa.int64()), pa.array([k] * len(some), pa.int32()), pa.array(h[some].view(np.int64)), pa.array(said, pa.string())], schema=schema)

    return rows.mapInArrow(run, SIFTED)


def _joined(rows: DataFrame, items: DataFrame, n: int, kept: list[str] | None) -> DataFrame:
    """contamination() by one scan behind a bitmap, and joins."""
    windows = materialise(_windows(items, n), "windows", kept)
    count, sizes = windows.agg(F.count_distinct("hash"), F.collect_set("size")).first()  # as many sizes as n at most
    bits = min(MOST_BITS, max(PIECE_BITS, 1 << (BITS_A_WINDOW * count - 1).bit_length()))
    held = rows.sparkSession.sparkContext.broadcast(_bitmap(windows, bits))
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text_hash", "text")
    sifted = materialise(_sifted(numbered, held, sorted(sizes)), "sifted", kept)  # numbers hold within the one job that writes them
    held.destroy()
    passed = sifted.where("n_words is null")
    # a window that very many rows have is one row here before anything is shuffled, and meets its items once
    real = windows.join(passed.select("hash", "words").distinct(), ["hash", "words"]).groupBy("hash", "words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    dealt = real.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    hits = passed.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(dealt, ["hash", "words", "salt"])
    hits = hits.select("row", "start", (F.col("start") + F.col("size")).alias("end"), "items")
    before = W.partitionBy("row").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    opens = hits.select("row", "start", "end", F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1).alias("opens"))
    runs = opens.withColumn("run", F.sum("opens").over(W.partitionBy("row").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    found = hits.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    every = sifted.where("n_words is not null").select("row", "doc_id", "text_hash", "n_words").join(spans.join(found, "row"), "row", "left")
    return every.withColumns({c: F.coalesce(c, F.array().cast(k)) for c, k in (("spans", "array<struct<start:bigint,end:bigint>>"), ("item_ids", "array<string>"))})


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", most_windows: int = MOST_WINDOWS, kept: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, spans, item_ids, text_hash) for every row of docs; text_hash is xxhash64 of the text.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. A window is n consecutive
    words of an item, or the whole item if it has fewer, but not none. spans are the maximal runs of words
    inside some occurrence; item_ids, sorted as strings, those with an occurring window. Null and empty texts have
    no words and no hits; null items are skipped, repeated items count once, and items with a null id count
    as item "None". With an empty benchmark nothing is hit. Repeated rows each have their own result. Very long texts and items count whole.
    A benchmark of over most_windows windows, counted with repeats, is not collected; see the module. kept notes the folders written then, which the result is read from.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    items, length = _item_words(benchmark), F.size(F.split("words", " "))
    count = items.agg(F.sum(F.greatest(length - n + 1, F.lit(1)).cast("long"))).first()[0] or 0
    out = ("doc_id", "n_words", "spans", "item_ids", "text_hash")
    if count > most_windows:
        return _joined(rows, items, n, kept).select(*out)
    held = docs.sparkSession.sparkContext.broadcast(WindowSet([(r["item_id"], r["words"].encode().split()) for r in items.collect()], n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                found = list(held.value.scan(part.column("text").to_pylist()))
                spans = [[{"start": s, "end": e} for s, e in x[1]] for x in found]
                cols = {c: part.column(c) for c in part.schema.names if c != "text"}
                cols |= {"n_words": pa.array([x[0] for x in found], pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "item_ids": pa.array([x[2] for x in found], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict(cols)

    return rows.mapInArrow(run, SCHEMA).select(*out)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from each span's first word to its last."""
    import re

    at = [m.span() for m in re.finditer(rb"[^ ]+", text.encode("utf-8", "replace").translate(TABLE))]
    data, out, last = text.encode("utf-8", "replace"), [], 0
    for s, e in spans:
        out.append(data[last : at[s][0]])
        last = at[e - 1][1]
    return b"".join([*out, data[last:]]).decode("utf-8", "replace")


def remove_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with hit spans cut from their texts; found: contamination(docs, ...).

    Rows are matched by id and text, so rows that repeat an id each lose their own spans and none is multiplied; rows without an
    id are matched alike. Null and empty texts stay as they are; other columns are passed on, whatever their names.
    """
    columns = docs.columns
    hit = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("__siftwell_id"), F.col("text_hash").alias("__siftwell_hash"), F.col("spans").alias("__siftwell_spans"))
    hit = hit.dropDuplicates(["__siftwell_id", "__siftwell_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(text_col).to_pylist(), b.column("__siftwell_spans").to_pylist()
            new = [cut(t, [(x["start"], x["end"]) for x in s]) if s and t else t for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text_col else b.column(c) for c in columns], columns)

    same = F.col(id_col).cast("long").eqNullSafe(F.col("__siftwell_id")) & (F.xxhash64(text_col) == F.col("__siftwell_hash"))
    return docs.join(hit, same, "left").select(*docs.columns, "__siftwell_spans").mapInArrow(run, docs.schema)


def remove_documents(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", kept: list[str] | None = None) -> DataFrame:
    """docs without those that have a hit; all rows of an id go if one of them has. Rows with a null id stay.

    The ids are written first (kept notes the folder): a table whose size is known before the join is planned, so that texts are not shuffled for few of them.
    """
    hit = materialise(found.where(F.size("spans") > 0).select(F.col("doc_id").alias("__siftwell_id")).distinct(), "hit-ids", kept)
    return docs.join(hit, F.col(id_col) == F.col("__siftwell_id"), "left_anti")
