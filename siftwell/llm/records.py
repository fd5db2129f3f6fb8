"""Token-ID output: length-delimited binary records with masked checksums, and a separate offset index.

A data set is a folder of shards in ascending id order. A shard NNNNN.rec is a run of records framed as

    u64 length | u32 masked CRC-32C of the length | payload | u32 masked CRC-32C of the payload

(little endian; the framing of TensorFlow's record files). The payload is i64 doc_id, u8 flags (1: the id is
null), u8 bytes per token id (2 or 4), then the ids. NNNNN.idx has 32 bytes a record: i64 doc_id, u64 offset
of the frame, u64 first token and u64 tokens, so that a shuffled reader fetches any record by itself.
manifest.json has one line per shard with its records, tokens and the tokens of all shards before it.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import commit_file, parts, storage

#: Bytes of distinct pieces of text, with their ids, that a worker keeps; when full it starts anew. Longer pieces than LONG are not kept.
CACHE_BYTES, LONG = 160_000_000, 200
#: About what a piece costs besides its characters and ids.
ENTRY_BYTES = 120
#: Bytes of input that a shard is made from, about.
SHARD_BYTES = 256 << 20
BLOCK = 512


def _crc_tables() -> tuple[np.ndarray, list[list[int]]]:
    """Of CRC-32C: what a byte adds at each distance from a block's end, and the shift of a register by one block."""
    one = np.zeros(256, np.uint32)
    for b in range(256):
        c = b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        one[b] = c
    at = np.zeros((BLOCK, 256), np.uint32)
    at[BLOCK - 1] = one
    for i in range(BLOCK - 2, -1, -1):
        at[i] = one[at[i + 1] & np.uint32(255)] ^ (at[i + 1] >> np.uint32(8))
    # A register followed by a block of zero bytes is that register as the first four bytes of the block.
    return at, [at[i].tolist() for i in range(4)]


_AT, _SHIFT = _crc_tables()
_PLACES = np.arange(BLOCK)


def crc32c(data: bytes) -> int:
    n = len(data)
    blocks = max(1, -(-n // BLOCK))
    padded = np.zeros(blocks * BLOCK, np.uint8)
    if n < 4:
        c = 0xFFFFFFFF
        for x in data:
            c = int(_AT[BLOCK - 1][(c ^ x) & 255]) ^ (c >> 8)
        return c ^ 0xFFFFFFFF
    padded[-n:] = np.frombuffer(data, np.uint8)
    padded[blocks * BLOCK - n : blocks * BLOCK - n + 4] ^= np.uint8(255)
    sums = np.bitwise_xor.reduce(_AT[_PLACES, padded.reshape(blocks, BLOCK)], axis=1).tolist()
    c = sums[0]
    s0, s1, s2, s3 = _SHIFT
    for x in sums[1:]:
        c = s0[c & 255] ^ s1[c >> 8 & 255] ^ s2[c >> 16 & 255] ^ s3[c >> 24] ^ x
    return c ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join([head, struct.pack("<I", masked(crc32c(head))), payload, struct.pack("<I", masked(crc32c(payload)))])


def read_frame(stream) -> bytes | None:
    """The next payload of a stream; None at its end; ValueError if a length or checksum is wrong."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(crc32c(head[:8])):
        raise ValueError("a record's length is damaged")
    n = struct.unpack("<Q", head[:8])[0]
    body = stream.read(n + 4)
    if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked(crc32c(body[:n])):
        raise ValueError("a record's payload is damaged")
    return body[:n]


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<qBB", doc_id or 0, doc_id is None, width) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = struct.unpack("<qBB", payload[:10])
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=10)


_TAILS = frozenset(".,;:!?")


class PieceEncoder:
    """Token ids of whole texts by a byte-level BPE tokenizer that joins a space with what follows it.

    Its pre-tokenizer never joins a non-space character with white space after it, nor a line's end with a word,
    so a text may be cut there and the pieces encoded apart. Texts that spell an added token, which may span pieces, are encoded whole. Pieces repeat, so each distinct one goes to the tokenizer once. Pieces of one
    leading space go there many at a time: the ids that begin with a space tell them apart again.
    """

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.kind, self.cache, self.held = f"<u{width}", {}, 0

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Stretches that are encoded apart: lines, their ends, and in lines each word with the space before it."""
        if "\0" in text or " ".join(text.split()) != text.rstrip("\n").replace("\n", " ") or text.endswith("\n\n"):
            return re.split(r"(?<=\S)(?= )", text)  # other white space, or two side by side: only cut before a space after a word
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little endian."""
        special = {i for a in self.added for i, t in enumerate(texts) if a in t} if self.cuts else set(range(len(texts)))
        if special:
            plain, rest = iter(self._plain([texts[i] for i in sorted(special)])), iter(self.encode([t for i, t in enumerate(texts) if i not in special]) if len(special) < len(texts) else [])
            return [next(plain) if i in special else next(rest) for i in range(len(texts))]
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        cut = [self.pieces(t) for t in texts]
        # A letter and a mark after it are never joined: words with a mark at the end are made from those without.
        new = set(chain.from_iterable(cut)).difference(self.cache)
        marked = [x for x in new if len(x) > 2 and x[-1] in _TAILS and x[-2].isalpha()]
        new.difference_update(marked)
        new.update({x[:-1] for x in marked}.difference(self.cache), {x[-1] for x in marked}.difference(self.cache))
        joined, apart = [], []
        for x in new:
            plain = x[:1] == " " and len(x) > 1 and not x[1].isspace() and " " not in x[1:]
            (joined if plain else apart).append(x)
        self.cache.update(zip(apart, self._plain(apart), strict=True))
        groups = [joined[i : i + 64] for i in range(0, len(joined), 64)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids)
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(group):
                raise ValueError("the tokenizer joined pieces")
            data, size = ids.astype(self.kind).tobytes(), int(self.kind[2:])
            ends = [*at[1:].tolist(), len(ids)]
            self.cache.update((p, data[a * size : b * size]) for p, a, b in zip(group, at.tolist(), ends, strict=True))
        get = self.cache.__getitem__
        self.cache.update((x, get(x[:-1]) + get(x[-1])) for x in marked)
        out = [b"".join(map(get, c)) for c in cut]
        for x in chain(apart, joined, marked):
            if len(x) > LONG:
                del self.cache[x]
            else:
                self.held += len(x) + len(get(x)) + ENTRY_BYTES
        return out


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, width: int) -> PieceEncoder:
    """One per worker process."""
    if (path, width) not in _encoders:
        _encoders[path, width] = PieceEncoder(path, width)
    return _encoders[path, width]


def write_records(docs: DataFrame, uri: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> list[dict]:
    """Write docs' token ids below uri in ascending id order; returns the manifest: a dict for each shard.

    Every text, whole, is followed by end_id; null and empty texts have that id alone. Null ids come first,
    equal ids stand by a hash of their texts and then as they came, so rows of one id are dealt to several shards; repeated rows are written as often as they occur. An empty table gives an
    empty manifest. Other columns are not read. One task writes one shard and moves it into place whole, so
    repeated attempts do no harm.
    """
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    end = np.array([end_id], f"<u{width}").tobytes()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), "hash", "tie"]
    ranged = rows.withColumns({"hash": F.xxhash64("text"), "tie": F.monotonically_increasing_id()}).repartitionByRange(shards or parts(rows, SHARD_BYTES), *order)
    rows = ranged.sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, index, shard = encoder(tokenizer_path, width), [], TaskContext.get().partitionId()
        state = {"at": 0, "tokens": 0}

        def write(out) -> None:
            for b in batches:
                for a in range(0, b.num_rows, 1000):
                    part = b.slice(a, 1000)
                    for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                        data = frame(pack(doc_id, ids + end, width))
                        n = len(ids) // width + 1
                        index.append((doc_id or 0, state["at"], state["tokens"], n))
                        out.write(data)
                        state["at"] += len(data)
                        state["tokens"] += n

        commit_file(f"{uri}/{shard:05d}.rec", write)
        commit_file(f"{uri}/{shard:05d}.idx", lambda out: out.write(np.array(index, "<i8").tobytes()))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "records": [len(index)], "tokens": [state["tokens"]], "bytes": [state["at"]]}, schema=pa.schema([(c, pa.int64()) for c in ("shard", "records", "tokens", "bytes")]))

    done = rows.mapInArrow(run, "shard long, records long, tokens long, bytes long").collect()
    manifest, start = [], 0
    for r in sorted(done, key=lambda r: r["shard"]):
        if r["records"]:
            manifest.append(r.asDict() | {"start": start})
            start += r["tokens"]
    text = "".join(json.dumps(m) + "\n" for m in manifest)
    hadoop = docs.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{uri}/manifest.json")
    out = path.getFileSystem(docs.sparkSession.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(text.encode()))
    out.close()
    return manifest


def read_records(spark: SparkSession, uri: str, manifest: list[dict] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids binary of u32) of every record below uri; frames are checked."""
    if manifest is None:
        manifest = [json.loads(r[0]) for r in spark.read.text(f"{uri}/manifest.json").collect()]
    shards = spark.createDataFrame([(m["shard"], m["start"], m["records"]) for m in manifest], "shard long, start long, records long").repartition(max(1, len(manifest)), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.to_pylist():
                fs, path = storage(f"{uri}/{m['shard']:05d}.rec")
                start, count, rows, size = m["start"], 0, [], 0
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    while (payload := read_frame(stream)) is not None:
                        doc_id, ids = unpack(payload)
                        data = ids.astype("<u4").tobytes()
                        rows.append((doc_id, start, len(ids), zlib.crc32(data), data))
                        start, count, size = start + len(ids), count + 1, size + len(data)
                        if size > 1 << 22:
                            yield _batch(rows)
                            rows, size = [], 0
                if count != m["records"]:
                    raise ValueError(f"{path}: {count} records; the manifest has {m['records']}")
                if rows:
                    yield _batch(rows)

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def read_one(uri: str, shard: int, record: int) -> tuple[int | None, np.ndarray]:
    """The id and token ids of one record, by the offset index."""
    fs, path = storage(f"{uri}/{shard:05d}")
    with fs.open_input_file(path + ".idx") as f:
        f.seek(32 * record)
        _, at, _, _ = struct.unpack("<4q", f.read(32))
    with fs.open_input_file(path + ".rec") as f:
        f.seek(at)
        return unpack(read_frame(f))
