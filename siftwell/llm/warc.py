"""WARC archives in Zstandard with a dictionary: one frame per record, the dictionary in a leading skippable frame.

Layout (the .warc.zst convention): a skippable frame of magic 0x184D2A5D holds the dictionary, bare or itself
a Zstandard frame; every record after it is one frame that is compressed with that dictionary. The reader
decodes frame by frame, checks that a record's headers are whole, that its block has the stated length, that
nothing follows it in its frame, and that digests agree.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import as_uri, commit_file, storage

SKIP_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: The dictionary is learnt from an archive's first payloads: at most so many, of so many bytes each. It only compresses.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 4096, 32_768
#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"

ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
LONG = "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, headers map<string,string>, payload binary"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        """Headers, lower-cased, and body of an HTTP block."""
        head, sep, body = self.block.partition(b"\r\n\r\n")
        if not sep:
            raise ValueError("an HTTP block has no end of headers")
        return {k.lower(): v for k, v in (_pair(x) for x in head.decode("latin-1").split("\r\n")[1:])}, body


def _pair(line: str) -> tuple[str, str]:
    name, sep, value = line.partition(":")
    if not sep or not name.strip():
        raise ValueError(f"not a header: {line[:60]!r}")
    return name.strip(), value.strip()


def digest_header(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, row: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:row:{row}>"


def serialise(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": str(len(block))}).items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, row: str) -> bytes:
    """A response record with the payload, or a revisit record that names the response with an equal one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Type": "response", "WARC-Record-ID": record_id(page_id, row), "WARC-Date": DATE, "WARC-Target-URI": re.sub(r"[\s\x00-\x1f]", "%20", url or "urn:unknown"), "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": digest_header(payload)}
    if refers_to is not None:
        headers |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, "")}
        payload = b""
    block = http + payload
    return serialise(headers | {"WARC-Block-Digest": digest_header(block)}, block)


def parse_record(data: bytes) -> Record:
    """One record, checked: version, headers, length, end, digest of the block."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    for k, v in map(_pair, lines[1:]):
        headers.setdefault(k.lower(), v)
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in headers:
            raise ValueError(f"a record has no {k}")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"a record's block has not the stated {n} bytes")
    block = rest[:n]
    if headers.get("warc-block-digest", digest_header(block)) != digest_header(block):
        raise ValueError("a block's digest does not agree")
    return Record(headers, block)


def learn_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary; a bare one of the samples' text where there is too little to train on."""
    samples = [s[:SAMPLE_BYTES] for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"<!DOCTYPE html><html>"


def write_archive(out, records: Iterator[bytes]) -> None:
    """Write records (serialised) to a stream; the first SAMPLE_RECORDS are held to learn the dictionary."""
    held = []
    for r in records:
        held.append(r)
        if len(held) >= SAMPLE_RECORDS:
            break
    dictionary = learn_dictionary(held)
    stored = zstandard.ZstdCompressor(level=3).compress(dictionary)
    out.write(struct.pack("<II", SKIP_MAGIC, len(stored)) + stored)
    comp = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
    for r in held:
        out.write(comp.compress(r))
    for r in records:
        out.write(comp.compress(r))


def read_archive(stream) -> Iterator[Record]:
    """Records of a stream, one frame at a time; ValueError where the archive breaks the layout."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIP_MAGIC:
        raise ValueError("no dictionary frame leads the archive")
    n = struct.unpack("<I", head[4:])[0]
    stored = stream.read(n)
    if len(stored) != n:
        raise ValueError("the dictionary frame is cut off")
    if stored[:4] == struct.pack("<I", FRAME_MAGIC):
        stored = zstandard.ZstdDecompressor().decompress(stored)
    decomp = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stored))
    rest = b""
    while True:
        rest = rest or stream.read(1 << 20)
        if not rest:
            return
        frame, got = decomp.decompressobj(), []
        try:
            while True:
                got.append(frame.decompress(rest))
                if frame.eof:
                    break
                rest = stream.read(1 << 20)
                if not rest:
                    raise ValueError("the last frame is cut off")
        except zstandard.ZstdError as e:
            raise ValueError(f"a frame is damaged: {e}") from e
        rest = frame.unused_data
        yield parse_record(b"".join(got))


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def write_pages(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES) -> list[dict]:
    """Write a record for every row of pages to archives below uri; returns one dict per archive.

    The payload is the html in UTF-8, empty if null. Of rows with equal payloads of least bytes or more, that
    with the largest id (several, if repeated) is a response and the others revisit it. Rows without an id
    are responses. An empty table gives no archives; other columns are not read. Equal payloads are found by SHA-1 and length:
    groups come from map-side aggregation, and only groups of two or more join back.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least, F.concat(F.sha1("html"), F.lit("-"), F.octet_length("html").cast("string"))))
    groups = rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("same"), "refers_to")
    # A payload without a digest gets a key of its own: as nulls, all of them would meet in one task.
    rows = rows.withColumn("key", F.coalesce("digest", F.concat(F.lit("row-"), F.xxhash64("page_id", "url").cast("string"))))
    rows = rows.join(groups, F.col("key") == F.col("same"), "left").select("page_id", "url", "html", F.when(F.col("page_id") != F.col("refers_to"), F.col("refers_to")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, count = TaskContext.get().partitionId(), 0

        def records() -> Iterator[bytes]:
            nonlocal count
            for b in batches:
                for a in range(0, b.num_rows, 500):
                    for r in b.slice(a, 500).to_pylist():
                        count += 1
                        yield page_record(r["page_id"], r["url"], r["html"].encode("utf-8", "replace"), r["refers_to"], f"{shard}-{count}")

        source = records()
        first = next(source, None)
        if first is None:
            return

        def chained() -> Iterator[bytes]:
            yield first
            yield from source

        commit_file(f"{uri}/{shard:05d}.warc.zst", lambda out: write_archive(out, chained()))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "records": pa.array([count], pa.int64())})

    return [r.asDict() for r in rows.mapInArrow(run, "shard long, records long").collect()]


def payload_of(rec: Record) -> tuple[int, str, bytes | None]:
    """Bytes and hexadecimal SHA-1 of the full payload, and the payload where the record has it.

    The payload of a response or revisit of HTTP is the body; it is checked against the headers, and for a revisit, which has none, they
    are taken from the headers where those tell them. Other records (warcinfo, request, metadata, resource, dns responses) have their block as payload.
    """
    h, kind = rec.headers, rec.headers["warc-type"]
    if kind not in ("response", "revisit") or not h.get("content-type", "application/http").lower().startswith("application/http"):
        return len(rec.block), hashlib.sha1(rec.block).hexdigest(), rec.block
    http, body = rec.http if rec.block else ({}, b"")
    told = h.get("warc-payload-digest")
    if kind == "response":
        if "content-length" in http and "transfer-encoding" not in http and int(http["content-length"]) != len(body):
            raise ValueError("a payload has not the length of its headers")
        if told and told.lower().startswith("sha1:") and told.upper() != digest_header(body).upper():
            raise ValueError("a payload's digest does not agree")
        return len(body), hashlib.sha1(body).hexdigest(), body
    digest = base64.b32decode(told[5:].upper()).hex() if told and told.lower().startswith("sha1:") else ""
    return int(http.get("content-length", 0)), digest, None


def read_pages(spark: SparkSession, uri: str, archives: list[dict] | None = None, payloads: bool = False) -> DataFrame:
    """Records of the archives (*.warc.zst) in a folder as rows: ROW's columns, or LONG's with headers and payload.

    archives: what write_pages() returned, whose counts are then checked; without it the folder is listed, so archives of others are
    read too. page_id is null for records that write_pages() did not name. See payload_of() for sizes and digests. A folder without archives gives no rows.
    """
    schema = LONG if payloads else ROW
    if archives is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(uri).select(F.col("path"), F.lit(-1).cast("long").alias("records"))
        files = files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")
    else:
        files = spark.createDataFrame([(f"{uri}/{a['shard']:05d}.warc.zst", a["records"]) for a in archives], "path string, records long").repartition(max(1, len(archives)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in b.to_pylist():
                fs, path = storage(as_uri(a["path"]))
                rows, count, size = [], 0, 0
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for rec in read_archive(stream):
                        h = rec.headers
                        try:
                            n, digest, payload = payload_of(rec)
                        except ValueError as e:
                            raise ValueError(f"{path}, {h['warc-record-id']}: {e}") from e
                        row = {"page_id": _number(h["warc-record-id"]), "payload_bytes": n, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": _number(h.get("warc-refers-to"))}
                        if payloads:
                            row |= {"uri": h.get("warc-target-uri"), "headers": list(h.items()), "payload": payload}
                        rows.append(row)
                        count, size = count + 1, size + len(payload or b"")
                        if len(rows) >= 2000 or payloads and size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, _arrow(payloads))
                            rows, size = [], 0
                if a["records"] not in (-1, count):
                    raise ValueError(f"{path}: {count} records; {a['records']} were written")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _arrow(payloads))

    return files.mapInArrow(run, schema)


def _arrow(payloads: bool) -> pa.Schema:
    kinds = {"page_id": pa.int64(), "uri": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
    order = [f.split()[0] for f in (LONG.replace("map<string,string>", "map") if payloads else ROW).split(", ")]
    return pa.schema([(c, kinds[c]) for c in order])
