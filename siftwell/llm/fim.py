"""Fill-in-middle transformation, with cuts found over a sparse checkpoint index.

A unit is a word with the white space before it, or white space at the end. Counting a text's units passes it once and
notes the byte and code-point offsets after every STEP units; a cut after u units is then found by a binary search of the checkpoints
and a scan of fewer than STEP units from the one before it. Units are matched on UTF-8 bytes: white space is ASCII, so no
match splits a character.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units between checkpoints.
STEP = 256
#: What stands before prefix, suffix and middle.
MARKS = (b"<P>", b"<S>", b"<M>")
UNIT = rb"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
#: Rows whose outputs are one Arrow batch, and bytes of them at most (a longer text is one batch).
ROWS, BYTES = 256, 1 << 23
OUTPUT = "doc_id long, n_units long, form string, prefix_chars long, middle_chars long, output string"

_some = {}


def _units(n: int) -> re.Pattern:
    """n units, no fewer."""
    if n not in _some:
        _some[n] = re.compile(UNIT + b"{%d}+" % n)
    return _some[n]


def code_points(data: bytes) -> int:
    """Of UTF-8: all bytes but those that continue a character."""
    return len(data) if data.isascii() else len(data.translate(None, bytes(range(0x80, 0xC0))))


class Checkpoints:
    """Unit, byte and code-point offsets of data after every step units from the start, and its number of units."""

    def __init__(self, data: bytes, step: int = STEP):
        self.data, self.units, self.bytes, self.points = data, [0], [0], [0]
        stride, at = _units(step), 0
        while found := stride.match(data, at):
            self.points.append(self.points[-1] + code_points(data[at : found.end()]))
            at = found.end()
            self.units.append(self.units[-1] + step)
            self.bytes.append(at)
        self.n = self.units[-1] + len(_units(1).findall(data, at))

    def cut(self, u: int) -> tuple[int, int]:
        """The byte and code-point offsets after u units."""
        k = bisect_right(self.units, u) - 1
        a = self.bytes[k]
        b = _units(u - self.units[k]).match(self.data, a).end() if u > self.units[k] else a
        return b, self.points[k] + code_points(self.data[a:b])


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that a document's id gives; a null id counts as an empty one."""
    h = hashlib.sha256(b"%d:%s" % (seed, b"" if doc_id is None else b"%d" % doc_id)).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(doc_id: int | None, data: bytes, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output) of a text."""
    index, (h1, h2, h3, h4) = Checkpoints(data), draws(doc_id, seed)
    if not data or h3 % 100 >= rate or any(m in data for m in MARKS):
        return index.n, "plain", None, None, data
    (a, pa_), (b, pb) = map(index.cut, sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = MARKS
    if h4 % 100 < spm:
        return index.n, "spm", pa_, pb - pa_, b"".join((s, suffix, p, prefix, m, middle))
    return index.n, "psm", pa_, pb - pa_, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """OUTPUT for every row of docs: rate in a hundred texts are cut at two places, spm in a hundred of these with the suffix first.

    What happens to a text depends on its id and the seed alone: repeated rows have one result, rows of one id are drawn alike, a null id
    counts as an empty one. Null and empty texts, and those that contain a mark, stay as they are (form plain; null becomes empty).
    Texts of any length are cut whole. Other columns are not read; an empty table gives no rows.
    """

    def batch(made: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        cols = list(zip(*made, strict=True))
        text = pa.array(cols[5], pa.binary()).cast(pa.string(), safe=False)
        return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], text], [f.split()[0] for f in OUTPUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for b in batches:
            for doc_id, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                row = (doc_id, *transform(doc_id, data.as_py() or b"", seed, rate, spm))
                made.append(row)
                size += len(row[5])
                if len(made) >= ROWS or size >= BYTES:
                    yield batch(made)
                    made, size = [], 0
        if made:
            yield batch(made)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, OUTPUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No mark can be read anywhere but where it was put: texts have none, and no mark's end begins another."""
    parts = F.split(output, "|".join(m.decode() for m in MARKS), -1)  # before the first mark there is nothing
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))
