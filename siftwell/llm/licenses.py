"""License scan: winnowed fingerprints of templates in an inverted index, then banded alignment of candidates.

Templates and texts become words (lower-cased runs of ASCII letters and digits). Hashes of K words are winnowed
per template: of every window of hashes in a row the smallest stays. A window has WINDOW hashes, or as many as a match of the least
coverage has in a row, if those are fewer. A text is looked up with all its hashes, so a shared stretch of K words and
a window's other hashes is always noticed. Hits near
one diagonal make a candidate, which local alignments within a band around that diagonal verify: after one is
taken the words before and after it are aligned again, so repeats within the band are all found.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, WINDOW, BAND = 3, 4, 8
LEAST_COVERAGE = 0.8
MATCH, MISMATCH, GAP = 2, -1, -1
BASE = np.uint64(0x9E3779B97F4A7C15)
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

# Public license texts and notices.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES = {
    "mit-notice": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "all-rights-reserved": "All rights reserved",
    "mit": f"{_MIT_GRANT} {_MIT_WARRANTY}",
    "mit-grant": _MIT_GRANT,
    "isc": f"{_ISC_GRANT} {_ISC_WARRANTY}",
    "isc-grant": _ISC_GRANT,
    "bsd-2-clause": f"{_BSD_TERMS} {_BSD_WARRANTY}",
    "bsd-3-clause": f"{_BSD_TERMS} {_BSD_ENDORSE} {_BSD_WARRANTY}",
    "bsd-terms": _BSD_TERMS,
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

SCHEMA = "doc_id long, license string, coverage double, matched_words long, start_word long, end_word long, start_char long, end_char long"


def license_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TABLE).split()


class TemplateIndex:
    def __init__(self, templates: dict[str, str], least: float = LEAST_COVERAGE):
        self.number: dict[bytes, int] = {}
        self.words = {n: license_words(t) for n, t in templates.items()}
        self.ids = {n: np.array([self.number.setdefault(w, len(self.number) + 1) for w in ws], np.uint64) for n, ws in self.words.items() if ws}
        self.index: dict[int, list[tuple[str, int]]] = {}
        for name, ids in self.ids.items():
            k = min(K, len(ids))
            hashes = self.hashes(ids, k)
            for i in self.winnow(hashes, max(1, min(WINDOW, int(least * len(ids)) - k + 1))):
                self.index.setdefault(int(hashes[i]), []).append((name, int(i)))
        self.keys = np.unique(np.array(list(self.index), np.uint64))
        self.sizes = sorted({min(K, len(ids)) for ids in self.ids.values()})

    @staticmethod
    def hashes(ids: np.ndarray, k: int) -> np.ndarray:
        h = np.full(max(0, len(ids) - k + 1), k, np.uint64)
        for j in range(k):
            h = h * BASE + ids[j : len(ids) - k + 1 + j]
        return h

    @staticmethod
    def winnow(hashes: np.ndarray, window: int) -> list[int]:
        """Positions of the smallest hash of each window, the rightmost if equal."""
        windows = np.lib.stride_tricks.sliding_window_view(hashes, min(window, len(hashes)))
        at = np.arange(len(windows)) + windows.shape[1] - 1 - np.argmin(windows[:, ::-1], axis=1)
        return np.unique(at).tolist()

    def candidates(self, ids: np.ndarray) -> list[tuple[str, int]]:
        """(template, diagonal) of groups of hits whose diagonals are within a band of the group's first."""
        out = []
        for k in self.sizes:
            h = self.hashes(ids, k)
            found: dict[str, list[int]] = {}
            for at in np.flatnonzero(np.isin(h, self.keys)).tolist():
                for name, i in self.index[int(h[at])]:
                    found.setdefault(name, []).append(at - i)
            for name, diagonals in found.items():
                diagonals.sort()
                first = None
                for d in diagonals:
                    if first is None or d > first + BAND:
                        first = d
                        out.append((name, d))
        return out


def align(doc: np.ndarray, template: np.ndarray, diagonal: int, start: int, stop: int, band: int = 2 * BAND) -> tuple[int, int, int] | None:
    """Best local alignment within band of the diagonal and words [start, stop) of doc: matched words, and the span [start, end) of doc."""
    low = max(start, diagonal - band)
    part = doc[low : max(low, min(stop, diagonal + len(template) + band))]
    best, score = None, 0
    # by row: columns within the band, each (score, matched, start); row i of the template meets doc column i + diagonal - low
    before: dict[int, tuple[int, int, int]] = {}
    for i, w in enumerate(template.tolist()):
        now: dict[int, tuple[int, int, int]] = {}
        centre = i + diagonal - low
        for j in range(max(0, centre - band), min(len(part), centre + band + 1)):
            same = int(part[j]) == w
            s, m, a = before.get(j - 1, (0, 0, j))
            cell = (s + (MATCH if same else MISMATCH), m + same, a)
            if j in before and before[j][0] + GAP > cell[0]:
                cell = (before[j][0] + GAP, *before[j][1:])
            if j - 1 in now and now[j - 1][0] + GAP > cell[0]:
                cell = (now[j - 1][0] + GAP, *now[j - 1][1:])
            if cell[0] > 0:
                now[j] = cell
                if cell[0] > score:
                    best, score = (cell[1], low + cell[2], low + j + 1), cell[0]
        before = now
    return best


def alignments(doc: np.ndarray, template: np.ndarray, diagonal: int, least: float) -> list[tuple[int, int, int]]:
    """Alignments of the least coverage within the band: the best one, and those of the words before and after each one taken."""
    out, parts = [], [(0, len(doc))]
    while parts:
        start, stop = parts.pop()
        if min(stop, diagonal + len(template) + 2 * BAND) - max(start, diagonal - 2 * BAND) < least * len(template):
            continue
        if (got := align(doc, template, diagonal, start, stop)) and got[0] >= least * len(template):
            out.append(got)
            parts += [(start, got[1]), (got[2], stop)]
    return out


def scan(text: str, index: TemplateIndex, least: float = LEAST_COVERAGE) -> list[tuple]:
    """(license, coverage, matched words, word span, character span), best first where spans overlap."""
    data = text.encode("utf-8", "replace")
    ws = data.translate(TABLE).split()
    get = index.number.get
    ids = np.fromiter((get(w, 0) for w in ws), np.uint64, len(ws))
    found = set()
    for name, diagonal in index.candidates(ids):
        template = index.ids[name]
        for got in alignments(ids, template, diagonal, least):
            found.add((name, got[0] / len(template), *got))
    out: list[tuple] = []
    starts: list[int] = []  # of the spans taken, ascending, and their ends: they never overlap
    ends: list[int] = []
    for x in sorted(found, key=lambda x: (-x[2], -x[1], x[0], x[3])):
        i = bisect.bisect_left(starts, x[4])
        if i == 0 or ends[i - 1] <= x[3]:
            starts.insert(i, x[3])
            ends.insert(i, x[4])
            out.append(x)
    if not out:
        return []
    at = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(TABLE))]
    raw = np.frombuffer(data, np.uint8)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80))).tolist()  # characters that begin before each byte
    return sorted(((*x, chars[at[x[3]][0]], chars[at[x[4] - 1][1]]) for x in out), key=lambda x: (x[3], x[0]))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per license found in a row of docs, as SCHEMA: spans are [start, end), of words and of characters.

    Of overlapping matches the one with most matched words stays; of those, the one with the higher coverage, then the first by name and place. Null and empty texts have none, repeated rows
    each their own, an empty table no rows. Other columns are not read. Texts of any length are scanned whole.
    The index holds the templates only, whatever the data.
    """
    held = docs.sparkSession.sparkContext.broadcast(TemplateIndex(TEMPLATES if templates is None else templates, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 5]
        for b in batches:
            rows = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) if t.is_valid for x in scan(t.as_py(), held.value, least)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
