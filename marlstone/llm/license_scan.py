"""Licence scans: normalised text is compared with licence templates by the Dice coefficient over word bigrams.

Of a text, these units are compared: each line, each run of lines that consist mostly of bigrams of
templates, each window of lines in such a run, and the whole text. A unit of n distinct bigrams can reach the coefficient t with
a template of m only if t / (2 - t) <= n / m <= (2 - t) / t, so templates are held by size and those
outside the bounds are never compared; of the rest, an index from bigrams to templates finds those that
share any. Windows are found by going backwards over a run's lines with its distinct bigrams in the
order in which they are first met from the line on: a window ends at one of the first few, as a window
of more distinct bigrams than the largest template allows can't match. One narrow pass, no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.llm.common import table, tidy
from marlstone.llm.decontaminate import words

THRESHOLD = 0.9
#: Share of a line's bigrams that templates have, from which the line may be part of a longer licence text.
LIKE = 0.5

# Texts and notices of public licences.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEMPLATES: list[tuple[str, str]] = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("bsd-2-clause", _BSD_TWO + " " + _BSD_END),
    ("bsd-3-clause", _BSD_TWO + " " + _BSD_THIRD + " " + _BSD_END),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("isc", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _AS_IS),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def bigrams(ws: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(ws, ws[1:]))


class Templates:
    """Templates by size, with an index from bigrams; a template of fewer than two words is refused."""

    def __init__(self, texts: list[tuple[str, str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names = [name for name, _ in texts]
        sets = [bigrams(words(text.encode())) for _, text in texts]
        if not all(sets):
            raise ValueError("a template has no bigram")
        self.sizes = [len(s) for s in sets]
        self.index: dict[tuple[bytes, bytes], list[int]] = {}
        for k, s in enumerate(sets):
            for b in s:
                self.index.setdefault(b, []).append(k)
        low, high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.bounds = [(m * low, m * high) for m in self.sizes]
        self.smallest, self.largest = min(b[0] for b in self.bounds), max(b[1] for b in self.bounds)

    def best(self, unit: set[tuple[bytes, bytes]]) -> tuple[float, str] | None:
        """The template of the largest coefficient, by name among equals, if it reaches the threshold."""
        n = len(unit)
        if not self.smallest <= n <= self.largest:
            return None
        fits = {k for k, (low, high) in enumerate(self.bounds) if low <= n <= high}
        shared = Counter(k for b in unit if b in self.index for k in self.index[b] if k in fits)
        found = [(-2 * c / (n + self.sizes[k]), self.names[k]) for k, c in shared.items() if 2 * c >= self.threshold * (n + self.sizes[k])]
        return (-min(found)[0], min(found)[1]) if found else None

    def scan(self, text: bytes | None) -> list[tuple[int, int, str, float]]:
        """(first line, last line, template, coefficient) of each unit that matches, in order; a longer unit replaces those in it unless it is worse."""
        lines = (text or b"").split(b"\n")
        units = [words(line) for line in lines]
        found: list[tuple[int, int, str, float]] = []
        run: list[int] = []
        for k, ws in enumerate([*units, []]):
            pairs = bigrams(ws)
            known = [b for b in pairs if b in self.index]
            if known and (hit := self.best(pairs)):
                found.append((k, k, hit[1], hit[0]))
            if pairs and len(known) >= LIKE * len(pairs) or run and k < len(lines) and not pairs:
                run.append(k)
            elif run:
                while len(units[run[-1]]) < 2:  # lines of a word or none only continue a run
                    run.pop()
                for first, last in self._windows(units, run[0], run[-1]):
                    self._add(found, units, first, last)
                self._add(found, units, run[0], run[-1])
                run = []
        self._add(found, units, 0, len(lines) - 1)
        return found

    def _windows(self, units: list[list[bytes]], first: int, last: int) -> list[tuple[int, int]]:
        """Windows of lines that match a template: the best by coefficient, then the shortest, that don't overlap, in order."""
        if last <= first:
            return []
        lines = [k for k in range(first, last + 1) for _ in units[k]]
        ws = [w for k in range(first, last + 1) for w in units[k]]
        pairs = list(zip(ws, ws[1:]))
        inside = Counter(k for b in set(pairs) if b in self.index for k in self.index[b])
        possible = {k for k, c in inside.items() if c >= self.bounds[k][0] - 1e-9}
        if not possible:
            return []
        largest = max(self.bounds[k][1] for k in possible)
        # distinct bigrams of the lines from here on with the line each first ends in, the nearest last
        ends: dict[tuple[bytes, bytes], int] = {}
        found: list[tuple[float, int, int]] = []
        at = len(pairs) - 1
        while at >= 0:
            line = lines[at]
            while at >= 0 and lines[at] == line:
                ends.pop(pairs[at], None)
                ends[pairs[at]] = lines[at + 1]
                at -= 1
            n, shared, end = 0, dict.fromkeys(possible, 0), line
            for b, e in chain(reversed(ends.items()), ((None, last + 1),)):
                if e != end:
                    hits = [2 * c / (n + self.sizes[k]) for k, c in shared.items() if 2 * c >= self.threshold * (n + self.sizes[k])]
                    if hits and end > line:
                        found.append((max(hits), line, end))
                    end = e
                n += 1
                if n > largest:
                    break
                for k in self.index.get(b, ()):
                    if k in shared:
                        shared[k] += 1
        taken: list[tuple[int, int]] = []
        used = bytearray(last + 1 - first)
        for _, i, j in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1])):
            if not any(used[i - first:j + 1 - first]):
                used[i - first:j + 1 - first] = b"\1" * (j + 1 - i)
                taken.append((i, j))
        return sorted(taken)

    def _bigrams(self, units: list[list[bytes]], first: int, last: int) -> set[tuple[bytes, bytes]]:
        """Those of the lines as one text, as far as there are not too many for any template."""
        out: set[tuple[bytes, bytes]] = set()
        before: list[bytes] = []
        for ws in units[first:last + 1]:
            out.update(zip(before + ws, (before + ws)[1:]))
            if len(out) > self.largest:
                break
            before = ws[-1:] or before
        return out

    def _add(self, found: list, units: list[list[bytes]], first: int, last: int) -> None:
        hit = self.best(self._bigrams(units, first, last)) if last > first else None
        inner = [x for x in found if first <= x[0] and x[1] <= last]
        if hit and all(hit[0] >= x[3] for x in inner):
            found[:] = [x for x in found if x not in inner] + [(first, last, hit[1], hit[0])]


def _map(docs: DataFrame, keep: tuple[str, ...], text_col: str, fields: str, kinds: list[pa.DataType], rows_of, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """rows_of(matches) gives the rows for one document."""
    schema = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL(fields).fields])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column("l_text").cast(pa.binary())):
                for row in rows_of(known.scan(text.as_py())):
                    at.append(k)
                    rows.append(row)
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int32())) for c in keep), *(pa.array(c, t) for c, t in zip(columns, kinds))], schema.names)

    return docs.select(*keep, F.col(text_col).alias("l_text")).mapInArrow(run, schema)


def license_spans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row for each match: the columns in `keep`, first_line, last_line (from 0), license, dice. Null and empty texts have none."""
    return _map(docs, keep, text_col, "first_line int, last_line int, license string, dice double", [pa.int32(), pa.int32(), pa.string(), pa.float64()], lambda found: found, templates, threshold)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row for each row: the columns in `keep`, license and dice of the best match (null and 0 without one), n_matches, and all licences found, sorted and comma-joined."""
    def summary(found: list[tuple[int, int, str, float]]) -> list[tuple]:
        best = min(found, key=lambda x: (-x[3], x[2]), default=(0, 0, None, 0.0))
        return [(best[2], best[3], len(found), ",".join(sorted({x[2] for x in found})))]

    return _map(docs, keep, text_col, "license string, dice double, n_matches long, licenses string", [pa.string(), pa.float64(), pa.int64(), pa.string()], summary, templates, threshold)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
