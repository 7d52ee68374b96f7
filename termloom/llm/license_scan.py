"""License scans by patience alignment."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COVERAGE = 0.8

# Public license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU General Public License for more details."
    ),
}

_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of ``pairs`` (sorted by first, falling second within one first) that rises in both."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[at], ends[at] = b, i
    found, i = [], ends[-1] if ends else -1
    while i >= 0:
        found.append(pairs[i])
        i = before[i]
    return found[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of ``a`` and ``b`` by patience alignment, rising in both.

    Equal ends of a range are matched first. Words that occur once on both sides of what is left are
    anchors, thinned to their longest increasing subsequence; every gap between anchors is a range
    of its own. In a range without such words all equal pairs stand in for anchors.
    """
    found: list[tuple[int, int]] = []
    ranges = [(0, len(a), 0, len(b))]
    while ranges:
        a0, a1, b0, b1 = ranges.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        count_a, count_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        unique = {b[j]: j for j in range(b0, b1) if count_b[b[j]] == 1 and count_a[b[j]] == 1}
        anchors = rising([(i, unique[a[i]]) for i in range(a0, a1) if a[i] in unique])
        if anchors:
            found.extend(anchors)
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            ranges.extend((p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:]))
            continue
        places: dict = {}
        for j in range(b1 - 1, b0 - 1, -1):
            if b[j] in count_a:
                places.setdefault(b[j], []).append(j)
        found.extend(rising([(i, j) for i in range(a0, a1) for j in places.get(a[i], ())]))
    return sorted(found)


class Scanner:
    """Templates prepared for the search in whole texts."""

    def __init__(self, templates: dict[str, str], coverage: float) -> None:
        self.templates = [(name, tokens(text)) for name, text in templates.items() if tokens(text)]
        self.coverage = coverage

    def need(self, words: list[str]) -> int:
        return math.ceil(self.coverage * len(words) - 1e-9)

    def marks(self) -> list[str]:
        """Words of which every text that holds a template has at least one.

        A text may lack ``len - need`` words of a template, so it holds one of any set of words that
        stand for more places than that. The longest words are taken, as they are rare.
        """
        marks: set[str] = set()
        for _, words in self.templates:
            spare, counts = len(words) - self.need(words), Counter(words)
            for word in sorted(counts, key=lambda w: (-len(w), w)):
                marks.add(word)
                spare -= counts[word]
                if spare < 0:
                    break
        return sorted(marks)

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, words, start, end) of each hit; hits do not overlap, the fullest wins."""
        words = tokens(text)
        at: dict[str, list[int]] = {}
        known = {w for _, t in self.templates for w in t}
        for i, word in enumerate(words):
            if word in known:
                at.setdefault(word, []).append(i)
        hits = []
        for name, template in self.templates:
            places = sorted(i for w in set(template) for i in at.get(w, ()))
            need, n = self.need(template), len(template)
            reach, step = 2 * n, max(1, n // 2)
            first = 0
            for j in range(need - 1, len(places)):
                # Windows of 2n words begin at every half template; only those with enough words are aligned.
                start = max(0, (places[j] - reach + step) // step * step)
                if start < first:
                    continue
                for begin in range(max(first, start), places[j] + 1, step):
                    lo, hi = bisect_left(places, begin), bisect_left(places, begin + reach)
                    if hi - lo < need:
                        continue
                    pairs = align(template, words[begin : begin + reach])
                    if len(pairs) >= need:
                        hits.append((len(pairs), name, n, begin + pairs[0][1], begin + pairs[-1][1] + 1))
                first = places[j] // step * step + step
        hits.sort(key=lambda h: (-h[0], h[2] - h[0], h[4] - h[3], h[3], h[1]))
        taken: list[tuple[int, int]] = []
        found = []
        for matched, name, n, start, end in hits:
            if all(end <= a or b <= start for a, b in taken):
                taken.append((start, end))
                found.append((name, matched / n, matched, start, end))
        return sorted(found, key=lambda f: f[3])


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    coverage: float = COVERAGE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row for every license text found: id, license, coverage, matched_words, start_word, end_word.

    Coverage is the part of a template's words (letters and digits, in lower case) that patience
    alignment matches in windows twice as long as the template. Of hits that overlap the one with
    the most matched words stays. Texts that hold none of the words without which no template can
    reach the coverage are left out before they reach Python; that loses nothing.

    Null and empty texts give no rows, nor does an empty table; null ids stay null; repeated rows each
    give theirs; other columns are not read.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage)
    id_type = docs.schema[id_column].dataType
    schema = T.StructType(
        [
            T.StructField(id_column, id_type),
            T.StructField("license", T.StringType()),
            T.StructField("coverage", T.DoubleType()),
            T.StructField("matched_words", T.LongType()),
            T.StructField("start_word", T.LongType()),
            T.StructField("end_word", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept = [], []
            for i, text in enumerate(batch.column(1)):
                for hit in scanner.scan(text.as_py()):
                    rows.append(hit)
                    kept.append(i)
            types = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            ids = batch.column(0).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *columns], names=schema.names)

    marked = F.lower(text_column).rlike("|".join(map(re.escape, scanner.marks())) or "$^")
    return docs.select(id_column, text_column).filter(marked).mapInArrow(run, schema)
