"""License scans by patience alignment.

A template's and a text's words are aligned like this: words that occur exactly once in both are anchors; the longest
increasing subsequence of the anchors' places is kept; runs of equal words next to anchors are taken along; the gaps
between kept anchors are aligned in the same way. Coverage is the share of the template's words that are aligned.

A text is first held against each template's bag of words: coverage can't exceed the share of template words that the
text has at all, so the rest can't match and isn't aligned. Then all words that the template has once cut the text into
windows, in each of which such a word stands once; so a license that occurs many times in a text is found each time. A
template has more such words than a copy may lack (else all its words are taken), so no copy goes without a window; only
windows that hold too few of the template's words are not aligned. Of places of one template that overlap, the one with
more aligned words and fewer others stays.

Windows are of two kinds: narrow ones, as long as a template and a half, and, for templates of at least `LONG` words,
wide ones that reach to the neighbouring places of their word, however far, so a license that foreign text cuts in two
is found too. An alignment falls into blocks where the text goes on for over half a template between aligned words; a
block of fewer than `BLOCK` words says nothing by itself and doesn't count (words of a short notice that lie about in a
long text are no license).

Defined results: a null or blank text has no license; texts are scanned whole; several licenses may be found in one
document, each once with its best place and its number of places; of templates whose places overlap the one with more
aligned words wins, then the first in the list; repeated rows are scanned each, rows without an id too; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import documents

# Short notices and the operative sentences of common licenses.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Released under the MIT License",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "all-rights-reserved": "All rights reserved",
}
MIN_COVERAGE = 0.8
LONG, BLOCK = 40, 8
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence, of pairs sorted by their first part, whose second parts increase."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        place = bisect_left(tails, b)
        tails[place : place + 1] = [b]
        at[place : place + 1] = [k]
        back.append(at[place - 1] if place else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists, increasing in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: k for k, w in enumerate(b[b0:b1], b0) if nb[w] == 1}
        anchors = _increasing([(k, where[w]) for k, w in enumerate(a[a0:a1], a0) if na[w] == 1 and w in where])
        if not anchors:
            continue
        found += anchors
        # Equal words around anchors are taken along as the gaps' common ends.
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:], strict=False)]
    return sorted(found)


def _dense(pairs: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """The alignment without blocks of fewer than BLOCK words, if it has several."""
    blocks: list[list[tuple[int, int]]] = []
    for pair in pairs:
        if not blocks or pair[1] - blocks[-1][-1][1] > gap:
            blocks.append([])
        blocks[-1].append(pair)
    return pairs if len(blocks) < 2 else [p for b in blocks if len(b) >= BLOCK for p in b]


class Scanner:
    """Templates, ready to be held against texts."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE):
        self.least = min_coverage
        self.templates = [(name, w := words(text), Counter(w)) for name, text in templates.items()]
        self.of = defaultdict(list)
        for k, (_, _, bag) in enumerate(self.templates):
            for w in bag:
                self.of[w].append(k)
        self.vocabulary = frozenset(self.of)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, first word, last word, places) of a whole text."""
        text = words(text or "")
        have = self.vocabulary.intersection(text)
        if not have:
            return []
        shares: Counter = Counter()
        for w in have:
            for k in self.of[w]:
                shares[k] += self.templates[k][2][w]
        able = [k for k, n in shares.items() if n >= self.least * len(self.templates[k][1])]
        if not able:
            return []
        places = defaultdict(list)
        for n, w in enumerate(text):
            if w in have:
                places[w].append(n)
        hits = []
        for k in able:
            template, bag = self.templates[k][1:]
            need = self.least * len(template)
            pivots = [w for w in bag if bag[w] == 1]
            if len(pivots) <= len(template) - need:
                pivots = list(bag)
            held = [0, *accumulate(w in bag for w in text)]
            slack = len(template) // 2 + 8
            windows = set()
            for pivot in pivots:
                spots = places.get(pivot, [])
                for own in (n for n, w in enumerate(template) if w == pivot):
                    for i, at in enumerate(spots):
                        start = max(spots[i - 1] + 1 if i else 0, at - own - slack)
                        stop = min(spots[i + 1] if i + 1 < len(spots) else len(text), at + len(template) - own + slack)
                        if held[stop] - held[start] >= need:
                            windows.add((start, stop))
                if len(template) >= LONG and bag[pivot] == 1:
                    edges = [-1, *spots, len(text)]
                    windows.update((a + 1, b) for a, b in zip(edges, edges[2:], strict=False) if held[b] - held[a + 1] >= need)
            best: dict[tuple[int, int], int] = {}
            for start, stop in windows:
                part = text[start:stop]
                if (Counter(part) & bag).total() < need:
                    continue
                pairs = _dense(align(template, part), slack)
                if len(pairs) >= need:
                    span = (start + pairs[0][1], start + pairs[-1][1])
                    best[span] = max(best.get(span, 0), len(pairs))
            own_places: list[tuple[int, int]] = []
            for span in sorted(best, key=lambda x: (x[1] - x[0] - 2 * best[x], x)):
                if all(span[1] < a or span[0] > b for a, b in own_places):
                    own_places.append(span)
                    hits.append((-best[span], k, span))
        taken: list[tuple[int, int]] = []
        out: dict[int, list] = {}
        for n, k, span in sorted(hits):
            if all(span[1] < a or span[0] > b for a, b in taken):
                taken.append(span)
                out.setdefault(k, [-n, span, 0])[2] += 1
        return [(self.templates[k][0], n / len(self.templates[k][1]), *span, times) for k, (n, span, times) in sorted(out.items())]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word, places): a row for each license found in a document."""
    scanner = Scanner(templates, min_coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc.as_py(), *hit) for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True) for hit in scanner.scan(text.as_py())]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "license", "coverage", "first_word", "last_word", "places"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, coverage double, first_word long, last_word long, places long")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


QUERIES = {"op2_licenses": op2_licenses}
SQL: dict[str, str] = {}
