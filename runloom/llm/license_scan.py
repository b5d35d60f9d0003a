"""License scan by patience alignment.

Texts and templates are words of letters and digits in lower case. Around every place of one of a
template's telling words lies a region of three template lengths; inside it, words unique to both
sides anchor the alignment, the longest increasing run of anchors stays, and the gaps between
anchors are aligned in the same way. Coverage is the share of template words found in order, within
a span of at most ``STRETCH`` template lengths. A template is found at ``COVERAGE`` or more.

The telling words of a template are chosen so that no text can reach the coverage without one of
them: its longest words, until they fill more places than may be missing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
STRETCH = 1.5

#: Public license texts and notices.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "BSD-line": "Released under the BSD License.",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
}

_WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given in order of the first number, whose second numbers increase."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[k], ends[k] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of two word lists, increasing on both sides."""
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
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if cb[w] == 1}
        anchors = increasing([(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if ca[w] == 1 and w in place])
        last = (a0, b0)
        for i, j in anchors:
            todo.append((last[0], i, last[1], j))
            last = (i + 1, j + 1)
        found += anchors
        if anchors:
            todo.append((last[0], a1, last[1], b1))
    return sorted(found)


class Template:
    def __init__(self, name: str, text: str, coverage: float, stretch: float) -> None:
        self.name, self.words = name, words_of(text)
        self.size = len(self.words)
        self.needed = -int(-coverage * self.size // 1)
        self.span = max(int(stretch * self.size), self.size)
        counts, telling, places = Counter(self.words), set(), 0
        for w in sorted(counts, key=lambda w: (-len(w), w)):
            if places > self.size - self.needed:
                break
            telling.add(w)
            places += counts[w]
        self.telling = telling

    def best(self, pairs: list[tuple[int, int]]) -> tuple[int, int, int] | None:
        """(matched words, first, end) of the fullest stretch of the pairs that is short enough."""
        best, low = None, 0
        for high in range(len(pairs)):
            while pairs[high][0] - pairs[low][0] >= self.span:
                low += 1
            n = high - low + 1
            if n >= self.needed and (best is None or n > best[0]):
                best = (n, pairs[low][0], pairs[high][0] + 1)
        return best

    def find(self, words: list[str], places: dict[str, list[int]]) -> Iterator[tuple[int, int, int]]:
        done = -1
        for at in sorted(p for w in self.telling for p in places.get(w, ())):
            if at < done:
                continue
            hit = self.align(words, max(at - self.span, done), at + self.span)
            if hit:
                # The region may have held a part of the text only: once more around what was found.
                again = self.align(words, max(hit[1] - self.span, done), hit[2] + self.span)
                hit = max(hit, again or hit, key=lambda h: h[0])
                done = hit[2]
                yield hit

    def align(self, words: list[str], low: int, high: int) -> tuple[int, int, int] | None:
        low = max(low, 0)
        return self.best([(low + i, j) for i, j in patience(words[low:high], self.words)])


def licenses(text: str, templates: list[Template]) -> list[tuple[str, int, int, int]]:
    """(name, first word, end, coverage in percent) of the templates in a text, in order.

    Of templates that overlap, the one with more matched words stays, then the fuller one.
    """
    words = words_of(text)
    wanted = {w for t in templates for w in t.telling}
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w in wanted:
            places.setdefault(w, []).append(i)
    hits = [(n, n * 100 // t.size, a, b, t.name) for t in templates if t.telling & places.keys() for n, a, b in t.find(words, places)]
    hits.sort(key=lambda h: (-h[0], -h[1], h[2], h[4]))
    taken: list[tuple[str, int, int, int]] = []
    for _, share, a, b, name in hits:
        if all(b <= x or a >= y for _, x, y, _ in taken):
            taken.append((name, a, b, share))
    return sorted(taken, key=lambda h: h[1])


def _scan(table: dict[str, str], coverage: float, stretch: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = [Template(n, t, coverage, stretch) for n, t in sorted(table.items()) if words_of(t)]
        for batch in batches:
            found = [licenses(t or "", templates) for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int32()), ("end", pa.int32()), ("coverage", pa.int32())]))
            rows = [[{"license": n, "first": a, "end": b, "coverage": c} for n, a, b, c in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "licenses"])
    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, stretch: float = STRETCH,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and licenses (array of license, first word, end word, coverage in percent) per row.

    Null and empty texts have none; a template without words is never found; ids may be null or
    repeated. The templates travel with the plan; they are the caller's fixed list.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(templates or TEMPLATES, coverage, stretch),
                           "doc_id long, licenses array<struct<license:string,first:int,end:int,coverage:int>>")
