"""License scans: patience alignment of each text with license templates.

The words unique to both text and template are anchors; of these the longest subsequence
that rises in both is kept. Between neighbouring anchors, equal words next to an anchor
are taken first, then the gap is aligned in the same way, until a gap has no anchors; a gap of
few words gets its longest common subsequence then.

Words that stand twice are no anchors, so a text is searched in windows: of one and a half
template lengths, so that some window holds one copy of a notice and of no other copy more than half, and, where
nothing was found, of more, for notices with up to twice their words of other text between. Windows that hold too few of the
template's words are left out; that is exact, as each aligned word is a word of the window. A window in which
patience aligns ``FOUND`` of what is asked for is a place; its coverage is measured exactly, by the
longest common subsequence, where that is shortest. Places don't overlap: the best are
chosen, and all are reported. The coverage of the best counts. Words that lie scattered, over more than
``SPREAD`` template lengths, are no place.

Templates that a text can reach are found by their rarest words: a template may miss so many words,
and one more than these, the rarest among all templates, are its keys; a text without any of them can't cover
it. So a text meets few templates, however many there are.

One narrow pass over all whole texts for each ``MOST_TEMPLATES`` templates, which are a dictionary or
a table (name, text); templates of one name are each on their own.

Nulls: a null or blank text, or a template without words, has no rows. Repeated rows are
scanned each on their own; an empty table gives no rows. Only id and text are read, so other columns can't
clash. The rows are not thinned: a text may match many templates.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import reduce
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPREAD = 3
MOST_TEMPLATES = 10_000
#: The share of the asked coverage that patience must align in a place.
FOUND = 0.75
#: Words of text and template between anchors that are still aligned where there is no anchor.
GAP = 48
WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")

_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NO_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: License notices as they stand in files, and whole short licenses.
TEMPLATES = {
    "mit-full": _GRANT,
    "bsd-2-clause": _BSD + _BSD_END,
    "bsd-3-clause": _BSD + _NO_NAMES + _BSD_END,
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "lgpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first number, that rises in the second."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(piles[at - 1] if at else -1)
        tops[at : at + 1], piles[at : at + 1] = [b], [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of the longest common subsequence of few words."""
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif size[i + 1][j] >= size[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of equal words, rising in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        anchors = rising([(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if w in where and once_a[w] == 1])
        if not anchors:
            if a1 - a0 <= GAP and b1 - b0 <= GAP:
                out += [(a0 + i, b0 + j) for i, j in common(a[a0:a1], b[b0:b1])]
            continue
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def lcs_ends(a: list[str], masks: dict[str, int], n: int) -> tuple[int, int]:
    """The longest common subsequence of ``a`` and a template of ``n`` words, and where in ``a`` it is first complete.

    Bit-parallel: a zero bit is a template word at which the subsequence grows.
    """
    full = (1 << n) - 1
    row, best, end = full, 0, 0
    for i, w in enumerate(a):
        if (m := masks.get(w)) is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
            if (now := n - row.bit_count()) > best:
                best, end = now, i + 1
    return best, end


def masks_of(template: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for j, w in enumerate(template):
        out[w] = out.get(w, 0) | 1 << j
    return out


class Template:
    def __init__(self, name: str, own: list[str], least: float):
        self.name, self.words, self.count, self.n = name, own, Counter(own), len(own)
        self.need = least * len(own)
        self.ahead, self.back = masks_of(own), masks_of(own[::-1])

    def held(self, own: Counter) -> int:
        return sum(min(c, own[w]) for w, c in self.count.items() if w in own)

    def place(self, own: list[str], a: int, b: int) -> tuple[int, int, int] | None:
        """(begin, end, aligned words) of the place in own[a:b] that patience finds and the exact measure confirms."""
        if self.held(Counter(w for w in own[a:b] if w in self.count)) < self.need or len(patience(own[a:b], self.words)) < FOUND * self.need:
            return None
        best, end = lcs_ends(own[a:b], self.ahead, self.n)
        if best < self.need:
            return None
        begin = a + end - lcs_ends(own[a : a + end][::-1], self.back, self.n)[1]
        return (begin, a + end, best) if a + end - begin <= SPREAD * self.n else None

    def windows(self, at: list[int], width: int, step: int) -> list[tuple[int, int]]:
        """Windows, at every ``step``, in which enough of the places ``at`` of template words lie."""
        hits: Counter = Counter()
        for i in at:
            for k in range(max(0, (i - width) // step + 1), i // step + 1):
                hits[k] += 1
        return [(k * step, k * step + width) for k, c in sorted(hits.items()) if c >= self.need]

    def places(self, own: list[str]) -> list[tuple[int, int, int]]:
        """Places that don't overlap, in order of the text."""
        chosen: list[tuple[int, int, int]] = []
        left = [i for i, w in enumerate(own) if w in self.count]
        for wide in (1.5, 1.5 * SPREAD):
            width, step = -int(-wide * self.n // 1) + 1, max(1, int(wide * self.n / 3))
            found = set()
            ends = [0, *[e for _, e, _ in chosen]]
            begins = [*[b for b, _, _ in chosen], len(own)]
            for a, b in self.windows(left, width, step):
                k = bisect_right(ends, a) - 1  # what was found before is no part of a window
                if (p := self.place(own, max(a, ends[k]), min(b, begins[k]))) is not None:
                    found.add(p)
            for p in sorted(found, key=lambda p: (-p[2], p[1] - p[0], p[0])):
                if all(p[1] <= b or e <= p[0] for b, e, _ in chosen):
                    chosen.append(p)
            chosen.sort()
            left = [i for i in left if not any(b <= i < e for b, e, _ in chosen)]
        return chosen


class Scanner:
    def __init__(self, templates: dict[str, str] | list[tuple[str, str]], least: float):
        pairs = templates.items() if isinstance(templates, dict) else templates
        self.templates = [Template(n, w, least) for n, w in ((n, words(t)) for n, t in sorted(pairs)) if w]
        common = Counter(w for t in self.templates for w in t.count)
        self.keys: dict[str, list[int]] = {}
        for k, t in enumerate(self.templates):
            spare = t.n - t.need
            for w in sorted(t.count, key=lambda w: (common[w], w)):
                self.keys.setdefault(w, []).append(k)
                spare -= t.count[w]
                if spare < 0:  # a text without any of these words misses too many
                    break

    def __call__(self, text: str) -> list[tuple[str, float, int, list[dict]]]:
        """(template, coverage, aligned words, places by word) of each template covered enough."""
        own = words(text)
        have = Counter(own)
        found = []
        for k in sorted({k for w in self.keys.keys() & have.keys() for k in self.keys[w]}):
            t = self.templates[k]
            if t.held(have) >= t.need and (where := t.places(own)):
                n = max(x for _, _, x in where)
                found.append((t.name, n / t.n, n, [{"begin": a, "end": b} for a, b, _ in where]))
        return found


def scan_licenses(docs: DataFrame, templates: dict[str, str] | list[tuple[str, str]] | DataFrame = TEMPLATES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, coverage, n_words, places) of each text and template with a coverage of ``least`` or more.

    ``places`` are ranges of the text's words.
    """
    if isinstance(templates, DataFrame):
        named = templates.select(F.col("name").cast("string").alias("name"), "text").where("name is not null and text is not null")
        passes = ceil(named.count() / MOST_TEMPLATES)
        part = lambda k: [(r["name"], r["text"]) for r in named.where(F.pmod(F.xxhash64("name", "text"), F.lit(passes)) == k).collect()]
        scans = [scan_licenses(docs, part(k), least, id_col, text_col) for k in range(passes)]
        return reduce(DataFrame.unionByName, scans) if scans else scan_licenses(docs, {}, least, id_col, text_col)
    spans = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        scan = Scanner(templates, least)
        for batch in batches:
            rows = [(r, *x) for r, t in enumerate(batch.column(1).to_pylist()) if t for x in scan(t)]
            if rows:
                at, name, cover, n, where = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(name), pa.array(cover), pa.array(n, pa.int32()), pa.array(where, spans)], names=["doc", "license", "coverage", "n_words", "places"])

    out = base.mapInArrow(run, f"doc {docs.schema[id_col].dataType.simpleString()}, license string, coverage double, n_words int, places array<struct<begin: int, `end`: int>>")
    return out.withColumnRenamed("doc", id_col)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
