"""License scan by patience alignment.

A template is looked for around its words that are rarest in the text: a match of
the wanted coverage lacks so few of the template's words that it must hold one
of them.  Each such place gives a stretch of text a little longer than the
template, and the two are aligned: equal ends are trimmed, words that are unique
in both are anchors, of which the longest increasing subsequence stays, and
the gaps between anchors are aligned the same way.  Coverage is the share of
the template's words that are aligned.  All of it is within a row; the
templates are a fixed list, and texts without a template's words cost one lookup
a word.

Cases: null and empty texts have no match; a license that occurs several
times is one row with the number of matches that don't overlap, and the place of
the first best; repeated rows and null ids are rows like others; an empty table
gives no row; other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WordHasher
from .decontam import NOT_WORD

# License notices and texts looked for, by SPDX identifier and form.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT line": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops, at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _once(words: list) -> dict:
    seen, twice = {}, set()
    for i, w in enumerate(words):
        if w in seen:
            twice.add(w)
        seen[w] = i
    return {w: i for w, i in seen.items() if w not in twice}


def align(text: list, template: list, at: int = 0, to: int = 0) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), by patience: ends, unique common words, then the gaps."""
    out, end = [], []
    a, b, c, d = 0, len(text), 0, len(template)
    while a < b and c < d and text[a] == template[c]:
        out.append((at + a, to + c))
        a, c = a + 1, c + 1
    while b > a and d > c and text[b - 1] == template[d - 1]:
        b, d = b - 1, d - 1
        end.append((at + b, to + d))
    if a < b and c < d:
        one, two = _once(text[a:b]), _once(template[c:d])
        common = sorted((two[w], one[w]) for w in two if w in one)
        anchors = [common[i] for i in longest_increasing([p for _, p in common])]
        if anchors:
            x, y = a, c
            for j, i in [*anchors, (d - c, b - a)]:
                out += align(text[x:a + i], template[y:c + j], at + x, to + y)
                if i < b - a:
                    out.append((at + a + i, to + c + j))
                x, y = a + i + 1, c + j + 1
    return out + end[::-1]


class Scanner:
    """Matches of all templates in a text's words."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.hasher, self.coverage = WordHasher(space=NOT_WORD), coverage
        self.templates = {name: self.words(t) for name, t in templates.items()}
        self.vocabulary = np.unique(np.concatenate(list(self.templates.values())))
        self.holds = np.zeros((len(self.templates), len(self.vocabulary)), bool)
        for r, w in enumerate(self.templates.values()):
            self.holds[r, np.searchsorted(self.vocabulary, w)] = True
        self.least = self.holds.sum(1) - np.array([len(w) - self.needed(len(w)) for w in self.templates.values()])

    def needed(self, m: int) -> int:
        """Words of a template of ``m`` words that must be aligned: the coverage, and all of a line of under ten."""
        return m if m < 10 else math.ceil(self.coverage * m - 1e-9)

    def words(self, text: str) -> np.ndarray:
        return self.hasher(np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8))[0]

    def __call__(self, text: str | None) -> list[tuple]:
        """(template, coverage, first word, last word, matches) of each template that is there."""
        w = self.words(text) if text else np.empty(0, np.uint64)
        if not len(w):
            return []
        k = np.searchsorted(self.vocabulary, w)
        k[k == len(self.vocabulary)] = 0
        known = np.flatnonzero(self.vocabulary[k] == w)
        times = np.bincount(k[known], minlength=len(self.vocabulary))
        enough = np.flatnonzero((self.holds & (times > 0)).sum(1) >= self.least)
        out = []
        for r in enough:
            name = list(self.templates)[r]
            got = self._matches(w, known, k, times, self.templates[name], r)
            if got:
                best = max(got, key=lambda m: (m[0], -m[1]))
                out.append((name, *best, len(got)))
        return out

    def _matches(self, w, known, k, times, template, r) -> list[tuple[float, int, int]]:
        m = len(template)
        words, counts = np.unique(template, return_counts=True)
        v = np.searchsorted(self.vocabulary, words)
        order = np.lexsort((v, times[v]))
        # the rarest words that together are more of the template than a match may lack
        lacking = m - self.needed(m)
        rare = v[order[:int(np.searchsorted(np.cumsum(counts[order]), lacking, side="right")) + 1]]
        places = known[np.isin(k[known], rare)]
        slack, got = max(2, m // 4), []
        tl = template.tolist()
        where: dict[int, list[int]] = {}
        for i, x in enumerate(tl):
            where.setdefault(x, []).append(i)
        tried = set()
        for p in places.tolist():
            for i in where[int(w[p])]:
                lo = max(0, p - i - slack)
                if p - i in tried:
                    continue
                tried.add(p - i)
                pairs = align(w[lo:p - i + m + slack].tolist(), tl, lo)
                if len(pairs) >= self.needed(m):
                    got.append((len(pairs) / m, pairs[0][0], pairs[-1][0]))
        # best first; what is chosen lies apart, so only the last that starts before a match ends can meet it
        apart, starts = [], []
        for c in sorted(got, key=lambda g: (-g[0], g[2] - g[1], g[1])):
            at = bisect_right(starts, c[2])
            if not at or apart[at - 1][2] < c[1]:
                starts.insert(at, c[1])
                apart.insert(at, c)
        return apart


def scan(docs: DataFrame, coverage: float = 0.8, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) and license found: doc_id, license, coverage, first_word, last_word, matches."""
    chosen = templates or TEMPLATES
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()),
                           *[T.StructField(n, T.LongType()) for n in ("first_word", "last_word", "matches")]])

    def run(batches):
        scanner = Scanner(chosen, coverage)
        for b in batches:
            rows = [(doc, *m) for doc, text in zip(b.column(0).to_pylist(), b.column(1)) for m in scanner(text.as_py())]
            if rows:
                kinds = (b.schema.field(0).type, pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
