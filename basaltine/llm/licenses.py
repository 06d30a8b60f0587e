"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates and documents are word sequences. Hashes of ``gram`` consecutive words are winnowed: of every
``window`` of them the smallest stays, so any run of gram + window - 1 shared words shares a
fingerprint. An inverted index of the templates' fingerprints gives, for a document, templates
and diagonals; around each diagonal the template is aligned with the document in a band, and the
share of its words that match (coverage) and the matched span are reported. Short templates differ from
each other by a name or version only, so these must stand in the match.

Templates are a parameter, sent to all tasks; their total size is checked against ``MOST``.

Edge cases: null and empty texts match nothing; a template shorter than a gram is an error; repeated
rows stay; several occurrences of one template are several rows; of overlapping matches the best stays; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import os
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, blocks, map_arrow, mix, seeds, utf8, words

#: Bytes of templates at most.
MOST = 32 << 20

# Usual notices and texts of licenses, by SPDX identifier and form.
TEMPLATES = {
    "Apache-2.0:line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0:header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause:conditions": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "CC-BY-4.0:line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0:line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0:line": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0:line": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0:line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0:header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT:line": "Released under the MIT License.",
    "MIT:grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0:header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "AGPL-3.0:header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "AGPL-3.0:line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-2-Clause:line": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause:line": "Licensed under the BSD 3-Clause License.",
    "BSL-1.0:line": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-NC-4.0:notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0:notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0:notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0:notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-4.0:notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "EPL-2.0:header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0:header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0:notice": "This work is licensed under the GNU General Public License, version 2.",
    "ISC:line": "Licensed under the ISC License.",
    "LGPL-2.1:header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0:header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0:line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT:notice": "Licensed under the MIT License.",
    "MPL-2.0:line": "Licensed under the Mozilla Public License, Version 2.0.",
}

# Whole texts lie in license_texts, a file for each SPDX identifier.
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")


def built_in() -> dict[str, str]:
    """The built-in lines, headers and whole texts."""
    out = dict(TEMPLATES)
    for name in sorted(os.listdir(TEXTS)):
        with open(os.path.join(TEXTS, name), encoding="utf-8") as f:
            out[f"{name.removesuffix('.txt')}:text"] = f.read()
    return out


# What tells a short template from others of its wording. Each phrase, or one of its
# alternatives, must stand whole in the match. A short template without an entry must match whole.
_GPL, _AGPL, _LGPL = "GNU General Public License", "GNU Affero General Public License", "GNU Lesser General Public License"
MARKS = {
    "AGPL-3.0:header": [_AGPL, "version 3 of the License"],
    "AGPL-3.0:line": [f"{_AGPL} version 3|{_AGPL} v3|{_AGPL} v 3"],
    "Apache-2.0:line": ["Apache License Version 2.0|Apache License 2.0|Apache License v2.0|Apache License v 2.0"],
    "Apache-2.0:header": ["Apache License Version 2.0|Apache License 2.0|Apache License v2.0|Apache License v 2.0"],
    "CC-BY-4.0:line": ["Creative Commons Attribution 4.0"],
    "CC-BY-NC-4.0:line": ["CC BY-NC 4.0"],
    "CC-BY-SA-4.0:line": ["CC BY-SA 4.0"],
    "EPL-2.0:header": ["Eclipse Public License 2.0|Eclipse Public License v 2.0|Eclipse Public License v2.0"],
    "GPL-2.0:header": [_GPL, "version 2 of the License"],
    "GPL-2.0:notice": [f"{_GPL} version 2|{_GPL} v2|{_GPL} v 2"],
    "GPL-2.0:line": [_GPL, "version 2 of the License"],
    "GPL-3.0:line": [f"{_GPL} version 3|{_GPL} v3|{_GPL} v 3"],
    "GPL-3.0:header": [_GPL, "version 3 of the License"],
    "LGPL-2.1:header": [_LGPL, "version 2.1 of the License"],
    "LGPL-3.0:header": [_LGPL, "version 3 of the License"],
    "LGPL-3.0:line": [f"{_LGPL} version 3|{_LGPL} v3|{_LGPL} v 3"],
    "MIT:line": ["MIT License"],
    "MPL-2.0:header": ["Mozilla Public License v 2.0|Mozilla Public License version 2.0|Mozilla Public License v2.0"],
}
#: Words of a short template at most.
SHORT = 16


def hashed(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text."""
    h, _, _, first = words(*utf8(pa.array(texts, pa.string())), ALNUM)
    return [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def holds(text: np.ndarray, phrase: np.ndarray) -> bool:
    """Whether the phrase's words stand in the text, one after another."""
    n = len(text) - len(phrase) + 1
    return n > 0 and bool(np.logical_and.reduce([text[j : j + n] == w for j, w in enumerate(phrase)]).any())


def fingerprints(h: np.ndarray, first: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed hashes of word sequences that begin at ``first`` (n + 1), and the first word of each."""
    n = len(h) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rolled = np.zeros(n, np.uint64)
    for j, k in enumerate(seeds(gram, 31)):
        rolled += h[j : j + n] * k
    rolled = mix(rolled)
    owner = np.searchsorted(first, np.arange(len(h)), "right") - 1
    whole = owner[:n] == owner[gram - 1 :]  # within one sequence
    kept = np.zeros(n, bool)
    top = ~np.uint64(0)
    value = np.where(whole, rolled, top)
    # A window that crosses an end is the shorter one of its sequence.
    for shift in range(-(window - 1), 1):
        low = np.full(n, top)
        for j in range(window):
            at = np.arange(n) + shift + j
            good = (at >= 0) & (at < n)
            good[good] &= owner[at[good]] == owner[:n][good]
            low[good] = np.minimum(low[good], value[at[good]])
        start, stop = np.arange(n) + shift, np.arange(n) + shift + window - 1
        size = np.diff(first)[owner[:n]] - gram + 1
        inside = (start >= first[owner[:n]]) & (stop < first[owner[:n]] + size)
        kept |= whole & (value == low) & (inside | (size < window))
    at = np.flatnonzero(kept)
    return rolled[at], at


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int, int]:
    """Best local alignment of the template at ``shift`` in the text, at most ``band`` words off the diagonal.

    Matches score 2, mismatches and gaps -1. Returns matched words, first and end word in the text, score.
    """
    width = 2 * band + 1
    before = [(0, 0, 0)] * (width + 1)  # score, matched, first word
    best = (0, 0, 0, 0)
    for i, word in enumerate(template.tolist()):
        row = [(0, 0, 0)] * (width + 1)
        for d in range(width):
            j = i + shift + d - band
            if not 0 <= j < len(text):
                continue
            s, m, f = before[d]
            same = text[j] == word
            options = [(s + 2, m + 1, f if s else j) if same else (s - 1, m, f)]
            if d + 1 < width:
                s, m, f = before[d + 1]
                options.append((s - 1, m, f))
            if d:
                s, m, f = row[d - 1]
                options.append((s - 1, m, f))
            top = max(options, key=lambda x: (x[0], x[1]))
            if top[0] > 0:
                row[d] = top
                if top[0] > best[0]:
                    best = (*top, j + 1)
        before = row
    return best[1], best[2], best[3], best[0]


def reachable(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> int:
    """How many of the template's words stand in the text within the band: no alignment there matches more."""
    near = np.zeros(len(template), bool)
    for d in range(shift - band, shift + band + 1):
        a, b = max(0, -d), min(len(template), len(text) - d)
        if a < b:
            near[a:b] |= template[a:b] == text[a + d : b + d]
    return int(near.sum())


class Index:
    """Templates, and an inverted index from fingerprint to (template, word)."""

    def __init__(self, templates: dict[str, str], gram: int, window: int, marks: dict[str, list[str]] | None = None):
        if sum(len(t.encode()) for t in templates.values()) > MOST:
            raise ValueError(f"templates of more than {MOST} bytes")
        self.names, self.gram, self.window = list(templates), gram, window
        h, _, _, first = words(*utf8(pa.array(list(templates.values()), pa.string())), ALNUM)
        if len(templates) and np.diff(first).min() < gram:
            raise ValueError(f"a template has fewer than {gram} words")
        self.words = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        marks = MARKS if marks is None else marks
        self.marks = [[hashed(m.split("|")) for m in marks.get(n, [templates[n]] if len(w) <= SHORT else [])] for n, w in zip(self.names, self.words, strict=True)]
        value, at = fingerprints(h, first, gram, window)
        order = np.argsort(value, kind="stable")
        self.value, at = value[order], at[order]
        self.template = np.searchsorted(first, at, "right") - 1
        self.place = at - first[self.template]

    def occurrences(self, t: int, text: np.ndarray, shift: np.ndarray, place: np.ndarray, coverage: float, band: int) -> list[tuple[int, int, int]]:
        """(matched, first word, end word) of a template's matches in a text, from the diagonals and words of shared fingerprints.

        Diagonals with most fingerprints come first; each is aligned in the words that no earlier match took,
        as long as a fingerprint of it lies there.
        """
        mine, spans, out = self.words[t], [], []
        shifts, which, many = np.unique(shift, return_inverse=True, return_counts=True)
        for k in np.lexsort((shifts, -many)):
            s, left = int(shifts[k]), np.unique(place[which == k]).tolist()
            while left:
                j = bisect_right(spans, (left[0], len(text)))
                low, high = spans[j - 1][1] if j else 0, spans[j][0] if j < len(spans) else len(text)
                if left[0] < low:
                    left.pop(0)
                    continue
                a, b = max(low, s - band), min(high, s + len(mine) + band)
                matched = begin = end = 0
                if a < b and reachable(mine, text[a:b], s - a, band) >= coverage * len(mine):
                    matched, begin, end, _ = align(mine, text[a:b], s - a, band)
                found = text[a + begin : a + end]
                if matched and matched >= coverage * len(mine) and all(any(holds(found, x) for x in m) for m in self.marks[t]):
                    spans.insert(j, (a + begin, a + end))
                    out.append((matched, a + begin, a + end))
                else:
                    left = [p for p in left if p >= high]
        return out

    def scan(self, h: np.ndarray, first: np.ndarray, coverage: float, band: int) -> list[tuple[int, int, float, int, int, int]]:
        """(document, template, coverage, matched, first word, end word) of all matches."""
        value, at = fingerprints(h, first, self.gram, self.window)
        low, high = np.searchsorted(self.value, value), np.searchsorted(self.value, value, "right")
        many = high - low
        if not many.sum():
            return []
        k = np.arange(many.sum()) + np.repeat(high - np.cumsum(many), many)
        doc = np.repeat(np.searchsorted(first, at, "right") - 1, many)
        place = np.repeat(at, many) - first[doc]
        template, shift = self.template[k], place - self.place[k]
        order = np.lexsort((template, doc))
        doc, template, shift, place = (x[order] for x in (doc, template, shift, place))
        edges = [0, *(np.flatnonzero((np.diff(doc) != 0) | (np.diff(template) != 0)) + 1).tolist(), len(doc)]
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            d, t = int(doc[a]), int(template[a])
            for matched, begin, end in self.occurrences(t, h[first[d] : first[d + 1]], shift[a:b], place[a:b], coverage, band):
                out.append((d, t, matched / len(self.words[t]), matched, begin, end))
        # Of overlapping matches the one with most matched words, then the best coverage, stays.
        kept: dict[int, list] = {}
        for m in sorted(out, key=lambda m: (-m[3], -m[2], m[4], m[1])):
            mine = kept.setdefault(m[0], [])
            if not any(m[4] < o[5] and o[4] < m[5] for o in mine):
                mine.append(m)
        return sorted((m for mine in kept.values() for m in mine), key=lambda m: (m[0], m[4], m[5]))


def scan(documents: DataFrame, templates: dict[str, str] | None = None, gram: int = 3, window: int = 3, coverage: float = 0.8, band: int = 8, marks: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, license, coverage, matched, start_word, end_word, start, end): a row for each match.

    ``marks`` are the phrases, by template, that a match must hold whole; see MARKS.
    start and end are UTF-8 byte offsets of the matched span.
    """
    given = built_in() if templates is None else templates
    shared = documents.sparkSession.sparkContext.broadcast(Index(given, gram, window, marks))
    names = ["doc_id", "license", "coverage", "matched", "start_word", "end_word", "start", "end"]

    def run(batches):
        index = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in blocks(offsets):
                h, starts, ends, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
                rows = index.scan(h, first, coverage, band)
                if rows:
                    doc, t, share, matched, begin, end = zip(*rows, strict=True)
                    base = [int(offsets[a + d] - offsets[a]) for d in doc]
                    span = [(int(starts[first[d] + x]) - o, int(ends[first[d] + y - 1]) - o) for d, x, y, o in zip(doc, begin, end, base, strict=True)]
                    yield pa.record_batch([batch.column(0).take(pa.array([a + d for d in doc])), pa.array([index.names[x] for x in t]), pa.array(share), *(pa.array([int(v) for v in x], pa.int64()) for x in (matched, begin, end, [s for s, _ in span], [e for _, e in span]))], names)

    long = [T.StructField(n, T.LongType()) for n in names[3:]]
    schema = T.StructType([documents.schema["doc_id"], T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), *long])
    return map_arrow(documents.select("doc_id", "text"), run, schema)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of the built-in templates in all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
