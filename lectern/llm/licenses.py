"""License scans: winnowed template fingerprints pick candidates, banded alignment judges them.

Templates are lower-cased words. Of the hashes of their ``gram`` consecutive words, the least of every
``window`` neighbours is a fingerprint (winnowing); the inverted index maps fingerprints to templates
and positions. Documents are looked up at every word, so a template's intact run of gram + window - 1
words is always met. Of templates of fewer words all runs are kept, as long as those that some run must
keep under the edits that ``coverage`` allows. Hits of a template whose diagonals lie
within the band are one candidate: its template is aligned, whole, to the words around (edit distance
with free ends in the document, within the band). Reported are matches whose share of equal template
words is at least ``coverage``, with their spans; of overlapping matches of one template the best stays.

The index is as large as the templates, which are a parameter; it travels with the task. Documents are
judged one by one, so no shuffle is needed and memory is bounded by one batch and one text.

Defined cases: a null text counts as empty and has no match; repeated rows are judged alike; null
doc_ids are kept; empty tables and empty template lists give an empty result; templates of fewer words
than ``gram`` are found by shorter runs; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Public statements and notices; callers may pass their own.
TEMPLATES = {
    "MIT-statement": "Released under the MIT License.",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies.""",
    "BSD-3-Clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
        from this software without specific prior written permission.""",
}
_WORD = re.compile(r"[^\W_]+")
_GAP = -1


def _hash(gram: tuple[int, ...], names: list[str]) -> int:
    return zlib.crc32(" ".join(names[i] for i in gram).encode())


class Index:
    """The inverted index of winnowed fingerprints."""

    def __init__(self, templates: dict[str, str], gram: int = 5, window: int = 4, coverage: float = 0.8):
        self.gram, self.names, self.words = gram, list(templates), []
        self.vocabulary: dict[str, int] = {}
        for text in templates.values():
            self.words.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in _WORD.findall(text.lower())])
        spelt = list(self.vocabulary)
        self.at: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, words in enumerate(self.words):
            short = len(words) < gram + window
            edits = int(len(words) * (1 - coverage) + 1e-9)
            n = min(gram, -(-(len(words) - edits) // (edits + 1))) if short else gram
            if not words:
                continue
            grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
            hashes = [_hash(g, spelt) for g in grams]
            span = 1 if short else window
            for i in {min(range(s, s + span), key=lambda j: (hashes[j], -j)) for s in range(len(grams) - span + 1)}:
                self.at[n][grams[i]].append((t, i))
        self.at = {n: dict(found) for n, found in self.at.items()}

    def candidates(self, ids: np.ndarray, band: float) -> list[tuple[int, int, int]]:
        """(template, first and last diagonal) of each group of near diagonals."""
        hits: dict[int, list[int]] = defaultdict(list)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for n, found in self.at.items():
            if len(ids) >= n:
                for p in np.flatnonzero(known[n:] - known[:-n] == n).tolist():
                    for t, i in found.get(tuple(ids[p:p + n].tolist()), ()):
                        hits[t].append(p - i)
        out = []
        for t, diagonals in hits.items():
            width = _band(len(self.words[t]), band)
            diagonals.sort()
            first = last = diagonals[0]
            for d in diagonals[1:]:
                if d - last > width:
                    out.append((t, first, last))
                    first = d
                last = d
            out.append((t, first, last))
        return out


def _band(n: int, share: float) -> int:
    return max(2, int(n * share))


def align(template: list[int], words: np.ndarray, slack: int) -> tuple[int, int, int] | None:
    """Edit distance of the whole template to any stretch of words, where position j of the words may
    face template position i if 0 <= j - i <= slack. Returns (equal words, first, last exclusive)."""
    n, m = len(template), len(words)
    big = n + m + 1
    cost = [[big] * (slack + 2) for _ in range(n + 1)]  # column d: j = i + d
    step = [[""] * (slack + 2) for _ in range(n + 1)]
    for d in range(slack + 1):
        if d <= m:
            cost[0][d] = 0
    for i in range(1, n + 1):
        for d in range(slack + 1):
            j = i + d
            best, how = cost[i - 1][d + 1] + 1, "t"  # template word without a partner
            if j <= m:
                equal = template[i - 1] == words[j - 1]
                if (c := cost[i - 1][d] + (not equal)) <= best:
                    best, how = c, "=" if equal else "x"
                if d and (c := cost[i][d - 1] + 1) < best:
                    best, how = c, "w"
            elif j - 1 > m:
                best = min(best, big)
            cost[i][d], step[i][d] = best, how
    d = min((d for d in range(slack + 1) if n + d <= m or cost[n][d] < big), key=lambda d: cost[n][d], default=None)
    if d is None or cost[n][d] >= big:
        return None
    i, equal, first, last = n, 0, None, None
    while i:
        how, j = step[i][d], i + d
        if how == "=":
            equal, first, last = equal + 1, j - 1, j if last is None else last
        if how in "=x":
            i -= 1
        elif how == "t":
            i, d = i - 1, d + 1
        else:
            d -= 1
    return (equal, first, last) if equal else None


def matches(text: str, index: Index, coverage: float, band: float) -> list[tuple[str, int, int, float]]:
    """(template, start, end, coverage) in code points, by start."""
    lowered = text.lower()
    # Where lower case changes the length, words are found in the text itself and lowered one by one.
    where = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)] if len(lowered) != len(text) else None
    words_of = _WORD.findall(lowered) if where is None else [w.lower() for w, _, _ in where]
    ids = np.array([index.vocabulary.get(w, _GAP) for w in words_of], np.int64)
    candidates = index.candidates(ids, band) if len(ids) else []
    if not candidates:
        return []
    places = [(m.start(), m.end()) for m in _WORD.finditer(lowered)] if where is None else [(s, e) for _, s, e in where]
    found: list[tuple[float, int, int, int]] = []
    for t, first, last in candidates:
        words = index.words[t]
        width = _band(len(words), band)
        # A group of diagonals wider than the band holds repeats of a short template; each step is aligned.
        for at in range(first, last + 1, width + 1):
            low = at - width  # before the text's first word stand gaps, so that a template may lack words there
            high = min(len(ids), min(last, at + width) + len(words) + width)
            around = np.concatenate([np.full(max(0, -low), _GAP), ids[max(0, low):high]])
            got = align(words, around, min(last, at + width) - at + 2 * width)
            if got and got[0] >= coverage * len(words):
                found.append((got[0] / len(words), t, low + got[1], low + got[2]))
    out: list[tuple[float, int, int, int]] = []
    for f in sorted(found, key=lambda f: (-f[0], f[2], f[1])):
        if not any(f[1] == o[1] and f[2] < o[3] and o[2] < f[3] for o in out):
            out.append(f)
    return sorted((index.names[t], places[a][0], places[b - 1][1], c) for c, t, a, b in out)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", coverage: float = 0.8, band: float = 0.15, gram: int = 5, window: int = 4) -> DataFrame:
    """One row per match: doc_id, license, start, end (code points, end exclusive), coverage."""
    index = Index(TEMPLATES if templates is None else templates, gram, window, coverage)

    def run(batches):
        for b in batches:
            rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for m in matches(t.as_py() or "", index, coverage, band)]
            cols = list(zip(*rows)) if rows else [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "license", "start", "end", "coverage"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, license string, start long, end long, coverage double"
    )


def query(spark, sf_dir):
    from .common import table

    return scan(table(spark, sf_dir, "documents"))
