"""License scans: winnowed fingerprints of templates find candidates, banded alignment measures them.

Texts are cut into words of a-z, 0-9 and characters beyond ASCII, lower-cased.  Of the hashes of all ``k``-word runs of a template the
least in each ``window`` neighbours are its fingerprints (winnowing: any match of ``k + window - 1`` words holds one).  They form an
inverted index hash -> (template, place), whose size depends on the templates alone.  Every run of a document is looked up; hits name
a template and a diagonal, and around each group of near diagonals a banded alignment counts the template's words that the document
has in order.  A document reports each match with the share of the template that is covered and its span of words.

Defined results: a null or empty text matches nothing; texts are scanned whole; matches of one template that overlap in a document are
one, the best (the earliest of equals); equal rows match alike, each for itself; templates without words are an error; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilflow.llm.scratch import small_batches, tidied
from veilflow.llm.words import pieces, text_buffers, window_hashes, word_bounds, word_hashes

#: Notices and texts as their publishers give them, fixed values.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
}

_PLAIN = np.full(256, 32, dtype=np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def plain_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and the rows' word offsets."""
    data, offsets = text_buffers(column)
    data = _PLAIN[data]
    starts, ends, words = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), words


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash in each ``window`` neighbours, the rightmost of equals."""
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Most words of the template that stand in ``words`` in order within ``band`` of a diagonal; first and last of them (exclusive).

    Of alignments with as many words the one that ends nearest to the diagonal holds.
    """
    width = 2 * band + 1
    none = (0, -1, -1)
    before = [none] * (width + 1)
    for i, t in enumerate(template.tolist()):
        now = [none] * (width + 1)
        for d in range(width):
            j = i + diagonal + d - band
            best = none
            if 0 <= j < len(words) and int(words[j]) == t:
                n, s, _ = before[d]
                best = (n + 1, j if s < 0 else s, j + 1)
            if before[d + 1][0] > best[0]:
                best = before[d + 1]  # the template's word is missing
            if d and now[d - 1][0] > best[0]:
                best = now[d - 1]  # the document has a word more
            now[d] = best
        before = now
    return before[max(range(width), key=lambda d: (before[d][0], -abs(d - band)))]


class LicenseIndex:
    def __init__(self, templates: dict[str, str], k: int = 3, window: int = 2, band: int = 6):
        self.names, self.k, self.band = sorted(templates), k, band
        hashes, words = plain_hashes(pa.array([templates[n] for n in self.names]))
        self.templates = [hashes[a:b] for a, b in zip(words[:-1], words[1:], strict=True)]
        if any(len(t) < k for t in self.templates):
            raise ValueError(f"a template has fewer than {k} words")
        posts = [(int(g), t, int(p)) for t, w in enumerate(self.templates) for grams in [window_hashes(w, k)] for p in winnow(grams, window) for g in [grams[p]]]
        posts.sort()
        self.grams = np.array([p[0] for p in posts], np.uint64)
        self.posts = posts

    def scan(self, words: np.ndarray, least: float) -> list[tuple[str, int, float, int, int]]:
        """(template, matched words, coverage, first word, last word exclusive) of a document, in order of template and place."""
        grams = window_hashes(words, self.k)
        lo = np.searchsorted(self.grams, grams, "left")
        hits = np.flatnonzero((lo < len(self.grams)) & (self.grams[np.minimum(lo, len(self.grams) - 1)] == grams))
        seen: dict[int, set[int]] = {}
        for p in hits.tolist():
            i = int(lo[p])
            while i < len(self.posts) and self.posts[i][0] == int(grams[p]):
                seen.setdefault(self.posts[i][1], set()).add(p - self.posts[i][2])
                i += 1
        out = []
        for t, diagonals in sorted(seen.items()):
            found, last = [], None
            for d in sorted(diagonals):
                if last is not None and d - last <= self.band // 2:
                    continue
                last = d
                matched, start, end = align(self.templates[t], words, d, self.band)
                if matched >= least * len(self.templates[t]):
                    found.append((-matched, start, end))
            taken: list[tuple[int, int]] = []
            for negative, start, end in sorted(found):
                if all(end <= a or b <= start for a, b in taken):
                    taken.append((start, end))
                    out.append((self.names[t], -negative, round(-negative / len(self.templates[t]), 6), start, end))
        return sorted(out, key=lambda x: (x[0], x[3]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, k: int = 3, window: int = 2, band: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, matched_words, coverage, start_word and end_word (exclusive) of every match that covers ``least`` of a template."""
    small_batches(docs.sparkSession)
    index = LicenseIndex(templates or TEMPLATES, k, window, band)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashes, words = plain_hashes(batch.column(1))
            rows = [(r, *m) for r, (a, b) in enumerate(zip(words[:-1].tolist(), words[1:].tolist(), strict=True)) for m in index.scan(hashes[a:b], least)]
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            columns = [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.string()), (2, pa.int32()), (3, pa.float64()), (4, pa.int32()), (5, pa.int32()))]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "license", "matched_words", "coverage", "start_word", "end_word"])

    return base.mapInArrow(tidied(work), f"doc_id {kind}, license string, matched_words int, coverage double, start_word int, end_word int")
