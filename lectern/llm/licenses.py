"""License scans: fingerprints pick candidates, alignment reports what is covered.

Templates are cut into word k-grams; winnowing keeps the smallest hash of each
window, and an inverted index maps it to its places. Short notices keep every
gram, the shortest also every pair of words. Where a text has an
indexed gram, the template is aligned to the text in a band around that
diagonal. The alignment gives the covered share of the template and the span.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow

#: Notices as their licenses or common usage word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
)
GRAM, WINDOW, BAND = 3, 3, 8
#: Templates below so many words are not winnowed; those up to so many have pairs: 6 of 8 words may leave no three in a row.
SHORT, SHORTEST = 20, 8
#: Least share of a template's words that a match covers.
MIN_COVERAGE = 0.75
_WORD = re.compile(r"[^\W_]+")


class Match(NamedTuple):
    """``start`` and ``end`` are code points of the text, end exclusive."""

    license: str
    template: int
    coverage: float
    matched: int
    start: int
    end: int


def align(text: list[int], template: list[int], diagonal: int, band: int) -> tuple[int, int, int, int]:
    """Best local alignment with text place - template place within ``band`` of ``diagonal``.

    Returns (score, matched words, first text place, place after the last);
    a match counts 1, a mismatch or gap -1. Ties go to more matched words, then
    to the earlier start.
    """
    none = (0, 0, 0)
    above: dict[int, tuple[int, int, int]] = {}  # by diagonal, of the previous text place: (score, matched, -start)
    best, end = none, 0
    for i, word in enumerate(text):
        row: dict[int, tuple[int, int, int]] = {}
        for d in range(min(diagonal + band, i), max(diagonal - band, i - len(template) + 1) - 1, -1):
            score, matched, start = above.get(d, none)
            if template[i - d] == word:
                cell = (score + 1, matched + 1, start if score else -i)
            else:
                skip = max((score - 1, matched, start), *[(s - 1, m, b) for s, m, b in (above.get(d - 1, none), row.get(d + 1, none))])
                cell = skip if skip[0] > 0 else none
            if cell[0]:
                row[d] = cell
                if cell > best:
                    best, end = cell, i + 1
        above = row
    return best[0], best[1], -best[2], end


class Index:
    """The winnowed fingerprints of the templates and where they stand; of fixed size."""

    def __init__(self, templates=TEMPLATES, gram: int = GRAM, window: int = WINDOW):
        texts = [[w.lower() for w in _WORD.findall(text)] for _, text in templates]
        self.names, self.gram = [name for name, _ in templates], gram
        self.number = {w: i for i, w in enumerate(sorted({w for words in texts for w in words}))}
        self.templates = [[self.number[w] for w in words] for words in texts]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.templates):
            keys = self.keys(np.array(words, dtype=np.int64)).tolist()
            hashes = [(key * 0x9E3779B97F4A7C15 >> 13) % (1 << 40) for key in keys]
            picked = {min(range(at, at + window), key=lambda j: (hashes[j], -j)) for at in range(len(keys) - window + 1)}
            for j in range(len(keys)) if len(words) < SHORT else sorted(picked):
                self.places[keys[j]].append((t, j))
            if len(words) <= SHORTEST:
                for j, key in enumerate(self.keys(np.array(words, dtype=np.int64), 2).tolist()):
                    self.pairs[key].append((t, j))
        self.fingerprints = np.array(sorted(self.places), dtype=np.int64)
        self.pair_keys = np.array(sorted(self.pairs), dtype=np.int64)

    def keys(self, words: np.ndarray, gram: int | None = None) -> np.ndarray:
        """A number per k-gram, -1 where a word is in no template."""
        gram = gram or self.gram
        n = len(words) - gram + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        parts = [words[j : n + j] for j in range(gram)]
        key = np.zeros(n, dtype=np.int64)
        for part in parts:
            key = key * len(self.number) + part
        return np.where(np.min(parts, axis=0) < 0, -1, key)

    def hits(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(place in the text, template, place in the template) of indexed grams, in the order of the text."""
        found = set()
        for keys, known, places in ((self.keys(words), self.fingerprints, self.places), (self.keys(words, 2), self.pair_keys, self.pairs)):
            found |= {(i, t, j) for i in np.flatnonzero(np.isin(keys, known)).tolist() for t, j in places[int(keys[i])]}
        return sorted(found)

    def scan(self, text: str, min_coverage: float = MIN_COVERAGE, band: int = BAND) -> list[Match]:
        """Matches in the order of the text; of those that overlap, the best score stays."""
        found = _WORD.findall(text.lower())
        words = np.fromiter(map(self.number.get, found, repeat(-1)), dtype=np.int64, count=len(found))
        hits = self.hits(words)
        if not hits:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        if len(spans) != len(found):  # lower-casing has changed the words' borders
            found = [text[a:b].lower() for a, b in spans]
            words = np.fromiter(map(self.number.get, found, repeat(-1)), dtype=np.int64, count=len(found))
            hits = self.hits(words)
        seeds = defaultdict(list)
        for i, t, j in hits:
            seeds[t].append((i, i - j))
        candidates = []
        for t, places in seeds.items():
            template = self.templates[t]
            regions: list[list[int]] = []  # diagonal, last seed
            for i, d in places:
                near = next((r for r in reversed(regions[-8:]) if abs(d - r[0]) <= band // 2 and i - r[1] <= len(template)), None)
                if near:
                    near[1] = i
                else:
                    regions.append([d, i])
            for d, _ in regions:
                low, high = max(0, d - band), min(len(words), d + len(template) + band)
                score, matched, start, end = align(words[low:high].tolist(), template, d - low, band)
                if matched >= min_coverage * len(template):
                    candidates.append((-score, low + start, low + end, t, matched))
        kept: list[tuple] = []
        for score, start, end, t, matched in sorted(set(candidates)):
            if all(end <= k[1] or start >= k[2] for k in kept):
                kept.append((score, start, end, t, matched))
        return [
            Match(self.names[t], t, matched / len(self.templates[t]), matched, spans[start][0], spans[end - 1][1])
            for _, start, end, t, matched in sorted(kept, key=lambda k: k[1])
        ]


MATCHES = "array<struct<license:string,template:int,coverage:double,matched:int,start:int,end:int>>"


def matches(text: Column, templates=TEMPLATES, min_coverage: float = MIN_COVERAGE) -> Column:
    """The matches in a text column; a null or empty text has none."""

    @F.pandas_udf(MATCHES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(templates)
        for batch in batches:
            yield pd.Series([[m._asdict() for m in index.scan(t, min_coverage)] if t else [] for t in batch], dtype=object)

    return run(text)


def scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, min_coverage: float = MIN_COVERAGE
) -> DataFrame:
    """A row per match: id, license, template (its place in the list), coverage, matched (words), start, end.

    Whole texts are scanned; repeated rows repeat their matches.
    """
    rows = narrow(df, id=id_col, text=text_col).select("id", matches(F.col("text"), templates, min_coverage).alias("found"))
    return rows.select(F.col("id").alias(id_col), F.explode("found").alias("m")).select(id_col, "m.*")
