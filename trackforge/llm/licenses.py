"""License scan: Dice coefficient over word bigrams against templates.

A template is sought in every window of consecutive words: with A and B the sets
of word bigrams, a window matches when ``2 |A & B| / (|A| + |B|) >= LEAST``.  The
best window of each template counts.

Bounds leave few comparisons.  A match shares at least ``LEAST / (2 - LEAST)``
of the template's bigrams, so one look at the bigrams of a whole text (hashes, no
strings) names the templates it can hold at all; most texts end there.  A window
can only be best if it starts with the last and ends with the first occurrence
of bigrams it shares with the template, and its set is at most the inverse of
that share larger than the template's; so each occurrence ends few windows, and
repeated lines cost no more than others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .shared import table

LEAST = 0.8
#: fixed values: license ids and the wording of their usual notices
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def words(text: str) -> list[str]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; A-Z folded."""
    return [w.translate(_LOWER) for w in WORD.findall(text)]


_LOWER = {c: c + 32 for c in range(65, 91)}


def bigrams(ws: list[str]) -> set[tuple[str, str]]:
    return set(zip(ws, ws[1:], strict=False))


@dataclass(frozen=True)
class Match:
    license: str
    template: int
    start: int  # code points
    end: int
    score: float


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], least: float = LEAST):
        self.names = [n for n, _ in templates]
        self.sets = [bigrams(words(t)) for _, t in templates]
        self.least, share = least, least / (2 - least)
        self.low = [max(1, int(np.ceil(share * len(s) - 1e-9))) for s in self.sets]
        self.high = [int(len(s) / share + 1e-9) for s in self.sets]
        # hashed bigrams of all templates, and which template holds which
        hashed = [self._hashes(t) for _, t in templates]
        self.known = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, K.U64)
        self.holds = np.array([np.isin(self.known, h) for h in hashed], np.int64).reshape(len(hashed), len(self.known))

    @staticmethod
    def _bigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        buf, offs = K.text_bytes(column)
        starts, ends, rows = K.word_spans(buf, offs, K.ALNUM)
        h = K.word_hashes(buf, starts, ends)
        pair = K.mix(h[:-1] * K.U64(0xD6E8FEB86659FD93) + h[1:])
        same = rows[1:] == rows[:-1]
        return pair[same], rows[:-1][same]

    def _hashes(self, text: str) -> np.ndarray:
        return np.unique(self._bigrams(pa.array([text]))[0])

    def possible(self, column: pa.Array) -> dict[int, list[int]]:
        """Templates that each text may hold, by the bigrams of the whole text."""
        pair, rows = self._bigrams(column)
        if not len(self.known) or not len(pair):
            return {}
        at = np.minimum(np.searchsorted(self.known, pair), len(self.known) - 1)
        hit = self.known[at] == pair
        seen = np.unique(rows[hit] * len(self.known) + at[hit])
        out: dict[int, list[int]] = {}
        owner = seen // len(self.known)
        for row, ids in zip(*_groups(owner, seen % len(self.known)), strict=True):
            shared = self.holds[:, ids].sum(axis=1)
            if able := np.flatnonzero(shared >= self.low).tolist():
                out[row] = able
        return out

    def scan(self, text: str, able: list[int]) -> list[Match]:
        """The best window of words for each template that matches: highest score,
        then earliest, then shortest."""
        spans = [m.span() for m in WORD.finditer(text)]
        ws = [text[a:b].translate(_LOWER) for a, b in spans]
        # bigram p is words p and p + 1; earlier[p] is its occurrence before, or -1
        pairs = list(zip(ws, ws[1:], strict=False))
        earlier, last = np.full(len(pairs), -1, np.int64), {}
        for p, pair in enumerate(pairs):
            earlier[p] = last.get(pair, -1)
            last[pair] = p
        out = []
        for t in able:
            best = self._best(pairs, earlier, t)
            if best:
                score, a, b = best
                end = spans[b + 1][1]
                end += text[end : end + 1] in (".", "!", "?")  # the sentence's own
                out.append(Match(self.names[t], t, spans[a][0], end, score))
        return out

    def _best(self, pairs: list[tuple[str, str]], earlier: np.ndarray, t: int) -> tuple[float, int, int] | None:
        """Score, first and last bigram of the best window."""
        want, high = self.sets[t], self.high[t]
        best: tuple[float, int, int] | None = None
        recent: dict[tuple[str, str], int] = {}  # where each shared bigram was seen last, latest at the end
        for end, pair in enumerate(pairs):
            if pair not in want:
                continue
            was = recent.pop(pair, -1)
            recent[pair] = end
            common = 0
            for start in reversed(recent.values()):
                if start <= was:
                    break  # the window would do without this end
                common += 1
                got = int(np.count_nonzero(earlier[start : end + 1] < start))
                if got > high:
                    break
                score = 2 * common / (got + len(want))
                if score >= self.least and (best is None or (score, -start, -end) > (best[0], -best[1], -best[2])):
                    best = (score, start, end)
        return best


def strongest(matches: list[Match]) -> list[Match]:
    """One match per license, and none that overlaps a better one (similar wordings)."""
    kept: list[Match] = []
    for m in sorted(matches, key=lambda m: (-m.score, m.license, m.start)):
        if all(m.license != k.license and (m.end <= k.start or m.start >= k.end) for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m.license)


def _groups(owner: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    return owner[edge].tolist(), np.split(values, edge[1:]) if len(edge) else []


SCHEMA = "doc_id long, n_licenses long, licenses string, best_license string, best_score double, matches array<struct<license:string,start:long,end:long,score:double>>"


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """``docs(doc_id, text, ...)`` to one row per row: the licenses found, sorted and
    comma-joined, the best one (ties: first by name), and where each was found.

    Null, empty and other texts without a match have no licenses, no best one and
    score 0.  A null doc_id stays null, repeated rows are scanned one by one, and an
    empty table gives no rows.  Texts are scanned whole; of equal scores the earlier
    window, then the shorter counts, and licenses with equal scores on overlapping
    windows go by name.  Other columns are not read.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, least)
        item = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for whole in batches:
            for batch in K.slices(whole, "text"):
                able = scanner.possible(batch.column("text"))
                found: list[list[Match]] = [[] for _ in range(batch.num_rows)]
                for row, names in able.items():
                    found[row] = strongest(scanner.scan(batch.column("text")[row].as_py(), names))
                top = [max(f, key=lambda m: m.score) if f else None for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(f) for f in found], pa.int64()),
                        pa.array([",".join(m.license for m in f) for f in found], pa.string()),
                        pa.array([m and m.license for m in top], pa.string()),
                        pa.array([m.score if m else 0.0 for m in top], pa.float64()),
                        pa.array([[{"license": m.license, "start": m.start, "end": m.end, "score": m.score} for m in f] for f in found], pa.list_(item)),
                    ],
                    names=["doc_id", "n_licenses", "licenses", "best_license", "best_score", "matches"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``find_licenses`` in the whole documents table; nulls, ties and repeated rows as
    there."""
    return find_licenses(table(spark, sf_dir, "documents"))
