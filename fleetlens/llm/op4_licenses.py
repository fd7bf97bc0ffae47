"""License scan: winnowed fingerprints find candidate templates, a banded alignment reports coverage and spans.

Templates and texts are compared as lower-case words (letters, digits, underscores). Of every ``WINNOW`` consecutive
hashes of ``GRAM`` words the smallest is a fingerprint, so any shared run of ``GRAM + WINNOW - 1`` words shares one (a template of fewer words has
shorter grams, for the same to hold of its whole). The
inverted index of the templates (bounded by their number, a parameter) goes to every task. Hits on about the same
diagonal make one candidate place, which a local alignment in a band around it confirms: coverage is the share of the
template's words that match, and the words that name the license must be among them.

Defined results: NULL and empty texts have no match; a repeated notice is reported at each place; of overlapping matches
the one with more matched words stays (then the higher coverage, then the template's order).
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import WordHashes, arrow_map, hashes_of, own_columns, shingle_hashes, table
from fleetlens.llm.registry import query

TOKEN = re.compile(r"\w+")
GRAM, WINNOW = 3, 2
BAND = 6
COVERAGE = 0.8

#: Notices in common use, as (name, words that name it, text).
TEMPLATES = [
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Licensed under the MIT License."),
    ("MIT", "permission granted free charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
     "this software and associated documentation files, to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "gnu general 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "gnu general 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "gnu general redistribute", "This program is free software: you can redistribute it and/or modify it under the "
     "terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "gnu lesser", "This library is free software; you can redistribute it and/or modify it under the terms of the "
     "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "affero 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "redistributions source", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met: Redistributions of source code must retain the above "
     "copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "bsd", "Released under the BSD License."),
    ("ISC", "permission purpose fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with "
     "or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "cc by nc 4", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "cc by sa 4", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "cc by 4", "Licensed under CC BY 4.0."),
    ("CC-BY", "creative commons attribution", "This work is licensed under a Creative Commons Attribution"),
    ("All rights reserved", "all rights reserved", "All rights reserved."),
    ("CC0-1.0", "cc0", "Released under CC0 1.0 Universal."),
]


@dataclass(frozen=True)
class Match:
    license: str
    template: int
    matched: int
    coverage: float
    first: int   # word numbers, the last excluded
    last: int


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: the smallest (rightmost) of every window of hashes; all of a shorter run's smallest."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    if n < WINNOW:
        return np.array([n - 1 - int(hashes[::-1].argmin())])
    at = np.arange(n - WINNOW + 1)
    best = at.copy()
    for j in range(1, WINNOW):
        best = np.where(hashes[at + j] <= hashes[best], at + j, best)
    return np.unique(best)


class Scanner:
    """Templates, their inverted index, and the scan of one text."""

    def __init__(self, templates=tuple(TEMPLATES)):
        self.known = WordHashes()
        self.names = [t[0] for t in templates]
        self.naming = [set(t[1].split()) for t in templates]
        self.words = [TOKEN.findall(t[2].lower()) for t in templates]
        # by gram length; every gram of a template is listed, the text's fingerprints decide which are looked up
        self.indexes: dict[int, tuple[dict[int, list[tuple[int, int]]], np.ndarray]] = {}
        listed: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for i, words in enumerate(self.words):
            gram = max(1, min(GRAM, len(words) - WINNOW + 1))
            for at, h in enumerate(shingle_hashes(hashes_of(words, self.known), gram)):
                listed[gram][int(h)].append((i, at))
        for gram, index in listed.items():
            self.indexes[gram] = dict(index), np.sort(np.array(list(index), np.uint64))

    def align(self, template: int, words: list[str], diagonal: int) -> Match | None:
        """Best local alignment of a template with words near the diagonal (word number less template number)."""
        pattern, width = self.words[template], 2 * BAND + 1
        # cell: (score, matched, first, last); the band's column c is word i + diagonal - BAND + c
        nothing = (0, 0, -1, -1)
        above, best = [nothing] * width, nothing
        naming: dict[int, None] = {}
        for i, word in enumerate(pattern):
            row, left = [], nothing
            for c in range(width):
                j = i + diagonal - BAND + c
                if not 0 <= j < len(words):
                    row.append(nothing)
                    left = nothing
                    continue
                d = above[c]
                if words[j] == word:
                    cell = (d[0] + 2, d[1] + 1, d[2] if d[0] > 0 else j, j + 1) if d[0] > 0 else (2, 1, j, j + 1)
                else:
                    cell = (d[0] - 1, *d[1:])
                up = above[c + 1] if c + 1 < width else nothing
                for other in (up, left):
                    if other[0] - 1 > cell[0]:
                        cell = (other[0] - 1, *other[1:])
                if cell[0] <= 0:
                    cell = nothing
                row.append(cell)
                left = cell
                if cell[1] > best[1] or cell[1] == best[1] and cell[0] > best[0]:
                    best = cell
            above = row
        if best[1] < COVERAGE * len(pattern) or not self.naming[template] <= set(words[best[2]:best[3]]):
            return None
        return Match(self.names[template], template, best[1], best[1] / len(pattern), best[2], best[3])

    def scan(self, text: str) -> list[Match]:
        words = TOKEN.findall(text.lower())
        hashed = hashes_of(words, self.known)
        diagonals: dict[int, list[int]] = defaultdict(list)
        for gram, (index, keys) in self.indexes.items():
            grams = shingle_hashes(hashed, gram) if len(words) >= gram else np.empty(0, np.uint64)
            places = winnowed(grams)
            if not len(places):
                continue
            looked = grams[places]
            hit = keys[np.minimum(np.searchsorted(keys, looked), len(keys) - 1)] == looked
            for place in places[hit]:
                for template, at in index[int(grams[place])]:
                    diagonals[template].append(int(place) - at)
        found = []
        for template, seen in diagonals.items():
            done, left = None, list(words)
            for d in sorted(set(seen)):
                if done is None or d > done + BAND // 2:
                    done = d
                    # a copy that begins inside the band is found once the words of the copy before it are taken
                    while match := self.align(template, left, d):
                        found.append(match)
                        left[match.first:match.last] = [""] * (match.last - match.first)
        found.sort(key=lambda m: (-m.matched, -m.coverage, m.template, m.first))
        kept: list[Match] = []
        for match in found:
            if all(match.last <= k.first or match.first >= k.last for k in kept):
                kept.append(match)
        return sorted(kept, key=lambda m: m.first)


SCHEMA = ("n_matches int, licenses array<string>, best_coverage double, matches array<struct<license: string, "
          "coverage: double, first_word: int, last_word: int, first_char: int, last_char: int>>")


def scan_licenses(docs: DataFrame, templates=tuple(TEMPLATES)) -> DataFrame:
    """doc_id, n_matches, licenses (distinct, sorted), best_coverage (NULL without a match) and matches in text order,
    with half-open spans in words and in characters."""
    slim = own_columns(docs, "doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def make():
        scanner = Scanner(templates)

        def step(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": batch.column("doc_id"), "n_matches": [], "licenses": [], "best_coverage": [], "matches": []}
            for value in batch.column("text"):
                text = value.as_py() or ""
                found = scanner.scan(text)
                spans = [m.span() for m in TOKEN.finditer(text)] if found else []
                if found and len(spans) != len(TOKEN.findall(text.lower())):
                    # a letter whose lower case is longer: character places of the lowered text
                    spans = [m.span() for m in TOKEN.finditer(text.lower())]
                out["n_matches"].append(len(found))
                out["licenses"].append(sorted({m.license for m in found}))
                out["best_coverage"].append(max((m.coverage for m in found), default=None))
                out["matches"].append([{
                    "license": m.license, "coverage": m.coverage, "first_word": m.first, "last_word": m.last,
                    "first_char": spans[m.first][0], "last_char": spans[m.last - 1][1]} for m in found])
            return out
        return step

    return arrow_map(slim, make, f"doc_id {kind}, {SCHEMA}")


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
