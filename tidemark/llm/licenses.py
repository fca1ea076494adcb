"""License scans: winnowed fingerprints pick templates, banded alignment reports what matches.

Templates are cut into grams of GRAM words, hashed, and winnowed: of each WINDOW neighbouring hashes
the smallest stays, so any run of GRAM + WINDOW - 1 words that a text shares with a template shares a
fingerprint. The inverted index leads from a text's fingerprints to templates and diagonals; along
each candidate diagonal a local alignment of words within a band gives the matched words and span.

A text can share a fingerprint only if it holds some word of its gram, so texts that hold none of the
anchors, one word of each gram in the index, are passed over without being cut into words. Along a
diagonal whose band holds too few of a template's words to reach `least`, nothing is aligned.

Defined results: null and empty texts match nothing; repeated rows match alike; null ids are passed
through; an empty table gives no rows. Where matches of several templates overlap, the one with more
matched words stays, then the one with the higher coverage, then the first name; a template of fewer than
GRAM words matches nothing; other columns give way.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Set

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import common

GRAM, WINDOW, BAND = 3, 2, 8
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = re.compile(r"[a-z0-9]+")

#: The opening notices of public licenses, as their stewards publish them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Words that other texts hold as well: an anchor only where a gram has no other.
_COMMON = frozenset("a above all author can code copies style your and any are at be by can for following free in is may not of on or other that the this to under use with without work you person met found source files 0 2 3 4".split())


def _hashes(words: list[str]) -> list[int]:
    return [zlib.crc32(" ".join(words[i : i + GRAM]).encode()) for i in range(len(words) - GRAM + 1)]


def winnow(hashes: list[int]) -> list[int]:
    """Places of the fingerprints: the rightmost smallest hash of each window."""
    n = max(1, len(hashes) - WINDOW + 1)
    return sorted({min(range(i, min(i + WINDOW, len(hashes))), key=lambda k: (hashes[k], -k)) for i in range(n)}) if hashes else []


class Index:
    """Templates' words and fingerprints, and one word of each fingerprint's gram that few texts hold."""

    def __init__(self, templates: dict[str, str]):
        self.words = {name: _WORD.findall(t.lower()) for name, t in templates.items()}
        self.places: dict[int, list[tuple[str, int]]] = defaultdict(list)
        often = Counter(w for ws in self.words.values() for w in set(ws))
        anchors = set()
        for name, words in self.words.items():
            h = _hashes(words)
            for i in winnow(h):
                self.places[h[i]].append((name, i))
                # The commonest of the telling words: few anchors then cover all grams.
                gram = words[i : i + GRAM]
                rare = [w for w in gram if w not in _COMMON]
                anchors.add(max(rare, key=lambda w: (often[w], len(w), w)) if rare else max(gram, key=lambda w: (len(w), w)))
        self.anchors = sorted(anchors)

    def need(self, name: str, least: float) -> int:
        """Fewest matched words whose share of a template is at least `least`."""
        n = len(self.words[name])
        return next(m for m in range(1, n + 2) if m > n or m / n >= least)

    def may_match(self, lower: str) -> bool:
        return any(a in lower for a in self.anchors)


def align(text: list[str], template: list[str], diagonal: int, need: int = 0, taken: Set[int] = frozenset()) -> tuple[int, int, int, int]:
    """(score, matched words, first and end word of text) of the best local alignment within BAND of a diagonal.

    diagonal is the place in text less the place in template. Alignments of fewer than need words are
    passed over, and none leads through a word of text that is taken.
    """
    best = (0, 0, 0, 0)
    width = 2 * BAND + 1
    above: list[tuple[int, int, int]] = [(0, 0, 0)] * (width + 1)  # score, matched, first
    for t, word in enumerate(template):
        row: list[tuple[int, int, int]] = []
        left = (0, 0, 0)
        for k in range(width):
            at = t + diagonal + k - BAND
            if not 0 <= at < len(text) or at in taken:
                left = (0, 0, at + 1)
                row.append(left)
                continue
            s, m, f = above[k]
            same = text[at] == word
            options = [(s + (MATCH if same else MISMATCH), m + same, f if s > 0 else at)]
            if above[k + 1][0]:
                options.append((above[k + 1][0] + GAP, *above[k + 1][1:]))
            if left[0]:
                options.append((left[0] + GAP, *left[1:]))
            left = max(options, key=lambda x: (x[0], x[1]))
            if left[0] <= 0:
                left = (0, 0, at + 1)
            row.append(left)
            if left[1] >= need and (left[0], left[1]) > best[:2]:
                best = (left[0], left[1], left[2], at + 1)
        above = [*row, (0, 0, 0)]
    return best


def _in_band(places: dict[str, list[int]], template: list[str], diagonal: int) -> int:
    """Words of a template that the text has within BAND of their place on the diagonal: no alignment there matches more."""
    n = 0
    for t, word in enumerate(template):
        own = places.get(word)
        if own:
            k = bisect_left(own, t + diagonal - BAND)
            n += k < len(own) and own[k] <= t + diagonal + BAND
    return n


def matches(text: str | None, index: Index, least: float) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, start, end) in text order; code points, end exclusive."""
    lower = (text or "").lower()
    if not index.may_match(lower):
        return []
    if len(lower) != len(text or ""):  # a letter whose lower case is longer: places have to stay true
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
    spans = [m.span() for m in _WORD.finditer(lower)]
    words = [lower[a:b] for a, b in spans]
    # Every gram is looked up: a superset of the text's own winnowed fingerprints, so edits lose none.
    seeds: dict[str, set[int]] = defaultdict(set)
    for at, h in enumerate(_hashes(words)):
        for name, place in index.places.get(h, ()):
            seeds[name].add(at - place)
    if not seeds:
        return []
    places: dict[str, list[int]] = defaultdict(list)
    for at, word in enumerate(words):
        places[word].append(at)
    found = []
    for name, diagonals in seeds.items():
        template = index.words[name]
        need = index.need(name, least)
        covered = -(10**9)
        for d in sorted(diagonals):
            if d - covered <= BAND // 2:
                continue  # within the band of the one before
            covered = d
            if _in_band(places, template, d) < need:
                continue
            # The band may hold the notice more than once: what is found is taken, until no more is.
            own: set[int] = set()
            while (best := align(words, template, d, need, own))[1]:
                _, matched, first, end = best
                found.append((name, matched / len(template), matched, first, end))
                own.update(range(first, end))
    # Of overlapping ones the best stays: what stays is disjoint, so its neighbours alone can overlap.
    found.sort(key=lambda f: (-f[2], -f[1], f[0], f[3]))
    starts: list[int] = []
    kept: dict[int, tuple] = {}
    for f in found:
        k = bisect_left(starts, f[4])
        if k and kept[starts[k - 1]][4] > f[3]:
            continue
        starts.insert(k, f[3])
        kept[f[3]] = f
    return [(n, c, m, spans[a][0], spans[b - 1][1]) for n, c, m, a, b in (kept[a] for a in starts)]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """One row per match: doc_id, license, coverage, matched_words, start, end.

    templates: texts by name, whole licenses or notices of them; TEMPLATES if none are given.
    """
    shared = docs.sparkSession.sparkContext.broadcast(templates or TEMPLATES)
    schema = common.schema_with(docs, "doc_id", license="string", coverage="double", matched_words="long", start="long", end="long")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for batch in batches:
            rows = [(doc, *f) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) for f in matches(text.as_py(), index, least)]
            cols = list(zip(*rows)) if rows else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, arrow.types)], names=arrow.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
