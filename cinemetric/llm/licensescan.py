"""Licence scan: winnowed template fingerprints and banded alignment.

Templates are cut into words; the hashes of all ``GRAM``-word runs are winnowed
(the smallest of each ``WINNOW`` neighbours) and kept in an inverted index, hash
to (template, position).  All runs of a document are looked up, so a shared
stretch as long as one winnowing window is always met.  Hits of a template on
nearby diagonals are a candidate; a banded alignment of the template's words
with the text's words around the hits gives the matched words, their coverage
of the template and the span.

The index is a fixed list of templates (or the caller's), small enough to ship
with the task; documents are scanned in one map-only pass.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as T

GRAM = 2
WINNOW = 2
BAND = 6
COVERAGE = 0.8
SLICE = 4 << 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# fixed values: short public licence notices
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "LGPL": "This library is licensed under the GNU Lesser General Public License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def plain(word: str) -> str:
    """A word for alignment: lower case, without marks at its ends."""
    return word.lower().strip(".,;:!?\"'()[]")


def winnowed(h: np.ndarray) -> np.ndarray:
    """Positions of the winnowed fingerprints of a run of hashes."""
    if len(h) <= WINNOW:
        return np.array([int(np.argmin(h))]) if len(h) else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(h, WINNOW)
    return np.unique(np.arange(len(windows)) + WINNOW - 1 - np.argmin(windows[:, ::-1], axis=1))


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [[plain(x) for x in WORD.findall(templates[n])] for n in self.names]
        w = T.words(pa.array([" ".join(x) for x in self.words], pa.large_string()))
        h, first = T.shingles(w, GRAM)
        rows = [(int(h[first[t] + p]), t, int(p)) for t in range(len(self.names)) for p in winnowed(h[first[t]:first[t + 1]])]
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.places = [(r[1], r[2]) for r in rows]


def align(template: list[str], text: list[str], shift: int) -> tuple[int, int, int]:
    """Longest common word sequence of the template and the text in a band of
    diagonals around ``shift`` (text position of the template's start):
    (matched, first, last + 1 matched text word)."""
    best: dict[int, tuple[int, int, int]] = {}
    n = len(text)
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        left = (0, n, 0)
        for j in range(max(0, shift + i - BAND), min(n, shift + i + BAND + 1)):
            up = best.get(j, (0, n, 0))
            cell = max(left, up, key=lambda c: (c[0], c[1] - c[2]))
            if text[j] == word:
                d = best.get(j - 1, (0, n, 0))
                hit = (d[0] + 1, d[1] if d[0] else j, j + 1)
                cell = max(cell, hit, key=lambda c: (c[0], c[1] - c[2]))
            row[j] = left = cell
        # the band moves right by one; cells that leave it carry their best value
        edge = max((c for k, c in best.items() if k not in row), default=None, key=lambda c: (c[0], c[1] - c[2]))
        if edge and row:
            k = min(row)
            row[k] = max(row[k], edge, key=lambda c: (c[0], c[1] - c[2]))
        best = row or best
    return max(best.values(), default=(0, 0, 0), key=lambda c: (c[0], c[1] - c[2]))


def matches(index: Index, text: str, hits: list[tuple[int, int, int]], coverage: float) -> list[tuple[str, int, int, int, float]]:
    """(template, start, end, matched words, coverage) of a text from its hits
    (template, template position, text word); code points, one row per place."""
    spans = [m.span() for m in WORD.finditer(text)]
    out = []
    by: dict[int, list[int]] = {}
    for t, p, j in hits:
        by.setdefault(t, []).append(j - p)
    for t, shifts in sorted(by.items()):
        words = index.words[t]
        need = max(1, len(words))
        near: list[tuple[int, int]] = []        # word ranges found that later diagonals may meet

        def found(s: int, lo: int, hi: int) -> tuple[int, int] | None:
            if hi - lo < coverage * need - 1e-9:
                return None
            got, a, b = align(words, [plain(text[x:y]) for x, y in spans[lo:hi]], s - lo)
            if not got or got < coverage * need - 1e-9:
                return None
            if (lo + a, lo + b) not in near:
                near.append((lo + a, lo + b))
                out.append((index.names[t], spans[lo + a][0], spans[lo + b - 1][1], got, got / need))
            return lo + a, lo + b

        for s in sorted(set(shifts)):
            lo, hi = max(0, s - BAND), min(len(spans), s + len(words) + BAND)
            near = [r for r in near if r[1] > lo]
            found(s, lo, hi)
            # what the ranges found leave of the window may hold another copy
            free, at = [], lo
            for a, b in sorted(near):
                free.append((at, min(a, hi)))
                at = max(at, b)
            free.append((at, hi))
            while free:
                x, y = free.pop()
                r = found(s, x, y)
                if r:
                    free += [(x, r[0]), (r[1], y)]
    # templates that are parts or variants of each other: the best coverage of a place stays
    out.sort(key=lambda r: (-r[3], -r[4], r[1], r[0]))
    kept: list[tuple] = []
    places: list[tuple[int, int]] = []
    for r in out:
        i = bisect.bisect(places, (r[1], r[2]))
        if (i == 0 or places[i - 1][1] <= r[1]) and (i == len(places) or r[2] <= places[i][0]):
            places.insert(i, (r[1], r[2]))
            kept.append(r)
    return sorted(kept, key=lambda r: (r[1], r[0]))


def _normal(batch: pa.RecordBatch) -> pa.Array:
    """Texts without the marks that ``plain`` strips from word ends; words of
    marks alone stay, so words keep their numbers."""
    import pyarrow.compute as pc
    t = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    return pc.replace_substring_regex(t, r"([^\s.,;:!?\"'()\[\]])[.,;:!?\"'()\[\]]+(\s|$)", r"\1\2")


def _scan(templates: dict[str, str], coverage: float):
    def run(batches):
        index = Index(templates)
        for whole in batches:
            _, offsets = T.text_bytes(whole.column("text"))
            out = []
            for lo, hi in T.row_slices(offsets, SLICE):
                batch = whole.slice(lo, hi - lo)
                w = T.words(_normal(batch))
                h, first = T.shingles(w, GRAM)
                at = np.searchsorted(index.keys, h)
                at = np.flatnonzero(index.keys[np.minimum(at, len(index.keys) - 1)] == h) if len(index.keys) else np.zeros(0, np.int64)
                doc = np.searchsorted(first, at, "right") - 1
                for d in np.unique(doc).tolist():
                    hits = []
                    for j in at[doc == d].tolist():
                        k = int(np.searchsorted(index.keys, h[j]))
                        while k < len(index.keys) and index.keys[k] == h[j]:
                            hits.append((*index.places[k], j - int(first[d])))
                            k += 1
                    out += [(batch.column("doc_id")[d].as_py(), *m) for m in matches(index, batch.column("text")[d].as_py(), hits, coverage)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)],
                                             ["doc_id", "license", "start", "end", "matched_words", "coverage"])
    return run


def licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per licence notice found: doc_id, license, start, end (code
    points, end exclusive), matched_words and coverage of the template; of
    overlapping notices the one with more matched words (of equal ones that with
    more coverage, then the earlier, then the first name).  Null and empty texts
    have none; repeated rows report alike; texts of any length are scanned whole;
    other columns, also of the result's names, are ignored; an empty table gives
    an empty result."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(dict(templates), coverage), "doc_id long, license string, start long, end long, matched_words long, coverage double")
