"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document when at least ``threshold`` of its
distinct ``k``-word shingles occur in the document.  Items are partitioned by
their number of shingles; for each size class the documents' shingle sequences
are cut into overlapping windows of a matching size, so that containment in a
window turns into a Jaccard similarity with a known lower bound, however long
the document is.  MinHash values of a window come from block minima that the
next class halves (one pass of hashing for all classes).  Windows and items
that agree on a band are candidates; the candidates' shingles are then counted
exactly, as words, in the whole document.

The items are read in blocks of at most about ``ITEM_BYTES`` of text, so what a
task holds is bounded whatever the benchmark's size; every block meets every
document in a map-only pass, without a shuffle.  Nothing is sampled or capped.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as T
from .storage import total_bytes

PERMUTATIONS = 64
ITEM_BYTES = 8 << 20
SLICE = 4 << 20
MISS = 1e-5                         # largest chance that a contained item shares no band
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_AZ = {c: c + 32 for c in range(65, 91)}
FACTORS = T.mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * T.BASE) | T.U(1)


def word_shingles(text: str | None, k: int) -> list[tuple[str, ...]]:
    """``k``-word shingles of a text, in order (the whole sequence if shorter)."""
    w = WORD.findall((text or "").translate(_AZ))
    return [tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def band_rows(threshold: float) -> int:
    """Rows per band: the most with which an item contained at ``threshold`` in
    a window of four times its size misses all bands with chance <= MISS.  A
    threshold for which not even one row does is an error (with the 0.8 of the
    queries it is met)."""
    j = threshold / (1 + 4 - threshold)
    if (1 - j) ** PERMUTATIONS > MISS:
        raise ValueError(f"containment {threshold} can't be found with a miss of at most {MISS} by {PERMUTATIONS} permutations")
    rows = 1
    while (1 - j ** (rows + 1)) ** (PERMUTATIONS // (rows + 1)) <= MISS:
        rows += 1
    return rows


def size_class(n: int) -> int:
    """Smallest c with 2**c >= n."""
    return max(0, (n - 1).bit_length())


class Items:
    """Index of one block of items: per (shingle length, size class) the
    MinHash values of the items under every permutation."""

    def __init__(self, ids: list, texts: list[str], k: int, threshold: float):
        self.ids, self.threshold, self.rows = ids, threshold, band_rows(threshold)
        self.words = []
        self.groups: dict[int, dict[int, list[int]]] = {}
        for i, t in enumerate(texts):
            n = len(WORD.findall((t or "").translate(_AZ)))
            sh = word_shingles(t, k)
            self.words.append(set(sh))
            if sh:
                self.groups.setdefault(min(k, n), {}).setdefault(size_class(len(set(sh))), []).append(i)
        self.hashes: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
        for kk, classes in self.groups.items():
            members = [i for m in classes.values() for i in m]
            w = T.words(pa.array([texts[i] for i in members], pa.large_string()))
            h, first = T.shingles(w, kk)
            for j, i in enumerate(members):
                self.hashes[i] = np.unique(h[first[j]:first[j + 1]])
        self.tables = {}
        for kk, classes in self.groups.items():
            for c, members in classes.items():
                mins = np.stack([(self.hashes[i][:, None] * FACTORS).min(axis=0) for i in members], axis=1)
                self.tables[kk, c] = (bands(mins, self.rows), np.array(members))
        keys = sum(t.size for t, _ in self.tables.values())
        self.bits = max(16, (64 * max(1, keys) - 1).bit_length())
        self.filters = {}
        for key, (t, members) in self.tables.items():
            seen = np.zeros(1 << min(self.bits, 24), bool)
            seen[(t & T.U(len(seen) - 1)).astype(np.int64).reshape(-1)] = True
            self.filters[key] = seen
            order = np.argsort(t, axis=1)
            self.tables[key] = (np.take_along_axis(t, order, 1), members[order])


def bands(mins: np.ndarray, rows: int) -> np.ndarray:
    """Band keys (bands x columns) of MinHash values (permutations x columns)."""
    if rows == 1:
        return mins
    out = np.zeros((len(mins) // rows, mins.shape[1]), np.uint64)
    for r in range(rows):
        out = T.mix(out * T.BASE + mins[r:len(out) * rows:rows])
    return out


def candidates(items: Items, h: np.ndarray, first: np.ndarray, k: int) -> set[tuple[int, int]]:
    """(document, item) pairs that agree on a band of some window."""
    out: set[tuple[int, int]] = set()
    wanted = sorted(c for kk, c in items.tables if kk == k)
    n = np.diff(first)
    if not wanted or not len(h):
        return out
    levels = []                                       # (class, block starts, last-block marks, owners)
    for c in range(wanted[-1] + 1):
        blocks = -(-n // (1 << c))
        owner = np.repeat(np.arange(len(n)), blocks)
        base = np.concatenate([[0], np.cumsum(blocks)])
        levels.append((blocks, owner, base))
    for r0 in range(0, PERMUTATIONS - items.rows + 1, items.rows):
        rows = []
        for r in range(r0, r0 + items.rows):
            v = h * FACTORS[r]
            low = wanted[0]
            blocks, owner, base = levels[low]
            start = first[:-1][owner] + ((np.arange(len(owner)) - base[owner]) << low)
            m = np.minimum.reduceat(v, start)
            per = {}
            for c in range(low, wanted[-1] + 1):
                if c > low:
                    blocks, owner, base = levels[c]
                    below = levels[c - 1][2]
                    m = np.minimum.reduceat(m, below[owner] + 2 * (np.arange(len(owner)) - base[owner]))
                if c in wanted:
                    w = m.copy()
                    same = owner[1:] == owner[:-1]
                    w[:-1] = np.where(same, np.minimum(m[:-1], m[1:]), m[:-1])
                    per[c] = w
            rows.append(per)
        for c in wanted:
            key = rows[0][c] if items.rows == 1 else bands(np.stack([x[c] for x in rows]), items.rows)[0]
            seen = items.filters[k, c]
            at = np.flatnonzero(seen[(key & T.U(len(seen) - 1)).astype(np.int64)])
            if not len(at):
                continue
            table, members = items.tables[k, c]
            t, who = table[r0 // items.rows], members[r0 // items.rows]
            lo, hi = np.searchsorted(t, key[at], "left"), np.searchsorted(t, key[at], "right")
            owner = levels[c][1]
            for i in np.flatnonzero(hi > lo).tolist():
                d = int(owner[at[i]])
                out.update((d, int(x)) for x in who[lo[i]:hi[i]])
    return out


def _hits(items: Items, whole: pa.RecordBatch, threshold: float):
    """(row, item, shingles of the item, shingles found) of a batch."""
    _, offsets = T.text_bytes(whole.column("text"))
    for lo, hi in T.row_slices(offsets, SLICE):
        texts = whole.column("text").slice(lo, hi - lo)
        w = T.words(texts)
        for kk in sorted(items.groups):
            h, first = T.shingles(w, kk)
            # texts below kk words hold no run of kk words
            short = np.diff(w.first) < kk
            if short.any():
                h = h[np.repeat(~short, np.diff(first))]
                first = np.concatenate([[0], np.cumsum(np.where(short, 0, np.diff(first)))])
            by_doc: dict[int, list[int]] = {}
            for d, i in sorted(candidates(items, h, first, kk)):
                mine = items.hashes[i]
                if np.isin(mine, h[first[d]:first[d + 1]]).sum() >= threshold * len(mine) - 1e-9:
                    by_doc.setdefault(d, []).append(i)
            for d, found in by_doc.items():
                have = set(word_shingles(texts[d].as_py(), kk))
                for i in found:
                    n, m = len(items.words[i]), len(items.words[i] & have)
                    if m >= threshold * n - 1e-9:
                        yield lo + d, i, n, m


def _search(block: list[tuple], k: int, threshold: float):
    def run(batches):
        items = Items([i for i, _ in block], [t for _, t in block], k, threshold)
        for whole in batches:
            ids = whole.column("doc_id")
            out = [(ids[d].as_py(), items.ids[i], n, m, m / n) for d, i, n, m in _hits(items, whole, threshold)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                ["doc_id", "item_id", "n_shingles", "n_found", "containment"])
    return run


def _without(block: list[tuple], k: int, threshold: float):
    def run(batches):
        items = Items([i for i, _ in block], [t for _, t in block], k, threshold)
        for whole in batches:
            keep = np.ones(whole.num_rows, bool)
            keep[[d for d, *_ in _hits(items, whole, threshold)]] = False
            yield whole.filter(pa.array(keep))
    return run


def item_blocks(items: DataFrame):
    """The items in parts of at most about ``ITEM_BYTES`` of text, one at a time."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, math.ceil(total_bytes(items, "text") / ITEM_BYTES))
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield sorted(((r["item_id"], r["text"]) for r in mine), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per (document row, test item) with containment of ``threshold``
    or more: doc_id, item_id, n_shingles (of the item), n_found, containment.

    Words are runs outside white space, A-Z lower-cased; an item of fewer than
    ``k`` words is looked for as one run of its words.  Null and blank texts or
    items match nothing; repeated rows each give their rows; null ids are
    carried as nulls; other columns are ignored; empty tables give an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [docs.mapInArrow(_search(block, k, threshold), "doc_id long, item_id long, n_shingles long, n_found long, containment double")
             for block in item_blocks(items)]
    return reduce(DataFrame.unionByName, parts)


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (all their columns) that contain no item: one
    map-only filter per block of items, so no text is shuffled.  Each row is
    judged by its own text, whatever its doc_id; null and empty texts stay."""
    for block in item_blocks(items):
        docs = docs.mapInArrow(_without(block, k, threshold), docs.schema)
    return docs
