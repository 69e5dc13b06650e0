"""Word arrays over Arrow string batches, shared by the operators on words.

A batch of texts is treated as one byte array.  Words are maximal runs of bytes
outside ``\\x20\\x09-\\x0D``; A-Z is lower-cased for hashing.  Everything is
vectorised: a word's hash is a difference of prefix sums of a polynomial over
its bytes, so no Python object is made per word.  Work goes in pieces of about
``PIECE`` bytes cut at word boundaries, which bounds memory whatever the batch
or the longest text is; only the word arrays themselves grow with the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)          # odd, so it has an inverse modulo 2**64
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse for i < n (kept and grown per process)."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, PIECE + 4096)
        up = np.full(size, BASE, np.uint64)
        down = np.full(size, BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up), np.cumprod(down)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1 texts); a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return raw[lo:hi], offsets - lo


@dataclass
class Words:
    """Words of a batch: hash, byte start and end in ``raw``; ``first[d]`` is
    the index of text d's first word (n + 1 entries)."""
    raw: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))


def prefix_hash(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums P (n + 1) and powers, so that the bytes s..e-1 hash to
    ``(P[e] - P[s]) * up[s]`` wherever they stand."""
    up, down = powers(len(piece) + 1)
    p = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum(_BYTE[piece] * down[:-1], out=p[1:])
    return p, up


def words(col: pa.Array | pa.ChunkedArray, lower: bool = True) -> Words:
    """All words of a batch of texts."""
    raw, offsets = text_bytes(col)
    n = len(raw)
    hs, ss, es = [], [], []
    lo = 0
    while lo < n:
        hi = min(n, lo + PIECE)
        while hi < n:                       # end the piece at white space or at a text's start
            tail = _SPACE[raw[hi:hi + 4096]]
            cut = int(np.argmax(tail)) if tail.any() else -1
            k = np.searchsorted(offsets, hi, "left")
            start = int(offsets[k]) if k < len(offsets) else n
            if cut >= 0 or start <= hi + 4096:
                hi = min(hi + cut if cut >= 0 else n, start if start >= hi else n)
                break
            hi = min(n, hi + 4096)
        piece = raw[lo:hi]
        inside = np.zeros(len(piece) + 2, bool)
        inside[1:-1] = ~_SPACE[piece]
        edge = np.zeros(len(piece) + 1, bool)   # a text starts here
        a, b = np.searchsorted(offsets, [lo, hi], "left")
        edge[offsets[a:b] - lo] = True
        s = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        e = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        p, up = prefix_hash(_LOWER[piece] if lower else piece)
        hs.append(mix((p[e] - p[s]) * up[s] + (e - s).astype(np.uint64)))
        ss.append(s + lo)
        es.append(e + lo)
        lo = hi
    cat = (lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t))
    starts = cat(ss, np.int64)
    return Words(raw, offsets, cat(hs, np.uint64), starts, cat(es, np.int64),
                 np.searchsorted(starts, offsets, "left").astype(np.int64))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles (repeats kept, text order) and the n + 1
    bounds per text; a text with 1 to k - 1 words has its whole sequence as
    its one shingle, a text without words none."""
    counts = np.diff(w.first)
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(per, out=first[1:])
    total = int(first[-1])
    if not total:
        return np.zeros(0, np.uint64), first
    doc = np.repeat(np.arange(len(counts)), per)
    at = np.arange(total) - first[doc] + w.first[doc]     # first word of each shingle
    size = np.minimum(counts, k)[doc]
    out = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            has = size > j
            if has.all():
                out = mix(out * BASE + w.hashes[at + j])
            else:
                out[has] = mix(out[has] * BASE + w.hashes[at[has] + j])
    return out, first


def row_slices(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes (one row at least)."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        out.append((lo, hi))
        lo = hi
    return out
