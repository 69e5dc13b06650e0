"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 5 bytes, with word bounds) and
itself, hashed into buckets with one embedding each.  The embeddings of a
window of words are averaged and a linear softmax over two classes scores the
window; a document scores as its most toxic window, so one insult in a long
text is not averaged away.  Embeddings and softmax are learned jointly: they
start from the buckets' log odds over documents, then every round takes the
highest-scoring windows of each document and descends the log loss.  A
misspelling that was never seen shares most n-grams with what was.

Because the softmax is linear in the average, scoring needs only one number per
bucket (embedding times the difference of the class weights); window averages
are differences of running sums.  Scoring is a map-only pass over whole texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as T
from .labelled import held_out, training_rows

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
WIDTH = 16
WINDOW = 3
TRAIN_ROWS = 12_000
ROUNDS = 12
SLICE = 1 << 20


def _spaced(w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with a space at both ends of every text, and the
    words' starts and ends in them."""
    n = len(w.first) - 1
    shift = 2 * np.repeat(np.arange(n), np.diff(w.offsets)) + 1
    out = np.full(len(w.raw) + 2 * n + 1, 32, np.uint8)
    out[np.arange(len(w.raw)) + shift] = np.where(T._SPACE[w.raw], 32, T._LOWER[w.raw])
    move = 2 * w.doc_of_words().astype(np.int64) + 1
    return out, w.starts + move, w.ends + move


def _pieces(starts: np.ndarray, ends: np.ndarray):
    """Word ranges of about a megabyte."""
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + T.PIECE, "right")))
        yield lo, hi
        lo = hi


def _bucket(h: np.ndarray) -> np.ndarray:
    return (T.mix(h) >> T.U(47)).astype(np.int64)


def word_sums(w: T.Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word the sum of its subwords' table values and their number."""
    text, starts, ends = _spaced(w)
    total = table[_bucket(w.hashes)].astype(np.float64)
    count = np.ones(len(starts))
    for lo, hi in _pieces(starts, ends):
        a, b = int(starts[lo]) - 1, int(ends[hi - 1]) + 1
        p, up = T.prefix_hash(text[a:b])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        for n in GRAMS:
            if b - a < n:
                continue
            h = (p[n:] - p[:-n]) * up[:b - a - n + 1] + T.U(n)
            run = np.concatenate([[0.0], np.cumsum(table[_bucket(h)], dtype=np.float64)])
            grams = np.maximum(e + 2 - n - (s - 1), 0)
            total[lo:hi] += run[np.minimum(s - 1 + grams, len(run) - 1)] - run[np.minimum(s - 1, len(run) - 1)]
            count[lo:hi] += grams
    return total, count


def word_buckets(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' subwords and the bounds per word."""
    text, starts, ends = _spaced(w)
    n = len(starts)
    grams = [np.maximum(ends - starts + 3 - g, 0) for g in GRAMS]
    per = 1 + sum(grams)
    first = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(int(first[-1]), np.int32)
    out[first[:-1]] = _bucket(w.hashes)
    at = first[:-1] + 1
    for lo, hi in _pieces(starts, ends):
        a, b = int(starts[lo]) - 1, int(ends[hi - 1]) + 1
        p, up = T.prefix_hash(text[a:b])
        for g, size in zip(GRAMS, grams):
            m = size[lo:hi]
            if b - a < g or not m.any():
                continue
            h = _bucket((p[g:] - p[:-g]) * up[:b - a - g + 1] + T.U(g))
            inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            out[np.repeat(at[lo:hi], m) + inner] = h[np.repeat(starts[lo:hi] - 1 - a, m) + inner]
            at[lo:hi] += m
    return out, first


def window_margins(total: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Average of every window (one per word: it and the next ones of its
    document), and each window's last word + 1."""
    n = np.diff(first)
    end = np.minimum(np.arange(len(total)) + WINDOW, np.repeat(first[1:], n))
    t, c = np.concatenate([[0], np.cumsum(total)]), np.concatenate([[0], np.cumsum(count)])
    at = np.arange(len(total))
    return (t[end] - t[at]) / (c[end] - c[at]), end


def fit(texts: list[str], y: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float, float]:
    """(value per bucket, bias of documents, margin of a document without
    words) learned from whole texts."""
    if not (y == 1).any():               # nothing toxic to learn from
        return np.zeros(BUCKETS, np.float32), -3.0, -3.0
    rng = np.random.default_rng(seed)
    w = T.words(pa.array(texts, pa.large_string()))
    names, at, word = np.unique(w.hashes, return_index=True, return_inverse=True)
    # one row of buckets per distinct word
    raw = w.raw
    distinct = T.words(pa.array([raw[s:e].tobytes() for s, e in zip(w.starts[at], w.ends[at])], pa.large_binary()).cast(pa.large_string()))
    sub, bound = word_buckets(distinct)
    size = np.diff(bound)
    first, doc = w.first, w.doc_of_words()
    pos, neg = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    seen = np.zeros((2, BUCKETS))
    for d in range(len(y)):
        mine = np.unique(word[first[d]:first[d + 1]])
        if len(mine):
            idx = np.repeat(bound[mine], size[mine]) + (np.arange(int(size[mine].sum())) - np.repeat(np.cumsum(size[mine]) - size[mine], size[mine]))
            seen[int(y[d])][np.unique(sub[idx])] += 1
    odds = np.log((seen[1] + 0.5) / pos) - np.log((seen[0] + 0.5 * neg / pos) / neg)
    # buckets met in few documents start near zero
    odds *= np.minimum(1, (seen[0] + seen[1]) / min(20, max(3, pos / 10)))
    e = rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32)
    e[:, 0] = np.clip(odds, -3, 5)
    soft = rng.normal(0, 0.05, (2, WIDTH)).astype(np.float32)
    soft[:, 0] = (-0.5, 0.5)
    bias = np.zeros(2, np.float32)
    ge, gs, gb = np.full((BUCKETS, 1), 0.1, np.float32), np.full((2, WIDTH), 0.1, np.float32), np.full(2, 0.1, np.float32)
    for turn in range(min(60, max(ROUNDS, 40_000 // max(1, len(y))))):       # few rows: more rounds
        value = e @ (soft[1] - soft[0])
        per_word = np.add.reduceat(value[sub], bound[:-1]) if len(names) else np.zeros(0)
        margin, end = window_margins(per_word[word].astype(np.float64), size[word].astype(np.float64), first)
        order = np.lexsort((-margin, doc))
        rank = np.arange(len(order)) - np.repeat(first[:-1], np.diff(first))
        chosen = order[rank < 2]                     # the two most toxic windows of each document
        if turn < 3:                                 # and some plain ones while the start is rough
            chosen = np.concatenate([chosen, rng.choice(len(margin), min(len(margin), len(chosen)), replace=False)])
            chosen = chosen[(y[doc[chosen]] == 0) | (margin[chosen] >= np.quantile(margin, 0.98))] if len(chosen) else chosen
        chosen = rng.permutation(chosen)
        weight = np.where(y[doc[chosen]] == 1, 0.5 * len(y) / pos, 0.5 * len(y) / neg)
        weight = np.minimum(weight, 6)
        for lo in range(0, len(chosen), 256):
            c = chosen[lo:lo + 256]
            wt = weight[lo:lo + 256]
            k = end[c] - c
            words_of = np.repeat(c - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            ids = word[words_of]
            m = size[ids]
            flat = sub[np.repeat(bound[ids] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
            row = np.repeat(np.repeat(np.arange(len(c)), k), m)
            n = np.bincount(row, minlength=len(c)).astype(np.float32)
            starts = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
            mean = np.add.reduceat(e[flat], starts) / n[:, None]
            z = mean @ soft.T + bias
            pr = np.exp(z - z.max(axis=1, keepdims=True))
            pr /= pr.sum(axis=1, keepdims=True)
            g = pr.astype(np.float32)
            g[np.arange(len(c)), y[doc[c]].astype(np.int64)] -= 1
            g *= (wt / len(c))[:, None].astype(np.float32)
            ds, db, dm = g.T @ mean, g.sum(axis=0), (g @ soft) / n[:, None]
            gs += ds * ds
            soft -= 0.05 * ds / np.sqrt(gs)
            gb += db * db
            bias -= 0.2 * db / np.sqrt(gb)
            u, inv = np.unique(flat, return_inverse=True)
            de = np.stack([np.bincount(inv, dm[row, f], minlength=len(u)) for f in range(WIDTH)], axis=1).astype(np.float32)
            ge[u] += (de * de).sum(axis=1, keepdims=True)
            e[u] -= 0.3 * de / np.sqrt(ge[u])
    value = (e @ (soft[1] - soft[0])).astype(np.float32)
    per_word = np.add.reduceat(value[sub], bound[:-1]) if len(names) else np.zeros(0)
    margin, _ = window_margins(per_word[word].astype(np.float64), size[word].astype(np.float64), first)
    top = np.full(len(y), np.nan)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        top[full] = np.maximum.reduceat(margin, first[:-1][full])
    # documents' own calibration: scale and shift of the top margin by a logistic fit
    a, b = 1.0, float(bias[1] - bias[0])
    ok = ~np.isnan(top)
    if ok.any() and 0 < y[ok].mean() < 1:
        mid, spread = float(np.median(top[ok])), float(top[ok].std() + 1e-6)
        x, t, a, b = (top[ok] - mid) / spread, y[ok], 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            h = p * (1 - p) + 1e-6
            ga, gb2 = float(((p - t) * x).sum() + 0.01 * a), float((p - t).sum())
            haa, hab, hbb = float((h * x * x).sum() + 0.01), float((h * x).sum()), float(h.sum())
            det = haa * hbb - hab * hab + 1e-9
            a, b = a - 0.5 * (hbb * ga - hab * gb2) / det, b - 0.5 * (haa * gb2 - hab * ga) / det
            a = min(max(a, 0.1), 12.0)
        a, b = a / spread, b - a * mid / spread
    return value * np.float32(a), float(b), float(np.log(pos / (pos + neg) / (1 - pos / (pos + neg))) - 2.0)


def _train(batches):
    pdf = pd.concat([*batches, pd.DataFrame({"doc_id": [], "y": [], "text": []})]).sort_values("doc_id")
    if not len(pdf):
        return
    value, b, empty = fit([t or "" for t in pdf["text"]], pdf["y"].to_numpy(np.int64))
    yield pd.DataFrame({"value": [value.tobytes()], "b": [b], "empty": [empty]})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = TRAIN_ROWS) -> tuple:
    """The model (a fixed number of bytes) from at most about ``limit``
    labelled rows outside the held-out third, trained in one task."""
    rows = training_rows(docs.select("doc_id", "text"), labels, label, limit) \
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("long").alias("y"), F.col("text").cast("string").alias("text"))
    got = rows.repartition(1).mapInPandas(_train, "value binary, b double, empty double").collect()
    if not got:                              # no labelled row: nothing is toxic
        return np.zeros(BUCKETS, np.float32), -3.0, -3.0
    got = got[0]
    return np.frombuffer(got["value"], np.float32), got["b"], got["empty"]


def _scores(model: tuple):
    value, b, empty = model

    def run(batches):
        for whole in batches:
            _, offsets = T.text_bytes(whole.column("_text"))
            out = [np.zeros(0)]
            for lo, hi in T.row_slices(offsets, SLICE):
                w = T.words(whole.column("_text").slice(lo, hi - lo))
                z = np.full(hi - lo, empty)
                full = np.flatnonzero(np.diff(w.first) > 0)
                if len(full):
                    margin, _ = window_margins(*word_sums(w, value), w.first)
                    z[full] = np.maximum.reduceat(margin, w.first[:-1][full]) + b
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield whole.drop_columns(["_text"]).append_column("score", pa.array(np.concatenate(out), pa.float64()))
    return run


def score(docs: DataFrame, model: tuple, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``score`` (0 to 1, higher: more toxic).  Null, empty
    and blank texts get the score of a text without words (below 0.5 unless
    most labelled texts are toxic); repeated rows score alike; an empty table
    gives an empty result."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(_scores(model), fields + ", score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", cut: float = 0.7) -> DataFrame:
    """Train and score: doc_id, held_out, score, predicted."""
    return score(docs, train(docs, labels, label), ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
