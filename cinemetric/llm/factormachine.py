"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

A document is a sparse vector x: its distinct words hashed into buckets with
their share of the text, one active bin per structure statistic (case, symbols,
digits, repeats, line and word lengths, ...) and a bin of the metadata column.
The score is the logistic of ``b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``;
the pair sum is computed in linear time as half the sum over factors of
``(sum v x)**2 - sum (v x)**2``.  Training (Adagrad on the log loss) runs in one
task on a bounded sample of labelled rows; scoring is a map-only pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as T
from .labelled import held_out, training_rows

WORD_BUCKETS = 1 << 15
FACTORS = 8
TRAIN_ROWS = 12_000          # documents learned from, at most (about)
EPOCHS = 8
SLICE = 2 << 20
SHARES = np.array([0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9])
LOGS = np.arange(1, 21, dtype=np.float64)
BINS = 24
STATISTICS = ("upper", "symbols", "odd", "digits", "distinct", "same_as_before", "word_bytes", "words", "lines", "words_per_line",
              "bar_words", "symbol_ends", "repeats", "chars")
FEATURES = WORD_BUCKETS + BINS * len(STATISTICS)

_B = np.arange(256)
_ALNUM = ((_B >= 48) & (_B < 58)) | ((_B >= 65) & (_B < 91)) | ((_B >= 97) & (_B < 123)) | (_B >= 128)
_UPPER = (_B >= 65) & (_B < 91)
_LETTER = _ALNUM & ~((_B >= 48) & (_B < 58))
_DIGIT = (_B >= 48) & (_B < 58)
_SYMBOL = (_B > 32) & (_B < 127) & ~_ALNUM
_ODD = _SYMBOL & ~np.isin(_B, [ord(c) for c in ".,;:'\"-()?"])


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return run[offsets[1:]] - run[offsets[:-1]]


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int):
    """Distinct (document, key): documents, keys, counts; sorted by document."""
    order = np.argsort(T.mix(keys + doc.astype(np.uint64) * T.BASE), kind="stable")
    k, d = keys[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate([at, [len(k)]]))
    k, d = k[at], d[at]
    by_doc = np.argsort(d, kind="stable")
    return d[by_doc], k[by_doc], count[by_doc]


def features(texts: pa.Array, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a batch: feature ids, values and n + 1 bounds.  ``chars``
    is the metadata column (nan for null)."""
    w = T.words(texts)
    n = len(w.first) - 1
    words = np.diff(w.first)
    doc = w.doc_of_words()
    raw, off = w.raw, w.offsets
    size = np.diff(off)
    lines = _per_text(raw == 10, off) + 1
    d, k, c = _distinct(w.hashes, doc, n)
    distinct = np.bincount(d, minlength=n)
    same = np.zeros(len(w.hashes), bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])
    ends = _SYMBOL[raw[w.ends - 1]] & ~np.isin(raw[w.ends - 1], [44, 46, 59, 58, 63])
    bar = (w.ends - w.starts == 1) & (raw[w.starts] == 124)
    sh, first = T.shingles(w, 3)
    sdoc = np.repeat(np.arange(n), np.diff(first))
    once = np.bincount(_distinct(sh, sdoc, n)[0], minlength=n)
    per = lambda x: np.bincount(doc[x], minlength=n)
    total = np.maximum(words, 1)
    share = lambda x, of: np.searchsorted(SHARES, x / np.maximum(of, 1), "right")
    log = lambda x: np.searchsorted(LOGS, np.log2(np.maximum(x, 0) + 1), "right")
    bins = [share(_per_text(_UPPER[raw], off), _per_text(_LETTER[raw], off)), share(_per_text(_SYMBOL[raw], off), size),
            share(_per_text(_ODD[raw], off), size), share(_per_text(_DIGIT[raw], off), size), share(distinct, total),
            share(per(same), total), np.minimum(np.bincount(doc, w.ends - w.starts, minlength=n) / total, BINS - 1).astype(np.int64),
            log(words), log(lines), log(words / lines), share(per(bar), total), share(per(ends), total),
            share(np.diff(first) - once, np.maximum(np.diff(first), 1)),
            np.where(np.isnan(chars), BINS - 1, log(np.nan_to_num(chars)))]
    stat = np.stack([np.minimum(b, BINS - 1) + BINS * i for i, b in enumerate(bins)], axis=1) + WORD_BUCKETS
    value = c / np.sqrt(np.maximum(np.bincount(d, c.astype(np.float64) ** 2, minlength=n), 1))[d]
    rows = np.concatenate([d, np.repeat(np.arange(n), stat.shape[1])])
    order = np.argsort(rows, kind="stable")
    ids = np.concatenate([(k % T.U(WORD_BUCKETS)).astype(np.int64), stat.reshape(-1)])[order]
    vals = np.concatenate([value, np.full(stat.size, 0.3)])[order].astype(np.float32)
    return ids.astype(np.int32), vals, np.concatenate([[0], np.cumsum(distinct + stat.shape[1])])


def margins(model: tuple, ids: np.ndarray, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Factorisation machine margins of sparse rows (each with an entry)."""
    b, w, v = model
    if len(first) < 2:
        return np.zeros(0)
    vx = v[ids] * x[:, None]
    s = np.add.reduceat(vx, first[:-1])
    q = np.add.reduceat(vx * vx, first[:-1])
    return b + np.add.reduceat(w[ids] * x, first[:-1]) + 0.5 * (s * s - q).sum(axis=1)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(ids: np.ndarray, x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 5) -> tuple:
    """Adagrad on the log loss over mini-batches."""
    rng = np.random.default_rng(seed)
    w = np.zeros(FEATURES, np.float32)
    v = rng.normal(0, 0.02, (FEATURES, FACTORS)).astype(np.float32)
    gw, gv = np.full(FEATURES, 1e-2, np.float32), np.full((FEATURES, FACTORS), 1e-2, np.float32)
    mean = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    b = float(np.log(mean / (1 - mean)))
    sizes = np.diff(first)
    for epoch in range(min(100, max(EPOCHS, -(-2000 * 64 // max(1, len(y)))))):      # few rows: more passes
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 64):
            rows = order[lo:lo + 64]
            n = sizes[rows]
            bound = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(first[:-1][rows] - bound[:-1], n) + np.arange(bound[-1])
            i, xv = ids[at], x[at]
            g = (logistic(margins((b, w, v), i, xv, bound)) - y[rows]).astype(np.float32) / len(rows)
            b -= 0.1 * float(g.sum())
            ge = np.repeat(g, n)
            vx = v[i] * xv[:, None]
            s = np.repeat(np.add.reduceat(vx, bound[:-1]), n, axis=0)
            u, inv = np.unique(i, return_inverse=True)
            dw = np.bincount(inv, ge * xv, minlength=len(u)).astype(np.float32) + 1e-5 * w[u]
            each = (ge * xv)[:, None] * (s - vx)
            dv = np.stack([np.bincount(inv, each[:, f], minlength=len(u)) for f in range(FACTORS)], axis=1).astype(np.float32) + 1e-5 * v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            w[u] -= 0.1 * dw / np.sqrt(gw[u])
            v[u] -= 0.02 * dv / np.sqrt(gv[u])
    return b, w, v


def _sparse(batches):
    for whole in batches:
        _, offsets = T.text_bytes(whole.column("text"))
        for lo, hi in T.row_slices(offsets, SLICE):
            t = whole.slice(lo, hi - lo)
            ids, x, first = features(t.column("text"), t.column("chars").to_numpy(zero_copy_only=False).astype(np.float64))
            yield pa.RecordBatch.from_arrays([
                t.column("doc_id"), t.column("y"),
                pa.array([ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()),
                pa.array([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], ["doc_id", "y", "ids", "x"])


def _train(batches):
    pdf = pd.concat([*batches, pd.DataFrame({"doc_id": [], "y": [], "ids": [], "x": []})]).sort_values("doc_id")
    ids = np.frombuffer(b"".join(pdf["ids"]), np.int32)
    x = np.frombuffer(b"".join(pdf["x"]), np.float32)
    first = np.concatenate([[0], np.cumsum([len(v) // 4 for v in pdf["ids"]])]).astype(np.int64)
    if not len(pdf):
        return
    b, w, v = fit(ids, x, first, pdf["y"].to_numpy(np.float64))
    yield pd.DataFrame({"b": [b], "w": [w.tobytes()], "v": [v.tobytes()]})


def _with_chars(df: DataFrame) -> DataFrame:
    chars = F.col("n_chars").cast("double") if "n_chars" in df.columns else F.lit(None).cast("double")
    return df.withColumn("chars", chars)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_ROWS) -> tuple:
    """(bias, weights, factors) from at most about ``limit`` labelled rows.
    The model has a fixed size, whatever the data."""
    spark = docs.sparkSession
    have = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    rows = _with_chars(training_rows(docs.select(*have), labels, label, limit)) \
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "chars", "y")
    sparse = rows.mapInArrow(_sparse, "doc_id long, y int, ids binary, x binary")
    got = sparse.repartition(1).mapInPandas(_train, "b double, w binary, v binary").collect()
    if not got:                       # no labelled row: every score is just above one half
        return 1e-6, np.zeros(FEATURES, np.float32), np.zeros((FEATURES, FACTORS), np.float32)
    got = got[0]
    return got["b"], np.frombuffer(got["w"], np.float32), np.frombuffer(got["v"], np.float32).reshape(FEATURES, FACTORS)


def _scores(model: tuple):
    def run(batches):
        for whole in batches:
            _, offsets = T.text_bytes(whole.column("_text"))
            out = [np.zeros(0)]
            for lo, hi in T.row_slices(offsets, SLICE):
                t = whole.slice(lo, hi - lo)
                ids, x, first = features(t.column("_text"), t.column("_chars").to_numpy(zero_copy_only=False).astype(np.float64))
                out.append(logistic(margins(model, ids, x, first)))
            yield whole.drop_columns(["_text", "_chars"]).append_column("score", pa.array(np.concatenate(out), pa.float64()))
    return run


def score(docs: DataFrame, model: tuple, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``score``, the probability of label 1.
    Null and empty texts are scored like any other (no words, empty bins); a
    null n_chars, or no such column, has a bin of its own; repeated rows score
    alike; an empty table gives an empty result."""
    rows = _with_chars(docs).select(*keep, F.col("text").cast("string").alias("_text"), F.col("chars").alias("_chars"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(_scores(model), fields + ", score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.5) -> DataFrame:
    """Train and score: doc_id, held_out, score, predicted."""
    return score(docs, train(docs, labels, label), ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
