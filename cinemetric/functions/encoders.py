"""Pluggable text encoders (UDF-01) and per-label scorers (UDF-04).

An encoder is any object with ``dim`` and ``encode(list[str]) -> np.ndarray``
of shape ``(n, dim)``.  Spark calls it through an iterator pandas UDF, so a
real model is loaded once per Python worker and fed Arrow batches
(``spark.sql.execution.arrow.maxRecordsPerBatch`` plays the role of the
reference's batch size).  The shipped ``HashingEncoder`` is deterministic and
dependency-free so results are repeatable in tests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\s\w]+", re.IGNORECASE)


class HashingEncoder:
    """Signed feature hashing of lower-cased tokens, L2-normalised."""

    def __init__(self, dim: int = 64, seed: int = 0):
        self.dim = dim
        self.seed = seed

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        for i, t in enumerate(texts):
            if not t:
                continue
            for tok in _TOKEN.findall(t.lower()):
                h = xxhash.xxh64_intdigest(tok, seed=self.seed)
                out[i, h % self.dim] += 1.0 if (h >> 63) & 1 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        np.divide(out, norms, out=out, where=norms > 0)
        return out


def encode_column(text: Column | str, encoder) -> Column:
    """Vector column (``array<double>``) from a text column via ``encoder``."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            mat = encoder.encode(s.fillna("").tolist())
            yield pd.Series(list(mat))

    return _enc(F.col(text) if isinstance(text, str) else text)


class KeywordLabelScorer:
    """Per-label text scorer (UDF-04 default): softmax over keyword hit counts.
    Labels and keywords are inputs; a real classifier plugs in the same way."""

    def __init__(self, labels: dict[str, list[str]]):
        self.labels = list(labels)
        self.keywords = [set(w.lower() for w in ws) for ws in labels.values()]

    def score(self, texts: list[str]) -> list[list[dict]]:
        res = []
        for t in texts:
            toks = _TOKEN.findall((t or "").lower())
            hits = np.array([sum(tok in kw for tok in toks) for kw in self.keywords], dtype=float)
            p = np.exp(hits - hits.max())
            p /= p.sum()
            res.append([{"label": lab, "score": float(v)} for lab, v in zip(self.labels, p)])
        return res


def label_scores_column(text: Column | str, scorer) -> Column:
    schema = T.ArrayType(T.StructType([T.StructField("label", T.StringType()),
                                       T.StructField("score", T.DoubleType())]))

    @F.pandas_udf(schema)
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(scorer.score(s.fillna("").tolist()))

    return _score(F.col(text) if isinstance(text, str) else text)
