"""Batch-wise contrastive losses.

A batch is a group (``batch_ids`` / ``epoch_batches`` cut the table into groups
of ``size`` rows).  Its n x n logits are formed as tiles of ``TILE`` x ``TILE``
rows, each a task's group of two row slices, so one large batch is the work of
many tasks and none holds more than one tile.  A tile gives the running
log-sum-exp (maximum, scaled sum) of its rows and of its columns; these are
merged per row slice and per column slice, and only then added up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import RANGE, running_sums

TILE = 1024


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _log_softmax(a: np.ndarray) -> np.ndarray:
    return a - _lse(a, 1)[:, None]


def inverse_divergence(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Inverse absolute divergences of every source row's distribution from
    every target row's, both given as log-probabilities: the divergence is the
    target's negative entropy minus its expected log-probability under the
    source (an underflowing probability counts 0); a zero divergence gives +inf."""
    p = np.exp(target)
    entropy = -np.einsum("ij,ij->i", p, target)
    with np.errstate(divide="ignore"):
        return 1.0 / np.abs(entropy[None, :] + source @ p.T)


def sentiment_weights(scores: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Rows lo..hi-1 of the inverse divergences of every row's softmax from the
    others' ones; 0 on the diagonal."""
    logp = _log_softmax(scores)
    w = inverse_divergence(logp[lo:hi], logp)
    w[np.arange(len(w)), np.arange(lo, lo + len(w))] = 0.0
    return w


def _stack(s: pd.Series) -> np.ndarray:
    return np.vstack(s.to_numpy()).astype(float)


def partial_lse(a: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """(maximum, sum of exp(value - maximum)) along ``axis``."""
    top = a.max(axis=axis)
    shift = np.where(np.isneginf(top), 0.0, top)
    return top, np.exp(a - np.expand_dims(shift, axis)).sum(axis=axis)


def merge_lse(tops: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Log-sum-exps from partial ones stacked in the first axis."""
    top = tops.max(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        scaled = np.where(np.isneginf(tops), 0.0, sums * np.exp(tops - top))
        return top + np.log(scaled.sum(axis=0))


_PARTS = "side string, slice long, loss_no int, tops array<double>, sums array<double>, diagonal double"


def _tile(scale: float, sentiment_scale: float, sentiment: bool):
    """Partial log-sum-exps of one tile: its rows' (side r) and columns' (side
    c), for the plain logits and for the reweighted ones."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("row"), right.sort_values("col")
        rows, cols = left["row"].to_numpy(), right["col"].to_numpy()
        logits = scale * _stack(left["x"]) @ _stack(right["y"]).T
        same = rows[:, None] == cols[None, :]
        losses = [logits]
        if sentiment:
            weight = inverse_divergence(_log_softmax(_stack(left["s"])), _log_softmax(_stack(right["t"])))
            weight[same] = 0.0
            losses.append(logits - sentiment_scale * weight)
        out = []
        for no, a in enumerate(losses):
            for side, axis, at in (("r", 1, left["li"]), ("c", 0, right["rj"])):
                top, total = partial_lse(a, axis)
                out.append((left["lk"].iloc[0], side, int(at.iloc[0]), no, top.tolist(), total.tolist(), float(a[same].sum()) if side == "r" else 0.0))
        return pd.DataFrame(out, columns=["_b", "side", "slice", "loss_no", "tops", "sums", "diagonal"])
    return run


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    lse = merge_lse(_stack(pdf["tops"]), _stack(pdf["sums"]))
    return pd.DataFrame({"_b": [pdf["_b"].iloc[0]], "loss_no": [pdf["loss_no"].iloc[0]], "lse": [float(lse.sum())], "diagonal": [pdf["diagonal"].sum()],
                         "rows": [len(lse) if pdf["side"].iloc[0] == "r" else 0]})


def contrastive_loss(df: DataFrame, batch: str, image: str, text: str, scale: float = 1.0,
                     sentiment: str | None = None, sentiment_scale: float = 10.0, tile: int = TILE) -> DataFrame:
    """One row per batch: ``n``, ``loss`` (and ``reweighted_loss`` when
    ``sentiment`` scores are given: logits minus ``sentiment_scale`` x weights).
    A batch of n rows is ``ceil(n / tile)`` squared tiles; every row is sent to
    as many tiles as a side has.  Rows with a null batch form a batch."""
    kind = dict(df.dtypes)[batch]
    known = F.struct(F.col(batch).alias("b"))
    rows = df.select(known.alias("_b"), F.col(image).cast("array<double>").alias("_x"), F.col(text).cast("array<double>").alias("_y"),
                     (F.col(sentiment).cast("array<double>") if sentiment else F.lit(None).cast("array<double>")).alias("_s"),
                     F.monotonically_increasing_id().alias("_id"))
    rows = running_sums(rows, ["_b"], ["_id"], {"_pos": F.lit(1)}, inclusive=False, chunk=RANGE, key_totals=True)
    rows = rows.withColumn("_own", F.floor(F.col("_pos") / tile).cast("long")).withColumn("_all", F.sequence(F.lit(0).cast("long"), F.floor((F.col("_pos_total") - 1) / tile).cast("long")))
    key = F.to_json("_b")
    left = rows.select(key.alias("lk"), F.col("_own").alias("li"), F.explode("_all").alias("lj"), F.col("_pos").alias("row"), F.col("_x").alias("x"), F.col("_s").alias("s"))
    right = rows.select(key.alias("rk"), F.explode("_all").alias("ri"), F.col("_own").alias("rj"), F.col("_pos").alias("col"), F.col("_y").alias("y"), F.col("_s").alias("t"))
    run = _tile(scale, sentiment_scale, sentiment is not None)
    parts = left.groupBy("lk", "li", "lj").cogroup(right.groupBy("rk", "ri", "rj")).applyInPandas(run, "_b string, " + _PARTS)
    merged = parts.groupBy("_b", "side", "slice", "loss_no").applyInPandas(_merged, "_b string, loss_no int, lse double, diagonal double, rows long")
    per = merged.groupBy("_b").agg(
        F.sum(F.when(F.col("loss_no") == 0, F.col("rows"))).alias("n"),
        *[F.sum(F.when(F.col("loss_no") == no, F.col(c))).alias(f"{c}{no}") for no in (0, 1) for c in ("lse", "diagonal")])
    loss = [((F.col(f"lse{no}") - 2 * F.col(f"diagonal{no}")) / (2 * F.col("n"))) for no in (0, 1)]
    out = per.select(F.from_json("_b", f"b {kind}")["b"].alias(batch), "n", loss[0].alias("loss"), loss[1].alias("reweighted_loss"))
    return out if sentiment else out.drop("reweighted_loss")


def clip_loss_from_logits(logits: np.ndarray) -> float:
    """The loss of one whole matrix of logits."""
    each = [merge_lse(*[x[None] for x in partial_lse(logits, axis)]).sum() for axis in (1, 0)]
    return float((sum(each) - 2 * np.trace(logits)) / (2 * len(logits)))


def dissimilarity(df: DataFrame, group: str, order: str, vec: str) -> DataFrame:
    """Per group: mean of ``1 - first . other`` over the other rows, the first
    row being the smallest ``order``."""

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        m = _stack(pdf[vec])
        d = 1.0 - m[1:] @ m[0]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "dissimilarity": [float(d.mean()) if len(d) else np.nan]})

    gtype = dict(df.dtypes)[group]
    return df.select(group, order, vec).groupBy(group).applyInPandas(per_group, f"{group} {gtype}, dissimilarity double")
