"""Savitzky-Golay smoothing of ordered series (WN-10).

Coefficients are least-squares polynomial fits computed once on the driver
(a window of L numbers).  The data side is distributed without a window over
a whole series: rows are numbered, cut into chunks of ``chunk`` positions,
and each chunk also receives a halo of the neighbouring rows it needs, so a
window runs per (series, chunk) with bounded size even when one series holds
most of the rows.  Edges follow the ``interp`` rule: the first and last
``L // 2`` outputs come from a polynomial fitted to the first / last ``L``
samples.

Even windows: the fit spans samples ``i - (L/2 - 1) .. i + L/2`` and is
evaluated half a sample to the right of ``i`` (derived from the filter
placement of an even-length convolution; not checked against an oracle).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import RANGE, global_row_index, running_sums


def window_layout(length: int) -> tuple[int, int, float]:
    """(samples left of i, samples right of i, evaluation offset from i)."""
    if length % 2:
        h = length // 2
        return h, h, 0.0
    return length // 2 - 1, length // 2, 0.5


def fit_matrix(length: int, order: int, positions: np.ndarray, eval_at: np.ndarray) -> np.ndarray:
    """Rows: weights giving the fitted polynomial at ``eval_at`` from samples at ``positions``."""
    A = positions[:, None] ** np.arange(order + 1)[None, :]
    V = eval_at[:, None] ** np.arange(order + 1)[None, :]
    return V @ np.linalg.pinv(A)


def savgol(df: DataFrame, value: str, order_cols: list[str], length: int, polyorder: int,
           by: list[str] | None = None, out: str = "smoothed", chunk: int = 4096) -> DataFrame:
    if length <= polyorder:
        raise ValueError("window length must exceed the polynomial order")
    left, right, t = window_layout(length)
    coef = fit_matrix(length, polyorder, np.arange(length) - left - t, np.array([0.0]))[0]
    half = length // 2
    head_w = fit_matrix(length, polyorder, np.arange(length, dtype=float), np.arange(half, dtype=float))
    tail_w = fit_matrix(length, polyorder, np.arange(length, dtype=float), np.arange(length - half, length, dtype=float))

    keys = list(by or [])
    if keys:
        # two-level numbering over range chunks: one long series is not one
        # task; the series length comes from the same pass (chunk totals), so
        # nothing is joined back on the series key
        base = (running_sums(df, keys, order_cols, {"_rn": F.lit(1)}, chunk=RANGE, key_totals=True)
                .withColumn("_rn", F.col("_rn") - 1).withColumnRenamed("_rn_total", "_n"))
    else:
        numbered = global_row_index(df, order_cols, "_rn")
        n = numbered.agg(F.count(F.lit(1)).alias("_n"))
        base = numbered.withColumn("_n", F.lit(n.select("_n").scalar()))

    # interior: chunked windows with a halo of left/right neighbours
    owner = F.floor(F.col("_rn") / chunk)
    halo = F.array_distinct(F.array(owner, F.floor((F.col("_rn") - right) / chunk),
                                    F.floor((F.col("_rn") + left) / chunk)))
    spread = base.select(*keys, "_rn", "_n", F.col(value).cast("double").alias("_v"), F.explode(halo).alias("_c"))
    wc = Window.partitionBy(*keys, "_c").orderBy("_rn").rowsBetween(-left, right)
    lit_coef = F.array(*[F.lit(float(c)) for c in coef])
    vals = F.collect_list("_v").over(wc)
    interior = (spread.withColumn("_win", vals)
                .where((F.floor(F.col("_rn") / chunk) == F.col("_c")) & (F.size("_win") == length))
                .select(*keys, "_rn", F.aggregate(F.zip_with("_win", lit_coef, lambda a, b: a * b), F.lit(0.0),
                                                  lambda acc, x: acc + x).alias("_mid")))

    # edges: polynomial through the first / last `length` samples of each series
    def edge(rows: DataFrame, weights: np.ndarray, first_out) -> DataFrame:
        g = rows.groupBy(*keys, "_n").agg(F.array_sort(F.collect_list(F.struct("_rn", F.col(value).cast("double")
                                                                                 .alias("v")))).alias("_a"))
        g = g.where(F.size("_a") == length).select(*keys, "_n", F.transform("_a", lambda s: s["v"]).alias("_a"))
        outs = [F.struct((first_out + i).alias("_rn"),
                         F.aggregate(F.zip_with("_a", F.array(*[F.lit(float(x)) for x in weights[i]]),
                                                lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x).alias("_e"))
                for i in range(weights.shape[0])]
        return g.select(*keys, F.explode(F.array(*outs)).alias("_o")).select(*keys, "_o._rn", "_o._e")

    head = edge(base.where(F.col("_rn") < length), head_w, F.lit(0))
    tail = edge(base.where(F.col("_rn") >= F.col("_n") - length), tail_w, F.col("_n") - half)
    edges = head.unionByName(tail).groupBy(*keys, "_rn").agg(F.first("_e").alias("_e"))
    res = (base.join(interior, [*keys, "_rn"], "left").join(edges, [*keys, "_rn"], "left")
           .withColumn(out, F.when((F.col("_rn") < half) | (F.col("_rn") >= F.col("_n") - half), F.col("_e"))
                       .otherwise(F.col("_mid"))))
    return res.drop("_rn", "_n", "_mid", "_e")
