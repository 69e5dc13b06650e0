"""Evaluation metrics as aggregations (regression, ranking, classification,
distribution summaries).  All are grouped aggregates or windows over
pre-aggregated rows; none collects rows to the driver."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import RANGE, running_sum, running_sums


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _pearson(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are given; null if one is constant."""
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def regression_metrics(df: DataFrame, pred: str, true: str, by: list[str] | None = None,
                       max_r2: float | None = None) -> DataFrame:
    """MSE, RMSE, MAE, R^2 (coefficient of determination, population variance
    of the truth) and Pearson r; rows with a null in either column are dropped
    and counted in ``n_dropped``; constant truth has a null R^2.  ``max_r2`` adds ``r2_share`` = R^2 as a
    percentage of a reliability ceiling."""
    p, y = _c(pred).cast("double"), _c(true).cast("double")
    ok = p.isNotNull() & y.isNotNull()
    err = F.when(ok, p - y)
    yy = F.when(ok, y)
    aggs = [
        F.count(err).alias("n"),
        F.sum(F.when(~ok | p.isNull() | y.isNull(), 1).otherwise(0)).alias("n_dropped"),
        F.avg(err * err).alias("mse"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.avg(err * err), F.var_pop(yy))).alias("r2"),
        _pearson(F.when(ok, p), yy).alias("pearson_r"),
    ]
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    if max_r2:
        out = out.withColumn("r2_share", F.col("r2") / F.lit(max_r2) * 100)
    return out


def residuals(df: DataFrame, pred: str, true: str, out: str = "residual") -> DataFrame:
    return df.withColumn(out, _c(pred) - _c(true))


def histogram(df: DataFrame, column: str, bins: int = 15) -> DataFrame:
    """Equal-width histogram between min and max; the last bin is closed;
    empty bins are kept.  Columns: bin (0-based), lo, hi, n."""
    x = _c(column).cast("double")
    # one scalar subquery carrying both statistics (evaluated once)
    st = df.agg(F.struct(F.min(x).alias("mn"), F.max(x).alias("mx")).alias("s")).scalar()
    mn, mx = st["mn"], st["mx"]
    width = (mx - mn)
    raw = F.when(width == 0, F.lit(0)).otherwise(F.floor((x - mn) * F.lit(float(bins)) / width))
    idx = F.least(F.lit(bins - 1), raw).cast("int")
    counts = df.where(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    grid = (spark.range(bins).select(F.col("id").cast("int").alias("bin"))
            .select("bin", (mn + F.col("bin") * width / bins).alias("lo"),
                    (mn + (F.col("bin") + 1) * width / bins).alias("hi")))
    return (grid.join(counts, "bin", "left")
            .select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def density(df: DataFrame, column: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on an even grid (Scott bandwidth
    ``n^-1/5 * sample sd``; grid from ``min - cut*bw`` to ``max + cut*bw``).

    Values are counted first (equal values are one kernel) and the statistics
    are one row; then every task adds up the kernels of its values at the grid
    points, batch by batch, and hands on one partial sum per point.  A constant column
    has no bandwidth: its densities are null."""
    x = _c(column).cast("double")
    vals = df.where(x.isNotNull()).select(x.alias("v"))
    st = vals.agg(F.count("v").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("mn"), F.max("v").alias("mx")).first()
    schema = "i int, x double, s double"
    n, bw = st["n"], (st["sd"] or 0.0) * st["n"] ** -0.2 if st["n"] else 0.0
    if not n:
        return df.sparkSession.createDataFrame([], "i int, x double, density double")
    lo = st["mn"] - cut * bw
    grid = lo + np.arange(points) * (st["mx"] - st["mn"] + 2 * cut * bw) / (points - 1)

    def kernels(batches):
        total = np.zeros(points)
        for b in batches:
            v, w = b["v"].to_numpy(), b["w"].to_numpy()
            for at in range(0, len(v), 1024):
                total += np.exp(-0.5 * ((grid[:, None] - v[at:at + 1024]) / bw) ** 2) @ w[at:at + 1024]
        yield pd.DataFrame({"i": np.arange(points, dtype=np.int32), "x": grid, "s": total})

    def no_kernels(batches):
        for _ in batches:
            pass
        yield pd.DataFrame({"i": np.arange(points, dtype=np.int32), "x": grid, "s": np.full(points, np.nan)})

    counted = vals.groupBy("v").agg(F.count(F.lit(1)).alias("w"))
    sums = counted.mapInPandas(kernels if bw else no_kernels, schema).groupBy("i", "x").agg(F.sum("s").alias("s"))
    scale = F.lit(float(n * bw * math.sqrt(2 * math.pi)))
    return sums.select("i", "x", F.when(F.lit(bool(bw)), F.try_divide(F.col("s"), scale)).alias("density"))


# ---------------------------------------------------------------- ranking metrics
def _score_counts(df: DataFrame, cls: str, label: str, score: str) -> DataFrame:
    """Pre-aggregate to one row per (class, distinct score): positives and rows."""
    return (df.groupBy(cls, score)
            .agg(F.sum(_c(label).cast("long")).alias("tp"), F.count(F.lit(1)).alias("nn")))


def average_precision(df: DataFrame, cls: str, label: str, score: str) -> DataFrame:
    """Average precision per class: ``sum over thresholds of (R_k - R_k-1) * P_k``,
    thresholds at the distinct scores (equal scores are one step).  Classes
    without positives give 0."""
    sc = _score_counts(df, cls, label, score)
    # prefix sums per class in descending score, two-level over range chunks
    # (a class has as many rows as distinct scores; few classes, many scores)
    # the class's positive total comes with the prefix sums (from the small
    # chunk-total table), so no join on the few-valued class key is needed
    cum = running_sums(sc, [cls], [F.col(score).desc()], {"ctp": "tp", "cn": "nn"}, chunk=RANGE,
                       key_totals=True).select(cls, "tp", "ctp", "cn", F.col("ctp_total").alias("P"))
    return cum.groupBy(cls).agg(F.coalesce(F.sum(F.try_divide(F.col("tp"), F.col("P")) * F.col("ctp") / F.col("cn")), F.lit(0.0)).alias("ap"),
                                F.first("P").alias("n_pos"))


def roc_auc(df: DataFrame, cls: str, label: str, score: str, one_class: str = "error") -> DataFrame:
    """ROC AUC per class by the mid-rank formula (ties count one half).  A class
    that has only positives or only negatives has no AUC: an error, as in the
    reference, or a null with ``one_class="null"`` (a mean then leaves it out)."""
    sc = _score_counts(df, cls, label, score)
    ranked = running_sum(sc, [cls], [F.col(score).asc()], "nn", "before", inclusive=False, chunk=RANGE)
    mid = F.col("before") + (F.col("nn") + 1) / 2.0
    agg = ranked.groupBy(cls).agg(F.sum(F.col("tp") * mid).alias("rs"), F.sum("tp").alias("P"),
                                  F.sum("nn").alias("T"))
    Nn = F.col("T") - F.col("P")
    auc = (F.col("rs") - F.col("P") * (F.col("P") + 1) / 2.0) / (F.col("P") * Nn)
    none = F.raise_error(F.concat(F.lit("only one class in the labels of "), F.col(cls).cast("string"))).cast("double")
    return agg.select(cls, F.when((F.col("P") > 0) & (Nn > 0), auc).otherwise(none if one_class == "error" else F.lit(None)).alias("auc"))


def macro(df: DataFrame, value: str, out: str) -> DataFrame:
    return df.agg(F.avg(value).alias(out))


# ---------------------------------------------------------------- classification metrics
def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def weighted_f1(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Support-weighted F1 and accuracy from the confusion counts (0/0 -> 0)."""
    cm = confusion(df, true, pred)
    support = cm.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("sup"))
    predicted = cm.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("npred"))
    tp = cm.where(F.col("t") == F.col("p")).select(F.col("t").alias("c"), F.col("n").alias("tp"))
    per = (support.join(predicted, "c", "full").join(tp, "c", "left")
           .select("c", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("sup", "npred", "tp")]))
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    rec = F.when(F.col("sup") > 0, F.col("tp") / F.col("sup")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return per.agg((F.sum(f1 * F.col("sup")) / F.sum("sup")).alias("weighted_f1"),
                   (F.sum("tp") / F.sum("sup")).alias("accuracy"))


def hit_any(df: DataFrame, scores: str, multi_hot: str) -> DataFrame:
    """Percent of rows whose argmax class is one of the true labels."""
    from ..functions.vectors import argmax
    hit = F.element_at(F.col(multi_hot), argmax(scores) + 1) > 0
    return df.agg((F.avg(hit.cast("double")) * 100).alias("hit_any"))


def per_dimension_metrics(df: DataFrame, pred: str, true: str) -> DataFrame:
    """MSE, Pearson r and R^2 per output dimension of two aligned arrays."""
    z = df.select(F.posexplode(F.arrays_zip(F.col(pred).alias("p"), F.col(true).alias("y"))).alias("dim", "pv"))
    p, y = F.col("pv.p"), F.col("pv.y")
    return z.groupBy("dim").agg(F.avg((p - y) * (p - y)).alias("mse"), _pearson(p, y).alias("pearson_r"),
                                (F.lit(1.0) - F.try_divide(F.avg((p - y) * (p - y)), F.var_pop(y))).alias("r2"))


def affect_metrics(df: DataFrame, pred: str, true: str) -> DataFrame:
    """Per-dimension metrics and their unweighted means (mean R^2 = uniform R^2)."""
    per = per_dimension_metrics(df, pred, true)
    return per.agg(F.avg("mse").alias("mean_mse"), F.avg("pearson_r").alias("mean_pearson_r"),
                   F.avg("r2").alias("r2_uniform"))
