"""Prediction post-processing: clamp, per-group z-normalisation, tail smoothing,
route counts and summaries (the numeric half of the expression predictor)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantile

# Prediction scale and normalisation targets.
SCORE_MIN = 1.0
SCORE_MAX = 5.0
TARGET_MEAN = 3.0
TARGET_SD = 1.0
TAIL_QUANTILE = 0.9
TAIL_STRENGTH = 0.1


def clamp(c, lo: float = SCORE_MIN, hi: float = SCORE_MAX) -> Column:
    """Clamp to [lo, hi]; NaN is kept as NaN (like a tensor clamp)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def znorm(df: DataFrame, score: str, by: list[str] | None = None, out: str | None = None,
          target_mean: float = TARGET_MEAN, target_sd: float = TARGET_SD, fixed_groups: bool = False) -> DataFrame:
    """Z-normalise ``score`` within each ``by`` group to ``target_mean``/``target_sd``
    using the sample standard deviation.

    Statistics are a grouped aggregate joined back on the key (one row per
    group); ``fixed_groups=True`` declares that the groups are a fixed small
    set (the three routes), so the statistics are broadcast and the rows are
    never shuffled onto as few tasks as there are groups.  Otherwise the join
    is left to the planner (many groups: a balanced shuffle join, with AQE's
    skew handling).  Without ``by`` they are scalar subqueries.  A group whose sample sd is null (one row) or 0 gets
    ``target_mean`` and ``norm_degenerate = true``.
    """
    out = out or score
    if by:
        stats = df.groupBy(*by).agg(F.avg(score).alias("_mu"), F.stddev_samp(score).alias("_sd"))
        joined = df.join(F.broadcast(stats) if fixed_groups else stats, on=by, how="left")
        mu, sd = F.col("_mu"), F.col("_sd")
    else:
        st = df.agg(F.struct(F.avg(score).alias("mu"), F.stddev_samp(score).alias("sd")).alias("s")).scalar()
        joined = df
        mu, sd = st["mu"], st["sd"]
    degenerate = sd.isNull() | (sd == 0)
    value = F.when(degenerate, F.lit(target_mean)).otherwise(
        (F.col(score) - mu) / sd * F.lit(target_sd) + F.lit(target_mean))
    res = joined.withColumn("norm_degenerate", degenerate).withColumn(out, value)
    return res.drop("_mu", "_sd") if by else res


def smooth_tail(df: DataFrame, score: str, out: str | None = None, q: float = TAIL_QUANTILE,
                ceiling: float = SCORE_MAX, strength: float = TAIL_STRENGTH,
                quantile_method: str = "distributed") -> DataFrame:
    """Shrink values above the exact ``q`` quantile ``t``:
    ``p * (1 - strength * (p - t) / (ceiling - t))`` for ``p > t``.
    ``t >= ceiling`` leaves the column unchanged."""
    out = out or score
    t = exact_quantile(df, score, q, quantile_method)
    p = F.col(score)
    if t is None or t >= ceiling:
        return df.withColumn(out, p)
    tl = F.lit(float(t))
    shrunk = p * (F.lit(1.0) - F.lit(strength) * (p - tl) / (F.lit(ceiling) - tl))
    return df.withColumn(out, F.when(p > tl, shrunk).otherwise(p))


def route_counts(df: DataFrame, route: str = "Model_Used") -> DataFrame:
    return df.groupBy(route).agg(F.count(F.lit(1)).alias("n_rows"))


def summary(df: DataFrame, score: str) -> DataFrame:
    return df.agg(F.min(score).alias("min_score"), F.max(score).alias("max_score"),
                  F.avg(score).alias("mean_score"), F.count(score).alias("n_scored"))


def finish_scores(df: DataFrame, score: str, route: str, out: str = "Predicted_Concreteness",
                  quantile_method: str = "distributed") -> DataFrame:
    """Order of the reference: clamp -> z-normalise per route -> tail smoothing
    over all routes together -> clamp."""
    step = df.withColumn("_p", clamp(score))
    step = znorm(step, "_p", by=[route], fixed_groups=True)
    step = smooth_tail(step, "_p", quantile_method=quantile_method)
    return step.withColumn(out, clamp("_p")).drop("_p")
