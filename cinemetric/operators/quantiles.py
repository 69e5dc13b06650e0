"""Exact quantiles without funnelling the data through one task.

Spark's ``percentile`` aggregate keeps a value -> count map that is merged on a
single reducer; for a global quantile over a very large column that map grows
with the number of distinct values.  ``exact_quantiles`` keeps every step
distributed:

1. value counts (partial aggregation collapses hot values map-side);
2. range partitioning on the value, checkpointed so both passes see the same
   partitions;
3. pass 1: per-partition row totals (one small row per partition);
4. pass 2: per-partition prefix sums, offset by the earlier partitions, emit
   only the values sitting at the wanted ranks.

The interpolation is numpy's default (``linear``), the same as DuckDB's
``quantile_cont`` and Spark's ``percentile``.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _targets(n: int, qs: list[float]) -> list[int]:
    ranks = set()
    for q in qs:
        h = (n - 1) * q
        ranks.add(int(math.floor(h)))
        ranks.add(int(math.ceil(h)))
    return sorted(ranks)


def exact_quantiles(df: DataFrame, column: str | Column, qs: list[float],
                    method: str = "distributed") -> list[float | None]:
    """Exact quantiles of a numeric column (nulls ignored, NaN above every
    number), linear interpolation; one way at every size.

    ``method``: ``distributed`` (default, scale-safe), ``builtin`` (Spark's
    ``percentile``; fine while the distinct values fit one reducer) or
    ``approx`` (``percentile_approx`` with accuracy 1e5, not exact).
    """
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    if method == "builtin":
        row = df.agg(F.percentile(x, F.array(*[F.lit(q) for q in qs])).alias("p")).first()
        return list(row["p"]) if row["p"] is not None else [None] * len(qs)
    if method == "approx":
        row = df.agg(F.percentile_approx(x, F.array(*[F.lit(q) for q in qs]), 100_000).alias("p")).first()
        return list(row["p"]) if row["p"] is not None else [None] * len(qs)

    spark = df.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = (df.select(x.alias("v")).where(F.col("v").isNotNull())
              .groupBy("v").agg(F.count(F.lit(1)).alias("c")))
    ranged = cut_lineage(counts.repartitionByRange(n_parts, "v").sortWithinPartitions("v")
                         .withColumn("pid", F.spark_partition_id()))
    parts = (ranged.groupBy("pid").agg(F.min("v").alias("lo"), F.sum("c").alias("n"))
             .orderBy("lo").collect())
    total = sum(int(r["n"]) for r in parts)
    if total == 0:
        return [None] * len(qs)
    wanted = _targets(total, qs)
    offsets, running = {}, 0
    for r in parts:
        offsets[int(r["pid"])] = running
        running += int(r["n"])

    def pick(batches):
        # One range partition of (v, c, pid) in ascending v (the checkpoint keeps
        # the sorted order).  Batches are consumed one at a time with a running
        # rank, so a task holds one Arrow batch, never the whole partition.
        import numpy as np
        seen, last = None, None
        for b in batches:
            if len(b) == 0:
                continue
            if seen is None:
                seen = offsets[int(b["pid"].iloc[0])]
            v, c = b["v"].to_numpy(), b["c"].to_numpy()
            if (last is not None and v[0] < last) or bool((np.diff(v) < 0).any()):
                raise RuntimeError("range partition is not sorted")
            hi = seen + np.cumsum(c)                 # rank (0-based) of the last copy + 1
            lo0 = seen
            out = [(r, float(v[np.searchsorted(hi, r, side="right")])) for r in wanted if lo0 <= r < hi[-1]]
            if out:
                yield pd.DataFrame(out, columns=["r", "v"])
            seen, last = int(hi[-1]), v[-1]

    # pandas hands a NaN back as null; real nulls were left out above
    found = {int(r["r"]): math.nan if r["v"] is None else float(r["v"]) for r in
             ranged.mapInPandas(pick, "r long, v double").collect()}
    result = []
    for q in qs:
        h = (total - 1) * q
        a, b = found[int(math.floor(h))], found[int(math.ceil(h))]
        result.append(a + (b - a) * (h - math.floor(h)))
    return result


def exact_quantile(df: DataFrame, column: str | Column, q: float, method: str = "distributed") -> float | None:
    return exact_quantiles(df, column, [q], method)[0]
