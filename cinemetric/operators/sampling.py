"""Repeatable sampling, splitting, batching and row numbering.

Randomness comes from an MD5 of (seed, key) rather than ``rand()``: a retried
task or a re-planned shuffle sees the same draws, so results survive executor
loss.  MD5 is also available in DuckDB, which lets the oracle recompute the
same draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import global_row_index

HEX_DIGITS = 13  # 52 bits: exact in a double


def stable_key(seed, *cols) -> Column:
    """Hex MD5 of ``seed:col1:col2...``; sorts like a uniform random key."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def stable_unit(seed, *cols) -> Column:
    """Uniform draw in [0, 1) from the first 52 bits of ``stable_key``."""
    h = F.substring(stable_key(seed, *cols), 1, HEX_DIGITS)
    return F.conv(h, 16, 10).cast("double") / float(16 ** HEX_DIGITS)


def random_frames(clips: DataFrame, keys: list[str], first: str, last: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` distinct frames of ``[first, last]`` drawn without replacement and
    returned sorted; clips shorter than ``k`` are dropped (and can be counted
    by the caller) instead of being swapped for another clip."""
    c = clips.where(F.col(last) - F.col(first) + 1 >= k)
    cand = F.transform(F.sequence(F.col(first), F.col(last)),
                       lambda f: F.struct(stable_key(seed, *keys, f).alias("h"), f.alias("f")))
    picked = F.transform(F.slice(F.array_sort(cand), 1, k), lambda s: s["f"])
    return c.withColumn("frames", F.array_sort(picked))


def assign_split(df: DataFrame, key: str, weights=(0.9, 0.1, 0.0), names=("train", "val", "test"),
                 seed: int = 0, out: str = "split") -> DataFrame:
    """Weighted split by a per-key draw against cumulative weights."""
    total = float(sum(weights))
    u = stable_unit(seed, key)
    cum, expr = 0.0, None
    for w, n in zip(weights, names):
        cum += w / total
        expr = (F.when(u < cum, F.lit(n)) if expr is None else expr.when(u < cum, F.lit(n)))
    return df.withColumn(out, expr.otherwise(F.lit(names[-1])))


def stratified_split(df: DataFrame, cls: str, key: str, sizes=(("train", 150), ("val", 50), ("test", 100)),
                     seed: int = 0, out: str = "split", salt_buckets: int | None = None) -> DataFrame:
    """Balanced sample per class: rank rows of each class by a stable draw and
    give the first n1 to the first split, the next n2 to the second, ...;
    rows beyond the total are not sampled (dropped)."""
    # Two-phase exact top-N per class: rows are first ranked inside
    # (class, salt) buckets and only each bucket's first N survive; the final
    # rank per class then runs over at most buckets x N rows, so a class
    # holding most of the table is never one task.
    total = sum(n for _, n in sizes)
    buckets = salt_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [stable_key(seed, key), F.col(key)]
    salted = df.withColumn("_salt", F.abs(F.xxhash64(F.col(key))) % buckets)
    w1 = Window.partitionBy(cls, "_salt").orderBy(*order)
    cand = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= total).drop("_r1", "_salt")
    w = Window.partitionBy(cls).orderBy(*order)
    r = cand.withColumn("_rn", F.row_number().over(w))
    expr, lo = None, 0
    for name, n in sizes:
        cond = (F.col("_rn") > lo) & (F.col("_rn") <= lo + n)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
        lo += n
    return r.withColumn(out, expr).where(F.col(out).isNotNull()).drop("_rn")


def batch_ids(df: DataFrame, order: list[str], size: int, out: str = "batch_id") -> DataFrame:
    """Batch number = floor(position / size) in the given order."""
    idx = global_row_index(df, order, "_pos")
    return idx.withColumn(out, F.floor(F.col("_pos") / size)).drop("_pos")


def epoch_batches(df: DataFrame, key: str, epoch: int, size: int, out: str = "batch_id") -> DataFrame:
    """Shuffle by a per-epoch draw, cut into batches of ``size`` and drop the
    incomplete last batch."""
    h = df.withColumn("_h", stable_key(epoch, key))
    idx = global_row_index(h, ["_h", key], "_pos")
    full_batches = idx.agg(F.floor(F.count(F.lit(1)) / size).alias("nb")).select("nb").scalar()
    b = idx.withColumn(out, F.floor(F.col("_pos") / size))
    return b.where(F.col(out) < full_batches).drop("_h", "_pos")


def reindex(df: DataFrame, old: str, out: str = "row_idx") -> DataFrame:
    """Dense 0-based renumbering by the old index (after rows were removed)."""
    return global_row_index(df, [old], out)


def rolling_mean(df: DataFrame, keys: list[str], order: list[str], value: str, k: int,
                 out: str = "rolling", chunk_rows: int | None = 4096) -> DataFrame:
    """Mean of the last ``k`` values (fewer at the start); chunked with a halo
    so one long series is not one task (``sequence.rolling_mean``)."""
    from .sequence import rolling_mean as chunked_rolling_mean
    return chunked_rolling_mean(df, keys, order, value, k, out, chunk_rows)
