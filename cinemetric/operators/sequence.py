"""Ordered, per-key sequence helpers: running sums, row numbers, lead.

A plain ``Window.partitionBy(key).orderBy(...)`` sends each key to one task;
when one key (a long video) holds a large share of the rows that task becomes
the bottleneck.  With ``chunk`` (a coarse column that is monotone in the
order, e.g. ``frame_idx div 4096``) the prefix sum is done in two levels:
chunk totals per key (small), an exclusive running sum over the chunk totals,
and a running sum inside each (key, chunk) window, so no task holds more than
one chunk of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


RANGE = "range"   # chunk by range-partition id (see ``range_chunks``)


def range_chunks(df: DataFrame, keys: list, order: list, out: str = "_rchunk",
                 partitions: int | None = None) -> DataFrame:
    """Range-partition on ``(keys, order)`` and tag every row with its
    partition id.  Within one key the id never decreases along the order, so
    it is a valid chunk column for the two-level helpers, and a key holding a
    third of all rows is spread over many partitions of bounded size without
    the caller knowing anything about the order column's values."""
    from ..session import cut_lineage
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The range bounds come from sampling and the partition id is not a
    # function of the row, so the tagged rows are written once (reliable
    # checkpoint in the shared checkpoint folder): every later branch (chunk
    # totals, in-chunk windows) reads the same ids, also after a task retry.
    return cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn(out, F.spark_partition_id()))


def _chunked(df: DataFrame, keys: list, order: list, chunk):
    """Resolve ``chunk``: ``RANGE`` tags range-partition ids; returns
    (frame, chunk column, helper columns to drop at the end)."""
    if isinstance(chunk, str) and chunk == RANGE:
        return range_chunks(df, keys, order), F.col("_rchunk"), ["_rchunk"]
    return df, chunk, []


def running_sums(df: DataFrame, keys: list[str], order: list, values: dict[str, Column | str],
                 inclusive: bool = True, chunk: Column | str | None = None,
                 key_totals: bool = False) -> DataFrame:
    """Add one running sum per ``values`` entry (``out -> value``) per ``keys``
    in ``order``; all sums share one window (and one chunk-total pass).
    ``chunk``: a column monotone in the order, or ``RANGE``.  ``key_totals``
    also adds ``{out}_total`` (the sum over the whole key), taken from the
    small per-chunk totals table instead of another pass over the rows."""
    df, chunk, extra = _chunked(df, keys, order, chunk)
    vals = {o: (F.col(v) if isinstance(v, str) else v) for o, v in values.items()}
    frame_end = Window.currentRow if inclusive else -1
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
        for o, v in vals.items():
            df = df.withColumn(o, F.coalesce(F.sum(v).over(w), F.lit(0)))
            if key_totals:
                df = df.withColumn(f"{o}_total", F.coalesce(F.sum(v).over(Window.partitionBy(*keys)), F.lit(0)))
        return df
    tmp = {o: f"_v_{o}" for o in vals}
    d = df.withColumn("_chunk", chunk)
    for o, v in vals.items():
        d = d.withColumn(tmp[o], v)
    totals = d.groupBy(*keys, "_chunk").agg(*[F.sum(tmp[o]).alias(f"_t_{o}") for o in vals])
    wt = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", *[F.coalesce(F.sum(f"_t_{o}").over(wt), F.lit(0)).alias(f"_off_{o}")
                                               for o in vals])
    if key_totals:
        kt = totals.groupBy(*keys).agg(*[F.coalesce(F.sum(f"_t_{o}"), F.lit(0)).alias(f"{o}_total") for o in vals])
        offsets = offsets.join(kt, keys)
    wi = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
    inner = d
    for o in vals:
        inner = inner.withColumn(f"_in_{o}", F.coalesce(F.sum(tmp[o]).over(wi), F.lit(0)))
    # every row with a key has its totals, so an outer join gives the inner one's
    # rows; with it only the totals may be broadcast, never the rows
    out = inner.dropna(subset=[*keys, "_chunk"]).join(offsets, [*keys, "_chunk"], "left")
    for o in vals:
        out = out.withColumn(o, F.coalesce(f"_off_{o}", F.lit(0)) + F.col(f"_in_{o}"))
    drop = ["_chunk", *extra] + [c for o in vals for c in (tmp[o], f"_in_{o}", f"_off_{o}")]
    return out.drop(*drop)


def running_sum(df: DataFrame, keys: list[str], order: list, value: Column | str, out: str,
                inclusive: bool = True, chunk: Column | str | None = None) -> DataFrame:
    """Add ``out`` = running sum of ``value`` per ``keys`` in ``order``."""
    return running_sums(df, keys, order, {out: value}, inclusive, chunk)


def row_number(df: DataFrame, keys: list[str], order: list, out: str,
               chunk: Column | str | None = None) -> DataFrame:
    """1-based position per key (two-level when ``chunk`` is given)."""
    if chunk is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return running_sum(df, keys, order, F.lit(1), out, inclusive=True, chunk=chunk)


def global_row_index(df: DataFrame, order: list, out: str = "row_idx") -> DataFrame:
    """0-based dense position over the whole table by ``order`` without a
    single-partition window and without leaving the JVM: the rows are
    range-partitioned on the order and written once with their partition id
    (``range_chunks``); one small aggregate counts the rows of each partition
    (one row per partition comes back), and each row's index is its
    partition's offset plus its position after a local sort of the partition
    (the low bits of ``monotonically_increasing_id``)."""
    t = range_chunks(df, [], order)
    counts = {int(r["_rchunk"]): int(r["n"]) for r in
              t.groupBy("_rchunk").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, run = [], 0
    for pid in range(max(counts, default=-1) + 1):
        offsets.append(run)
        run += counts.get(pid, 0)
    if not offsets:
        return t.drop("_rchunk").withColumn(out, F.lit(None).cast("long"))
    off = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_rchunk") + 1)
    # the checkpointed partitions are read back one to one, so after a local
    # sort the id's low 33 bits are the row's position inside its partition
    pos = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return t.sortWithinPartitions(*order).withColumn(out, off + pos).drop("_rchunk")


def next_value(df: DataFrame, keys: list[str], order: list, value: Column | str, out: str,
               chunk: Column | str | None = None) -> DataFrame:
    """Add ``out`` = ``value`` of the next row per ``keys`` in ``order`` (null
    on the last row).  With ``chunk`` (monotone in the order) the lead is taken
    inside each (key, chunk) window; the last row of a chunk takes the first
    value of the next non-empty chunk, found on the small one-row-per-chunk
    table, so no task holds more than one chunk of a key."""
    v = F.col(value) if isinstance(value, str) else value
    if chunk is None:
        return df.withColumn(out, F.lead(v).over(Window.partitionBy(*keys).orderBy(*order)))
    df, chunk, extra = _chunked(df, keys, order, chunk)
    d = df.withColumn("_chunk", chunk).withColumn("_val", v)
    w_in = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    d = d.withColumn("_lead_in", F.lead("_val").over(w_in)) \
        .withColumn("_last_in", F.lead(F.lit(1)).over(w_in).isNull())
    firsts = d.groupBy(*keys, "_chunk").agg(F.min_by("_val", F.struct(*order)).alias("_first"))
    wc = Window.partitionBy(*keys).orderBy("_chunk")
    nxt = firsts.select(*keys, "_chunk", F.lead("_first").over(wc).alias("_next_first"))
    j = d.join(nxt, [*keys, "_chunk"])
    return (j.withColumn(out, F.when(F.col("_last_in"), F.col("_next_first")).otherwise(F.col("_lead_in")))
            .drop("_chunk", "_val", "_lead_in", "_last_in", "_next_first", *extra))


def rolling_mean(df: DataFrame, keys: list[str], order: list, value: str, k: int, out: str,
                 chunk_rows: int | None = 4096) -> DataFrame:
    """Mean of the last ``k`` values per key (fewer at the start).

    With ``chunk_rows`` the rows of each key are numbered in two levels, cut
    into chunks of ``chunk_rows`` positions, and the first ``k - 1`` rows of
    each chunk's successor get a copy (halo) in the chunk before, so every
    window runs per (key, chunk) and stays exact."""
    if not chunk_rows:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(k - 1), 0)
        return df.withColumn(out, F.avg(value).over(w))
    size = max(int(chunk_rows), k)
    n = row_number(df, keys, order, "_rn", chunk=RANGE)
    owner = F.floor((F.col("_rn") - 1) / size)
    # a row also feeds the next chunk when it is among the last k-1 of its own
    halo = F.when((F.col("_rn") - 1) % size >= size - (k - 1), F.array(owner, owner + 1)).otherwise(F.array(owner))
    spread = n.withColumn("_own", owner).withColumn("_c", F.explode(halo))
    w = Window.partitionBy(*keys, "_c").orderBy("_rn").rowsBetween(-(k - 1), 0)
    return (spread.withColumn(out, F.avg(value).over(w)).where(F.col("_own") == F.col("_c"))
            .drop("_rn", "_own", "_c"))
