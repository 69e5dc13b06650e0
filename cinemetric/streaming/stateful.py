"""Structured Streaming operators.

* ``every_nth``: keep every n-th event of each source (frame-skipping camera
  reader) with a per-key counter in ``applyInPandasWithState``;
* ``latest_per_source``: last retained event per source as a streaming
  ``max_by`` aggregation in update mode;
* ``rolling_mean_stream``: mean of the last k values per key with a ring
  buffer kept in state (batch twin: ``sampling.rolling_mean``);
* ``score_stream``: expression scoring on arriving rows with frozen
  statistics (per-route mean/sd and the tail threshold from a batch fit).


Both keyed operators take ``idle``, a time to live in event time: the state of a
source is dropped when the watermark (the latest event time less ``lateness``)
has passed its last event by so much, so sources that fell silent leave the
state instead of staying in it for good; one that comes back starts anew.
Being bound to event time, a replay gives the same rows.

Order inside a micro-batch is (event time, id); across micro-batches it is
arrival order, as for a live camera.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import text as TX
from ..operators import scoring as S


def _watched(events: DataFrame, time: str, idle: str | None, lateness: str | None) -> tuple[DataFrame, str]:
    """The events with a watermark, and the kind of timeout, if state expires."""
    if not idle:
        return events, GroupStateTimeout.NoTimeout
    return events.withWatermark(time, lateness or idle), GroupStateTimeout.EventTimeTimeout


def _stay(state, last: pd.Timestamp, idle: str | None) -> None:
    """Keep the state until ``idle`` after its last event."""
    if idle:
        due = int(pd.Timestamp(last).timestamp() * 1000) + int(pd.Timedelta(idle).total_seconds() * 1000)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))


def _in_order(parts: list[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """The rows of a key sorted, ties as they came, missing values last."""
    pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    cols = [pdf[c].to_numpy() for c in order]
    if any(c.dtype.kind not in "iufM" for c in cols):
        return pdf.sort_values(order, kind="mergesort")
    return pdf.take(np.lexsort(cols[::-1]))


def every_nth(events: DataFrame, key: str, order: list[str], n: int = 4, idle: str | None = None, lateness: str | None = None) -> DataFrame:
    """Events whose 1-based position within their key is a multiple of ``n``;
    with ``idle`` a key silent for so long (``order[0]`` is the event time, a
    timestamp) is counted from one again.  ``lateness`` is how late events may
    come (``idle`` if not given); later ones are dropped."""
    events, kind = _watched(events, order[0], idle, lateness)
    schema = events.schema
    state_schema = "count long"

    def step(k, pdfs: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else 0
        pdf = _in_order(list(pdfs), order)
        pos = seen + pd.RangeIndex(1, len(pdf) + 1)
        state.update((int(seen + len(pdf)),))
        _stay(state, pdf[order[0]].iloc[-1], idle)
        yield pdf[(pos % n == 0)]

    return events.groupBy(key).applyInPandasWithState(step, schema, state_schema, "append", kind)



def _drop_version(spark, state_path: str, batch_id: int) -> None:
    """Remove a state version that no retry needs any more (a repeated batch
    reads the version before its own)."""
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/batch={batch_id}")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def every_nth_batchwise(events: DataFrame, key: str, order: list[str], n: int, out_path: str, state_path: str,
                        checkpoint: str, prune: bool = False) -> None:
    """Scale form of ``every_nth`` for sources that may hold a large share of
    a micro-batch: each micro-batch is numbered per key in two levels over
    range chunks (``sequence.row_number``), offset by the key's count from
    the previous batches, and filtered; the counts live in a state table with
    one version per batch id.  Re-running a batch id overwrites the same
    output and state version, so a retried batch gives the same rows;
    ``prune`` keeps only the last two state versions.
    Runs to completion (``availableNow``); the kept rows are appended under
    ``out_path`` as ``batch=<id>`` folders."""
    from ..operators.sequence import RANGE, row_number

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prev = None
        if batch_id > 0:
            prev = spark.read.parquet(f"{state_path}/batch={batch_id - 1}")
        numbered = row_number(batch, [key], order, "_rn", chunk=RANGE)
        if prev is not None:
            numbered = numbered.join(prev, key, "left")
            pos = F.coalesce(F.col("_seen"), F.lit(0)) + F.col("_rn")
        else:
            pos = F.col("_rn")
        kept = numbered.where(pos % n == 0).drop("_rn", "_seen")
        kept.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        counts = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_new"))
        if prev is not None:
            counts = counts.join(prev, key, "full").select(
                key, (F.coalesce("_seen", F.lit(0)) + F.coalesce("_new", F.lit(0))).alias("_seen"))
        else:
            counts = counts.select(key, F.col("_new").alias("_seen"))
        counts.write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")
        if prune:
            _drop_version(spark, state_path, batch_id - 2)

    q = (events.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()

def latest_per_source(events: DataFrame, key: str, ts: str, payload: list[str]) -> DataFrame:
    """Last event per source by time, ties by the payload's columns (update-mode streaming aggregation)."""
    return events.groupBy(key).agg(F.max_by(F.struct(*payload), F.struct(ts, *payload)).alias("latest"), F.max(ts).alias("last_ts"))


def rolling_mean_stream(events: DataFrame, key: str, order: list[str], value: str, id_col: str,
                        k: int = 5, idle: str | None = None, lateness: str | None = None) -> DataFrame:
    """Per event: mean of the last ``k`` values of its key (ring buffer in
    state); with ``idle`` the buffer of a key silent for so long is dropped
    (see ``every_nth``)."""
    events, kind = _watched(events, order[0], idle, lateness)
    id_type = dict(events.dtypes)[id_col]
    key_type = dict(events.dtypes)[key]
    out_schema = f"{key} {key_type}, {id_col} {id_type}, rolling double"

    def step(kk, pdfs: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        buf = list(state.get[0]) if state.exists else []
        pdf = _in_order(list(pdfs), order)
        n, old = len(pdf), min(len(buf), k - 1)
        run = np.concatenate([np.zeros(k - 1 - old), buf[len(buf) - old:], pdf[value].to_numpy(dtype=float)])
        total = np.zeros(n)
        for lag in range(k):               # oldest first, as a plain sum adds them
            total += run[lag:lag + n]
        means = total / np.minimum(np.arange(1, n + 1) + old, k)
        state.update(((buf + run[k - 1:].tolist())[-k:],))
        _stay(state, pdf[order[0]].iloc[-1], idle)
        yield pd.DataFrame({key: pdf[key].to_numpy(), id_col: pdf[id_col].to_numpy(), "rolling": means})

    return events.groupBy(key).applyInPandasWithState(step, out_schema, "buf array<double>", "append", kind)



def rolling_mean_batchwise(events: DataFrame, key: str, order: list[str], value: str, id_col: str, k: int,
                           out_path: str, state_path: str, checkpoint: str, chunk_rows: int = 4096,
                           prune: bool = False) -> None:
    """Scale form of ``rolling_mean_stream``: per micro-batch, the last
    ``k - 1`` rows of every key from earlier batches (a state table versioned
    by batch id) are put in front of the batch rows, the rolling mean runs in
    chunks with a halo (``sequence.rolling_mean``), and the new last ``k - 1``
    rows per key are found with a two-level count, so a hot key is never one
    task.  Writes ``(key, id, rolling)`` for the batch rows under
    ``out_path/batch=<id>``; a retried batch rewrites the same versions;
    ``prune`` keeps only the last two state versions."""
    from ..operators.sequence import RANGE, rolling_mean, running_sums

    cols = list(dict.fromkeys([key, *order, value, id_col]))

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cur = batch.select(*cols).withColumn("_seq", F.lit(1)).withColumn("_pos", F.lit(None).cast("long"))
        rows = cur
        if batch_id > 0:
            halo = spark.read.parquet(f"{state_path}/batch={batch_id - 1}").withColumn("_seq", F.lit(0))
            rows = halo.select(*cols, "_seq", "_pos").unionByName(cur)
        # earlier batches first (arrival order), kept rows in their old order
        ordering = ["_seq", "_pos", *order]
        means = rolling_mean(rows, [key], ordering, value, k, "rolling", chunk_rows=chunk_rows)
        means.where(F.col("_seq") == 1).select(key, id_col, "rolling") \
            .write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        numbered = running_sums(rows, [key], ordering, {"_n": F.lit(1)}, chunk=RANGE, key_totals=True)
        last = numbered.where(F.col("_n") > F.col("_n_total") - (k - 1))
        last.select(*cols, F.col("_n").cast("long").alias("_pos")) \
            .write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")
        if prune:
            _drop_version(spark, state_path, batch_id - 2)

    q = (events.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()

def score_stream(rows: DataFrame, text: str, score: str, route_stats: DataFrame, tail_threshold: float) -> DataFrame:
    """Stateless scoring of arriving expressions with frozen statistics:
    route -> clamp -> z-normalise with the given (route, mu, sd) -> tail
    smoothing with the given threshold -> clamp.  ``route_stats`` is a small
    batch table (one row per route) joined as a static side."""
    r = rows.withColumn("Model_Used", TX.model_used(text)).withColumn("_p", S.clamp(score))
    j = r.join(F.broadcast(route_stats), "Model_Used", "left")  # one row per route: at most three
    z = F.when(F.col("sd").isNull() | (F.col("sd") == 0), F.lit(S.TARGET_MEAN)) \
        .otherwise((F.col("_p") - F.col("mu")) / F.col("sd") * S.TARGET_SD + S.TARGET_MEAN)
    t = F.lit(float(tail_threshold))
    sm = F.when((t < S.SCORE_MAX) & (z > t), z * (1 - S.TAIL_STRENGTH * (z - t) / (S.SCORE_MAX - t))).otherwise(z)
    return j.withColumn("Predicted_Concreteness", S.clamp(sm)).drop("_p", "mu", "sd")


def fit_frozen_stats(rows: DataFrame, text: str, score: str,
                     quantile_method: str = "distributed") -> tuple[DataFrame, float | None]:
    """Batch fit of the statistics ``score_stream`` freezes: per-route mean and
    sample sd of the clamped score, and the exact tail quantile of the
    normalised score.  The route table has at most one row per route (three),
    so it is brought back and rebuilt as a literal table: later micro-batches
    join that fixed table instead of re-running the fit."""
    r = rows.withColumn("Model_Used", TX.model_used(text)).withColumn("_p", S.clamp(score))
    z = S.znorm(r, "_p", by=["Model_Used"], out="_z", fixed_groups=True)
    stats = (r.groupBy("Model_Used").agg(F.avg("_p").alias("mu"), F.stddev_samp("_p").alias("sd")))
    frozen = rows.sparkSession.createDataFrame(stats.collect(), stats.schema)  # <= 3 rows (one per route)
    from ..operators.quantiles import exact_quantile
    return frozen, exact_quantile(z, "_z", S.TAIL_QUANTILE, quantile_method)


def run_available(stream: DataFrame, out_path: str, checkpoint: str) -> DataFrame:
    """Process everything available (``availableNow``) into a Parquet sink
    under the shared folder, then return the written table.  Append mode."""
    q = (stream.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out_path)   # no file of rows yet: an empty table


def run_updates(stream: DataFrame, out_path: str, checkpoint: str, key: str) -> DataFrame:
    """Update-mode aggregation: each micro-batch's changed rows are appended
    with the batch id; the returned table keeps the last version per key."""
    def sink(batch_df, batch_id):
        batch_df.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out_path)

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    t = stream.sparkSession.read.parquet(out_path)
    # last version per key: an aggregate (partial on the map side), no per-key sort
    cols = [c for c in t.columns if c not in (key, "_batch")]
    return t.groupBy(key).agg(F.max_by(F.struct(*cols), "_batch").alias("_last")).select(key, "_last.*")
