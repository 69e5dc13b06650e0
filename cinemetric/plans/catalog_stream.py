"""Registered streaming queries: the events table is read as a file stream,
processed with stateful operators until everything available is consumed,
and the sink table is returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import read_table, scratch_path
from ..streaming import stateful as ST

R6 = 6


def _table_stream(spark, sf, name, **options):
    """A table as a file stream, be it one file or a folder of files.  The file
    source watches folders; a pattern (here of one name) also takes a file."""
    schema = read_table(spark, sf, name).schema
    return spark.readStream.schema(schema).options(**options).parquet(f"{sf.rstrip('/')}/[{name[0]}]{name[1:]}.parquet")


def _events_stream(spark, sf):
    # one batch: the files of a folder need not follow the order of time
    return _table_stream(spark, sf, "events")


SLICES, FILES_PER_SLICE, FILES_PER_BATCH = 3, 4, 16


def _events_in_slices(spark, sf):
    """The events as a stream of several micro-batches in time order (time
    slices of several files each, written one after the other), so that state
    crosses batches."""
    ev = read_table(spark, sf, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    span = ev.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    path = scratch_path(spark, "events")
    for i in range(SLICES):
        since, until = lo + (hi + 1 - lo) * i // SLICES, lo + (hi + 1 - lo) * (i + 1) // SLICES
        ev.where((t >= since) & (t < until)).repartition(FILES_PER_SLICE).write.mode("append").parquet(path)
    return spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", FILES_PER_SLICE).parquet(path)


def q_stream_every_nth(spark, sf):
    ev = _events_stream(spark, sf).select("event_id", "ts", "user_id", "value")
    out = ST.every_nth(ev, "user_id", ["ts", "event_id"], 4)
    t = ST.run_available(out, scratch_path(spark, "every-nth"), scratch_path(spark, "every-nth-ckpt"))
    return t.select("user_id", "event_id")


SQL_STREAM_EVERY_NTH = """
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
FROM events) WHERE rn % 4 = 0"""



def q_stream_every_nth_batchwise(spark, sf):
    """ST-01 in its scale form: per micro-batch two-level numbering with
    per-source counts kept in a versioned state table."""
    ev = _events_in_slices(spark, sf).select("event_id", "ts", "user_id", "value")
    out, state = scratch_path(spark, "every-nth-b"), scratch_path(spark, "every-nth-b-state")
    ST.every_nth_batchwise(ev, "user_id", ["ts", "event_id"], 4, out, state, scratch_path(spark, "every-nth-b-ckpt"), prune=True)
    return spark.read.parquet(out).select("user_id", "event_id")


def q_stream_every_nth_idle(spark, sf):
    """ST-01 over several micro-batches; counters live as long as the events do."""
    ev = _events_in_slices(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    out = ST.every_nth(ev, "user_id", ["ts", "event_id"], 4, idle="3650 days")
    return ST.run_available(out, scratch_path(spark, "every-nth-i"), scratch_path(spark, "every-nth-i-ckpt")).select("user_id", "event_id")


def q_stream_rolling_mean_idle(spark, sf):
    """ST-03 over several micro-batches; the last values live as long as the events do."""
    ev = _events_in_slices(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    out = ST.rolling_mean_stream(ev, "user_id", ["ts", "event_id"], "value", "event_id", 5, idle="3650 days")
    t = ST.run_available(out, scratch_path(spark, "rolling-i"), scratch_path(spark, "rolling-i-ckpt"))
    return t.select("event_id", F.round("rolling", R6).alias("rolling"))


def q_stream_rolling_mean(spark, sf):
    ev = _events_stream(spark, sf).select("event_id", "ts", "user_id", "value")
    out = ST.rolling_mean_stream(ev, "user_id", ["ts", "event_id"], "value", "event_id", 5)
    t = ST.run_available(out, scratch_path(spark, "rolling"), scratch_path(spark, "rolling-ckpt"))
    return t.select("event_id", F.round("rolling", R6).alias("rolling"))


SQL_STREAM_ROLLING_MEAN = """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                              ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events"""



def q_stream_rolling_mean_batchwise(spark, sf):
    """ST-03 in its scale form: per micro-batch halo of the last k-1 values
    per source from a versioned state table, chunked rolling means."""
    ev = _events_in_slices(spark, sf).select("event_id", "ts", "user_id", "value")
    out, state = scratch_path(spark, "rolling-b"), scratch_path(spark, "rolling-b-state")
    ST.rolling_mean_batchwise(ev, "user_id", ["ts", "event_id"], "value", "event_id", 5, out, state,
                              scratch_path(spark, "rolling-b-ckpt"), prune=True)
    return spark.read.parquet(out).select("event_id", F.round("rolling", R6).alias("rolling"))

def q_stream_latest(spark, sf):
    ev = _events_stream(spark, sf)
    out = ST.latest_per_source(ev, "user_id", "ts", ["event_id", "event_type", "value"])
    t = ST.run_updates(out, scratch_path(spark, "latest"), scratch_path(spark, "latest-ckpt"), "user_id")
    return t.select("user_id", F.col("latest.event_id").alias("event_id"), F.col("latest.event_type").alias("event_type"))


SQL_STREAM_LATEST = """SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type
FROM events GROUP BY user_id"""


def _doc_scores(df):
    """Documents with a stand-in raw model score in [1, 5] derived from their length."""
    return df.select("doc_id", "text", (F.lit(1.0) + F.lit(4.0) * (F.col("n_chars") % 997) / 996.0).alias("raw"))


def q_stream_scores(spark, sf):
    """Score arriving expressions (ST-04): routes, clamp, per-route
    normalisation and tail smoothing with statistics frozen from a batch fit
    of the same table, applied to the documents read as a file stream."""
    stats, tail = ST.fit_frozen_stats(_doc_scores(read_table(spark, sf, "documents")), "text", "raw")
    out = ST.score_stream(_doc_scores(_table_stream(spark, sf, "documents", maxFilesPerTrigger=FILES_PER_BATCH)), "text", "raw", stats, tail)
    t = ST.run_available(out, scratch_path(spark, "scores"), scratch_path(spark, "scores-ckpt"))
    return t.select("doc_id", "Model_Used", F.round("Predicted_Concreteness", R6).alias("score"))


_DOC_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"

SQL_STREAM_SCORES = f"""
WITH d AS (SELECT doc_id, 1 + 4 * (n_chars % 997) / 996.0 AS raw, {_DOC_WORDS} AS n FROM documents WHERE text IS NOT NULL)
, c AS (SELECT doc_id, greatest(1.0, least(5.0, raw)) AS p0,
               CASE WHEN n > 8 THEN 'Sentence' WHEN n > 1 THEN 'Multiword' ELSE 'Single-word' END AS Model_Used FROM d)
, s AS (SELECT Model_Used, avg(p0) AS mu, stddev_samp(p0) AS sd FROM c GROUP BY 1)
, z AS (SELECT c.*, CASE WHEN sd IS NULL OR sd = 0 THEN 3.0 ELSE (p0 - mu) / sd * 1.0 + 3.0 END AS pz
        FROM c JOIN s USING (Model_Used))
, t AS (SELECT quantile_cont(pz, 0.9) AS t FROM z)
SELECT doc_id, Model_Used, round(greatest(1.0, least(5.0,
       CASE WHEN t.t < 5 AND pz > t.t THEN pz * (1 - 0.1 * (pz - t.t) / (5 - t.t)) ELSE pz END)), 6) AS score
FROM z, t"""


QUERIES = {
    "stream_every_nth_idle": (q_stream_every_nth_idle, SQL_STREAM_EVERY_NTH),
    "stream_rolling_mean_idle": (q_stream_rolling_mean_idle, SQL_STREAM_ROLLING_MEAN),
    "stream_every_nth": (q_stream_every_nth, SQL_STREAM_EVERY_NTH),
    "stream_every_nth_batchwise": (q_stream_every_nth_batchwise, SQL_STREAM_EVERY_NTH),
    "stream_rolling_mean": (q_stream_rolling_mean, SQL_STREAM_ROLLING_MEAN),
    "stream_rolling_mean_batchwise": (q_stream_rolling_mean_batchwise, SQL_STREAM_ROLLING_MEAN),
    "stream_latest": (q_stream_latest, SQL_STREAM_LATEST),
    "stream_scores": (q_stream_scores, SQL_STREAM_SCORES),
}
