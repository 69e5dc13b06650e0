"""Shots, scenes and fixed-length clips over frame numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import next_value, range_chunks, row_number

# Open-ended last clip length (8 s at 24 fps) and clip length.
OPEN_END_FRAMES = 8 * 24
CLIP_LEN = 8


def shots_from_cuts(cuts: DataFrame, movie: str = "movie_id", start: str = "start_frame") -> DataFrame:
    """Shot table per movie: starts are 0 then every cut; a shot ends one frame
    before the next start; the last end is -1 (open).  ``shot_no`` is 1-based."""
    starts = cuts.select(movie, F.col(start).cast("long").alias("start_frame")).unionByName(
        cuts.select(movie).distinct().select(movie, F.lit(0).cast("long").alias("start_frame")))
    # lead and numbering per movie in two levels over range chunks
    tagged = range_chunks(starts, [movie], ["start_frame"])
    nxt = next_value(tagged, [movie], ["start_frame"], "start_frame", "_next", chunk=F.col("_rchunk"))
    num = row_number(nxt, [movie], ["start_frame"], "shot_no", chunk=F.col("_rchunk"))
    return num.select(movie, "start_frame",
                      F.coalesce(F.col("_next") - 1, F.lit(-1).cast("long")).alias("end_frame"),
                      F.col("shot_no").cast("long").alias("shot_no"))


def close_open_end(start: Column, end: Column, length: int = OPEN_END_FRAMES) -> Column:
    """End -1 (open) becomes ``start + length``."""
    return F.when(end == -1, start + length).otherwise(end)


def clip_frames(clips: DataFrame, scenes: DataFrame, shots: DataFrame, movie: str = "movie_id") -> DataFrame:
    """Clip (0-based ``clip_id``) -> scene row -> first/last shot (1-based) ->
    first/last frame.  A shot number outside the shot table drops the clip
    (inner joins) instead of wrapping around like a negative position."""
    sc = scenes.select(movie, "clip_id", "start_shot", "end_shot")
    s1 = shots.select(movie, F.col("shot_no").alias("start_shot"), F.col("start_frame"))
    s2 = shots.select(movie, F.col("shot_no").alias("end_shot"), F.col("end_frame"))
    return (clips.join(sc, [movie, "clip_id"]).join(s1, [movie, "start_shot"]).join(s2, [movie, "end_shot"]))


def centered_clips(totals: DataFrame, movie: str = "movie_id", total: str = "total",
                   length: int = CLIP_LEN, split: str = "test") -> DataFrame:
    """One clip of ``length`` frames per labelled frame i in ``[0, total)``:
    near the start ``[0, L)`` (label i), near the end ``[total-L, total)``
    (label ``i-(total-L)``), else ``[i-ceil(L/2), i+floor(L/2))`` (label ceil(L/2)).
    The edge clips are skipped for the train split.  End is exclusive."""
    up, down = math.ceil(length / 2), math.floor(length / 2)
    rows = totals.select(movie, total, F.explode(F.sequence(F.lit(0).cast("long"), F.col(total) - 1)).alias("i"))
    head = F.col("i") < up
    tail = (F.col(total) - F.col("i")) < down
    out = rows.select(
        movie, F.col("i").alias("label_idx"),
        F.when(head, F.lit(0)).when(tail, F.col(total) - length).otherwise(F.col("i") - up).cast("long").alias("start_frame"),
        F.when(head, F.lit(length)).when(tail, F.col(total)).otherwise(F.col("i") + down).cast("long").alias("end_frame"),
        F.when(head, F.col("i")).when(tail, F.col("i") - (F.col(total) - length)).otherwise(F.lit(up))
        .cast("long").alias("label_frame"),
        (head | tail).alias("_edge"))
    if split == "train":
        out = out.where(~F.col("_edge"))
    return out.drop("_edge")


def uniform_frames(lo: Column, hi: Column, k: int = 8) -> Column:
    """``k`` evenly spaced frame numbers from lo to hi inclusive, truncated to
    int like ``linspace(..., dtype=int)`` (the last one is exactly hi)."""
    if k == 1:
        return F.array(lo.cast("long"))
    step = (hi - lo).cast("double") / (k - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                       lambda i: F.when(i == k - 1, hi.cast("long")).otherwise((lo + i * step).cast("long")))


def rebase_frames(joints: DataFrame, video: str = "video_id", frame: str = "frame") -> DataFrame:
    """Re-number frames per video to start at 1 (``frame - min + 1``)."""
    mins = joints.groupBy(video).agg(F.min(frame).alias("_m"))
    # one row per video: broadcast when the probe proves it small, so a long
    # video's rows are not all shuffled to one join task
    return joints.join(mins, video).withColumn(frame, F.col(frame) - F.col("_m") + 1).drop("_m")


def label_at_time(samples: DataFrame, annotations: DataFrame, movie: str = "movie_id",
                  frame: str = "label_frame", time: str = "Time") -> DataFrame:
    """Sample -> annotation row whose time equals the label frame (JN-09)."""
    a = annotations.withColumnRenamed(time, frame)
    return samples.join(a, [movie, frame])
