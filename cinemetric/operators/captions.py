"""Timed captions -> timed words -> sentences (transcript regrouping).

Input: ``(video_id, cap_idx, text, start, duration)``.  Caption order is data
(``cap_idx``), never row order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words as py_words
from .sequence import RANGE, next_value, row_number, running_sums

# Sentence mark, default exclusion pattern, unknown-mark label.
SPLIT_PUNC = "."
EXCLUDE_ON = r".*\["
NO_PUNC = "0"
SENTENCE_CHUNK = 4096     # sentences per chunk of the two-level numbering


def clip_ends(captions: DataFrame, video: str = "video_id", order: str = "cap_idx",
              chunk: Column | str | None = RANGE) -> DataFrame:
    """``end = min(start + duration, next start)``; the last caption keeps its own end.
    The next caption is taken before empty captions are removed.  ``chunk``
    (e.g. ``cap_idx div 256``, or ``RANGE``, the default) takes the lead in
    two levels (see ``sequence.next_value``) so a long video is not one task;
    ``None`` uses one window per video."""
    own = F.col("start") + F.col("duration")
    with_next = next_value(captions, [video], [order], "start", "_next_start", chunk=chunk)
    nxt = F.col("_next_start")
    return with_next.withColumn("end", F.when(nxt.isNull(), own).otherwise(F.least(own, nxt))).drop("_next_start")


def default_punctuation(word: Column) -> Column:
    """Rule-based labeller (UDF-03 default): a word ending with ``.`` carries
    the mark; the mark is removed from the word."""
    return F.struct(
        F.regexp_replace(word, r"\.$", "").alias("word"),
        F.when(word.endswith(SPLIT_PUNC), F.lit(SPLIT_PUNC)).otherwise(F.lit(NO_PUNC)).alias("punc"),
        F.lit(1.0).alias("punc_conf"))


def word_times(captions: DataFrame, video: str = "video_id", order: str = "cap_idx",
               labeller=default_punctuation) -> DataFrame:
    """One row per word with ``time_range = (s + i*d, s + (i+1)*d)``, ``d = (end-start)/n``.
    Captions without words produce no rows.  Needs ``end`` (see ``clip_ends``)."""
    # Materialise the word array once: an expression over the input row that
    # sits next to a generator would otherwise be re-evaluated per output row.
    arr = captions.select(video, order, "start", "end", py_words("text").alias("_ws"))
    arr = arr.select(video, order, "start", "end", "_ws", F.size("_ws").alias("_n"))
    exploded = arr.select(video, order, "start", "end", "_n", F.posexplode("_ws").alias("w_idx", "_raw"))
    d = (F.col("end") - F.col("start")) / F.col("_n")
    lab = labeller(F.col("_raw"))
    return exploded.select(
        video, order, "w_idx", lab["word"].alias("word"), lab["punc"].alias("punc"),
        lab["punc_conf"].alias("punc_conf"),
        F.struct((F.col("start") + F.col("w_idx") * d).alias("start"),
                 (F.col("start") + (F.col("w_idx") + 1) * d).alias("end")).alias("time_range"))


def regroup(words: DataFrame, video: str = "video_id", order: tuple[str, str] = ("cap_idx", "w_idx"),
            split_punc: str = SPLIT_PUNC, exclude_on: str | None = EXCLUDE_ON,
            chunk: Column | str | None = RANGE) -> DataFrame:
    """Sentences between consecutive marks: words after one mark up to and
    including the next.  Words up to the first mark and after the last are
    dropped (reference behaviour).  ``exclude_on`` drops sentences whose text
    matches the pattern at the start (``re.match`` semantics).

    The group number is an exclusive running count of marks; with ``chunk``
    (e.g. ``cap_idx div 256``) the count is two-level so one long video never
    lands in a single task.  Output: video, sent_idx (0-based over kept
    sentences), text, start, end, duration."""
    is_mark = (F.col("punc") == split_punc).cast("long")
    # exclusive mark count per word, plus the video's mark total from the
    # same pass (no second aggregation over all words)
    g = running_sums(words, [video], list(order), {"_g": is_mark}, inclusive=False, chunk=chunk, key_totals=True)
    kept = g.where((F.col("_g") >= 1) & (F.col("_g") < F.col("_g_total")))
    sent = (kept.groupBy(video, "_g")
            .agg(F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], F.col("word")))).alias("_w"),
                 F.min("time_range.start").alias("start"), F.max("time_range.end").alias("end"))
            .select(video, "_g", F.array_join(F.transform("_w", lambda s: s["word"]), " ").alias("text"),
                    "start", "end", (F.col("end") - F.col("start")).alias("duration")))
    if exclude_on:
        sent = sent.where(~F.col("text").rlike(f"^(?:{exclude_on})"))
    # sentence number over the kept sentences; two-level when chunked
    sent_chunk = F.floor(F.col("_g") / SENTENCE_CHUNK) if chunk is not None else None
    sent = row_number(sent, [video], ["_g"], "_rn", chunk=sent_chunk)
    return sent.withColumn("sent_idx", (F.col("_rn") - 1).cast("long")).drop("_g", "_rn")


def drop_bracketed(captions: DataFrame, text: str = "text") -> DataFrame:
    """Drop captions containing ``[`` (sound tags)."""
    return captions.where(~F.col(text).contains("["))


def regroup_status(captions: DataFrame, words: DataFrame, labelled: DataFrame | None = None,
                   video: str = "video_id") -> DataFrame:
    """Per processed video (every video with captions): words given timings vs
    words returned by the labeller (the reference's status is always true;
    ours compares the counts).  The three aggregates share the video
    partitioning, so the joins add no shuffle."""
    labelled = labelled if labelled is not None else words
    vids = captions.groupBy(video).agg(F.count(F.lit(1)).alias("n_captions"))
    a = words.groupBy(video).agg(F.count(F.lit(1)).alias("n_timed"))
    b = labelled.groupBy(video).agg(F.count(F.lit(1)).alias("n_labelled"))
    j = vids.join(a, video, "left").join(b, video, "left")
    nt, nl = F.coalesce("n_timed", F.lit(0)), F.coalesce("n_labelled", F.lit(0))
    return j.select(video, nt.alias("n_timed"), nl.alias("n_labelled"), (nt == nl).alias("same_length"))


def failure_rate(status: DataFrame) -> DataFrame:
    """Share of processed videos whose labelled word count differs (AG-25)."""
    failed = F.when(F.col("same_length"), 0).otherwise(1)
    return status.agg(F.count(F.lit(1)).alias("n_videos"), F.sum(failed).cast("long").alias("n_failed"),
                      F.avg(failed.cast("double")).alias("failure_rate"))


def label_words_by_video(words: DataFrame, labeller, video: str = "video_id",
                         order: tuple[str, str] = ("cap_idx", "w_idx"),
                         captions_per_call: int | None = 256, halo: int = 32) -> DataFrame:
    """Model hook for punctuation (UDF-03): ``labeller(list[str]) -> list[(word,
    punc, conf)]`` sees the words of a video in order (a punctuation model
    needs the running text).  It is called once per (video, run of
    ``captions_per_call`` consecutive captions): Spark gathers and sorts the
    runs, and many of them reach Python in one batch.  A run also sees the
    words of ``halo`` captions before and after it and keeps only its own
    words' labels, so the result equals one call over the whole video for any
    model whose context is no longer than the halo;
    ``captions_per_call=None`` is that one call.  The input needs ``word`` and
    ``time_range``; the output replaces word/punc/conf."""
    if captions_per_call:
        own, reach = F.floor(F.col(order[0]) / captions_per_call), F.lit(halo)
        first = F.floor((F.col(order[0]) - reach) / captions_per_call)
        last = F.floor((F.col(order[0]) + reach) / captions_per_call)
        runs = F.explode(F.sequence(first, last))
    else:
        own, runs = F.lit(0), F.lit(0)
    cols = [video, *order, "word", "time_range"]
    seen = words.select(*cols, own.alias("_own"), runs.alias("_run")).withColumn("_own", F.col("_own") == F.col("_run"))
    run = Window.partitionBy(video, "_run")
    # a run of other runs' words only is not called; the rows stay in order
    numbered = (seen.withColumn("_n", F.row_number().over(run.orderBy(*[F.asc_nulls_last(o) for o in order])))
                .withColumn("_any", F.max("_own").over(run)).where("_any").select(*cols, "_own", "_n"))
    schema = words.select(*cols).schema.add("punc", "string").add("punc_conf", "double")

    def of_runs(t: pa.Table, starts: list[int]) -> pa.RecordBatch:
        """The runs that begin at ``starts`` labelled, their own words kept."""
        seen_words, lab = t.column("word").to_pylist(), []
        for lo, hi in zip(starts, [*starts[1:], t.num_rows]):
            got = labeller(seen_words[lo:hi])
            if len(got) != hi - lo:
                raise ValueError("labeller must return one label per word")
            lab.extend(got)
        out = [pa.array([x[0] for x in lab], pa.string()) if c == "word" else t.column(c) for c in cols]
        out += [pa.array([x[1] for x in lab], pa.string()), pa.array([float(x[2]) for x in lab], pa.float64())]
        return pa.Table.from_arrays(out, [*cols, "punc", "punc_conf"]).filter(t.column("_own"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = []              # the run that may go on in the next batch
        for b in batches:
            firsts = np.flatnonzero(b.column("_n").to_numpy() == 1)
            if len(firsts) and (rest or firsts[-1]):
                done = pa.Table.from_batches([*rest, b.slice(0, int(firsts[-1]))])
                if done.num_rows:
                    yield from of_runs(done, np.flatnonzero(done.column("_n").to_numpy() == 1).tolist()).to_batches()
                rest = []
            rest.append(b.slice(int(firsts[-1])) if len(firsts) else b)
        if rest:
            last = pa.Table.from_batches(rest)
            if last.num_rows:
                yield from of_runs(last, np.flatnonzero(last.column("_n").to_numpy() == 1).tolist()).to_batches()

    return numbered.mapInArrow(label, schema)
