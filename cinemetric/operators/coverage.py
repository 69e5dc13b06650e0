"""Clip index: which caption intervals are fully covered by frames, and how
many of those frames show a person.

The naive form is a range join (caption x frames of its video where
``s <= frame <= e``), whose cost is the sum over videos of captions x frames.
The form used here needs only equi-joins: number the frames of each video in
order (``rn``) and keep a running count of boxed frames (``pb``); then a
caption ``[s, e]`` is complete iff frames ``s`` and ``e`` both exist and
``rn(e) - rn(s) = e - s``, and its person share is
``(pb(e) - pb(s) + box(s)) / (e - s + 1)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import running_sum, running_sums

# Frame rate and minimum clip length of the index build.
FPS = 8
VIDEO_LEN = 8


def frame_bounds(start: Column, end: Column, fps: int = FPS) -> tuple[Column, Column]:
    """First and last frame of an interval: ``ceil(start*fps)``, ``floor(end*fps)``."""
    return F.ceil(start * fps).cast("long"), F.floor(end * fps).cast("long")


def number_frames(frames: DataFrame, video: str = "video_id", frame: str = "frame_idx",
                  has_box: str = "has_box", chunk_size: int | None = 4096) -> DataFrame:
    """Add ``rn`` (1-based rank of the frame in its video) and ``pb`` (running
    count of boxed frames), two-level when ``chunk_size`` is set."""
    chunk = F.floor(F.col(frame) / chunk_size) if chunk_size else None
    f = frames.select(video, frame, F.col(has_box).cast("long").alias("box"))
    return running_sums(f, [video], [frame], {"rn": F.lit(1), "pb": F.col("box")}, chunk=chunk)


def frame_coverage(clips: DataFrame, frames: DataFrame, video: str = "video_id", fps: int = FPS,
                   video_len: int = VIDEO_LEN, frame: str = "frame_idx", has_box: str = "has_box",
                   chunk_size: int | None = 4096, keys: list[str] | None = None) -> DataFrame:
    """Keep clips with at least ``video_len`` frames, all present on disk; add
    ``start_frame``, ``end_frame`` and ``has_person`` (share of boxed frames).

    With ``keys`` (columns that identify a clip, e.g. video and caption
    position) both end frames are looked up in a single join: each clip
    becomes two end-point rows, joined once to the numbered frames and folded
    back per clip.  Without keys, two joins (one per end point) are used.

    The joins on frames are merge joins: frames made by ``explode`` look small
    to the planner, which would otherwise broadcast all of them."""
    s, e = frame_bounds(F.col("start"), F.col("end"), fps)
    c = clips.withColumn("start_frame", s).withColumn("end_frame", e) \
        .where(F.col("end_frame") - F.col("start_frame") + 1 >= video_len)
    nf = number_frames(frames, video, frame, has_box, chunk_size)
    n = F.col("end_frame") - F.col("start_frame") + 1
    if keys:
        ends = c.select(*keys, video, F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("start_frame").alias("_f")),
            F.struct(F.lit(1).alias("side"), F.col("end_frame").alias("_f")))).alias("_p"))
        ends = ends.select(*keys, video, F.col("_p.side").alias("side"), F.col("_p._f").alias(frame))
        hit = ends.join(nf.hint("merge"), [video, frame])
        folded = hit.groupBy(*keys).agg(
            F.max(F.when(F.col("side") == 0, F.col("rn"))).alias("rn_s"),
            F.max(F.when(F.col("side") == 0, F.col("pb"))).alias("pb_s"),
            F.max(F.when(F.col("side") == 0, F.col("box"))).alias("box_s"),
            F.max(F.when(F.col("side") == 1, F.col("rn"))).alias("rn_e"),
            F.max(F.when(F.col("side") == 1, F.col("pb"))).alias("pb_e"))
        j = c.join(folded, keys)
    else:
        at_s = nf.select(F.col(video).alias("_v1"), F.col(frame).alias("_f1"), F.col("rn").alias("rn_s"),
                         F.col("pb").alias("pb_s"), F.col("box").alias("box_s"))
        at_e = nf.select(F.col(video).alias("_v2"), F.col(frame).alias("_f2"), F.col("rn").alias("rn_e"),
                         F.col("pb").alias("pb_e"))
        j = (c.join(at_s.hint("merge"), (F.col(video) == F.col("_v1")) & (F.col("start_frame") == F.col("_f1")))
             .join(at_e.hint("merge"), (F.col(video) == F.col("_v2")) & (F.col("end_frame") == F.col("_f2"))))
    return (j.where(F.col("rn_s").isNotNull() & F.col("rn_e").isNotNull()
                    & (F.col("rn_e") - F.col("rn_s") == F.col("end_frame") - F.col("start_frame")))
            .withColumn("has_person", (F.col("pb_e") - F.col("pb_s") + F.col("box_s")) / n)
            .drop("_v1", "_f1", "_v2", "_f2", "rn_s", "pb_s", "box_s", "rn_e", "pb_e"))


def frame_coverage_naive(clips: DataFrame, frames: DataFrame, video: str = "video_id", fps: int = FPS,
                         video_len: int = VIDEO_LEN, frame: str = "frame_idx",
                         has_box: str = "has_box") -> DataFrame:
    """Range-join twin of ``frame_coverage`` (for tests on small inputs)."""
    s, e = frame_bounds(F.col("start"), F.col("end"), fps)
    c = clips.withColumn("start_frame", s).withColumn("end_frame", e) \
        .where(F.col("end_frame") - F.col("start_frame") + 1 >= video_len)
    f = frames.select(F.col(video).alias("_v"), F.col(frame).alias("_f"), F.col(has_box).cast("int").alias("_b"))
    j = c.join(f, (F.col(video) == F.col("_v")) & F.col("_f").between(F.col("start_frame"), F.col("end_frame")))
    keys = [x for x in c.columns]
    agg = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("_b").alias("_nb"))
    n = F.col("end_frame") - F.col("start_frame") + 1
    return agg.where(F.col("_n") == n).withColumn("has_person", F.col("_nb") / n).drop("_n", "_nb")


def attach_scores(clips: DataFrame, scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Inner lookup that must hit: a clip without a score raises at run time."""
    j = clips.join(scores.select(*keys, F.col(score).alias("_s")), keys, "left")
    # the check is a filter on the row, so it runs whatever columns are used later
    hit = F.when(F.col("_s").isNull(), F.raise_error(F.lit(f"missing {score} for a clip")).cast("boolean")).otherwise(F.lit(True))
    return j.where(hit).withColumn(score, F.col("_s")).drop("_s")


def select_clips(index: DataFrame, dmin: float = 2.0, dmax: float = 10.0, text_min: int = 3,
                 neutral_max: float = 1.0, person_min: float = 0.0) -> DataFrame:
    """``dmin < duration < dmax`` (strict), ``length(text) >= text_min``,
    ``neutral_score <= neutral_max``, ``has_person >= person_min``."""
    return index.where((F.col("duration") > dmin) & (F.col("duration") < dmax)
                       & (F.length("text") >= text_min)
                       & (F.col("neutral_score") <= neutral_max)
                       & (F.col("has_person") >= person_min))


def index_counts(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("n_samples"),
                     F.count_if(F.col("has_person") > 0).alias("n_with_person_partial"),
                     F.count_if(F.col("has_person") == 1).alias("n_with_person_all"))


def video_ids(index: DataFrame, video: str = "video_id") -> DataFrame:
    """Distinct video ids of an index, with the number of clips of each (AG-31)."""
    return index.groupBy(video).agg(F.count(F.lit(1)).alias("n_clips"))


def video_id_from_link(link: Column) -> Column:
    """Watch link -> id (text after ``?v=``); other strings unchanged."""
    return F.when(link.contains("https://www.youtube.com/watch"), F.substring_index(link, "?v=", -1)).otherwise(link)


def base_video_id(vid: Column) -> Column:
    """Id before the first ``&``."""
    return F.substring_index(vid, "&", 1)


def anti_blocklist(df: DataFrame, blocklist: DataFrame, video: str = "video_id") -> DataFrame:
    """Drop videos whose base id is listed; the list is a small fixed table."""
    bl = blocklist.select(F.col(blocklist.columns[0]).cast("string").alias("_b")).distinct()
    return (df.withColumn("_base", base_video_id(F.col(video).cast("string")))
            .join(bl, F.col("_base") == F.col("_b"), "left_anti").drop("_base"))


def valid_videos(*id_sets: DataFrame, video: str = "video_id", require: list[DataFrame] | None = None) -> DataFrame:
    """Union of candidate ids, kept when present in every ``require`` set."""
    ids = None
    for s in id_sets:
        part = s.select(video)
        ids = part if ids is None else ids.unionByName(part)
    ids = ids.distinct()
    for r in require or []:
        ids = ids.join(r.select(video).distinct(), video, "left_semi")
    return ids


def long_videos(playlist: DataFrame, duration: str = "duration", min_s: int = 2000) -> DataFrame:
    """Keep entries whose duration (text before the first comma, ``:``-separated)
    is known and either has more than two parts or weighs ``60*a + b > min_s``
    (pairs beyond the second part are ignored, so a single ``45`` counts 2700)."""
    parts = F.split(F.substring_index(F.col(duration), ",", 1), ":")
    a = F.try_element_at(parts, F.lit(1)).try_cast("long")
    b = F.try_element_at(parts, F.lit(2)).try_cast("long")
    weight = F.lit(60) * a + F.coalesce(b, F.lit(0))
    return playlist.where(F.col(duration).isNotNull() & ((F.size(parts) > 2) | (weight > min_s)))


def frame_name(idx: Column, width: int = 8, ext: str = ".jpg") -> Column:
    """Frame number -> zero-padded file name (``00001321.jpg``)."""
    return F.concat(F.lpad(idx.cast("string"), width, "0"), F.lit(ext))


def frame_number(name: Column) -> Column:
    """File name -> frame number: the digits before the first dot."""
    return F.regexp_extract(name, r"(\d+)\.", 1).cast("long")


def useful_frames(frames: DataFrame, captions: DataFrame, fps: int = 24, keep: bool = True,
                  video: str = "video_id", frame: str = "frame_idx") -> DataFrame:
    """Frames inside (``keep``) or outside (``keep=False``) the bracket-free
    captions: each caption covers ``int(start*fps) ..< int((start+dur)*fps)``
    (JN-14, FLT-03, SET-05)."""
    cap = captions.where(~F.col("text").contains("["))
    lo = (F.col("start") * fps).cast("long")
    hi = (F.col("start") * fps + F.col("duration") * fps).cast("long")
    span = F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))
    useful = cap.select(video, F.explode(span).alias(frame)).distinct()
    return frames.join(useful, [video, frame], "left_semi" if keep else "left_anti")


def intervals_complete(clips: DataFrame, frames: DataFrame, first: str, last: str, video: str = "video_id",
                       frame: str = "frame_idx", chunk_size: int | None = 4096) -> DataFrame:
    """Keep clip rows whose integer frame range ``[first, last]`` is fully present
    in ``frames`` (equi-joins on the two end frames plus the rank difference).
    The joins are merge joins: frames made by ``explode`` look small to the
    planner, which would otherwise broadcast all of them through the driver."""
    chunk = F.floor(F.col(frame) / chunk_size) if chunk_size else None
    nf = running_sum(frames.select(video, frame), [video], [frame], F.lit(1), "rn", chunk=chunk)
    a = nf.select(F.col(video).alias("_v1"), F.col(frame).alias("_f1"), F.col("rn").alias("_r1"))
    b = nf.select(F.col(video).alias("_v2"), F.col(frame).alias("_f2"), F.col("rn").alias("_r2"))
    j = (clips.join(a.hint("merge"), (F.col(video) == F.col("_v1")) & (F.col(first) == F.col("_f1")))
         .join(b.hint("merge"), (F.col(video) == F.col("_v2")) & (F.col(last) == F.col("_f2"))))
    return (j.where(F.col("_r2") - F.col("_r1") == F.col(last) - F.col(first))
            .drop("_v1", "_f1", "_r1", "_v2", "_f2", "_r2"))
