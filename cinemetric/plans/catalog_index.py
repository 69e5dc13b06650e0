"""Registered queries for the clip-index build: caption timing, sentence
regrouping, frame coverage, score lookup, index selection and playlist
filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import captions as C
from ..operators import coverage as V
from ..session import scratch_path
from . import proxies as P

R6 = 6
WORDS_SQL = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"

# Fixed blocklist used by the playlist query (base ids, compared as text).
BLOCKLIST = ["3", "7", "11"]


def _captions(spark, sf):
    return C.clip_ends(P.p_caption(spark, sf), chunk=F.floor(F.col("cap_idx") / 256))


ENDS_SQL = """
, ends AS (SELECT *, CASE WHEN lead(start) OVER w IS NULL THEN start + duration
                          ELSE least(start + duration, lead(start) OVER w) END AS "end"
           FROM p_caption WINDOW w AS (PARTITION BY video_id ORDER BY cap_idx))"""

WORDS_CTE = ENDS_SQL + f"""
, ws AS (SELECT video_id, cap_idx, start, "end", {WORDS_SQL} AS wl FROM ends)
, wx AS (SELECT video_id, cap_idx, start, "end", len(wl) AS n, unnest(wl) AS raw,
                generate_subscripts(wl, 1) - 1 AS w_idx FROM ws)
, words AS (SELECT video_id, cap_idx, CAST(w_idx AS INTEGER) AS w_idx, regexp_replace(raw, '\\.$', '') AS word,
                   CASE WHEN suffix(raw, '.') THEN '.' ELSE '0' END AS punc,
                   start + w_idx * (("end" - start) / n) AS ws, start + (w_idx + 1) * (("end" - start) / n) AS we
            FROM wx)"""

SENT_CTE = WORDS_CTE + """
, g AS (SELECT *, coalesce(sum(CASE WHEN punc = '.' THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY cap_idx, w_idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g,
               sum(CASE WHEN punc = '.' THEN 1 ELSE 0 END) OVER (PARTITION BY video_id) AS k FROM words)
, sent AS (SELECT video_id, g, string_agg(word, ' ' ORDER BY cap_idx, w_idx) AS text, min(ws) AS start, max(we) AS "end"
           FROM g WHERE g >= 1 AND g < k GROUP BY video_id, g)
, kept AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY g) - 1 AS sent_idx
           FROM sent WHERE NOT regexp_matches(text, '^(?:.*\\[)'))"""


def q_caption_ends(spark, sf):
    return _captions(spark, sf).select("video_id", "cap_idx", F.round("end", R6).alias("end"))


SQL_CAPTION_ENDS = P.with_ctes(P.P_CAPTION_SQL) + ENDS_SQL + """
SELECT video_id, cap_idx, round("end", 6) AS "end" FROM ends"""


def q_word_times(spark, sf):
    w = C.word_times(_captions(spark, sf))
    return w.select("video_id", "cap_idx", "w_idx", "word", "punc",
                    F.round("time_range.start", R6).alias("ws"), F.round("time_range.end", R6).alias("we"))


SQL_WORD_TIMES = P.with_ctes(P.P_CAPTION_SQL) + WORDS_CTE + """
SELECT video_id, cap_idx, w_idx, word, punc, round(ws, 6) AS ws, round(we, 6) AS we FROM words"""


def _sentences(spark, sf):
    words = C.word_times(_captions(spark, sf))
    return C.regroup(words, chunk=F.floor(F.col("cap_idx") / 256))


def q_regroup_sentences(spark, sf):
    s = _sentences(spark, sf)
    return s.select("video_id", "sent_idx", "text", F.round("start", R6).alias("start"),
                    F.round("end", R6).alias("end"), F.round("duration", R6).alias("duration"))


SQL_REGROUP_SENTENCES = P.with_ctes(P.P_CAPTION_SQL) + SENT_CTE + """
SELECT video_id, CAST(sent_idx AS BIGINT) AS sent_idx, text, round(start, 6) AS start, round("end", 6) AS "end",
       round("end" - start, 6) AS duration FROM kept"""



def _dot_labeller(words: list[str]) -> list[tuple[str, str, float]]:
    """Python labeller for the hook: a trailing dot is the sentence mark."""
    return [(w[:-1], ".", 1.0) if w.endswith(".") else (w, "0", 1.0) for w in words]


def q_regroup_labelled(spark, sf):
    """Sentences regrouped from words labelled by a Python punctuation model
    through the hook (UDF-03: one call per run of captions of a video, its
    labels written once); with the dot rule as the model it equals
    ``regroup_sentences``."""
    keep_raw = lambda w: F.struct(w.alias("word"), F.lit("0").alias("punc"), F.lit(1.0).alias("punc_conf"))
    words = C.word_times(_captions(spark, sf), labeller=keep_raw)
    path = scratch_path(spark, "labelled")
    C.label_words_by_video(words, _dot_labeller).write.parquet(path)
    s = C.regroup(spark.read.parquet(path), chunk=F.floor(F.col("cap_idx") / 256))
    return s.select("video_id", "sent_idx", "text", F.round("start", R6).alias("start"),
                    F.round("end", R6).alias("end"), F.round("duration", R6).alias("duration"))

def q_sentence_coverage(spark, sf):
    """Regrouped sentences checked against the frame table (index build on sentences)."""
    cov = V.frame_coverage(_sentences(spark, sf), P.p_frame(spark, sf), keys=["video_id", "sent_idx"])
    return cov.select("video_id", "sent_idx", "start_frame", "end_frame", F.round("has_person", R6).alias("has_person"))


COVER_TAIL = """
, nf AS (SELECT video_id, frame_idx, CAST(has_box AS INTEGER) AS box FROM p_frame)
, cov AS (SELECT c.*, CAST(count(nf.frame_idx) AS BIGINT) AS nfr, sum(nf.box) AS nb
          FROM clip c JOIN nf ON nf.video_id = c.video_id AND nf.frame_idx BETWEEN c.start_frame AND c.end_frame
          WHERE c.end_frame - c.start_frame + 1 >= 8
          GROUP BY ALL)
, covered AS (SELECT * EXCLUDE (nfr, nb), nb / (end_frame - start_frame + 1) AS has_person
              FROM cov WHERE nfr = end_frame - start_frame + 1)"""

SQL_SENTENCE_COVERAGE = P.with_ctes(P.P_CAPTION_SQL, P.P_FRAME_SQL) + SENT_CTE + """
, clip AS (SELECT video_id, sent_idx, CAST(ceil(start * 8) AS BIGINT) AS start_frame,
                  CAST(floor("end" * 8) AS BIGINT) AS end_frame FROM kept)""" + COVER_TAIL + """
SELECT video_id, CAST(sent_idx AS BIGINT) AS sent_idx, start_frame, end_frame, round(has_person, 6) AS has_person
FROM covered"""


def _index(spark, sf):
    clips = _captions(spark, sf).withColumn("duration", F.col("end") - F.col("start"))
    cov = V.frame_coverage(clips, P.p_frame(spark, sf), keys=["video_id", "cap_idx"])
    return V.attach_scores(cov, P.p_neutral(spark, sf).withColumnRenamed("neutral", "neutral_score"),
                           ["video_id", "cap_idx"], "neutral_score")


CLIP_CTE = ENDS_SQL + """
, clip AS (SELECT video_id, cap_idx, text, "end" - start AS duration, CAST(ceil(start * 8) AS BIGINT) AS start_frame,
                  CAST(floor("end" * 8) AS BIGINT) AS end_frame FROM ends)""" + COVER_TAIL + """
, idx AS (SELECT covered.*, n.neutral AS neutral_score FROM covered
          JOIN p_neutral n ON n.video_id = covered.video_id AND n.cap_idx = covered.cap_idx)"""


def q_frame_coverage(spark, sf):
    cov = _index(spark, sf)
    return cov.select("video_id", "cap_idx", "start_frame", "end_frame", F.round("has_person", R6).alias("has_person"))


SQL_FRAME_COVERAGE = P.with_ctes(P.P_CAPTION_SQL, P.P_FRAME_SQL, P.P_NEUTRAL_SQL) + CLIP_CTE + """
SELECT video_id, cap_idx, start_frame, end_frame, round(has_person, 6) AS has_person FROM idx"""


def q_clip_index(spark, sf):
    idx = V.select_clips(_index(spark, sf), dmin=2.0, dmax=10.0, text_min=3, neutral_max=0.5, person_min=0.0)
    return idx.select("video_id", "cap_idx", F.round("duration", R6).alias("duration"), "start_frame", "end_frame",
                      "text", F.round("neutral_score", R6).alias("neutral_score"),
                      F.round("has_person", R6).alias("has_person"))


SQL_CLIP_INDEX = P.with_ctes(P.P_CAPTION_SQL, P.P_FRAME_SQL, P.P_NEUTRAL_SQL) + CLIP_CTE + """
SELECT video_id, cap_idx, round(duration, 6) AS duration, start_frame, end_frame, text,
       round(neutral_score, 6) AS neutral_score, round(has_person, 6) AS has_person
FROM idx WHERE duration > 2.0 AND duration < 10.0 AND length(text) >= 3 AND neutral_score <= 0.5 AND has_person >= 0.0"""


def q_index_counts(spark, sf):
    return V.index_counts(_index(spark, sf))


SQL_INDEX_COUNTS = P.with_ctes(P.P_CAPTION_SQL, P.P_FRAME_SQL, P.P_NEUTRAL_SQL) + CLIP_CTE + """
SELECT CAST(count(*) AS BIGINT) AS n_samples, CAST(count(*) FILTER (WHERE has_person > 0) AS BIGINT) AS n_with_person_partial,
       CAST(count(*) FILTER (WHERE has_person = 1) AS BIGINT) AS n_with_person_all FROM idx"""


def q_valid_videos(spark, sf):
    cap = P.p_caption(spark, sf).select("video_id")
    frames = P.p_frame(spark, sf)
    boxed = frames.where("has_box").select("video_id")
    return V.valid_videos(cap, frames.select("video_id"), require=[cap, frames, boxed])


SQL_VALID_VIDEOS = P.with_ctes(P.P_CAPTION_SQL, P.P_FRAME_SQL) + """
, ids AS (SELECT video_id FROM p_caption UNION SELECT video_id FROM p_frame)
SELECT video_id FROM ids
WHERE video_id IN (SELECT video_id FROM p_caption) AND video_id IN (SELECT video_id FROM p_frame)
  AND video_id IN (SELECT video_id FROM p_frame WHERE has_box)"""


# ------------------------------------------------------------------ playlist
def p_playlist(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    secs = F.col("n_chars")
    mmss = F.concat((secs / 60).cast("long").cast("string"), F.lit(":"), F.lpad((secs % 60).cast("string"), 2, "0"))
    hms = F.concat((secs / 3600).cast("long").cast("string"), F.lit(":"),
                   F.lpad(((secs % 3600) / 60).cast("long").cast("string"), 2, "0"), F.lit(":"),
                   F.lpad((secs % 60).cast("string"), 2, "0"))
    dur = (F.when(secs < 100, F.lit(None).cast("string"))
           .when(secs < 1000, (secs / 10).cast("long").cast("string"))
           .when(secs < 3600, mmss).otherwise(hms))
    dur = F.when(F.col("lang") == "fr", F.concat(dur, F.lit(",1"))).otherwise(dur)
    link = F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("doc_id").cast("string"),
                    F.lit("&src="), F.col("source"))
    return d.select(link.alias("link"), dur.alias("duration"))


P_PLAYLIST_SQL = """p_playlist AS (
  SELECT 'https://www.youtube.com/watch?v=' || doc_id || '&src=' || source AS link,
         CASE WHEN lang = 'fr' THEN d || ',1' ELSE d END AS duration
  FROM (SELECT *, CASE WHEN n_chars < 100 THEN NULL
                       WHEN n_chars < 1000 THEN CAST(n_chars // 10 AS VARCHAR)
                       WHEN n_chars < 3600 THEN (n_chars // 60) || ':' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0')
                       ELSE (n_chars // 3600) || ':' || lpad(CAST((n_chars % 3600) // 60 AS VARCHAR), 2, '0') || ':'
                            || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0') END AS d FROM documents))"""


def q_long_videos(spark, sf):
    pl = V.long_videos(p_playlist(spark, sf))
    vids = pl.select(V.video_id_from_link(F.col("link")).alias("video_id"), "duration")
    bl = spark.createDataFrame([(b,) for b in BLOCKLIST], "video_id string")
    return V.anti_blocklist(vids, bl).select("video_id", "duration")


SQL_LONG_VIDEOS = P.with_ctes(P_PLAYLIST_SQL) + """
, p AS (SELECT *, string_split(split_part(duration, ',', 1), ':') AS parts FROM p_playlist)
, k AS (SELECT split_part(link, '?v=', -1) AS video_id, duration FROM p
        WHERE duration IS NOT NULL AND (len(parts) > 2 OR 60 * CAST(parts[1] AS BIGINT) + coalesce(CAST(parts[2] AS BIGINT), 0) > 2000))
SELECT video_id, duration FROM k WHERE split_part(video_id, '&', 1) NOT IN ('3', '7', '11')"""


def q_useful_frames(spark, sf, fps: int = 24):
    """Frames inside bracket-free captions (JN-14, FLT-03, SET-05)."""
    frames = P.p_frame(spark, sf).select("video_id", "frame_idx")
    return V.useful_frames(frames, P.p_caption(spark, sf), fps=fps, keep=True)


SQL_USEFUL_FRAMES = P.with_ctes(P.P_CAPTION_SQL, P.P_FRAME_SQL) + """
, u AS (SELECT DISTINCT video_id, unnest(range(CAST(trunc(start * 24) AS BIGINT), CAST(trunc(start * 24 + duration * 24) AS BIGINT))) AS frame_idx
        FROM p_caption WHERE NOT contains(text, '['))
SELECT video_id, frame_idx FROM p_frame WHERE (video_id, frame_idx) IN (SELECT (video_id, frame_idx) FROM u)"""


def q_frame_names(spark, sf):
    f = P.p_frame(spark, sf)
    name = V.frame_name(F.col("frame_idx"))
    return f.select("video_id", "frame_idx", name.alias("frame_name"), V.frame_number(name).alias("parsed"))


SQL_FRAME_NAMES = P.with_ctes(P.P_FRAME_SQL) + """
SELECT video_id, frame_idx, lpad(CAST(frame_idx AS VARCHAR), 8, '0') || '.jpg' AS frame_name, frame_idx AS parsed
FROM p_frame"""


def q_index_videos(spark, sf):
    """Distinct videos of the selected clip index with their clip counts (AG-31)."""
    idx = V.select_clips(_index(spark, sf), dmin=2.0, dmax=10.0, text_min=3, neutral_max=0.5, person_min=0.0)
    return V.video_ids(idx)


SQL_INDEX_VIDEOS = P.with_ctes(P.P_CAPTION_SQL, P.P_FRAME_SQL, P.P_NEUTRAL_SQL) + CLIP_CTE + """
SELECT video_id, CAST(count(*) AS BIGINT) AS n_clips
FROM idx WHERE duration > 2.0 AND duration < 10.0 AND length(text) >= 3 AND neutral_score <= 0.5 AND has_person >= 0.0
GROUP BY video_id"""


# A punctuation model returns no label for a token without any letter or
# digit (for example a lone "-"); the stand-in labeller keeps the other tokens.
LABELLED_WORD = r"[\p{L}\p{N}]"


def q_regroup_failure_rate(spark, sf):
    """Share of videos whose labelled word count differs from the timed word
    count (AG-25), with the stand-in labeller above."""
    caps = _captions(spark, sf)
    words = C.word_times(caps)
    labelled = words.where(F.col("word").rlike(LABELLED_WORD))
    st = C.failure_rate(C.regroup_status(caps, words, labelled))
    return st.select("n_videos", "n_failed", F.round("failure_rate", R6).alias("failure_rate"))


SQL_REGROUP_FAILURE_RATE = P.with_ctes(P.P_CAPTION_SQL) + WORDS_CTE + """
, st AS (SELECT c.video_id, count(w.word) AS n_timed,
                count(w.word) FILTER (WHERE regexp_matches(w.word, '[\\p{L}\\p{N}]')) AS n_labelled
         FROM (SELECT DISTINCT video_id FROM p_caption) c LEFT JOIN words w USING (video_id) GROUP BY c.video_id)
SELECT CAST(count(*) AS BIGINT) AS n_videos, CAST(count(*) FILTER (WHERE n_timed <> n_labelled) AS BIGINT) AS n_failed,
       round(avg(CASE WHEN n_timed <> n_labelled THEN 1.0 ELSE 0.0 END), 6) AS failure_rate FROM st"""




QUERIES = {
    "caption_ends": (q_caption_ends, SQL_CAPTION_ENDS),
    "word_times": (q_word_times, SQL_WORD_TIMES),
    "regroup_sentences": (q_regroup_sentences, SQL_REGROUP_SENTENCES),
    "regroup_labelled": (q_regroup_labelled, SQL_REGROUP_SENTENCES),
    "sentence_coverage": (q_sentence_coverage, SQL_SENTENCE_COVERAGE),
    "frame_coverage": (q_frame_coverage, SQL_FRAME_COVERAGE),
    "clip_index": (q_clip_index, SQL_CLIP_INDEX),
    "index_counts": (q_index_counts, SQL_INDEX_COUNTS),
    "valid_videos": (q_valid_videos, SQL_VALID_VIDEOS),
    "long_videos": (q_long_videos, SQL_LONG_VIDEOS),
    "useful_frames": (q_useful_frames, SQL_USEFUL_FRAMES),
    "frame_names": (q_frame_names, SQL_FRAME_NAMES),
    "index_videos": (q_index_videos, SQL_INDEX_VIDEOS),
    "regroup_failure_rate": (q_regroup_failure_rate, SQL_REGROUP_FAILURE_RATE),
}
