"""Registered queries for frames, shots and boxes: shot tables, clip frames,
centred clips, box geometry, body-joint boxes, patch coverage and
rectangular batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes as B
from ..operators import coverage as V
from ..operators import shots as S
from . import proxies as P

R6 = 6


# ------------------------------------------------------------------ shots and clips
def _shots(spark, sf):
    return S.shots_from_cuts(P.p_cut(spark, sf).distinct())


SHOTS_SQL = """
, cuts AS (SELECT DISTINCT movie_id, CAST(start_frame AS BIGINT) AS start_frame FROM p_cut
           UNION SELECT DISTINCT movie_id, CAST(0 AS BIGINT) FROM p_cut)
, shots AS (SELECT movie_id, start_frame,
                   coalesce(lead(start_frame) OVER w - 1, -1) AS end_frame,
                   CAST(row_number() OVER w AS BIGINT) AS shot_no
            FROM cuts WINDOW w AS (PARTITION BY movie_id ORDER BY start_frame))"""


def q_shots(spark, sf):
    s = _shots(spark, sf)
    return s.select("movie_id", "shot_no", "start_frame", "end_frame",
                    S.close_open_end(F.col("start_frame"), F.col("end_frame")).alias("closed_end"))


SQL_SHOTS = P.with_ctes(P.P_CUT_SQL) + SHOTS_SQL + """
SELECT movie_id, shot_no, start_frame, end_frame,
       CASE WHEN end_frame = -1 THEN start_frame + 192 ELSE end_frame END AS closed_end FROM shots"""


def q_clip_frames(spark, sf):
    """Scenes of three consecutive shots -> frame range -> 8 evenly spaced frames."""
    shots = _shots(spark, sf)
    scenes = (shots.groupBy("movie_id", F.floor((F.col("shot_no") - 1) / 3).alias("clip_id"))
              .agg(F.min("shot_no").alias("start_shot"), F.max("shot_no").alias("end_shot")))
    clips = scenes.select("movie_id", "clip_id")
    cf = S.clip_frames(clips, scenes, shots)
    end = S.close_open_end(F.col("start_frame"), F.col("end_frame"))
    cf = cf.withColumn("end_frame", end).where(F.col("end_frame") - F.col("start_frame") + 1 >= 8)
    frames = S.uniform_frames(F.col("start_frame"), F.col("end_frame"), 8)
    return cf.select("movie_id", "clip_id", "start_frame", "end_frame",
                     F.array_join(F.transform(frames, lambda x: x.cast("string")), ",").alias("frames"))


SQL_CLIP_FRAMES = P.with_ctes(P.P_CUT_SQL) + SHOTS_SQL + """
, scenes AS (SELECT movie_id, (shot_no - 1) // 3 AS clip_id, min(shot_no) AS start_shot, max(shot_no) AS end_shot
             FROM shots GROUP BY 1, 2)
, cf AS (SELECT sc.movie_id, sc.clip_id, a.start_frame,
                CASE WHEN b.end_frame = -1 THEN a.start_frame + 192 ELSE b.end_frame END AS end_frame
         FROM scenes sc JOIN shots a ON a.movie_id = sc.movie_id AND a.shot_no = sc.start_shot
                        JOIN shots b ON b.movie_id = sc.movie_id AND b.shot_no = sc.end_shot)
SELECT movie_id, clip_id, start_frame, end_frame,
       array_to_string(list_transform(range(0, 8), lambda i: CASE WHEN i = 7 THEN end_frame
              ELSE CAST(trunc(start_frame + i * (CAST(end_frame - start_frame AS DOUBLE) / 7)) AS BIGINT) END), ',') AS frames
FROM cf WHERE end_frame - start_frame + 1 >= 8"""


def q_centered_clips(spark, sf):
    """Clips of 8 around every frame (test split), kept when all frames exist
    on disk (frame i is file i+1)."""
    frames = P.p_frame(spark, sf)
    totals = frames.groupBy(F.col("video_id").alias("movie_id")).agg(F.count(F.lit(1)).alias("total"))
    cl = S.centered_clips(totals, split="test")
    cl = cl.withColumn("video_id", F.col("movie_id")).withColumn("f1", F.col("start_frame") + 1) \
        .withColumn("f2", F.col("end_frame"))
    ok = V.intervals_complete(cl, frames, "f1", "f2")
    return ok.select("movie_id", "label_idx", "start_frame", "end_frame", "label_frame")


SQL_CENTERED_CLIPS = P.with_ctes(P.P_FRAME_SQL) + """
, tot AS (SELECT video_id AS movie_id, count(*) AS total FROM p_frame GROUP BY 1)
, r AS (SELECT movie_id, total, unnest(range(0, total)) AS i FROM tot)
, c AS (SELECT movie_id, i AS label_idx,
               CASE WHEN i < 4 THEN 0 WHEN total - i < 4 THEN total - 8 ELSE i - 4 END AS start_frame,
               CASE WHEN i < 4 THEN 8 WHEN total - i < 4 THEN total ELSE i + 4 END AS end_frame,
               CASE WHEN i < 4 THEN i WHEN total - i < 4 THEN i - (total - 8) ELSE 4 END AS label_frame FROM r)
, cnt AS (SELECT c.movie_id, c.label_idx, count(f.frame_idx) AS n FROM c JOIN p_frame f
          ON f.video_id = c.movie_id AND f.frame_idx BETWEEN c.start_frame + 1 AND c.end_frame GROUP BY 1, 2)
SELECT c.movie_id, CAST(c.label_idx AS BIGINT) AS label_idx, CAST(start_frame AS BIGINT) AS start_frame,
       CAST(end_frame AS BIGINT) AS end_frame, CAST(label_frame AS BIGINT) AS label_frame
FROM c JOIN cnt USING (movie_id, label_idx) WHERE n = end_frame - start_frame"""



def q_clip_audit(spark, sf):
    """Clip bounds audit of the centred clips (FLT-11): per movie, clips
    whose length is not 8, whose label position is outside 0..7 or whose end
    passes the movie's frame total."""
    from ..operators import tables as TB
    frames = P.p_frame(spark, sf)
    totals = frames.groupBy(F.col("video_id").alias("movie_id")).agg(F.count(F.lit(1)).alias("total"))
    cl = S.centered_clips(totals, split="test").select("movie_id", "start_frame", "end_frame", "label_frame")
    bad = TB.audit_clips(cl, totals, "movie_id").groupBy("movie_id").agg(F.count(F.lit(1)).alias("n_bad"))
    per = cl.groupBy("movie_id").agg(F.count(F.lit(1)).alias("n_clips"))
    return per.join(bad, "movie_id", "left").select("movie_id", "n_clips", F.coalesce("n_bad", F.lit(0)).alias("n_bad"))


SQL_CLIP_AUDIT = SQL_CENTERED_CLIPS.split(", cnt AS")[0] + """
SELECT movie_id, count(*) AS n_clips,
       count(*) FILTER (WHERE end_frame - start_frame <> 8 OR label_frame < 0 OR label_frame > 7 OR end_frame > total)
         AS n_bad
FROM c JOIN tot USING (movie_id) GROUP BY movie_id"""

# ------------------------------------------------------------------ box geometry
def _imgsize(label):
    return (F.lit(455) + label * 100), (F.lit(256) + label * 50)


def q_box_rescale(spark, sf):
    b = P.p_box(spark, sf)
    w, h = _imgsize(F.col("label"))
    r = B.rescale_box("x1", "y1", "x2", "y2", w, h)
    return b.select("vec_id", r["x1"].cast("long").alias("rx1"), r["y1"].cast("long").alias("ry1"),
                    r["x2"].cast("long").alias("rx2"), r["y2"].cast("long").alias("ry2"),
                    F.round("score", R6).alias("score"))


SQL_BOX_RESCALE = P.with_ctes(P.P_BOX_SQL) + """
, s AS (SELECT *, 455 + label * 100 AS w, 256 + label * 50 AS h,
               least(640.0 / (455 + label * 100), 640.0 / (256 + label * 50)) AS r FROM p_box)
SELECT vec_id, CAST(greatest(floor(x1 / r), 0) AS BIGINT) AS rx1, CAST(greatest(floor(y1 / r), 0) AS BIGINT) AS ry1,
       CAST(least(ceil(x2 / r), w) AS BIGINT) AS rx2, CAST(least(ceil(y2 / r), h) AS BIGINT) AS ry2,
       round(score, 6) AS score FROM s"""


def q_letterbox(spark, sf):
    b = P.p_box(spark, sf)
    w, h = F.col("x2") - F.col("x1") + 100, F.col("y2") - F.col("y1") + 100
    lb = B.letterbox(w, h)
    return b.select("vec_id", F.round(lb["ratio_w"], R6).alias("ratio"), lb["unpad_w"].alias("unpad_w"),
                    lb["unpad_h"].alias("unpad_h"), F.round(lb["pad_w"], R6).alias("pad_w"),
                    F.round(lb["pad_h"], R6).alias("pad_h"))


SQL_LETTERBOX = P.with_ctes(P.P_BOX_SQL) + """
, s AS (SELECT vec_id, x2 - x1 + 100 AS w, y2 - y1 + 100 AS h FROM p_box)
, r AS (SELECT *, least(640.0 / h, 640.0 / w) AS r FROM s)
, u AS (SELECT *, CAST(round_even(w * r, 0) AS BIGINT) AS uw, CAST(round_even(h * r, 0) AS BIGINT) AS uh FROM r)
SELECT vec_id, round(r, 6) AS ratio, uw AS unpad_w, uh AS unpad_h,
       round(((640 - uw) % 32) / 2.0, 6) AS pad_w, round(((640 - uh) % 32) / 2.0, 6) AS pad_h FROM u"""


CUT = [100.0, 100.0, 400.0, 400.0]


def q_box_filters(spark, sf):
    """Detections kept as persons, ioa against a fixed cut-out, candidate test
    against a shrunken copy (FLT-12, SC-24, FLT-16, FLT-17)."""
    b = P.p_box(spark, sf).withColumn("cls", F.col("label") % 3).withColumn("conf", F.col("score"))
    b = B.keep_person(b)
    box = [F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")]
    cut = [F.lit(v) for v in CUT]
    shrunk = [F.col("x1") + 5, F.col("y1") + 5, F.col("x2") * 0.9, F.col("y2") * 0.9]
    return b.select("vec_id", F.round(B.ioa(cut, box), R6).alias("ioa"),
                    (B.ioa(cut, box) < B.OBSCURED_MAX).alias("kept_unobscured"),
                    B.box_candidates(box, shrunk).alias("candidate"))


SQL_BOX_FILTERS = P.with_ctes(P.P_BOX_SQL) + """
, b AS (SELECT * FROM p_box WHERE label % 3 = 0 AND score >= 0.25)
, i AS (SELECT vec_id, greatest(least(400.0, x2) - greatest(100.0, x1), 0) * greatest(least(400.0, y2) - greatest(100.0, y1), 0)
               / ((x2 - x1) * (y2 - y1) + 1e-16) AS ioa,
               x2 - x1 AS w1, y2 - y1 AS h1, x2 * 0.9 - (x1 + 5) AS w2, y2 * 0.9 - (y1 + 5) AS h2 FROM b)
SELECT vec_id, round(ioa, 6) AS ioa, ioa < 0.6 AS kept_unobscured,
       (w2 > 2 AND h2 > 2 AND w2 * h2 / (w1 * h1 + 1e-16) > 0.1
        AND greatest(w2 / (h2 + 1e-16), h2 / (w2 + 1e-16)) < 20) AS candidate FROM i"""


def q_crop_boxes(spark, sf):
    """Normalised centre labels -> pixel corners, mirror, crop geometry (SC-25, SC-26)."""
    b = P.p_box(spark, sf)
    W, H = F.lit(1100.0), F.lit(1100.0)
    xywh = B.xyxy_to_xywh(F.col("x1") / W, F.col("y1") / H, F.col("x2") / W, F.col("y2") / H)
    px = B.normalized_to_pixels(*xywh, 1100.0, 1100.0)
    crop = B.crop_box(*xywh, F.lit(640), F.lit(480))
    return b.select("vec_id", F.round(px[0], 4).alias("px1"), F.round(px[3], 4).alias("py2"),
                    F.round(B.mirror_x(xywh[0]), R6).alias("mirror_cx"),
                    *[c.alias(n) for c, n in zip(crop, ["cx1", "cy1", "cx2", "cy2"])])


SQL_CROP_BOXES = P.with_ctes(P.P_BOX_SQL) + """
, n AS (SELECT vec_id, (x1 / 1100.0 + x2 / 1100.0) / 2 AS cx, (y1 / 1100.0 + y2 / 1100.0) / 2 AS cy,
               x2 / 1100.0 - x1 / 1100.0 AS w, y2 / 1100.0 - y1 / 1100.0 AS h FROM p_box)
, c AS (SELECT *, cx * 640 AS bx, cy * 480 AS b_y, w * 640 * 1.2 + 3 AS bw, h * 480 * 1.2 + 3 AS bh FROM n)
SELECT vec_id, round(1100.0 * (cx - w / 2), 4) AS px1, round(1100.0 * (cy + h / 2), 4) AS py2, round(1 - cx, 6) AS mirror_cx,
       least(greatest(CAST(trunc(bx - bw / 2) AS BIGINT), 0), 640) AS cx1, least(greatest(CAST(trunc(b_y - bh / 2) AS BIGINT), 0), 480) AS cy1,
       least(greatest(CAST(trunc(bx + bw / 2) AS BIGINT), 0), 640) AS cx2, least(greatest(CAST(trunc(b_y + bh / 2) AS BIGINT), 0), 480) AS cy2
FROM c"""



def q_label_at_time(spark, sf):
    """Samples -> annotation row whose time equals the label frame (JN-09).
    Annotations are one row per (movie, time): the mean value of the events
    of that movie at that time step."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    ann = (e.groupBy((F.col("user_id") % 10).alias("movie_id"), (F.col("event_id") % 89).alias("Time"))
           .agg(F.avg("value").alias("valence")))
    samples = e.select("event_id", (F.col("user_id") % 10).alias("movie_id"),
                       (F.col("event_id") % 97).alias("label_frame"))
    return S.label_at_time(samples, ann).select("event_id", "movie_id", "label_frame",
                                                F.round("valence", R6).alias("valence"))


SQL_LABEL_AT_TIME = """
WITH ann AS (SELECT user_id % 10 AS movie_id, event_id % 89 AS t, avg(value) AS valence FROM events GROUP BY 1, 2)
SELECT e.event_id, e.user_id % 10 AS movie_id, e.event_id % 97 AS label_frame, round(ann.valence, 6) AS valence
FROM events e JOIN ann ON ann.movie_id = e.user_id % 10 AND ann.t = e.event_id % 97"""


def q_label_rows(spark, sf):
    """Label-row helpers on the box table: width and height swapped for EXIF
    orientation 6 or 8 (SC-34, orientation from the id), every class collapsed
    to 0 (SC-33) and one item repeated as a clip of 3 (SC-32)."""
    from ..operators import tables as TB
    b = P.p_box(spark, sf)
    size = TB.oriented_size(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("vec_id") % 9)
    rows = F.array(F.array(F.col("label").cast("double"), "x1", "y1", "x2", "y2"))
    return b.select("vec_id", size["w"].alias("ow"), size["h"].alias("oh"),
                    TB.single_class(rows).alias("one_class"), TB.repeat_item(F.col("label"), 3).alias("clip"))


SQL_LABEL_ROWS = P.with_ctes(P.P_BOX_SQL) + """
SELECT vec_id, CASE WHEN vec_id % 9 IN (6, 8) THEN y2 - y1 ELSE x2 - x1 END AS ow,
       CASE WHEN vec_id % 9 IN (6, 8) THEN x2 - x1 ELSE y2 - y1 END AS oh,
       [[0.0, x1, y1, x2, y2]] AS one_class, [label, label, label] AS clip FROM p_box"""


def q_person_boxes(spark, sf):
    """Annotation -> joints of the same (video, person) -> one box per joint
    row (JN-08 + AG-10).  Joint rows come from the embeddings (three joints
    each, scaled to pixels); an annotation is one row per (video, person)."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    joints = e.select((F.col("vec_id") % 37).alias("video_id"), (F.col("vec_id") % 3).alias("person_id"),
                      F.col("vec_id").alias("frame"),
                      F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.struct(
                          (F.abs(F.element_at("embedding", j * 3 + 1)) * 100).cast("double").alias("x"),
                          (F.abs(F.element_at("embedding", j * 3 + 2)) * 100).cast("double").alias("y"),
                          F.abs(F.element_at("embedding", j * 3 + 3)).cast("double").alias("conf"))).alias("joints"))
    ann = e.groupBy((F.col("vec_id") % 37).alias("video_id"), (F.col("vec_id") % 3).alias("person_id")) \
        .agg(F.min("label").alias("label"))
    pb = B.person_boxes(ann, joints)
    return pb.select("video_id", "person_id", "frame", "label", *[pb["bbox"][i].alias(n)
                                                                  for i, n in enumerate(["y1", "x1", "y2", "x2"])])


SQL_PERSON_BOXES = """
WITH j AS (SELECT vec_id % 37 AS video_id, vec_id % 3 AS person_id, vec_id AS frame, unnest(range(0, 3)) AS k, embedding
           FROM embeddings)
, p AS (SELECT video_id, person_id, frame, CAST(abs(embedding[k * 3 + 1]) * 100 AS DOUBLE) AS x,
               CAST(abs(embedding[k * 3 + 2]) * 100 AS DOUBLE) AS y FROM j)
, ann AS (SELECT vec_id % 37 AS video_id, vec_id % 3 AS person_id, min(label) AS label FROM embeddings GROUP BY 1, 2)
SELECT p.video_id, p.person_id, frame, ann.label, CAST(floor(min(y)) AS BIGINT) AS y1, CAST(floor(min(x)) AS BIGINT) AS x1,
       CAST(ceil(max(y)) AS BIGINT) AS y2, CAST(ceil(max(x)) AS BIGINT) AS x2
FROM p JOIN ann ON ann.video_id = p.video_id AND ann.person_id = p.person_id
GROUP BY p.video_id, p.person_id, frame, ann.label"""


# Fixed label names of the per-label text scorer proxy (seven sentiment labels).
SCORE_LABELS = ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]


def q_neutral_score(spark, sf):
    """Score of the ``neutral`` label picked out of an array of (label, score)
    structs (SC-30); the per-label scores are the softmax of the logit proxy."""
    from ..functions import vectors as VEC
    from ..operators import tables as TB
    lg = P.p_logits(spark, sf)
    sm = VEC.softmax("logits")
    labels = F.array(*[F.lit(n) for n in SCORE_LABELS])
    scores = F.arrays_zip(labels.alias("label"), sm.alias("score"))
    return lg.select("vec_id", F.round(TB.label_score(scores, "neutral"), R6).alias("neutral"))


SQL_NEUTRAL_SCORE = P.with_ctes(P.P_LOGITS_SQL) + """
, x AS (SELECT vec_id, unnest(logits) AS v, generate_subscripts(logits, 1) AS i FROM p_logits)
, m AS (SELECT vec_id, max(v) AS mx FROM x GROUP BY vec_id)
, e AS (SELECT x.vec_id, i, exp(v - mx) AS ev FROM x JOIN m USING (vec_id))
SELECT vec_id, round(sum(ev) FILTER (WHERE i = 5) / sum(ev), 6) AS neutral FROM e GROUP BY vec_id"""



# Fixed keyword lists of the stand-in per-label text scorer (our own choice).
SCORER_KEYWORDS = {
    "anger": ["angry", "hate", "mad", "furious"],
    "joy": ["happy", "great", "love", "good", "glad"],
    "neutral": ["the", "a", "is", "and", "of", "to"],
    "sadness": ["sad", "sorry", "miss", "lost"],
}


def q_caption_neutral(spark, sf):
    """Per-label scores of every caption from the text-scorer hook (UDF-04,
    an Arrow pandas UDF) and the ``neutral`` score picked out (SC-30), as
    the neutral-score preprocessing does for each caption."""
    from ..functions.encoders import KeywordLabelScorer, label_scores_column
    from ..operators import tables as TB
    cap = P.p_caption(spark, sf)
    scores = label_scores_column("text", KeywordLabelScorer(SCORER_KEYWORDS))
    return cap.select("video_id", "cap_idx", F.round(TB.label_score(scores, "neutral"), R6).alias("neutral"))


def _caption_neutral_sql() -> str:
    # the scorer's tokens: contractions, letter runs, single digits, other runs
    pat = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}\p{Nl}\p{No}]+|\p{Nd}|[^\s\p{L}\p{N}_]+"
    hits = ",\n       ".join(
        f"len(list_filter(toks, lambda x: list_contains({[w.lower() for w in ws]!r}, x))) AS h_{lab}"
        for lab, ws in SCORER_KEYWORDS.items())
    labs = list(SCORER_KEYWORDS)
    mx = "greatest(" + ", ".join(f"h_{l}" for l in labs) + ")"
    den = " + ".join(f"exp(h_{l} - m)" for l in labs)
    return P.with_ctes(P.P_CAPTION_SQL) + f"""
, t AS (SELECT video_id, cap_idx, regexp_extract_all(lower(coalesce(text, '')), '{pat.replace("'", "''")}') AS toks FROM p_caption)
, h AS (SELECT video_id, cap_idx, {hits} FROM t)
, g AS (SELECT *, {mx} AS m FROM h)
SELECT video_id, cap_idx, round(exp(h_neutral - m) / ({den}), 6) AS neutral FROM g"""

def q_boxed_frames(spark, sf):
    """Frames whose box list is empty are dropped (FLT-13) after the default
    empty-list lookup (JN-05)."""
    from ..operators import tables as TB
    from ..sources.readers import frames_with_box
    frames = P.p_frame(spark, sf).select("video_id", "frame_idx")
    f = F.col("frame_idx").cast("double")
    boxes = frames.where(F.col("frame_idx") % 7 == 0).select(
        "video_id", "frame_idx", F.array(F.array(f % 640, f % 480, f % 640 + 10, f % 480 + 10, F.lit(0.9))).alias("boxes"))
    return frames_with_box(TB.attach_boxes(frames, boxes, ["video_id", "frame_idx"])).select("video_id", "frame_idx")


SQL_BOXED_FRAMES = P.with_ctes(P.P_FRAME_SQL) + """
SELECT video_id, frame_idx FROM p_frame WHERE frame_idx % 7 = 0"""

# ------------------------------------------------------------------ joints, masks, batches
def p_joints(spark, sf):
    v = P.p_vec(spark, sf)
    js = F.transform(F.sequence(F.lit(0), F.lit(17)), lambda j: F.struct(
        (F.abs(F.element_at("embedding", j * 3 + 1)) * 100).alias("x"),
        (F.abs(F.element_at("embedding", j * 3 + 2)) * 100).alias("y"),
        F.abs(F.element_at("embedding", j * 3 + 3)).alias("conf")))
    js = F.transform(js, lambda s: F.when(s["conf"] < 0.05, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"),
                                                                      F.lit(0.0).alias("conf"))).otherwise(s))
    return v.select("vec_id", js.alias("joints"))


def q_joints_bbox(spark, sf):
    b = B.joints_to_bbox("joints", x_pad=2, y_pad=1)
    return p_joints(spark, sf).select("vec_id", *[b[i].alias(n) for i, n in enumerate(["y1", "x1", "y2", "x2"])])


SQL_JOINTS_BBOX = P.with_ctes(P.P_VEC_SQL) + """
, j AS (SELECT vec_id, unnest(range(0, 18)) AS k, embedding FROM p_vec)
, p AS (SELECT vec_id, abs(embedding[k * 3 + 1]) * 100 AS x, abs(embedding[k * 3 + 2]) * 100 AS y,
               abs(embedding[k * 3 + 3]) AS conf FROM j)
, kept AS (SELECT * FROM p WHERE conf >= 0.05)
SELECT v.vec_id, CAST(floor(min(y)) - 1 AS BIGINT) AS y1, CAST(floor(min(x)) - 2 AS BIGINT) AS x1,
       CAST(ceil(max(y)) + 1 AS BIGINT) AS y2, CAST(ceil(max(x)) + 2 AS BIGINT) AS x2
FROM (SELECT DISTINCT vec_id FROM p_vec) v LEFT JOIN kept USING (vec_id) GROUP BY v.vec_id"""


def q_mask_patches(spark, sf):
    b = P.p_box(spark, sf).withColumnRenamed("label", "image_id")
    m = B.mask_patches(b, ["image_id"], 320, 320, 32)
    return m.select("image_id", "patch_row", "patch_col", F.round("coverage", R6).alias("coverage"))


SQL_MASK_PATCHES = P.with_ctes(P.P_BOX_SQL) + """
, b AS (SELECT label AS image_id, greatest(CAST(x1 AS BIGINT), 0) AS bx1, greatest(CAST(y1 AS BIGINT), 0) AS by1,
               least(CAST(x2 AS BIGINT), 320) AS bx2, least(CAST(y2 AS BIGINT), 320) AS by2 FROM p_box WHERE score > 0.5)
, px AS (SELECT DISTINCT image_id, unnest(range(bx1, bx2)) AS x, y
         FROM (SELECT *, unnest(range(by1, by2)) AS y FROM b WHERE bx2 > bx1 AND by2 > by1))
, cov AS (SELECT image_id, y // 32 AS pr, x // 32 AS pc, count(*) AS n FROM px GROUP BY ALL)
, grid AS (SELECT image_id, r AS pr, c AS pc FROM (SELECT DISTINCT label AS image_id FROM p_box),
           range(0, 10) t1(r), range(0, 10) t2(c))
SELECT grid.image_id, CAST(grid.pr AS BIGINT) AS patch_row, CAST(grid.pc AS BIGINT) AS patch_col,
       round(coalesce(n, 0) / 1024.0, 6) AS coverage
FROM grid LEFT JOIN cov ON cov.image_id = grid.image_id AND cov.pr = grid.pr AND cov.pc = grid.pc"""


def q_rect_batches(spark, sf):
    b = P.p_box(spark, sf).select("vec_id", (F.col("x2") - F.col("x1") + 50).alias("w"),
                                  (F.col("y2") - F.col("y1") + 50).alias("h"))
    return B.rect_batch_shapes(b, "w", "h", batch_size=16, img_size=640, stride=32, pad=0.5)


SQL_RECT_BATCHES = P.with_ctes(P.P_BOX_SQL) + """
, s AS (SELECT vec_id, (y2 - y1 + 50) / (x2 - x1 + 50) AS ar FROM p_box)
, o AS (SELECT ar, (row_number() OVER (ORDER BY ar, vec_id) - 1) // 16 AS batch FROM s)
, a AS (SELECT batch, min(ar) AS mn, max(ar) AS mx FROM o GROUP BY batch)
SELECT batch, CAST(ceil(CASE WHEN mx < 1 THEN mx ELSE 1.0 END * 640 / 32 + 0.5) * 32 AS BIGINT) AS shape_h,
       CAST(ceil(CASE WHEN mx < 1 THEN 1.0 WHEN mn > 1 THEN 1 / mn ELSE 1.0 END * 640 / 32 + 0.5) * 32 AS BIGINT) AS shape_w
FROM a"""


BOXES_PER_FRAME = 40


def q_suppressed_boxes(spark, sf):
    """Boxes of a frame that survive greedy non-maximum suppression, by class
    (UDF-06)."""
    b = P.p_box(spark, sf).select(F.floor(F.col("vec_id") / BOXES_PER_FRAME).alias("frame"), "vec_id", "x1", "y1", "x2", "y2", "score", (F.col("label") % 3).alias("cls"))
    kept = B.suppress_rows(b, ["frame"], "vec_id", overlap=0.2)
    return kept.select("frame", "rank", *[F.round(c, R6).alias(c) for c in ("x1", "y1", "x2", "y2", "score", "cls")])


#: Box after box of a frame and class; ``kept`` holds the places of those that stay.
SQL_SUPPRESSED_BOXES = "WITH RECURSIVE " + P.P_BOX_SQL + f"""
, b AS (SELECT vec_id // {BOXES_PER_FRAME} AS frame, label % 3 AS cls, vec_id, x1, y1, x2, y2, score, (x2 - x1) * (y2 - y1) AS area,
               row_number() OVER (PARTITION BY vec_id // {BOXES_PER_FRAME}, label % 3 ORDER BY score DESC, vec_id) AS r FROM p_box WHERE score > 0.25)
, near AS (SELECT a.frame, a.cls, a.r, list(z.r) FILTER (z.r IS NOT NULL) AS before FROM b a LEFT JOIN b z ON z.frame = a.frame AND z.cls = a.cls AND z.r < a.r
           AND greatest(least(a.x2, z.x2) - greatest(a.x1, z.x1), 0) * greatest(least(a.y2, z.y2) - greatest(a.y1, z.y1), 0)
             > 0.2 * (a.area + z.area - greatest(least(a.x2, z.x2) - greatest(a.x1, z.x1), 0) * greatest(least(a.y2, z.y2) - greatest(a.y1, z.y1), 0))
           GROUP BY a.frame, a.cls, a.r)
, step AS (SELECT frame, cls, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT frame, cls FROM b)
           UNION ALL SELECT s.frame, s.cls, n.r, CASE WHEN n.before IS NOT NULL AND list_has_any(s.kept, n.before) THEN s.kept ELSE list_append(s.kept, n.r) END
           FROM step s JOIN near n ON n.frame = s.frame AND n.cls = s.cls AND n.r = s.r + 1)
, last AS (SELECT frame, cls, arg_max(kept, r) AS kept FROM step GROUP BY frame, cls)
SELECT CAST(frame AS BIGINT) AS frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(score, 6) AS score, CAST(cls AS DOUBLE) AS cls
FROM b JOIN last USING (frame, cls) WHERE list_contains(kept, r)"""


QUERIES = {
    "suppressed_boxes": (q_suppressed_boxes, SQL_SUPPRESSED_BOXES),
    "shots": (q_shots, SQL_SHOTS),
    "label_at_time": (q_label_at_time, SQL_LABEL_AT_TIME),
    "label_rows": (q_label_rows, SQL_LABEL_ROWS),
    "person_boxes": (q_person_boxes, SQL_PERSON_BOXES),
    "neutral_score": (q_neutral_score, SQL_NEUTRAL_SCORE),
    "boxed_frames": (q_boxed_frames, SQL_BOXED_FRAMES),
    "caption_neutral": (q_caption_neutral, _caption_neutral_sql()),
    "clip_frames": (q_clip_frames, SQL_CLIP_FRAMES),
    "centered_clips": (q_centered_clips, SQL_CENTERED_CLIPS),
    "clip_audit": (q_clip_audit, SQL_CLIP_AUDIT),
    "box_rescale": (q_box_rescale, SQL_BOX_RESCALE),
    "letterbox": (q_letterbox, SQL_LETTERBOX),
    "box_filters": (q_box_filters, SQL_BOX_FILTERS),
    "crop_boxes": (q_crop_boxes, SQL_CROP_BOXES),
    "joints_bbox": (q_joints_bbox, SQL_JOINTS_BBOX),
    "mask_patches": (q_mask_patches, SQL_MASK_PATCHES),
    "rect_batches": (q_rect_batches, SQL_RECT_BATCHES),
}
