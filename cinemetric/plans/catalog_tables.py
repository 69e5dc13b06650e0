"""Registered queries for the small table operators of the loaders: audits,
keys, label encodings, positional joins, thresholds and set tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as TB
from ..operators.sequence import global_row_index
from ..sources.readers import binarize
from . import proxies as P

HOT_NAMES = {"quality": "Happiness", "toxic": "Anger"}


def q_audit_nulls(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return TB.audit_nulls(e, "event_type", ["value", "props"])


SQL_AUDIT_NULLS = """SELECT event_type, CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) AS null_value,
       CAST(count(*) FILTER (WHERE props IS NULL) AS BIGINT) AS null_props FROM events GROUP BY 1"""


def q_clip_keys(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return c.select("conv_id", "turn", TB.clip_key(F.col("conv_id"), F.col("turn")).alias("clip_key"))


SQL_CLIP_KEYS = "SELECT conv_id, turn, printf('dia%d_utt%d', conv_id, turn) AS clip_key FROM conversations"


def q_label_index(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type")
    classes = global_row_index(e.select(F.col("event_type").alias("name")).distinct(), ["name"], "class_id")
    return TB.label_index(e, "event_type", classes).select("event_id", "class_id")


SQL_LABEL_INDEX = "SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS class_id FROM events"


def q_multi_hot_labels(spark, sf):
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    names = F.filter(F.array(*[F.when(F.col(c) == 1, F.lit(n)) for c, n in HOT_NAMES.items()]), lambda x: x.isNotNull())
    mh = TB.multi_hot(names)
    hot = F.filter(F.transform(mh, lambda v, i: F.when(v > 0, i)), lambda x: x.isNotNull())
    return lab.select("doc_id", F.aggregate(mh, F.lit(0.0), lambda a, x: a + x).alias("n_hot"),
                      F.array_join(F.transform(hot, lambda i: i.cast("string")), ",").alias("hot"))


def _multi_hot_sql() -> str:
    idx = {c: TB.MOVIE_CLASSES.index(n) for c, n in HOT_NAMES.items()}
    parts = sorted(idx.items(), key=lambda kv: kv[1])
    pieces = " || ".join([f"CASE WHEN {c} = 1 THEN '{i},' ELSE '' END" for c, i in parts])
    return f"""SELECT doc_id, CAST(quality + toxic AS DOUBLE) AS n_hot, rtrim({pieces}, ',') AS hot FROM labels"""


def q_positional_join(spark, sf):
    emb = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id")
    lab = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    # two tables of different lengths: positions that both have, as the twin
    return TB.positional_join(emb, lab, ["vec_id"], ["doc_id"], unmatched="drop")


SQL_POSITIONAL_JOIN = """
SELECT a.row_idx, vec_id, doc_id, quality FROM
  (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row_idx FROM embeddings) a JOIN
  (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM labels) b USING (row_idx)"""


def q_binarize(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("value").alias("v"))
    return binarize(e, ["v"], 10.0)


SQL_BINARIZE = "SELECT event_id, CAST(value >= 10.0 AS INTEGER) AS v FROM events"


def q_set_checks(spark, sf):
    """Intersection size, union size, concatenation size and subset test of
    caption videos and boxed-frame videos."""
    cap = P.p_caption(spark, sf).select("video_id")
    boxed = P.p_frame(spark, sf).where("has_box").select("video_id")
    count = F.count(F.lit(1))
    return TB.concat_tables(cap, boxed).agg(count.alias("n_concat")).select(
        TB.intersection_size(cap, boxed, "video_id").scalar().alias("n_intersect"),
        TB.union_ids(cap, boxed, col="video_id").agg(count.alias("n")).scalar().alias("n_union"), "n_concat",
        F.lit(TB.is_subset(cap, boxed, "video_id")).alias("is_subset"))


SQL_SET_CHECKS = P.with_ctes(P.P_CAPTION_SQL, P.P_FRAME_SQL) + """
, c AS (SELECT video_id FROM p_caption), b AS (SELECT video_id FROM p_frame WHERE has_box)
SELECT (SELECT count(*) FROM (SELECT video_id FROM c INTERSECT SELECT video_id FROM b)) AS n_intersect,
       (SELECT count(*) FROM (SELECT video_id FROM c UNION SELECT video_id FROM b)) AS n_union,
       (SELECT count(*) FROM c) + (SELECT count(*) FROM b) AS n_concat,
       NOT EXISTS (SELECT 1 FROM c WHERE video_id NOT IN (SELECT video_id FROM b)) AS is_subset"""


def q_language_subset(spark, sf):
    """Rows in one language having a title or a description (FLT-20): the
    documents' text and source stand in for the two fields."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text", "source")
    return TB.subset_language(d, "lang", "en", "text", "source").select("doc_id")


SQL_LANGUAGE_SUBSET = """
SELECT doc_id FROM documents
WHERE lang = 'en' AND (length(trim(coalesce(text, ''))) > 0 OR length(trim(coalesce(source, ''))) > 0)"""


def q_short_clips(spark, sf):
    """Caption clips with fewer than the wanted 32 frames (4 s at 8 fps) are
    dropped and counted (FLT-18)."""
    from ..operators import captions as C
    from ..operators.coverage import frame_bounds
    caps = C.clip_ends(P.p_caption(spark, sf), chunk=F.floor(F.col("cap_idx") / 256))
    s, e = frame_bounds(F.col("start"), F.col("end"))
    clips = caps.select("video_id", "cap_idx", s.alias("start_frame"), e.alias("end_frame"))
    kept, dropped = TB.min_frames(clips, "start_frame", "end_frame", 32)
    return (kept.agg(F.count(F.lit(1)).alias("value")).select(F.lit("n_kept").alias("metric"), "value")
            .unionByName(dropped.select(F.lit("n_dropped").alias("metric"), F.col("n_dropped").alias("value"))))


SQL_SHORT_CLIPS = P.with_ctes(P.P_CAPTION_SQL) + """
, ends AS (SELECT *, CASE WHEN lead(start) OVER w IS NULL THEN start + duration
                          ELSE least(start + duration, lead(start) OVER w) END AS "end"
           FROM p_caption WINDOW w AS (PARTITION BY video_id ORDER BY cap_idx))
, c AS (SELECT CAST(floor("end" * 8) AS BIGINT) - CAST(ceil(start * 8) AS BIGINT) + 1 AS n FROM ends)
SELECT 'n_kept' AS metric, CAST(count(*) FILTER (WHERE n >= 32) AS BIGINT) AS value FROM c
UNION ALL SELECT 'n_dropped', CAST(count(*) FILTER (WHERE n < 32) AS BIGINT) FROM c"""


def q_split_members(spark, sf):
    """Label rows of the documents listed for ``train+val`` (FLT-09); the split
    lists come from the documents (ids ending 0-7 train, 8 val, 9 test)."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "val").otherwise("test")
    splits = d.select(F.col("doc_id").alias("key"), split.alias("split"))
    lab = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    return TB.select_split(lab, splits, "doc_id", "train+val")


SQL_SPLIT_MEMBERS = """
SELECT doc_id, quality, toxic FROM labels
WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 10 <= 8)"""


def q_word_dedupe(spark, sf):
    """Per document: words, distinct words kept in first-seen order (SET-06)
    and whether any word repeats (SET-07)."""
    from ..functions import text as TX
    d = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("text").isNotNull())
    w = d.select("doc_id", TX.words("text").alias("w"))
    u = w.select("doc_id", "w", TB.dedupe_keep_first(F.col("w")).alias("u"))
    return u.select("doc_id", F.size("w").alias("n_words"), F.size("u").alias("n_distinct"),
                    TB.has_duplicate_rows(F.col("w")).alias("has_duplicates"),
                    F.col("u").alias("distinct_words"))


SQL_WORD_DEDUPE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w
           FROM documents WHERE text IS NOT NULL)
, x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d)
, f AS (SELECT doc_id, word, min(i) AS i FROM x GROUP BY doc_id, word)
, r AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f)
, t AS (SELECT doc_id, count(*) AS n_distinct, list(word ORDER BY k) AS distinct_words
        FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS INTEGER) AS n_words, CAST(coalesce(t.n_distinct, 0) AS INTEGER) AS n_distinct,
       len(d.w) <> coalesce(t.n_distinct, 0) AS has_duplicates,
       coalesce(t.distinct_words, CAST([] AS VARCHAR[])) AS distinct_words
FROM d LEFT JOIN t USING (doc_id)"""



# Fixed target columns per mode (PRJ-01), on the embeddings proxy.
TARGET_MODES = {"vad": ["valence", "arousal", "dominance"], "cat": ["label"]}


def q_affect_targets(spark, sf):
    """Target columns chosen by mode (PRJ-01): ``vad`` keeps three continuous
    targets, here the first three embedding values."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        "vec_id", "label", *[F.round(F.col("embedding")[i].cast("double"), 6).alias(n)
                             for i, n in enumerate(TARGET_MODES["vad"])])
    return TB.select_target(e, "vad", TARGET_MODES, ["vec_id"])


SQL_AFFECT_TARGETS = """
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS valence, round(CAST(embedding[2] AS DOUBLE), 6) AS arousal,
       round(CAST(embedding[3] AS DOUBLE), 6) AS dominance FROM embeddings"""


def q_label_corrections(spark, sf):
    """Known-bad rows removed and one value patched by natural id (FLT-08);
    the correction lists name existing rows (ids ending 7 in fifty are
    dropped, ids ending 3 get quality 1)."""
    lab = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    drops = lab.where(F.col("doc_id") % 50 == 7).select("doc_id")
    patches = lab.where(F.col("doc_id") % 50 == 3).select("doc_id", F.lit(1).cast(lab.schema["quality"].dataType)
                                                          .alias("quality"))
    return TB.apply_corrections(lab, drops, patches, ["doc_id"], "quality")


SQL_LABEL_CORRECTIONS = """
SELECT doc_id, CASE WHEN doc_id % 50 = 3 THEN 1 ELSE quality END AS quality, toxic
FROM labels WHERE doc_id % 50 <> 7"""


def q_annotated_docs(spark, sf):
    """Items that have a label file (FLT-19): document image paths mapped to
    label paths (``/images/`` -> ``/labels/``, suffix -> ``.txt``, JN-13) and
    kept when that label file is listed."""
    from ..sources.readers import label_path_for
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", F.concat(F.lit("/data/images/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    files = spark.read.parquet(f"{sf}/labels.parquet").select(
        F.concat(F.lit("/data/labels/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"))
    return TB.annotated_only(docs, files, "path", label_path_for(F.col("path")))


SQL_ANNOTATED_DOCS = """
SELECT doc_id, '/data/images/' || doc_id || '.jpg' AS path FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels)"""


def q_frame_boxes(spark, sf):
    """Frame -> box list with the default empty list for frames without boxes
    (JN-05); boxes exist for every seventh frame of the frame proxy."""
    frames = P.p_frame(spark, sf).select("video_id", "frame_idx")
    f = F.col("frame_idx").cast("double")
    boxes = frames.where(F.col("frame_idx") % 7 == 0).select(
        "video_id", "frame_idx", F.array(F.array(f % 640, f % 480, f % 640 + 10, f % 480 + 10, F.lit(0.9))).alias("boxes"))
    return TB.attach_boxes(frames, boxes, ["video_id", "frame_idx"]).select(
        "video_id", "frame_idx", F.size("boxes").alias("n_boxes"), "boxes")


SQL_FRAME_BOXES = P.with_ctes(P.P_FRAME_SQL) + """
SELECT video_id, frame_idx, CASE WHEN frame_idx % 7 = 0 THEN 1 ELSE 0 END AS n_boxes,
       CASE WHEN frame_idx % 7 = 0 THEN [[CAST(frame_idx % 640 AS DOUBLE), CAST(frame_idx % 480 AS DOUBLE),
                                          CAST(frame_idx % 640 AS DOUBLE) + 10, CAST(frame_idx % 480 AS DOUBLE) + 10, 0.9]]
            ELSE CAST([] AS DOUBLE[][]) END AS boxes
FROM p_frame"""

QUERIES = {
    "affect_targets": (q_affect_targets, SQL_AFFECT_TARGETS),
    "label_corrections": (q_label_corrections, SQL_LABEL_CORRECTIONS),
    "annotated_docs": (q_annotated_docs, SQL_ANNOTATED_DOCS),
    "frame_boxes": (q_frame_boxes, SQL_FRAME_BOXES),
    "language_subset": (q_language_subset, SQL_LANGUAGE_SUBSET),
    "short_clips": (q_short_clips, SQL_SHORT_CLIPS),
    "split_members": (q_split_members, SQL_SPLIT_MEMBERS),
    "word_dedupe": (q_word_dedupe, SQL_WORD_DEDUPE),
    "audit_nulls": (q_audit_nulls, SQL_AUDIT_NULLS),
    "clip_keys": (q_clip_keys, SQL_CLIP_KEYS),
    "label_index": (q_label_index, SQL_LABEL_INDEX),
    "multi_hot_labels": (q_multi_hot_labels, _multi_hot_sql()),
    "positional_join": (q_positional_join, SQL_POSITIONAL_JOIN),
    "binarize": (q_binarize, SQL_BINARIZE),
    "set_checks": (q_set_checks, SQL_SET_CHECKS),
}
