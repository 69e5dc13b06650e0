"""Registered queries for batches and sampling: contrastive losses per batch,
repeatable frame sampling, splits, shuffled epochs, batch numbers, renumbering
and rolling means."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import contrastive as CT
from ..operators import sampling as SM
from . import proxies as P

R6 = 6
SPLIT_WEIGHTS = (0.9, 0.1, 0.0)


def _pairs_input(spark, sf):
    lg = P.p_logits(spark, sf).select("vec_id", "logits")
    v = P.p_vec(spark, sf)
    rot = F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1))
    return v.join(lg, "vec_id").select("vec_id", "batch_id", V.l2_normalize("embedding").alias("img"),
                                      V.l2_normalize(rot).alias("txt"), "logits")


def q_contrastive_loss(spark, sf):
    loss = CT.contrastive_loss(_pairs_input(spark, sf), "batch_id", "img", "txt", scale=10.0,
                               sentiment="logits", sentiment_scale=10.0)
    return loss.select("batch_id", "n", F.round("loss", R6).alias("loss"),
                       F.round("reweighted_loss", R6).alias("reweighted_loss"))


PAIR_SQL = P.with_ctes(P.P_LOGITS_SQL) + """
, rot AS (SELECT vec_id, batch_id, embedding AS a, list_concat(embedding[2:64], embedding[1:1]) AS b FROM p_vec)
, ea AS (SELECT vec_id, batch_id, unnest(a) AS x, generate_subscripts(a, 1) AS d FROM rot)
, eb AS (SELECT vec_id, batch_id, unnest(b) AS x, generate_subscripts(b, 1) AS d FROM rot)
, na AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM ea GROUP BY 1)
, nb AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM eb GROUP BY 1)
, ia AS (SELECT ea.vec_id, batch_id, d, x / n AS x FROM ea JOIN na USING (vec_id))
, tb AS (SELECT eb.vec_id, batch_id, d, x / n AS x FROM eb JOIN nb USING (vec_id))
, lg AS (SELECT i.vec_id AS i, t.vec_id AS j, i.batch_id, 10.0 * sum(i.x * t.x) AS l
         FROM ia i JOIN tb t ON i.batch_id = t.batch_id AND i.d = t.d GROUP BY 1, 2, 3)
, el AS (SELECT vec_id, batch_id, unnest(logits) AS z, generate_subscripts(logits, 1) AS k FROM p_logits)
, ls AS (SELECT vec_id, max(z) + ln(sum(exp(z - mx))) AS lse FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS mx FROM el) GROUP BY vec_id)
, lp AS (SELECT el.vec_id, batch_id, k, z - lse AS lx, exp(z - lse) AS y FROM el JOIN ls USING (vec_id))
, ent AS (SELECT vec_id, sum(y * ln(y)) AS h FROM lp GROUP BY vec_id)
, kl AS (SELECT a.vec_id AS i, b.vec_id AS j, any_value(e.h) - sum(a.lx * b.y) AS kl
         FROM lp a JOIN lp b ON a.batch_id = b.batch_id AND a.k = b.k JOIN ent e ON e.vec_id = b.vec_id GROUP BY 1, 2)
, lw AS (SELECT lg.*, lg.l - 10.0 * CASE WHEN lg.i = lg.j THEN 0 ELSE 1.0 / abs(kl.kl) END AS lr
         FROM lg JOIN kl ON kl.i = lg.i AND kl.j = lg.j)"""


def _ce_sql(col: str) -> str:
    return f"""
, r_{col} AS (SELECT batch_id, i, max({col}) + ln(sum(exp({col} - mx))) - max(CASE WHEN i = j THEN {col} END) AS ce
             FROM (SELECT *, max({col}) OVER (PARTITION BY i) AS mx FROM lw) GROUP BY batch_id, i)
, c_{col} AS (SELECT batch_id, j, max({col}) + ln(sum(exp({col} - mx))) - max(CASE WHEN i = j THEN {col} END) AS ce
             FROM (SELECT *, max({col}) OVER (PARTITION BY j) AS mx FROM lw) GROUP BY batch_id, j)
, s_{col} AS (SELECT batch_id, (avg_r + avg_c) / 2 AS loss FROM
             (SELECT batch_id, avg(ce) AS avg_r FROM r_{col} GROUP BY 1) JOIN
             (SELECT batch_id, avg(ce) AS avg_c FROM c_{col} GROUP BY 1) USING (batch_id))"""


SQL_CONTRASTIVE_LOSS = PAIR_SQL + _ce_sql("l") + _ce_sql("lr") + """
SELECT batch_id, CAST(n AS BIGINT) AS n, round(s_l.loss, 6) AS loss, round(s_lr.loss, 6) AS reweighted_loss
FROM s_l JOIN s_lr USING (batch_id) JOIN (SELECT batch_id, count(*) AS n FROM p_vec GROUP BY 1) USING (batch_id)"""


def q_dissimilarity(spark, sf):
    v = P.p_vec(spark, sf).select("batch_id", "vec_id", V.l2_normalize("embedding").alias("tok"))
    d = CT.dissimilarity(v, "batch_id", "vec_id", "tok")
    return d.select("batch_id", F.round("dissimilarity", R6).alias("dissimilarity"))


SQL_DISSIMILARITY = P.with_ctes(P.P_VEC_SQL) + """
, e AS (SELECT vec_id, batch_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM p_vec)
, n AS (SELECT vec_id, sqrt(sum(x * x)) AS nv FROM e GROUP BY 1)
, en AS (SELECT e.vec_id, batch_id, d, x / nv AS x FROM e JOIN n USING (vec_id))
, f AS (SELECT batch_id, min(vec_id) AS first FROM p_vec GROUP BY 1)
, dots AS (SELECT o.batch_id, o.vec_id, sum(o.x * t.x) AS dp FROM en o JOIN f ON f.batch_id = o.batch_id AND o.vec_id <> f.first
           JOIN en t ON t.vec_id = f.first AND t.d = o.d GROUP BY 1, 2)
SELECT batch_id, round(avg(1 - dp), 6) AS dissimilarity FROM dots GROUP BY 1"""


# ------------------------------------------------------------------ sampling and splits
def q_random_frames(spark, sf):
    from .catalog_frames import q_clip_frames
    clips = q_clip_frames(spark, sf).select("movie_id", "clip_id", "start_frame", "end_frame")
    r = SM.random_frames(clips, ["movie_id", "clip_id"], "start_frame", "end_frame", 8, seed=7)
    return r.select("movie_id", "clip_id", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


def _sql_clip_frames():
    from .catalog_frames import SQL_CLIP_FRAMES
    return SQL_CLIP_FRAMES


def _sql_random_frames() -> str:
    base = _sql_clip_frames()
    head, tail = base.rsplit("SELECT movie_id, clip_id, start_frame, end_frame,", 1)
    tail = "SELECT movie_id, clip_id, start_frame, end_frame," + tail
    return head + f""", clipsel AS ({tail})
, fr AS (SELECT movie_id, clip_id, unnest(range(start_frame, end_frame + 1)) AS f FROM clipsel)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY movie_id, clip_id ORDER BY md5(concat_ws(':', '7', movie_id, clip_id, f))) AS rk FROM fr)
SELECT movie_id, clip_id, string_agg(CAST(f AS VARCHAR), ',' ORDER BY f) AS frames FROM ranked WHERE rk <= 8 GROUP BY 1, 2"""


def _hex_unit_sql(expr: str) -> str:
    digits = f"string_split(substr(md5({expr}), 1, 13), '')"
    val = f"list_reduce(list_transform({digits}, lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, b: a * 16 + b)"
    return f"(CAST({val} AS DOUBLE) / {float(16 ** 13)!r})"


def q_assign_split(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    return SM.assign_split(d, "doc_id", SPLIT_WEIGHTS, seed=3)


def _split_sql() -> str:
    total = float(sum(SPLIT_WEIGHTS))
    cum, parts = 0.0, []
    for w, n in zip(SPLIT_WEIGHTS, ("train", "val", "test")):
        cum += w / total
        parts.append(f"WHEN u < {cum!r} THEN '{n}'")
    return f"""WITH u AS (SELECT doc_id, {_hex_unit_sql("concat_ws(':', '3', doc_id)")} AS u FROM documents)
SELECT doc_id, CASE {' '.join(parts)} ELSE 'test' END AS split FROM u"""


def q_stratified_split(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label")
    return SM.stratified_split(e, "label", "vec_id", (("train", 20), ("val", 10), ("test", 10)), seed=5)


SQL_STRATIFIED_SPLIT = """
WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', '5', vec_id)), vec_id) AS rn
           FROM embeddings)
SELECT vec_id, label, CASE WHEN rn <= 20 THEN 'train' WHEN rn <= 30 THEN 'val' ELSE 'test' END AS split FROM r WHERE rn <= 40"""


def q_epoch_batches(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    return SM.epoch_batches(d, "doc_id", epoch=3, size=64)


SQL_EPOCH_BATCHES = """
WITH o AS (SELECT doc_id, (row_number() OVER (ORDER BY md5(concat_ws(':', '3', doc_id)), doc_id) - 1) // 64 AS batch_id FROM documents)
SELECT doc_id, batch_id FROM o WHERE batch_id < (SELECT count(*) // 64 FROM documents)"""


def q_batch_ids(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    return SM.batch_ids(e, ["ts", "event_id"], 100).select("event_id", "batch_id")


SQL_BATCH_IDS = """SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 100 AS batch_id FROM events"""


def q_reindex(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("lang") != "es").select("doc_id")
    return SM.reindex(d, "doc_id")


SQL_REINDEX = """SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents WHERE lang <> 'es'"""


def q_rolling_mean(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    r = SM.rolling_mean(e, ["user_id"], ["ts", "event_id"], "value", 5)
    return r.select("event_id", F.round("rolling", R6).alias("rolling"))


SQL_ROLLING_MEAN = """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                          ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events"""


QUERIES = {
    "contrastive_loss": (q_contrastive_loss, SQL_CONTRASTIVE_LOSS),
    "dissimilarity": (q_dissimilarity, SQL_DISSIMILARITY),
    "random_frames": (q_random_frames, _sql_random_frames()),
    "assign_split": (q_assign_split, _split_sql()),
    "stratified_split": (q_stratified_split, SQL_STRATIFIED_SPLIT),
    "epoch_batches": (q_epoch_batches, SQL_EPOCH_BATCHES),
    "batch_ids": (q_batch_ids, SQL_BATCH_IDS),
    "reindex": (q_reindex, SQL_REINDEX),
    "rolling_mean": (q_rolling_mean, SQL_ROLLING_MEAN),
}


# ------------------------------------------------------------------ polynomial smoothing
SG_LEN, SG_ORDER = 7, 3


def q_savgol(spark, sf):
    from ..operators.smoothing import savgol
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "value")
    s = savgol(e, "value", ["ts", "event_id"], SG_LEN, SG_ORDER, by=["user_id"], chunk=64)
    return s.select("event_id", F.round("smoothed", 6).alias("smoothed"))


def _savgol_sql() -> str:
    import numpy as np
    from ..operators.smoothing import fit_matrix, window_layout
    left, right, t = window_layout(SG_LEN)
    half = SG_LEN // 2
    coef = fit_matrix(SG_LEN, SG_ORDER, np.arange(SG_LEN) - left - t, np.array([0.0]))[0]
    head = fit_matrix(SG_LEN, SG_ORDER, np.arange(SG_LEN, dtype=float), np.arange(half, dtype=float))
    tail = fit_matrix(SG_LEN, SG_ORDER, np.arange(SG_LEN, dtype=float), np.arange(SG_LEN - half, SG_LEN, dtype=float))
    cv = ", ".join(f"({j - left}, {float(c)!r})" for j, c in enumerate(coef))
    hv = ", ".join(f"({i}, {s}, {float(head[i, s])!r})" for i in range(half) for s in range(SG_LEN))
    tv = ", ".join(f"({i}, {s}, {float(tail[i, s])!r})" for i in range(half) for s in range(SG_LEN))
    return f"""
WITH b AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn,
                  count(*) OVER (PARTITION BY user_id) AS n FROM events),
cf(off, c) AS (VALUES {cv}),
hw(t, s, w) AS (VALUES {hv}),
tw(t, s, w) AS (VALUES {tv}),
mid AS (SELECT b.user_id, b.rn, sum(cf.c * o.value) AS v, count(*) AS k FROM b, cf, b o
        WHERE o.user_id = b.user_id AND o.rn = b.rn + cf.off GROUP BY 1, 2),
hd AS (SELECT b.user_id, hw.t AS rn, sum(hw.w * b.value) AS v FROM b JOIN hw ON hw.s = b.rn WHERE b.n >= {SG_LEN} GROUP BY 1, 2),
tl AS (SELECT b.user_id, b.n - {half} + tw.t AS rn, sum(tw.w * b.value) AS v FROM b JOIN tw ON tw.s = b.rn - (b.n - {SG_LEN})
       WHERE b.n >= {SG_LEN} GROUP BY 1, 2)
SELECT b.event_id, round(CASE WHEN b.rn >= b.n - {half} THEN tl.v WHEN b.rn < {half} THEN hd.v
                              WHEN mid.k = {SG_LEN} THEN mid.v END, 6) AS smoothed
FROM b LEFT JOIN mid ON mid.user_id = b.user_id AND mid.rn = b.rn
       LEFT JOIN hd ON hd.user_id = b.user_id AND hd.rn = b.rn
       LEFT JOIN tl ON tl.user_id = b.user_id AND tl.rn = b.rn"""


QUERIES["savgol"] = (q_savgol, _savgol_sql())
