"""Registered queries for vector tables: scaling, normalisation, prototypes,
zero-shot scoring and ranking, and the evaluation metrics built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import vectors as V
from ..operators import metrics as M
from ..operators import vectors as O
from ..session import read_table
from . import proxies as P

R6 = 6

# Fixed prompt templates used by the prompt-grid query.
TEMPLATES = ["a photo of a {}.", "a bad photo of the {}.", "an image of {}."]

EXPLODE_SQL = """
, e AS (SELECT vec_id, label, is_test, batch_id, unnest(embedding) AS x,
               CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM p_vec)
, nrm AS (SELECT vec_id, sqrt(sum(x * x)) AS nv FROM e GROUP BY vec_id)
, en AS (SELECT e.*, CASE WHEN nv = 0 THEN x ELSE x / nv END AS xn FROM e JOIN nrm USING (vec_id))"""

PROTO_SQL = EXPLODE_SQL + """
, pm AS (SELECT label, dim, avg(xn) AS m FROM en WHERE NOT is_test GROUP BY label, dim)
, pn AS (SELECT label, sqrt(sum(m * m)) AS np FROM pm GROUP BY label)
, proto AS (SELECT pm.label, dim, CASE WHEN np = 0 THEN m ELSE m / np END AS p FROM pm JOIN pn USING (label))
, sc AS (SELECT en.vec_id, en.label, proto.label AS class_id, 100.0 * sum(en.xn * proto.p) AS score
         FROM en JOIN proto USING (dim) WHERE en.is_test GROUP BY en.vec_id, en.label, proto.label)
, lse AS (SELECT vec_id, max(score) + ln(sum(exp(score - mx))) AS lse
          FROM (SELECT *, max(score) OVER (PARTITION BY vec_id) AS mx FROM sc) GROUP BY vec_id, mx)
, rk AS (SELECT sc.*, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class_id DESC) AS rank FROM sc)"""


def q_vector_scaler(spark, sf):
    s = O.scaler_fit(P.p_vec(spark, sf), "embedding")
    return s.select("dim", F.round("mean", R6).alias("mean"), F.round("sd", R6).alias("sd"))


SQL_VECTOR_SCALER = P.with_ctes(P.P_VEC_SQL) + EXPLODE_SQL + """
SELECT dim, round(avg(x), 6) AS mean,
       round(CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END, 6) AS sd FROM e GROUP BY dim"""


def q_scaled_vectors(spark, sf):
    """Concatenate each vector with itself, scale by the fitted statistics and
    report the squared norm of the scaled row."""
    v = P.p_vec(spark, sf).withColumn("wide", F.concat("embedding", "embedding"))
    stats = O.scaler_fit(v, "wide")
    s = O.scaler_apply(v, "wide", stats, "scaled")
    return s.select("vec_id", F.round(F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x * x), R6).alias("sq_norm"))


SQL_SCALED_VECTORS = P.with_ctes(P.P_VEC_SQL) + """
, w AS (SELECT vec_id, list_concat(embedding, embedding) AS wide FROM p_vec)
, e AS (SELECT vec_id, unnest(wide) AS x, generate_subscripts(wide, 1) AS dim FROM w)
, st AS (SELECT dim, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS s FROM e GROUP BY dim)
SELECT vec_id, round(sum(((x - m) / s) * ((x - m) / s)), 6) AS sq_norm FROM e JOIN st USING (dim) GROUP BY vec_id"""


def q_l2_normalize(spark, sf):
    v = P.p_vec(spark, sf)
    return v.select("vec_id", F.posexplode(V.l2_normalize("embedding")).alias("dim", "x")) \
        .select("vec_id", "dim", F.round("x", R6).alias("x"))


SQL_L2_NORMALIZE = P.with_ctes(P.P_VEC_SQL) + EXPLODE_SQL + """
SELECT vec_id, dim, round(xn, 6) AS x FROM en"""


def q_class_prototypes(spark, sf):
    train = P.p_vec(spark, sf).where(~F.col("is_test"))
    protos = O.class_prototypes(train, "label", "embedding")
    return protos.select("label", F.posexplode("prototype").alias("dim", "p")) \
        .select("label", "dim", F.round("p", R6).alias("p"))


SQL_CLASS_PROTOTYPES = P.with_ctes(P.P_VEC_SQL) + PROTO_SQL + """
SELECT label, dim, round(p, 6) AS p FROM proto"""


def q_temporal_mean(spark, sf):
    m = O.mean_vectors(P.p_vec(spark, sf), ["batch_id"], "embedding", "mean_vec")
    return m.select("batch_id", F.posexplode("mean_vec").alias("dim", "m")) \
        .select("batch_id", "dim", F.round("m", R6).alias("m"))


SQL_TEMPORAL_MEAN = P.with_ctes(P.P_VEC_SQL) + EXPLODE_SQL + """
SELECT batch_id, dim, round(avg(x), 6) AS m FROM e GROUP BY batch_id, dim"""


PARTS_PER_SPLIT = 64


def q_subword_pooling(spark, sf):
    """Document words cut into 3-character pieces (the last one carries the
    end-of-word marker), piece vectors (length, piece index), then the word
    number of every piece (WN-09) and the mean piece vector per word (AG-13).
    The texts are dealt by document before they are cut up, so that only they
    are shuffled: a document's pieces stay in the task that holds its text."""
    d = read_table(spark, sf, "documents").select("doc_id", "text").dropna()
    # many small parts, for a text's pieces are sorted at dozens of times its size
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS_PER_SPLIT * d.rdd.getNumPartitions())
    d = d.repartition(parts, "doc_id")
    w = d.select("doc_id", F.posexplode(TX.words("text")).alias("wp", "word"))
    n = F.ceil(F.length("word") / 3.0).cast("int")
    p = w.select("doc_id", "wp", "word", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    piece = F.substring("word", F.col("i") * 3 + 1, 3)
    piece = F.when(F.col("i") == F.col("n") - 1, F.concat(piece, F.lit("</w>"))).otherwise(piece)
    toks = p.select("doc_id", (F.col("wp").cast("long") * (1 << 20) + F.col("i")).alias("pos"), piece.alias("piece"),
                    F.array(F.length(piece).cast("double"), F.col("i").cast("double")).alias("v"))
    pooled = O.pool_subwords(toks, ["doc_id"], "pos", "piece", "v", chunk=None, dims=2)
    return pooled.select("doc_id", "word_no", F.transform("word_vec", lambda x: F.round(x, R6)).alias("word_vec"))


SQL_SUBWORD_POOLING = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w
           FROM documents WHERE text IS NOT NULL)
, x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS wp FROM d)
, p AS (SELECT doc_id, wp, word, CAST(ceil(length(word) / 3.0) AS BIGINT) AS n,
               unnest(range(0, CAST(ceil(length(word) / 3.0) AS BIGINT))) AS i FROM x)
, q AS (SELECT doc_id, wp, i, CASE WHEN i = n - 1 THEN substring(word, 3 * i + 1, 3) || '</w>'
                                   ELSE substring(word, 3 * i + 1, 3) END AS piece FROM p)
SELECT doc_id, wp AS word_no, [round(avg(length(piece)), 6), round(avg(i), 6)] AS word_vec
FROM q GROUP BY doc_id, wp"""

def _zero_shot_data(spark, sf):
    v = P.p_vec(spark, sf)
    protos = O.class_prototypes(v.where(~F.col("is_test")), "label", "embedding")
    return v.where("is_test").withColumn("embedding", V.l2_normalize("embedding")), protos


def _zero_shot_top(spark, sf, k):
    test, protos = _zero_shot_data(spark, sf)
    return O.top_classes(test, "embedding", protos, "label", "prototype", k)


def q_zero_shot_top5(spark, sf):
    top = O.top_pairs(_zero_shot_top(spark, sf, 5), ["vec_id"])
    return top.select("vec_id", "rank", "class_id", F.round("score", 4).alias("score"), F.round("prob", R6).alias("prob"))


SQL_ZERO_SHOT_TOP5 = P.with_ctes(P.P_VEC_SQL) + PROTO_SQL + """
SELECT vec_id, CAST(rank AS INTEGER) AS rank, class_id, round(score, 4) AS score, round(exp(score - lse), 6) AS prob
FROM rk JOIN lse USING (vec_id) WHERE rank <= 5"""


def q_topk_accuracy(spark, sf):
    test, protos = _zero_shot_data(spark, sf)
    a = O.topk_accuracy(O.score_matrix(test, "embedding", protos, "label", "prototype"), "label", "scores", (1, 5))
    return a.select(F.round("top1", R6).alias("top1"), F.round("top5", R6).alias("top5"))


SQL_TOPK_ACCURACY = P.with_ctes(P.P_VEC_SQL) + PROTO_SQL + """
, hits AS (SELECT vec_id, max(CASE WHEN rank <= 1 AND class_id = label THEN 1 ELSE 0 END) AS h1,
                  max(CASE WHEN rank <= 5 AND class_id = label THEN 1 ELSE 0 END) AS h5 FROM rk GROUP BY vec_id)
SELECT round(avg(h1), 6) AS top1, round(avg(h5), 6) AS top5 FROM hits"""


def q_zero_shot_f1(spark, sf):
    top1 = O.top_pairs(_zero_shot_top(spark, sf, 1), ["vec_id", "label"], with_prob=False)
    f = M.weighted_f1(top1, "label", "class_id")
    return f.select(F.round("weighted_f1", R6).alias("weighted_f1"), F.round("accuracy", R6).alias("accuracy"))


SQL_ZERO_SHOT_F1 = P.with_ctes(P.P_VEC_SQL) + PROTO_SQL + """
, pr AS (SELECT vec_id, label AS t, class_id AS p FROM rk WHERE rank = 1)
, cls AS (SELECT t AS c FROM pr UNION SELECT p FROM pr)
, per AS (SELECT c, (SELECT count(*) FROM pr WHERE t = c) AS sup, (SELECT count(*) FROM pr WHERE p = c) AS npred,
                 (SELECT count(*) FROM pr WHERE p = c AND t = c) AS tp FROM cls)
, f AS (SELECT *, CASE WHEN npred > 0 THEN tp / npred ELSE 0 END AS pre, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rec FROM per)
SELECT round(sum(CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END * sup) / sum(sup), 6) AS weighted_f1,
       round(sum(tp) / sum(sup), 6) AS accuracy FROM f"""


def q_softmax_logits(spark, sf):
    lg = P.p_logits(spark, sf)
    probs = V.softmax("logits")
    return lg.select("vec_id", V.argmax("logits").alias("argmax"),
                     F.round(F.array_max(probs), R6).alias("max_prob"),
                     F.round(V.logsumexp("logits"), R6).alias("lse"),
                     F.round(F.element_at(V.log_softmax("logits"), 1), R6).alias("first_log_prob"))


SQL_SOFTMAX_LOGITS = P.with_ctes(P.P_LOGITS_SQL) + """
, e AS (SELECT vec_id, unnest(logits) AS z, generate_subscripts(logits, 1) - 1 AS k, logits[1] AS z0 FROM p_logits)
, m AS (SELECT vec_id, max(z) AS mx FROM e GROUP BY vec_id)
, s AS (SELECT e.vec_id, mx, z0, sum(exp(z - mx)) AS se, min(k) FILTER (WHERE z = mx) AS am FROM e JOIN m USING (vec_id)
        GROUP BY e.vec_id, mx, z0)
SELECT vec_id, CAST(am AS INTEGER) AS argmax, round(1.0 / se, 6) AS max_prob, round(mx + ln(se), 6) AS lse,
       round(z0 - (mx + ln(se)), 6) AS first_log_prob FROM s"""


# ------------------------------------------------------------------ prompt grid
def q_prompt_grid(spark, sf):
    brands = (spark.read.parquet(f"{sf}/part.parquet")
              .groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
              .select(F.col("p_brand").alias("class_name"),
                      F.array(F.col("p_brand"), F.lower(F.regexp_replace("p_brand", "#", " "))).alias("names")))
    g = O.prompt_grid(brands, "class_name", "names", TEMPLATES)
    return g.select("class_name", "name", "template_idx", "prompt")


SQL_PROMPT_GRID = """
WITH b AS (SELECT DISTINCT p_brand FROM part),
n AS (SELECT p_brand AS class_name, unnest([p_brand, lower(replace(p_brand, '#', ' '))]) AS name FROM b),
t AS (SELECT CAST(i - 1 AS INTEGER) AS template_idx, tpl AS template
      FROM (SELECT unnest(['a photo of a {}.', 'a bad photo of the {}.', 'an image of {}.']) AS tpl,
                   unnest(range(1, 4)) AS i))
SELECT class_name, name, template_idx, replace(template, '{}', name) AS prompt FROM n, t"""


# ------------------------------------------------------------------ multi-label ranking metrics
def p_multilabel(spark, sf):
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    doc = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars")
    j = lab.join(doc, "doc_id")
    sq = F.lit(1.0) - F.exp(-F.col("n_chars") / F.lit(2000.0))
    st = ((F.col("doc_id") * 7) % 100) / 100.0
    return j.select("doc_id", F.array(F.col("quality"), F.col("toxic")).alias("labels"),
                    F.array(sq, st).alias("scores"))


P_MULTILABEL_SQL = """p_ml AS (
  SELECT doc_id, [quality, toxic] AS labels, [1.0 - exp(-n_chars / 2000.0), ((doc_id * 7) % 100) / 100.0] AS scores
  FROM labels JOIN documents USING (doc_id))"""

ML_LONG_SQL = """
, lg AS (SELECT doc_id, unnest(labels) AS y, unnest(scores) AS s, unnest(range(0, 2)) AS cls FROM p_ml)"""


def _ml_long(spark, sf):
    m = p_multilabel(spark, sf)
    return m.select("doc_id", F.posexplode(F.arrays_zip(F.col("labels").alias("y"), F.col("scores").alias("s")))
                    .alias("cls", "ys")).select("doc_id", "cls", F.col("ys.y").alias("y"), F.col("ys.s").alias("s"))


def q_macro_ap(spark, sf):
    ap = M.average_precision(_ml_long(spark, sf), "cls", "y", "s")
    return ap.select("cls", F.round("ap", R6).alias("ap")).unionByName(
        M.macro(ap, "ap", "ap").select(F.lit(-1).alias("cls"), F.round("ap", R6).alias("ap")))


SQL_MACRO_AP = P.with_ctes(P_MULTILABEL_SQL) + ML_LONG_SQL + """
, sc AS (SELECT cls, s, sum(y) AS tp, count(*) AS nn FROM lg GROUP BY cls, s)
, cum AS (SELECT *, sum(tp) OVER (PARTITION BY cls ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS ctp,
                 sum(nn) OVER (PARTITION BY cls ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn,
                 sum(tp) OVER (PARTITION BY cls) AS P FROM sc)
, ap AS (SELECT cls, sum(tp / P * ctp / cn) AS ap FROM cum GROUP BY cls)
SELECT CAST(cls AS INTEGER) AS cls, round(ap, 6) AS ap FROM ap
UNION ALL SELECT -1, round(avg(ap), 6) FROM ap"""


def q_macro_auc(spark, sf):
    auc = M.roc_auc(_ml_long(spark, sf), "cls", "y", "s")
    return auc.select("cls", F.round("auc", R6).alias("auc")).unionByName(
        M.macro(auc, "auc", "auc").select(F.lit(-1).alias("cls"), F.round("auc", R6).alias("auc")))


SQL_MACRO_AUC = P.with_ctes(P_MULTILABEL_SQL) + ML_LONG_SQL + """
, sc AS (SELECT cls, s, sum(y) AS tp, count(*) AS nn FROM lg GROUP BY cls, s)
, rk AS (SELECT *, coalesce(sum(nn) OVER (PARTITION BY cls ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sc)
, a AS (SELECT cls, sum(tp * (before + (nn + 1) / 2.0)) AS rs, sum(tp) AS P, sum(nn) AS T FROM rk GROUP BY cls)
, auc AS (SELECT cls, CASE WHEN P > 0 AND T - P > 0 THEN (rs - P * (P + 1) / 2.0) / (P * (T - P)) END AS auc FROM a)
SELECT CAST(cls AS INTEGER) AS cls, round(auc, 6) AS auc FROM auc
UNION ALL SELECT -1, round(avg(auc), 6) FROM auc"""


def q_hit_any(spark, sf):
    return M.hit_any(p_multilabel(spark, sf), "scores", "labels").select(F.round("hit_any", R6).alias("hit_any"))


SQL_HIT_ANY = P.with_ctes(P_MULTILABEL_SQL) + """
SELECT round(avg(CASE WHEN labels[CASE WHEN scores[2] > scores[1] THEN 2 ELSE 1 END] > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS hit_any
FROM p_ml"""


def q_affect_metrics(spark, sf):
    lg = P.p_logits(spark, sf)
    d = lg.select(F.slice("logits", 1, 3).alias("pred"), F.slice("logits", 4, 3).alias("truth"))
    m = M.affect_metrics(d, "pred", "truth")
    return m.select(*[F.round(c, R6).alias(c) for c in m.columns])


SQL_AFFECT_METRICS = P.with_ctes(P.P_LOGITS_SQL) + """
, d AS (SELECT unnest(logits[1:3]) AS p, unnest(logits[4:6]) AS y, unnest(range(0, 3)) AS dim FROM p_logits)
, per AS (SELECT dim, avg((p - y) * (p - y)) AS mse, corr(p, y) AS r, 1 - avg((p - y) * (p - y)) / var_pop(y) AS r2
          FROM d GROUP BY dim)
SELECT round(avg(mse), 6) AS mean_mse, round(avg(r), 6) AS mean_pearson_r, round(avg(r2), 6) AS r2_uniform FROM per"""


QUERIES = {
    "vector_scaler": (q_vector_scaler, SQL_VECTOR_SCALER),
    "scaled_vectors": (q_scaled_vectors, SQL_SCALED_VECTORS),
    "l2_normalize": (q_l2_normalize, SQL_L2_NORMALIZE),
    "class_prototypes": (q_class_prototypes, SQL_CLASS_PROTOTYPES),
    "temporal_mean": (q_temporal_mean, SQL_TEMPORAL_MEAN),
    "zero_shot_top5": (q_zero_shot_top5, SQL_ZERO_SHOT_TOP5),
    "subword_pooling": (q_subword_pooling, SQL_SUBWORD_POOLING),
    "topk_accuracy": (q_topk_accuracy, SQL_TOPK_ACCURACY),
    "zero_shot_f1": (q_zero_shot_f1, SQL_ZERO_SHOT_F1),
    "softmax_logits": (q_softmax_logits, SQL_SOFTMAX_LOGITS),
    "prompt_grid": (q_prompt_grid, SQL_PROMPT_GRID),
    "macro_ap": (q_macro_ap, SQL_MACRO_AP),
    "macro_auc": (q_macro_auc, SQL_MACRO_AUC),
    "hit_any": (q_hit_any, SQL_HIT_ANY),
    "affect_metrics": (q_affect_metrics, SQL_AFFECT_METRICS),
}
