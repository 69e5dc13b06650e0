"""Registered queries for the expression predictor: routing, translation
post-editing, score post-processing and metrics.  Each entry is
``name -> (spark_fn(spark, sf_dir) -> DataFrame, duckdb_sql | None)``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators import scoring as S
from ..operators.quantiles import exact_quantile
from ..operators.regressor import Regressor
from ..session import read_table
from . import proxies as P

R6 = 6  # decimals kept for floating results compared across engines

PY_WORDS_SQL = "list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')"


def _words_sql(t: str) -> str:
    return PY_WORDS_SQL.format(t=t)


# ---------------------------------------------------------------- routing
def q_expression_routes(spark, sf):
    e = P.p_expr(spark, sf).dropna(subset=["text"])
    return e.select("id", T.n_words("text").alias("n_words"), T.is_multiword("text").alias("is_multiword"),
                    T.is_sentence("text").alias("is_sentence"), T.model_used("text").alias("Model_Used"))


SQL_EXPRESSION_ROUTES = P.with_ctes(P.P_EXPR_SQL) + f"""
, w AS (SELECT id, CAST(len({_words_sql('text')}) AS INTEGER) AS n FROM p_expr WHERE text IS NOT NULL)
SELECT id, n AS n_words, n > 1 AS is_multiword, n > 8 AS is_sentence,
       CASE WHEN n > 8 THEN 'Sentence' WHEN n > 1 THEN 'Multiword' ELSE 'Single-word' END AS Model_Used
FROM w"""


def q_route_counts(spark, sf):
    return S.route_counts(q_expression_routes(spark, sf), "Model_Used")


SQL_ROUTE_COUNTS = f"""SELECT Model_Used, CAST(count(*) AS BIGINT) AS n_rows FROM ({SQL_EXPRESSION_ROUTES}) GROUP BY 1"""


# ---------------------------------------------------------------- translation post-editing
def q_clean_translation(spark, sf):
    e = P.p_expr(spark, sf).dropna(subset=["text"])
    e = e.select("id", "text", T.clean_translation("text").alias("cleaned"))
    return e.select("id", T.before_ellipsis("text").alias("head"), "cleaned",
                    T.translation_audit("cleaned", "text").alias("warning"))


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _strip_chars_sql(x: str, cls: str) -> str:
    return f"regexp_replace({x}, '^{cls}+|{cls}+$', '', 'g')"


def _clean_sql(t: str) -> str:
    first = (f"list_filter(list_transform(string_split({t}, '...'), lambda p: {_strip_sql('p')}), "
             f"lambda p: p <> '')[1]")
    s = f"CASE WHEN contains({t}, '...') AND {first} IS NOT NULL THEN {first} ELSE {t} END"
    for sep in [",", "–", "-"]:
        s = f"array_to_string(list_transform(string_split({s}, '{sep}'), lambda p: {_strip_sql('p')}), ' ')"
    part = _strip_chars_sql(_strip_sql("p"), "[.,;]")
    s = f"lower(coalesce(list_filter(list_transform(string_split({s}, 'and'), lambda p: {part}), lambda p: p <> '')[1], {s}))"
    for sub in ["the ", " the", "a ", " a", "an ", " an", "to ", " to"]:
        s = f"replace({s}, '{sub}', '')"
    return _strip_sql(_strip_chars_sql(s, "[.,;:\\-–—()\\[\\]{}]"))


SQL_CLEAN_TRANSLATION = P.with_ctes(P.P_EXPR_SQL) + f"""
, c AS (SELECT id, text, split_part(text, '...', 1) AS head, {_clean_sql('text')} AS cleaned
        FROM p_expr WHERE text IS NOT NULL)
SELECT id, head, cleaned,
       CASE WHEN {_strip_sql('cleaned')} = '' THEN 'empty'
            WHEN lower(cleaned) = lower(text) THEN 'untranslated'
            WHEN len({_words_sql('cleaned')}) > 3 THEN 'long' END AS warning
FROM c"""



def q_translated_expressions(spark, sf):
    """Language routing with the translation hook as a lookup table (UDF-02):
    English rows pass unchanged; other rows take the cleaned translation when
    the table has one (here the whole text of each non-English document stands
    in for the model output); a failed row keeps its text as ``unknown``."""
    from .concreteness import translate
    e = P.p_expr(spark, sf).dropna(subset=["text"])
    docs = read_table(spark, sf, "documents")
    lookup = docs.where(F.col("lang") != "en").select(
        "lang", "text", F.col("text").alias("translation"))
    t = translate(e, "text", "lang", lookup)
    return t.select("id", "Detected_Language", "English_Translation", "was_translated")


SQL_TRANSLATED_EXPRESSIONS = P.with_ctes(P.P_EXPR_SQL) + f"""
, lk AS (SELECT lang, text, min({_clean_sql('text')}) AS tr FROM documents
         WHERE lang <> 'en' GROUP BY lang, text)
, j AS (SELECT e.id, e.text, coalesce(e.lang, 'unknown') AS Detected_Language, lk.tr
        FROM p_expr e LEFT JOIN lk ON lk.lang = coalesce(e.lang, 'unknown') AND lk.text = e.text
        WHERE e.text IS NOT NULL)
SELECT id, CASE WHEN Detected_Language <> 'en' AND tr IS NULL THEN 'unknown' ELSE Detected_Language END AS Detected_Language,
       CASE WHEN Detected_Language = 'en' OR tr IS NULL THEN text ELSE tr END AS English_Translation,
       Detected_Language <> 'en' AND tr IS NOT NULL AS was_translated FROM j"""

# ---------------------------------------------------------------- score post-processing
def q_concreteness_scores(spark, sf):
    s = S.finish_scores(P.p_score(spark, sf), "pred", "route", out="score")
    return s.select("l_orderkey", "l_linenumber", "route", F.round("score", R6).alias("score"))


_FINISH_SQL = """
, c AS (SELECT *, greatest(1.0, least(5.0, pred)) AS p0 FROM p_score)
, s AS (SELECT route, avg(p0) AS mu, stddev_samp(p0) AS sd FROM c GROUP BY route)
, z AS (SELECT c.*, CASE WHEN s.sd IS NULL OR s.sd = 0 THEN 3.0 ELSE (p0 - mu) / sd * 1.0 + 3.0 END AS pz
        FROM c JOIN s USING (route))
, t AS (SELECT quantile_cont(pz, 0.9) AS t FROM z)
, fin AS (SELECT z.*, greatest(1.0, least(5.0,
            CASE WHEN t.t >= 5 THEN pz WHEN pz > t.t THEN pz * (1 - 0.1 * (pz - t.t) / (5 - t.t)) ELSE pz END)) AS score
          FROM z, t)"""

SQL_CONCRETENESS_SCORES = P.with_ctes(P.P_SCORE_SQL) + _FINISH_SQL + """
SELECT l_orderkey, l_linenumber, route, round(score, 6) AS score FROM fin"""


def q_znorm_routes(spark, sf):
    z = S.znorm(P.p_score(spark, sf), "pred", by=["route"], out="z", fixed_groups=True)
    return z.select("l_orderkey", "l_linenumber", "route", F.round("z", R6).alias("z"), "norm_degenerate")


SQL_ZNORM_ROUTES = P.with_ctes(P.P_SCORE_SQL) + """
, s AS (SELECT route, avg(pred) AS mu, stddev_samp(pred) AS sd FROM p_score GROUP BY route)
SELECT l_orderkey, l_linenumber, route,
       round(CASE WHEN sd IS NULL OR sd = 0 THEN 3.0 ELSE (pred - mu) / sd * 1.0 + 3.0 END, 6) AS z,
       (sd IS NULL OR sd = 0) AS norm_degenerate
FROM p_score JOIN s USING (route)"""


def q_p90(spark, sf):
    df = P.p_score(spark, sf)
    t = exact_quantile(df, "pred", 0.9)
    return spark.range(1).select(F.round(F.lit(t), R6).alias("p90"))


SQL_P90 = P.with_ctes(P.P_SCORE_SQL) + "SELECT round(quantile_cont(pred, 0.9), 6) AS p90 FROM p_score"


def q_smooth_tail(spark, sf):
    df = S.smooth_tail(P.p_score(spark, sf), "pred", out="smoothed")
    return df.select("l_orderkey", "l_linenumber", F.round("smoothed", R6).alias("smoothed"))


SQL_SMOOTH_TAIL = P.with_ctes(P.P_SCORE_SQL) + """
, t AS (SELECT quantile_cont(pred, 0.9) AS t FROM p_score)
SELECT l_orderkey, l_linenumber,
       round(CASE WHEN t.t >= 5 THEN pred WHEN pred > t.t THEN pred * (1 - 0.1 * (pred - t.t) / (5 - t.t))
                  ELSE pred END, 6) AS smoothed
FROM p_score, t"""


def q_score_summary(spark, sf):
    s = S.summary(q_concreteness_scores(spark, sf), "score")
    return s.select(*[F.round(c, R6).alias(c) if c != "n_scored" else F.col(c) for c in s.columns])


SQL_SCORE_SUMMARY = P.with_ctes(P.P_SCORE_SQL) + _FINISH_SQL + """
, r AS (SELECT round(score, 6) AS score FROM fin)
SELECT round(min(score), 6) AS min_score, round(max(score), 6) AS max_score,
       round(avg(score), 6) AS mean_score, CAST(count(score) AS BIGINT) AS n_scored FROM r"""


def q_regression_metrics(spark, sf):
    s = S.finish_scores(P.p_score(spark, sf), "pred", "route", out="score")
    m = M.regression_metrics(s, "score", "truth", max_r2=0.8)
    return m.select(*[F.round(c, R6).alias(c) if c not in ("n", "n_dropped") else F.col(c) for c in m.columns])


SQL_REGRESSION_METRICS = P.with_ctes(P.P_SCORE_SQL) + _FINISH_SQL + """
, m AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_dropped, avg(pow(score - truth, 2)) AS mse,
               avg(abs(score - truth)) AS mae, var_pop(truth) AS vy, corr(score, truth) AS r FROM fin)
SELECT n, n_dropped, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae,
       round(1 - mse / vy, 6) AS r2, round(r, 6) AS pearson_r, round((1 - mse / vy) / 0.8 * 100, 6) AS r2_share
FROM m"""


def q_residual_histogram(spark, sf):
    s = S.finish_scores(P.p_score(spark, sf), "pred", "route", out="score")
    h = M.histogram(M.residuals(s, "score", "truth"), "residual", 15)
    return h.select("bin", F.round("lo", R6).alias("lo"), F.round("hi", R6).alias("hi"), "n")


SQL_RESIDUAL_HISTOGRAM = P.with_ctes(P.P_SCORE_SQL) + _FINISH_SQL + """
, r AS (SELECT score - truth AS x FROM fin)
, st AS (SELECT min(x) AS mn, max(x) AS mx FROM r)
, b AS (SELECT CAST(least(14, CASE WHEN mx = mn THEN 0 ELSE floor((x - mn) * 15.0 / (mx - mn)) END) AS INTEGER) AS bin
        FROM r, st)
, g AS (SELECT CAST(i AS INTEGER) AS bin, mn + i * (mx - mn) / 15 AS lo, mn + (i + 1) * (mx - mn) / 15 AS hi
        FROM st, range(15) t(i))
SELECT g.bin, round(lo, 6) AS lo, round(hi, 6) AS hi, CAST(count(b.bin) AS BIGINT) AS n
FROM g LEFT JOIN b ON g.bin = b.bin GROUP BY g.bin, lo, hi"""


def q_truth_density(spark, sf):
    d = M.density(P.p_score(spark, sf), "truth", 200)
    return d.select(F.col("i").cast("int").alias("i"), F.round("x", R6).alias("x"),
                    F.round("density", R6).alias("density"))


SQL_TRUTH_DENSITY = P.with_ctes(P.P_SCORE_SQL) + """
, st AS (SELECT count(truth) AS n, stddev_samp(truth) AS sd, min(truth) AS mn, max(truth) AS mx FROM p_score)
, bw AS (SELECT n, mn, mx, sd * pow(CAST(n AS double), -0.2) AS bw FROM st)
, g AS (SELECT CAST(i AS INTEGER) AS i, mn - 3.0 * bw + i * ((mx - mn + 6.0 * bw) / 199) AS x, n, bw
        FROM bw, range(200) t(i))
SELECT i, round(x, 6) AS x,
       round(sum(exp(-0.5 * pow((x - truth) / bw, 2))) / (n * bw * sqrt(2 * pi())), 6) AS density
FROM g, p_score GROUP BY i, x, n, bw"""


def q_residuals(spark, sf):
    s = S.finish_scores(P.p_score(spark, sf), "pred", "route", out="score")
    return M.residuals(s, "score", "truth").select(
        "l_orderkey", "l_linenumber", F.round("residual", R6).alias("residual"))


SQL_RESIDUALS = P.with_ctes(P.P_SCORE_SQL) + _FINISH_SQL + """
SELECT l_orderkey, l_linenumber, round(score - truth, 6) AS residual FROM fin"""


# ---------------------------------------------------------------- sentence path (per-word scores)
def word_score(w):
    """Stand-in per-word score on the 1..5 scale (monotone in word length)."""
    return F.lit(1.0) + F.lit(4.0) * (F.lit(1.0) - F.exp(-F.length(w) / F.lit(4.0)))


def q_sentence_mean(spark, sf):
    docs = read_table(spark, sf, "documents", spread_rows=True).select("doc_id", "text")
    # one pass over the text: the score array is materialised, then summarised
    docs = docs.select("doc_id", F.transform(T.words("text"), lambda w: word_score(w)).alias("_s"))
    scores = F.col("_s")
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, b: a + b) / n
    return docs.select(
        "doc_id", n.alias("n_words"),
        F.round(F.when(n > 0, mean).otherwise(F.lit(3.0)), R6).alias("sentence_score"),
        F.when(n > 0, T.format_scores(scores)).otherwise(F.lit("3.0")).alias("per_word"))


SQL_SENTENCE_MEAN = f"""
WITH w AS (SELECT doc_id, list_transform({_words_sql('text')},
                  lambda w: 1.0 + 4.0 * (1.0 - exp(-length(w) / 4.0))) AS s FROM documents)
SELECT doc_id, CAST(len(s) AS INTEGER) AS n_words,
       round(CASE WHEN len(s) > 0 THEN list_sum(s) / len(s) ELSE 3.0 END, 6) AS sentence_score,
       CASE WHEN len(s) > 0 THEN array_to_string(list_transform(s, lambda x: printf('%.2f', x)), ';')
            ELSE '3.0' END AS per_word
FROM w"""


def q_expression_predictions(spark, sf):
    """The flagship end to end on the expression proxy (nation, part and
    document texts): routing, distinct-text encoders, per-route regressors,
    sentence word scores, normalisation and tail smoothing.  Hashing encoders
    and a fixed-weight network have no SQL twin: rows-only check."""
    from .concreteness import OUTPUT_COLUMNS, flagship
    return flagship(spark, sf).select("id", *OUTPUT_COLUMNS)


class CountingEncoder:
    """Two numbers per text: its length against ``cap`` and its share of
    ``letter``; DuckDB can compute both."""
    dim = 2

    def __init__(self, cap: int, letter: str):
        self.cap, self.letter = cap, letter

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([[min(len(t), self.cap) / self.cap, t.count(self.letter) / (len(t) + 1)] for t in texts], float).reshape(-1, 2)


def _linear_network(bias: float, weights: list[float]) -> Regressor:
    """A regressor whose output on non-negative inputs is
    ``bias + sum(weights * inputs)`` (non-negative weights)."""
    net = Regressor.init(len(weights))
    p = {k: np.zeros_like(v) for k, v in net.params.items()}
    p["scale_sd"] += 1
    for i, w in enumerate(weights):
        p["w1"][i, i], p["w2"][i, 0] = 1.0, w
    p["w3"][0, 0], p["b3"][0] = 1.0, bias
    return Regressor(p)


# inputs: base length, base letter share, affect length, affect letter share
SINGLE_NET = (1.2, [3.0, 2.0, 0.7, 4.0])
MULTI_NET = (1.0, [4.5, 1.0, 0.2, 2.0])


def q_expression_scores(spark, sf):
    """The flagship plan end to end on the expression proxy (routes, lookup
    with the failure rule, word scores given their sentence, normalisation,
    tail smoothing) with counting encoders and a network that DuckDB can
    recompute.  The lookup has no translations from one language."""
    from .concreteness import TextEmbedder, predict_expressions
    docs = read_table(spark, sf, "documents")
    lookup = docs.where(~F.col("lang").isin("en", UNSERVED_LANGUAGE)).select("lang", "text", F.col("text").alias("translation"))
    out = predict_expressions(
        P.p_expr(spark, sf), "id", "text", "lang", single_model=_linear_network(*SINGLE_NET), multi_model=_linear_network(*MULTI_NET),
        embedder=TextEmbedder(CountingEncoder(24, "e"), CountingEncoder(600, "a")), lookup=lookup)
    return out.select("id", "Detected_Language", "Model_Used", "Is_Multiword", "Is_Sentence",
                      F.round("Predicted_Concreteness", R6).alias("score"),
                      F.size(F.split("Per_Word_Predictions", ";")).alias("n_word_scores"))


UNSERVED_LANGUAGE = "de"


def _net_sql(net, base: str, affect: str) -> str:
    def two(t, cap, letter):
        return [f"least(length({t}), {cap}) / {cap}.0", f"(length({t}) - length(replace({t}, '{letter}', ''))) / (length({t}) + 1.0)"]
    terms = [f"{w} * ({x})" for w, x in zip(net[1], two(base, 24, "e") + two(affect, 600, "a"))]
    return f"greatest(1.0, least(5.0, CAST({net[0]} + {' + '.join(terms)} AS DOUBLE)))"


SQL_EXPRESSION_SCORES = P.with_ctes(P.P_EXPR_SQL) + f"""
, lk AS (SELECT lang, text, min({_clean_sql('text')}) AS tr FROM documents
         WHERE lang NOT IN ('en', '{UNSERVED_LANGUAGE}') GROUP BY lang, text)
, j AS (SELECT e.id, coalesce(e.lang, 'unknown') AS lang, lk.tr,
               CASE WHEN coalesce(e.lang, 'unknown') = 'en' OR lk.tr IS NULL THEN e.text ELSE lk.tr END AS t
        FROM p_expr e LEFT JOIN lk ON lk.lang = coalesce(e.lang, 'unknown') AND lk.text = e.text WHERE e.text IS NOT NULL)
, b AS (SELECT id, CASE WHEN lang <> 'en' AND tr IS NULL THEN 'unknown' ELSE lang END AS Detected_Language, t,
               {_words_sql('t')} AS ws FROM j)
, r AS (SELECT *, CASE WHEN len(ws) > 8 THEN 'Sentence' WHEN len(ws) > 1 THEN 'Multiword' ELSE 'Single-word' END AS Model_Used FROM b)
, ph AS (SELECT id, Model_Used, CASE WHEN Model_Used = 'Single-word' THEN {_net_sql(SINGLE_NET, 't', 't')}
                                     ELSE {_net_sql(MULTI_NET, 't', 't')} END AS p FROM r WHERE Model_Used <> 'Sentence')
, st AS (SELECT Model_Used, avg(p) AS mu, stddev_samp(p) AS sd FROM ph GROUP BY 1)
, w AS (SELECT id, t, unnest(ws) AS word FROM r WHERE Model_Used = 'Sentence')
, wp AS (SELECT id, {_net_sql(SINGLE_NET, 'word', 't')} AS p FROM w)
, ws AS (SELECT avg(p) AS mu, stddev_samp(p) AS sd FROM wp)
, z AS (SELECT id, CASE WHEN sd IS NULL OR sd = 0 THEN 3.0 ELSE (p - mu) / sd + 3.0 END AS p FROM ph JOIN st USING (Model_Used)
        UNION ALL SELECT id, avg(CASE WHEN sd IS NULL OR sd = 0 THEN 3.0 ELSE (p - mu) / sd + 3.0 END) FROM wp, ws GROUP BY id)
, q AS (SELECT quantile_cont(p, 0.9) AS t FROM z)
SELECT r.id, Detected_Language, Model_Used, len(ws) > 1 AS Is_Multiword, len(ws) > 8 AS Is_Sentence,
       round(greatest(1.0, least(5.0, CASE WHEN q.t >= 5 THEN z.p WHEN z.p > q.t THEN z.p * (1 - 0.1 * (z.p - q.t) / (5 - q.t)) ELSE z.p END)), 6) AS score,
       CAST(CASE WHEN Model_Used = 'Sentence' THEN len(ws) ELSE 1 END AS INTEGER) AS n_word_scores
FROM r JOIN z USING (id), q"""


QUERIES = {
    "expression_predictions": (q_expression_predictions, None),
    "expression_scores": (q_expression_scores, SQL_EXPRESSION_SCORES),
    "expression_routes": (q_expression_routes, SQL_EXPRESSION_ROUTES),
    "route_counts": (q_route_counts, SQL_ROUTE_COUNTS),
    "clean_translation": (q_clean_translation, SQL_CLEAN_TRANSLATION),
    "translated_expressions": (q_translated_expressions, SQL_TRANSLATED_EXPRESSIONS),
    "concreteness_scores": (q_concreteness_scores, SQL_CONCRETENESS_SCORES),
    "znorm_routes": (q_znorm_routes, SQL_ZNORM_ROUTES),
    "p90": (q_p90, SQL_P90),
    "smooth_tail": (q_smooth_tail, SQL_SMOOTH_TAIL),
    "score_summary": (q_score_summary, SQL_SCORE_SUMMARY),
    "regression_metrics": (q_regression_metrics, SQL_REGRESSION_METRICS),
    "residual_histogram": (q_residual_histogram, SQL_RESIDUAL_HISTOGRAM),
    "truth_density": (q_truth_density, SQL_TRUTH_DENSITY),
    "residuals": (q_residuals, SQL_RESIDUALS),
    "sentence_mean": (q_sentence_mean, SQL_SENTENCE_MEAN),
}
