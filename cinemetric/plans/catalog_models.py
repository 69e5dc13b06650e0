"""Registered queries that fit models (MLlib probes, the ReLU regressor) or
select prompt templates.  Where another solver can be written in SQL (normal
equations, Newton's method, the selection unrolled) it is the twin; the others
are checked by tests against closed forms and invariants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.encoders import HashingEncoder, encode_column
from ..operators import linear as L
from ..operators import metrics as M
from ..operators import regressor as RG
from ..session import read_table, scratch_path, spread_by_rows
from . import proxies as P
from .zero_shot import select_templates, zero_shot_accuracy

R6 = 6
TEMPLATES = ["a photo of a {}.", "a bad photo of the {}.", "an image of {}.", "a {} in a shop.",
             "itap of a {}."]


def _probe_data(spark, sf):
    v = P.p_vec(spark, sf).withColumn("embedding", V.l2_normalize("embedding"))
    return v.where(~F.col("is_test")), v.where("is_test")


def q_linear_probe_multiclass(spark, sf):
    train, test = _probe_data(spark, sf)
    res = L.logistic_scores(train, test, "embedding", "label", L.LOGISTIC_C["single_label"], keys=["vec_id"])
    f1 = M.weighted_f1(res, "label", "pred")
    return f1.select(F.round("weighted_f1", R6).alias("weighted_f1"), F.round("accuracy", R6).alias("accuracy"))


def q_linear_probe_multilabel(spark, sf):
    train, test = _probe_data(spark, sf)
    add = lambda d: d.withColumn("y_low", (F.col("label") < 5).cast("int")) \
        .withColumn("y_even", (F.col("label") % 2 == 0).cast("int"))
    long = L.one_vs_rest_scores(add(train), add(test), "embedding", ["y_low", "y_even"],
                                L.LOGISTIC_C["multi_label"], keys=["vec_id"])
    ap = M.macro(M.average_precision(long, "cls", "y", "score"), "ap", "macro_ap")
    auc = M.macro(M.roc_auc(long, "cls", "y", "score"), "auc", "macro_auc")
    return (ap.select(F.lit("macro_ap").alias("metric"), F.round("macro_ap", R6).alias("value"))
            .unionByName(auc.select(F.lit("macro_auc").alias("metric"), F.round("macro_auc", R6).alias("value"))))


def q_ridge_probe(spark, sf):
    train, test = _probe_data(spark, sf)
    tg = lambda d: d.withColumn("t0", F.col("label").cast("double")) \
        .withColumn("t1", F.aggregate(F.slice("embedding", 1, 4), F.lit(0.0), lambda a, x: a + x)) \
        .withColumn("t2", F.element_at("embedding", 11) * 10)
    pr = L.ridge_predict(tg(train), tg(test), "embedding", ["t0", "t1", "t2"], keys=["vec_id"])
    arr = pr.select(F.array("pred_t0", "pred_t1", "pred_t2").alias("p"), F.array("t0", "t1", "t2").alias("y"))
    m = M.affect_metrics(arr, "p", "y")
    return m.select(*[F.round(c, R6).alias(c) for c in m.columns])


_PROBE_SQL = P.with_ctes(P.P_VEC_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + """
, v AS (SELECT vec_id, is_test, label, CAST(list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS DOUBLE[]) AS e
        FROM (SELECT vec_id, is_test, label, CAST(embedding AS DOUBLE[]) AS embedding FROM p_vec))"""


def _solve_sql(name: str, system: str) -> str:
    """Gauss-Jordan elimination: ``system`` has one row ``m``, the rows of a
    square matrix with the right-hand sides behind; ``name`` gets the solved one."""
    return f"""
, {name}_step(k, m) AS (SELECT 1, m FROM {system} UNION ALL
    SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda x: x / m[k][k])
        ELSE list_transform(row, lambda x, j: x - row[k] / m[k][k] * m[k][j]) END) FROM {name}_step WHERE k <= len(m))
, {name} AS (SELECT m FROM {name}_step ORDER BY k DESC LIMIT 1)"""


def _ridge_sql() -> str:
    """Ridge by its normal equations on centred columns."""
    targets = ["label", "list_sum(e[1:4])", "e[11] * 10"]
    return _PROBE_SQL + f"""
, t AS (SELECT vec_id, is_test, e, [{', '.join(f'CAST({x} AS DOUBLE)' for x in targets)}] AS y FROM v)
, x AS (SELECT vec_id, generate_subscripts(f, 1) AS i, unnest(f) AS x FROM (SELECT vec_id, list_concat(e, y) AS f FROM t WHERE NOT is_test))
, mu AS (SELECT i, avg(x) AS mu FROM x GROUP BY i)
, c AS MATERIALIZED (SELECT vec_id, i, x - mu AS x FROM x JOIN mu USING (i))
, d AS (SELECT len(any_value(e)) AS d FROM t)
, g AS (SELECT a.i, b.i AS j, sum(a.x * b.x) + CASE WHEN a.i = b.i THEN {L.RIDGE_ALPHA} ELSE 0 END AS g FROM c a JOIN c b USING (vec_id) WHERE a.i <= (SELECT d FROM d) GROUP BY a.i, b.i)
, s AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(g ORDER BY j) AS r FROM g GROUP BY i))""" + _solve_sql("w", "s") + f"""
, p AS (SELECT vec_id, y, list_transform(range(1, {len(targets) + 1}), lambda o: q[d + o]
               + list_sum(list_transform(e, lambda x, i: (x - q[i]) * m[i][d + o]))) AS p
        FROM t, w, d, (SELECT list(mu ORDER BY i) AS q FROM mu) WHERE is_test)
, z AS (SELECT unnest(p) AS p, unnest(y) AS y, generate_subscripts(y, 1) AS dim FROM p)
, per AS (SELECT dim, avg((p - y) * (p - y)) AS mse, corr(p, y) AS r, 1 - avg((p - y) * (p - y)) / var_pop(y) AS r2 FROM z GROUP BY dim)
SELECT round(avg(mse), 6) AS mean_mse, round(avg(r), 6) AS mean_pearson_r, round(avg(r2), 6) AS r2_uniform FROM per"""


NEWTON_STEPS = 9


def _multilabel_sql() -> str:
    """One logistic fit per label by Newton's method, then the macro means."""
    out = _PROBE_SQL + """
, a AS MATERIALIZED (SELECT vec_id, is_test, list_append(e, 1.0) AS x, label FROM v)
, long AS MATERIALIZED (SELECT vec_id, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM a WHERE NOT is_test)
, d AS (SELECT len(any_value(x)) AS d FROM a)"""
    penalty = 1.0 / L.LOGISTIC_C["multi_label"]
    scores = []
    for no, label in enumerate(["label < 5", "label % 2 = 0"]):
        out += f"\n, w{no}_0 AS (SELECT list_transform(range(0, d), lambda i: 0.0::DOUBLE) AS w FROM d)"
        for t in range(NEWTON_STEPS):
            now, s = f"w{no}_{t}", f"{no}_{t}"
            out += f"""
, p{s} AS MATERIALIZED (SELECT vec_id, 1 / (1 + exp(-list_dot_product(x, w))) AS p, CASE WHEN {label} THEN 1.0 ELSE 0.0 END AS y FROM a, {now} WHERE NOT is_test)
, h{s} AS (SELECT l.i, r.i AS j, sum(l.x * r.x * p * (1 - p)) + CASE WHEN l.i = r.i AND l.i < d THEN {penalty} ELSE 0 END AS h FROM long l JOIN long r USING (vec_id) JOIN p{s} USING (vec_id), d GROUP BY l.i, r.i, d)
, f{s} AS (SELECT i, sum(x * (p - y)) + CASE WHEN i < d THEN {penalty} * any_value(w)[i] ELSE 0 END AS f FROM long JOIN p{s} USING (vec_id), d, {now} GROUP BY i, d)
, s{s} AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list_append(list(h ORDER BY j), any_value(f)) AS r FROM h{s} JOIN f{s} USING (i) GROUP BY i))""" + _solve_sql(f"n{s}", f"s{s}") + f"""
, w{no}_{t + 1} AS (SELECT list_transform(w, lambda x, i: x - m[i][len(w) + 1]) AS w FROM {now}, n{s})"""
        scores.append(f"SELECT {no} AS cls, CASE WHEN {label} THEN 1 ELSE 0 END AS y, round(list_dot_product(x, w), 12) AS s FROM a, w{no}_{NEWTON_STEPS} WHERE is_test")
    return out + f"""
, lg AS ({' UNION ALL '.join(scores)})
, sc AS (SELECT cls, s, sum(y) AS tp, count(*) AS nn FROM lg GROUP BY cls, s)
, cum AS (SELECT *, sum(tp) OVER (PARTITION BY cls ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS ctp, sum(nn) OVER (PARTITION BY cls ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn,
                 sum(tp) OVER (PARTITION BY cls) AS P, coalesce(sum(nn) OVER (PARTITION BY cls ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sc)
, ap AS (SELECT cls, sum(tp / P * ctp / cn) AS ap, (sum(tp * (before + (nn + 1) / 2.0)) - sum(tp) * (sum(tp) + 1) / 2.0) / (sum(tp) * (sum(nn) - sum(tp))) AS auc FROM cum GROUP BY cls)
SELECT 'macro_ap' AS metric, round(avg(ap), 6) AS value FROM ap UNION ALL SELECT 'macro_auc', round(avg(auc), 6) FROM ap"""


SMALL_DIMS, SMALL_CLASSES = 8, 3


def q_linear_probe_probabilities(spark, sf):
    """Multinomial fit on the first components and three classes: the
    probabilities of every test vector (ML-04)."""
    small = lambda d: d.select("vec_id", F.slice("embedding", 1, SMALL_DIMS).alias("x"), (F.col("label") % SMALL_CLASSES).alias("y"))
    train, test = (small(d) for d in _probe_data(spark, sf))
    res = L.logistic_scores(train, test, "x", "y", L.LOGISTIC_C["large"], keys=["vec_id"])
    return res.select("vec_id", "pred", *[F.round(F.col("probs")[i], 5).alias(f"p{i}") for i in range(SMALL_CLASSES)])


def _multinomial_sql() -> str:
    """Newton's method on all weights at once; the last class's intercept is 0."""
    k, d = SMALL_CLASSES, SMALL_DIMS + 1
    penalty = 1.0 / L.LOGISTIC_C["large"]
    out = _PROBE_SQL + f"""
, a AS MATERIALIZED (SELECT vec_id AS r, is_test, list_append(e[1:{SMALL_DIMS}], 1.0) AS x, label % {k} AS y FROM v)
, q AS (SELECT c, i, (c - 1) * {d} + i AS n FROM (SELECT unnest(range(1, {k + 1})) AS c), (SELECT unnest(range(1, {d + 1})) AS i) WHERE (c - 1) * {d} + i < {k * d})
, f AS MATERIALIZED (SELECT r, n, c, i, x[i] AS x, CASE WHEN y + 1 = c THEN 1.0 ELSE 0.0 END AS y FROM a, q WHERE NOT is_test)
, w0 AS (SELECT list_transform(range(0, {k * d}), lambda i: 0.0::DOUBLE) AS w)"""
    for t in range(NEWTON_STEPS):
        parts = ", ".join(f"exp(list_dot_product(x, w[{c * d + 1}:{c * d + d}]))" for c in range(k))
        out += f"""
, e{t} AS MATERIALIZED (SELECT r, list_transform(z, lambda v: v / list_sum(z)) AS p FROM (SELECT r, [{parts}] AS z FROM a, w{t} WHERE NOT is_test))
, h{t} AS (SELECT u.n AS i, o.n AS j, sum(u.x * o.x * p[u.c] * (CASE WHEN u.c = o.c THEN 1 ELSE 0 END - p[o.c])) + CASE WHEN u.n = o.n AND u.i < {d} THEN {penalty} ELSE 0 END AS h
      FROM f u JOIN f o USING (r) JOIN e{t} USING (r) GROUP BY u.n, o.n, u.i)
, g{t} AS (SELECT n AS i, sum(x * (p[c] - y)) + CASE WHEN f.i < {d} THEN {penalty} * any_value(w)[n] ELSE 0 END AS g FROM f JOIN e{t} USING (r), w{t} GROUP BY n, f.i)
, s{t} AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, list_append(list(h ORDER BY j), any_value(g)) AS m FROM h{t} JOIN g{t} USING (i) GROUP BY i))""" + _solve_sql(f"n{t}", f"s{t}") + f"""
, w{t + 1} AS (SELECT list_transform(w, lambda x, i: CASE WHEN i <= len(m) THEN x - m[i][len(m) + 1] ELSE 0 END) AS w FROM w{t}, n{t})"""
    parts = ", ".join(f"exp(list_dot_product(x, w[{c * d + 1}:{c * d + d}]))" for c in range(k))
    return out + f"""
, z AS (SELECT r, list_transform(z, lambda v: v / list_sum(z)) AS p FROM (SELECT r, [{parts}] AS z FROM a, w{NEWTON_STEPS} WHERE is_test))
SELECT r AS vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred, {', '.join(f'round(p[{c + 1}], 5) AS p{c}' for c in range(k))} FROM z"""


def q_regressor_fit(spark, sf):
    """Fit the ReLU regressor on two united labelled lists (part names rated by
    price, nation names by region) until the loss of a held-out fifth has not
    fallen for five epochs; one row per epoch with that loss."""
    part, nation = read_table(spark, sf, "part"), read_table(spark, sf, "nation")
    rating = F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.lit(1.0) + F.lit(4.0) * (F.col("p_retailprice") - 900) / 1200))
    both = RG.unite(part.select(F.col("p_name").alias("text"), rating.alias("rating")),
                    nation.select(F.col("n_name").alias("text"), (F.col("n_regionkey") + 1).alias("rating")))
    both = spread_by_rows(both)          # texts are dealt, not vectors
    data = both.select(encode_column("text", HashingEncoder(32, seed=5)).alias("x"), "rating", (F.crc32("text") % 5 == 0).alias("held"))
    _model, losses = RG.fit(data, "x", "rating", seed=1, lr=5e-3, max_epochs=20, held_out=F.col("held"))
    return spark.createDataFrame([(i + 1, float(l)) for i, l in enumerate(losses)], "epoch int, loss double")


def formula_model(dim: int) -> RG.Regressor:
    """A regressor whose weights DuckDB can compute: sines of the position."""
    def wave(rows, cols, a, b):
        i, j = np.arange(1, rows + 1)[:, None], np.arange(1, cols + 1)[None, :]
        return np.sin(a * i + b * j) / np.sqrt(rows)
    h1, h2 = RG.HIDDEN
    return RG.Regressor({"scale_mean": np.zeros(dim), "scale_sd": np.ones(dim), "w1": wave(dim, h1, 1.3, 0.7), "b1": wave(1, h1, 0.0, 0.9)[0],
                         "w2": wave(h1, h2, 0.8, 1.9), "b2": wave(1, h2, 0.0, 1.1)[0], "w3": wave(h2, 1, 2.3, 0.0), "b3": np.array([0.5])})


def q_regressor_gradient(spark, sf):
    """One training step's gradient over all vectors (ML-02): per weight array
    and output unit the sum of the gradient and its sum weighted by the input's
    position, and the mean loss."""
    v = P.p_vec(spark, sf).select(F.transform("embedding", lambda x: x.cast("double") * 8).alias("x"), (F.col("label") / 2.0).alias("y"))
    dim = len(v.first()["x"])
    g, loss, n = RG.gradient(v, formula_model(dim))
    rows = [("loss", 0, float(loss), float(n))]
    for k in RG.WEIGHTS:
        a = g[k].reshape(-1, g[k].shape[-1]) if g[k].ndim == 2 else g[k][None, :]
        for j in range(a.shape[1]):
            rows.append((k, j + 1, float(a[:, j].sum()), float((a[:, j] * np.arange(1, len(a) + 1)).sum())))
    out = spark.createDataFrame(rows, "weights string, unit int, total double, weighted double")
    return out.select("weights", "unit", F.round("total", R6).alias("total"), F.round("weighted", R6).alias("weighted"))


def q_regressor_weights(spark, sf):
    """Regressor weights saved and loaded again: the loaded model's score of
    every vector (SNK-10, ML-01)."""
    v = P.p_vec(spark, sf).select("vec_id", F.transform("embedding", lambda x: x * 8).alias("x"))
    path = scratch_path(spark, "weights")
    formula_model(len(v.first()["x"])).save(spark, path)
    again = RG.Regressor.load(spark, path)
    return v.select("vec_id", F.round(RG.predict_column("x", again, spark), R6).alias("score"))


def _forward_sql() -> str:
    """Tables x, w1, w2, a1, a2 and o: the formula model's layers per vector."""
    h1, h2 = RG.HIDDEN
    return P.with_ctes(P.P_VEC_SQL) + f"""
, x AS (SELECT vec_id AS r, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) * 8 AS x FROM p_vec)
, d AS (SELECT max(i) AS d FROM x)
, w1 AS (SELECT i, j, sin(1.3 * i + 0.7 * j) / sqrt(d) AS w FROM d, (SELECT unnest(range(1, 1025)) AS i), (SELECT unnest(range(1, {h1 + 1})) AS j) WHERE i <= d)
, w2 AS (SELECT j, k, sin(0.8 * j + 1.9 * k) / sqrt({h1}) AS w FROM (SELECT unnest(range(1, {h1 + 1})) AS j), (SELECT unnest(range(1, {h2 + 1})) AS k))
, a1 AS MATERIALIZED (SELECT r, j, sum(x * w) + sin(0.9 * j) AS a FROM x JOIN w1 USING (i) GROUP BY r, j)
, a2 AS MATERIALIZED (SELECT r, k, sum(greatest(a, 0) * w) + sin(1.1 * k) AS a FROM a1 JOIN w2 USING (j) GROUP BY r, k)
, o AS (SELECT r, sum(greatest(a, 0) * sin(2.3 * k) / sqrt({h2})) + 0.5 AS o FROM a2 GROUP BY r)"""


def _gradient_sql() -> str:
    """Forward and backward pass as joins over (row, unit) tables."""
    h2 = RG.HIDDEN[1]
    return _forward_sql() + f"""
, y AS (SELECT vec_id AS r, label / 2.0 AS y, count(*) OVER () AS n FROM p_vec)
, e AS (SELECT r, n, o - y AS e, 2 * (o - y) / n AS g FROM o JOIN y USING (r))
, d2 AS MATERIALIZED (SELECT r, k, CASE WHEN a > 0 THEN g * sin(2.3 * k) / sqrt({h2}) ELSE 0 END AS g FROM a2 JOIN e USING (r))
, d1 AS MATERIALIZED (SELECT r, j, CASE WHEN any_value(a) > 0 THEN sum(g * w) ELSE 0 END AS g FROM d2 JOIN w2 USING (k) JOIN a1 USING (r, j) GROUP BY r, j)
, s1 AS (SELECT r, sum(x) AS x1, sum(x * i) AS xi FROM x GROUP BY r)
, s2 AS (SELECT r, sum(greatest(a, 0)) AS x1, sum(greatest(a, 0) * j) AS xi FROM a1 GROUP BY r)
, u AS (SELECT 'w1' AS weights, j AS unit, sum(g * x1) AS total, sum(g * xi) AS weighted FROM d1 JOIN s1 USING (r) GROUP BY j
        UNION ALL SELECT 'b1', j, sum(g), sum(g) FROM d1 GROUP BY j
        UNION ALL SELECT 'w2', k, sum(g * x1), sum(g * xi) FROM d2 JOIN s2 USING (r) GROUP BY k
        UNION ALL SELECT 'b2', k, sum(g), sum(g) FROM d2 GROUP BY k
        UNION ALL SELECT 'w3', 1, sum(g * greatest(a, 0)), sum(g * greatest(a, 0) * k) FROM a2 JOIN e USING (r)
        UNION ALL SELECT 'b3', 1, sum(g), sum(g) FROM e
        UNION ALL SELECT 'loss', 0, avg(e * e), any_value(n) FROM e)
SELECT weights, CAST(unit AS INTEGER) AS unit, round(total, 6) AS total, round(weighted, 6) AS weighted FROM u"""


def _brand_classes(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    classes = part.select(F.col("p_brand").alias("brand")).distinct() \
        .select("brand", F.array(F.col("brand"), F.lower(F.regexp_replace("brand", "#", " "))).alias("names"))
    items = part.select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("text"), F.col("p_brand").alias("brand"))
    return items, classes


def q_zero_shot_prompts(spark, sf):
    items, classes = _brand_classes(spark, sf)
    acc = zero_shot_accuracy(items, "p_partkey", "text", "brand", classes, "brand", "names", TEMPLATES[:3], PLACES)
    return acc.select(F.round("top1", R6).alias("top1"), F.round("top5", R6).alias("top5"))


class PlaceEncoder:
    """One number per letter, where it stands first in the text (0: nowhere),
    and the text's length, in 40ths; DuckDB can compute them."""

    def __init__(self, letters: str):
        self.letters, self.dim = letters, len(letters) + 1

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([[*(t.find(c) + 1 for c in self.letters), len(t)] for t in texts], float).reshape(-1, self.dim) / 40


PLACES = PlaceEncoder("0123456789e.")


def q_select_templates(spark, sf):
    """Templates kept by forward selection, with the accuracy of every step (AG-33)."""
    items, classes = _brand_classes(spark, sf)
    hist = select_templates(items, "p_partkey", "text", "brand", classes, "brand", "names", TEMPLATES, PLACES)
    return spark.createDataFrame(hist, "step int, template string, top1 double").withColumn("top1", F.round("top1", R6))


def _places_sql() -> str:
    """Tables g (templates), i (items) and s (sum per template and class of the
    normalised prompt vectors), one row per dimension."""
    def places(text, *keys):
        cols = ", ".join(keys)
        each = " UNION ALL ".join(f"SELECT {cols}, {d} AS d, {x} / 40.0 AS x FROM src"
                                  for d, x in enumerate([f"instr({text}, '{c}')" for c in PLACES.letters] + [f"length({text})"]))
        total = f"sqrt(sum(x * x) OVER (PARTITION BY {cols}))"
        return f"SELECT {cols}, d, CASE WHEN {total} = 0 THEN x ELSE x / {total} END AS x FROM ({each})"
    grid = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TEMPLATES))
    return f"""
WITH g(t, template) AS (VALUES {grid})
, i AS MATERIALIZED (WITH src AS (SELECT p_partkey AS key, p_brand || ' ' || p_name AS text FROM part) {places('text', 'key')})
, pr AS (SELECT c, t, n, replace(template, '{{}}', name) AS prompt FROM g, (SELECT DISTINCT p_brand AS c, 1 AS n, p_brand AS name FROM part
         UNION ALL SELECT DISTINCT p_brand, 2, lower(replace(p_brand, '#', ' ')) FROM part))
, v AS MATERIALIZED (WITH src AS (SELECT * FROM pr) {places('prompt', 'c', 't', 'n')})
, s AS MATERIALIZED (SELECT t, c, d, sum(x) AS x FROM v GROUP BY t, c, d)"""


def _zero_shot_prompts_sql() -> str:
    return _places_sql() + """
, m AS (SELECT c, d, sum(x) AS x FROM s WHERE t < 3 GROUP BY c, d)
, n AS (SELECT c, d, x / sqrt(sum(x * x) OVER (PARTITION BY c)) AS x FROM m)
, k AS (SELECT key, c, row_number() OVER (PARTITION BY key ORDER BY score DESC, c DESC) AS r FROM (SELECT key, c, sum(i.x * n.x) AS score FROM i JOIN n USING (d) GROUP BY key, c))
SELECT round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS top5
FROM part JOIN k ON key = p_partkey AND c = p_brand"""


def _select_templates_sql() -> str:
    """All steps of the selection in a row; a step that does not improve ends it."""
    steps = []
    for r in range(len(TEMPLATES)):
        before = "UNION ALL ".join(f"SELECT t FROM p{q} " for q in range(r)) or "SELECT -1 AS t WHERE false"
        last = f"(SELECT acc FROM p{r - 1})" if r else "-1"
        steps.append(f"""
, m{r} AS MATERIALIZED (SELECT t, c, d, x + coalesce((SELECT sum(u.x) FROM s u WHERE u.c = s.c AND u.d = s.d AND u.t IN ({before})), 0) AS x FROM s WHERE t NOT IN ({before}))
, n{r} AS MATERIALIZED (SELECT t, c, d, x / sqrt(sum(x * x) OVER (PARTITION BY t, c)) AS x FROM m{r})
, h{r} AS (SELECT t, key, arg_max(c, (score, c)) AS c FROM (SELECT t, key, n{r}.c, sum(i.x * n{r}.x) AS score FROM i JOIN n{r} USING (d) GROUP BY t, key, n{r}.c) GROUP BY t, key)
, p{r} AS MATERIALIZED (SELECT t, acc FROM (SELECT t, avg(CASE WHEN h.c = l.p_brand THEN 1.0 ELSE 0 END) AS acc FROM h{r} h JOIN part l ON l.p_partkey = h.key GROUP BY t)
      WHERE acc > {last} ORDER BY acc DESC, t LIMIT 1)""")
    rows = " UNION ALL ".join(f"SELECT {r + 1} AS step, t, acc FROM p{r}" for r in range(len(TEMPLATES)))
    return _places_sql() + "".join(steps) + f"""
SELECT CAST(step AS INTEGER) AS step, template, round(acc, 6) AS top1 FROM ({rows}) JOIN g USING (t)"""


QUERIES = {
    "linear_probe_multiclass": (q_linear_probe_multiclass, None),
    "linear_probe_multilabel": (q_linear_probe_multilabel, _multilabel_sql()),
    "linear_probe_probabilities": (q_linear_probe_probabilities, _multinomial_sql()),
    "ridge_probe": (q_ridge_probe, _ridge_sql()),
    "regressor_fit": (q_regressor_fit, None),
    "regressor_weights": (q_regressor_weights, _forward_sql() + " SELECT r AS vec_id, round(o, 6) AS score FROM o"),
    "regressor_gradient": (q_regressor_gradient, _gradient_sql()),
    "zero_shot_prompts": (q_zero_shot_prompts, _zero_shot_prompts_sql()),
    "select_templates": (q_select_templates, _select_templates_sql()),
}
