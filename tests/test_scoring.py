"""Golden cases for score post-processing and metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinemetric.operators import metrics as M
from cinemetric.operators import scoring as S
from cinemetric.operators.quantiles import exact_quantile, exact_quantiles


def test_znorm_sample_sd(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "p double")
    got = sorted(r[0] for r in S.znorm(df, "p", out="z").select("z").collect())
    assert got == pytest.approx([2.0, 3.0, 4.0])
    one = spark.createDataFrame([(1.0,)], "p double")
    r = S.znorm(one, "p", out="z").first()
    assert r["z"] == 3.0 and r["norm_degenerate"]


def test_p90_and_smoothing(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5]], "p double")
    assert exact_quantile(df, "p", 0.9) == pytest.approx(4.6)
    got = sorted(r[0] for r in S.smooth_tail(df, "p", out="s").select("s").collect())
    assert got == pytest.approx([1, 2, 3, 4, 4.5])


@pytest.mark.parametrize("method", ["distributed", "builtin"])
def test_exact_quantiles_match_numpy(spark, method):
    rng = np.random.default_rng(3)
    vals = np.round(rng.normal(size=2000), 2)  # many ties
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(7)
    qs = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    got = exact_quantiles(df, "x", qs, method)
    assert got == pytest.approx(list(np.quantile(vals, qs)), abs=1e-12)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (5.0, 4.0)], "p double, y double")
    r = M.regression_metrics(df, "p", "y").first()
    assert r["mse"] == pytest.approx(0.5)
    assert r["mae"] == pytest.approx(0.5)
    assert r["r2"] == pytest.approx(0.6)
    assert r["pearson_r"] == pytest.approx(0.894427190999916)
    assert r["rmse"] == pytest.approx(math.sqrt(0.5))


def test_ap_auc_golden(spark):
    df = spark.createDataFrame([(0, 1, 0.9), (0, 0, 0.8), (0, 1, 0.7)], "c int, y int, s double")
    assert M.average_precision(df, "c", "y", "s").first()["ap"] == pytest.approx(0.8333333333)
    assert M.roc_auc(df, "c", "y", "s").first()["auc"] == pytest.approx(0.5)


def test_auc_matches_pairwise_bruteforce(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300), 1)  # ties
    df = spark.createDataFrame([(0, int(a), float(b)) for a, b in zip(y, s)], "c int, y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    brute = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert M.roc_auc(df, "c", "y", "s").first()["auc"] == pytest.approx(brute)


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (1.0,)], "x double")
    h = M.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["n"] for r in h] == [2, 0, 0, 0, 1]


def test_weighted_f1(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "t int, p int")
    r = M.weighted_f1(df, "t", "p").first()
    # sklearn: per-class f1 = [0.667, 0.5, 0.0], supports [2,1,1]
    assert r["weighted_f1"] == pytest.approx((2 * 2 / 3 + 0.5) / 4)
    assert r["accuracy"] == pytest.approx(0.5)


def test_exact_quantiles_distributed_path(spark):
    from cinemetric.operators import quantiles as Q
    rng = np.random.default_rng(5)
    vals = np.round(rng.normal(size=3000), 2)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(5)
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    assert Q.exact_quantiles(df, "x", qs) == pytest.approx(list(np.quantile(vals, qs)), abs=1e-12)
    nan = df.limit(9).select("x").unionByName(spark.createDataFrame([(float("nan"),)], "x double"))
    low, high = Q.exact_quantiles(nan, "x", [0.0, 1.0])
    assert low == low and high != high          # NaN stands above every number
    assert Q.exact_quantiles(df.where("x > 99"), "x", qs) == [None] * 5


@pytest.mark.parametrize("engine", ["sql", "numpy"])
def test_score_matrix_blocks_equal_one_matrix(spark, engine):
    """More classes than one block holds: block-wise scores equal the single matrix."""
    import random
    from cinemetric.operators import vectors as O
    rnd = random.Random(3)
    items = spark.createDataFrame([(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(12)],
                                  "id int, v array<double>")
    classes = spark.createDataFrame([(c, [rnd.uniform(-1, 1) for _ in range(4)]) for c in range(9)],
                                    "c int, p array<double>")
    one = {r["id"]: (r["class_ids"], r["scores"]) for r in O.score_matrix(items, "v", classes, "c", "p", engine=engine).collect()}
    blk = {r["id"]: (r["class_ids"], r["scores"])
           for r in O.score_matrix(items, "v", classes, "c", "p", engine=engine, max_values=8).collect()}
    assert one.keys() == blk.keys()
    for k in one:
        assert one[k][0] == blk[k][0] == list(range(9))
        assert one[k][1] == pytest.approx(blk[k][1], abs=1e-12)
