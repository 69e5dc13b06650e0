"""Greedy non-maximum suppression against a plain loop; AUC of one class."""

import random

import pytest
from pyspark.sql import functions as F

from cinemetric.operators import boxes as B
from cinemetric.operators import metrics as M


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union else 0.0


def plain(dets, overlap, by_class, most):
    kept = []
    for d in sorted((d for d in dets if d[4] > 0.25), key=lambda d: -d[4]):
        if len(kept) < most and not any(iou(d, k) > overlap and (d[5] == k[5] or not by_class) for k in kept):
            kept.append(d)
    return kept


@pytest.mark.parametrize("by_class,most", [(True, 300), (False, 300), (True, 4)])
def test_suppression_equals_the_plain_loop(spark, by_class, most):
    rng = random.Random(3)
    frames = []
    for f in range(25):
        dets = []
        for _ in range(rng.randint(0, 30)):
            x, y = rng.randint(0, 30), rng.randint(0, 30)
            dets.append([float(v) for v in (x, y, x + rng.randint(0, 20), y + rng.randint(0, 20), rng.choice([0.1, 0.25, 0.3, 0.5, 0.5, 0.9]), rng.randint(0, 2))])
        frames.append((f, dets))
    df = spark.createDataFrame(frames + [(100, None)], "f int, dets array<array<double>>").repartition(3)
    got = {r.f: r.k for r in df.select("f", B.suppress("dets", overlap=0.4, by_class=by_class, most=most).alias("k")).collect()}
    assert got.pop(100) is None
    assert got == {f: plain(d, 0.4, by_class, most) for f, d in frames}
    rows = df.select("f", F.posexplode("dets").alias("o", "d")).select("f", "o", *[F.col("d")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2", "score", "cls"))])
    back = B.suppress_rows(rows, ["f"], "o", overlap=0.4, by_class=by_class, most=most)
    assert sorted((r.f, r["rank"], r.x1, r.score) for r in back.collect()) == sorted((f, i + 1, d[0], d[4]) for f, ds in got.items() for i, d in enumerate(ds))


def test_unusable_detections_are_dropped(spark):
    df = spark.createDataFrame([([[0.0, 0.0, 5.0, 5.0, 0.9, 1.0], None, [1.0, 2.0], [0.0, 0.0, 5.0, 5.0, float("nan"), 1.0], [0.0, 0.0, None, 5.0, 0.9, 1.0]],), ([],)], "d array<array<double>>")
    assert [r.k for r in df.select(B.suppress("d").alias("k")).collect()] == [[[0.0, 0.0, 5.0, 5.0, 0.9, 1.0]], []]


def test_auc_of_one_class_is_an_error(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.4), ("b", 1, 0.9), ("b", 0, 0.1)], "c string, y int, s double")
    with pytest.raises(Exception, match="only one class in the labels of a"):
        M.roc_auc(df, "c", "y", "s").collect()
    assert {r.c: r.auc for r in M.roc_auc(df, "c", "y", "s", one_class="null").collect()} == {"a": None, "b": 1.0}
