"""Golden cases from FIXTURES.md section 4 and scale-form vs naive-form checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinemetric.operators import boxes as B
from cinemetric.operators import captions as C
from cinemetric.operators import coverage as V
from cinemetric.operators import contrastive as CT
from cinemetric.operators import shots as S
from cinemetric.operators import sampling as SM
from cinemetric.operators import linear as L
from cinemetric.operators.smoothing import savgol
from cinemetric.operators import tables as TB


def test_regroup_golden(spark):
    caps = spark.createDataFrame([("v", 0, "hello there. how are", 0.0, 4.0),
                                  ("v", 1, "you. fine [music].", 3.0, 3.0),
                                  ("v", 2, "bye", 6.0, 1.0)],
                                 "video_id string, cap_idx int, text string, start double, duration double")
    ends = C.clip_ends(caps)
    assert [r["end"] for r in ends.orderBy("cap_idx").collect()] == [3.0, 6.0, 7.0]
    words = C.word_times(ends)
    spans = [(r["word"], r["time_range"]["start"], r["time_range"]["end"])
             for r in words.orderBy("cap_idx", "w_idx").collect()]
    assert spans[0] == ("hello", 0.0, 0.75) and spans[4] == ("you", 3.0, 4.0)
    for chunk in (None, F.floor(F.col("cap_idx") / 2)):
        sent = C.regroup(words, chunk=chunk).collect()
        assert [(r["text"], r["start"], r["end"], r["duration"], r["sent_idx"]) for r in sent] == \
            [("how are you", 1.5, 4.0, 2.5, 0)]


def _frames(spark, present, boxed):
    return spark.createDataFrame([("v", f, f in boxed) for f in present], "video_id string, frame_idx long, has_box boolean")


def test_frame_coverage_golden(spark):
    clip = spark.createDataFrame([("v", 1.0, 2.5)], "video_id string, start double, end double")
    f = _frames(spark, range(8, 21), set(range(8, 15)))
    r = V.frame_coverage(clip, f).first()
    assert (r["start_frame"], r["end_frame"]) == (8, 20) and r["has_person"] == pytest.approx(7 / 13)
    f2 = _frames(spark, [x for x in range(8, 21) if x != 13], set())
    assert V.frame_coverage(clip, f2).count() == 0
    clip0 = spark.createDataFrame([("v", 0.0, 2.0)], "video_id string, start double, end double")
    assert V.frame_coverage(clip0, _frames(spark, range(1, 40), set())).count() == 0


def test_frame_coverage_scale_form_equals_range_join(spark):
    rng = np.random.default_rng(1)
    frames = [(v, int(f), bool(rng.random() < 0.6)) for v in ("a", "b") for f in range(1, 400) if rng.random() > 0.01]
    fdf = spark.createDataFrame(frames, "video_id string, frame_idx long, has_box boolean")
    clips = [(v, i, float(s), float(s + d)) for v in ("a", "b")
             for i, (s, d) in enumerate(zip(rng.uniform(0, 45, 60), rng.uniform(0.5, 4, 60)))]
    cdf = spark.createDataFrame(clips, "video_id string, cid int, start double, end double")
    fast = sorted(tuple(r) for r in V.frame_coverage(cdf, fdf, chunk_size=16).collect())
    keyed = V.frame_coverage(cdf, fdf, chunk_size=16, keys=["video_id", "cid"])
    keyed = sorted(tuple(r) for r in keyed.select(*V.frame_coverage(cdf, fdf).columns).collect())
    naive = sorted(tuple(r) for r in V.frame_coverage_naive(cdf, fdf).collect())
    assert fast == naive and keyed == naive and len(fast) > 0


def test_long_videos_and_select_clips(spark):
    pl = spark.createDataFrame([("34:00",), ("33:20",), ("1:05:00",), ("45",), (None,)], "duration string")
    assert [r[0] for r in V.long_videos(pl).collect()] == ["34:00", "1:05:00", "45"]
    idx = spark.createDataFrame([(2.0, "abc", 0.0, 0.0), (10.0, "abc", 0.0, 0.0), (2.1, "abc", 0.0, 0.0)],
                                "duration double, text string, neutral_score double, has_person double")
    assert [r["duration"] for r in V.select_clips(idx).collect()] == [2.1]


def test_shots_and_clips(spark):
    cuts = spark.createDataFrame([("m", 100), ("m", 250)], "movie_id string, start_frame long")
    got = [(r["start_frame"], r["end_frame"], r["shot_no"]) for r in S.shots_from_cuts(cuts).orderBy("shot_no").collect()]
    assert got == [(0, 99, 1), (100, 249, 2), (250, -1, 3)]
    df = spark.createDataFrame([(250, -1)], "s long, e long")
    assert df.select(S.close_open_end(F.col("s"), F.col("e"))).first()[0] == 442
    u = spark.createDataFrame([(10, 33)], "lo long, hi long").select(S.uniform_frames(F.col("lo"), F.col("hi"), 8)).first()[0]
    assert u == [10, 13, 16, 19, 23, 26, 29, 33]


def test_centered_clips_golden(spark):
    t = spark.createDataFrame([("m", 20)], "movie_id string, total long")
    test = {r["label_idx"]: (r["start_frame"], r["end_frame"], r["label_frame"])
            for r in S.centered_clips(t, split="test").collect()}
    assert test[2] == (0, 8, 2) and test[4] == (0, 8, 4) and test[16] == (12, 20, 4) and test[17] == (12, 20, 5)
    train = {r["label_idx"] for r in S.centered_clips(t, split="train").collect()}
    assert not ({0, 1, 2, 3, 17, 18, 19} & train) and 4 in train and 16 in train


def test_box_geometry_golden(spark):
    df = spark.createDataFrame([(100.0, 50.0, 300.0, 700.0, 455, 256)], "x1 double, y1 double, x2 double, y2 double, w int, h int")
    r = df.select(B.rescale_box("x1", "y1", "x2", "y2", "w", "h").alias("b")).first()["b"]
    assert (r["x1"], r["y1"], r["x2"], r["y2"]) == (71, 35, 214, 256)
    lb = spark.createDataFrame([(1920, 1080)], "w int, h int").select(B.letterbox("w", "h").alias("l")).first()["l"]
    assert (lb["unpad_w"], lb["unpad_h"]) == (640, 360)
    j = spark.createDataFrame([([(0.0, 0.0, 0.0), (10.2, 5.7, 0.9), (20.1, 8.1, 0.8)],)],
                              "j array<struct<x:double,y:double,conf:double>>")
    assert j.select(B.joints_to_bbox("j")).first()[0] == [5, 10, 9, 21]


def test_mask_patches_bruteforce(spark):
    boxes = [("i", 3, 5, 40, 20, 0.9), ("i", 30, 10, 70, 64, 0.8), ("i", 0, 0, 64, 64, 0.3)]
    df = spark.createDataFrame(boxes, "img string, x1 long, y1 long, x2 long, y2 long, score double")
    got = {(r["patch_row"], r["patch_col"]): r["coverage"] for r in B.mask_patches(df, ["img"], 64, 64, 32).collect()}
    mask = np.zeros((64, 64))
    for _, x1, y1, x2, y2, s in boxes:
        if s > 0.5:
            mask[y1:y2, x1:x2] = 1
    want = {(r, c): mask[r * 32:(r + 1) * 32, c * 32:(c + 1) * 32].mean() for r in range(2) for c in range(2)}
    assert got == pytest.approx(want)


def test_rect_batches_golden(spark):
    df = spark.createDataFrame([(i, 100.0, 75.0 - i) for i in range(4)], "id int, w double, h double")
    r = B.rect_batch_shapes(df, "w", "h", batch_size=4, img_size=640, stride=32, pad=0.5).first()
    assert (r["shape_h"], r["shape_w"]) == (512, 672)


def test_contrastive_golden():
    assert CT.clip_loss_from_logits(np.array([[2.0, 0.0], [0.0, 1.0]])) == pytest.approx(0.22009484928059775)
    w = CT.sentiment_weights(np.log(np.array([[0.5, 0.5], [0.9, 0.1]])))
    assert w[0, 1] == pytest.approx(2.716917267486994) and w[1, 0] == pytest.approx(1.9576151889712174)
    assert w[0, 0] == 0 and w[1, 1] == 0


def test_savgol_cubic(spark):
    x = np.arange(40, dtype=float)
    y = 0.01 * x ** 3 - 0.3 * x ** 2 + 2 * x + 1
    df = spark.createDataFrame([(int(i), float(v)) for i, v in zip(x, y)], "t long, v double")
    odd = {r["t"]: r["smoothed"] for r in savgol(df, "v", ["t"], 7, 3, chunk=8).collect()}
    assert [odd[i] for i in range(40)] == pytest.approx(list(y), abs=1e-8)
    even = {r["t"]: r["smoothed"] for r in savgol(df, "v", ["t"], 8, 3, chunk=16).collect()}
    p = lambda z: 0.01 * z ** 3 - 0.3 * z ** 2 + 2 * z + 1
    assert [even[i] for i in range(4, 36)] == pytest.approx([p(i + 0.5) for i in range(4, 36)], abs=1e-8)
    assert [even[i] for i in range(4)] == pytest.approx(list(y[:4]), abs=1e-8)


def test_sampling_repeatable(spark):
    clips = spark.createDataFrame([("c", 10, 40), ("d", 1, 5)], "clip string, lo long, hi long")
    a = SM.random_frames(clips, ["clip"], "lo", "hi", 8, seed=1).collect()
    b = SM.random_frames(clips.repartition(3), ["clip"], "lo", "hi", 8, seed=1).collect()
    assert len(a) == 1 and a[0]["frames"] == b[0]["frames"] and a[0]["frames"] == sorted(set(a[0]["frames"]))
    ids = spark.range(2000).withColumnRenamed("id", "k")
    s = SM.assign_split(ids, "k", (0.9, 0.1, 0.0)).groupBy("split").count().collect()
    counts = {r["split"]: r["count"] for r in s}
    assert 1700 < counts["train"] < 1900 and "test" not in counts
    e = SM.epoch_batches(ids, "k", 1, 64)
    assert e.count() == 64 * (2000 // 64)
    assert e.groupBy("batch_id").count().where("count != 64").count() == 0


def test_rolling_mean_matches_numpy(spark):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(vals)], "g int, i int, v double")
    got = [r["rolling"] for r in SM.rolling_mean(df, ["g"], ["i"], "v", 3).orderBy("i").collect()]
    assert got == pytest.approx([np.mean(vals[max(0, i - 2):i + 1]) for i in range(len(vals))])


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(120, 8))
    y = X @ rng.normal(size=8) + 0.3 * rng.normal(size=120) + 2.0
    df = spark.createDataFrame([(X[i].tolist(), float(y[i])) for i in range(120)], "x array<double>, y double")
    model = L.fit_ridge(df, "x", "y", alpha=1.0)
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + np.eye(8), Xc.T @ yc)
    assert np.array(model.coefficients) == pytest.approx(w, abs=1e-8)


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(200, 3))
    y = (X @ np.array([1.0, -2.0, 0.5]) + rng.normal(size=200) > 0).astype(float)
    C = 2.5
    df = spark.createDataFrame([(X[i].tolist(), float(y[i])) for i in range(200)], "x array<double>, y double")
    m = L.fit_logistic(df, "x", "y", C, "binomial")
    # Newton on C * sum(logloss) + 0.5 * ||w||^2 with free intercept
    Z = np.hstack([X, np.ones((200, 1))])
    b = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-Z @ b))
        reg = np.diag([1, 1, 1, 0.0])
        g = C * Z.T @ (p - y) + reg @ b
        H = C * Z.T @ (Z * (p * (1 - p))[:, None]) + reg
        b -= np.linalg.solve(H, g)
    assert np.array(m.coefficients) == pytest.approx(b[:3], abs=1e-5)
    assert m.intercept == pytest.approx(b[3], abs=1e-5)


def test_positional_join_lengths(spark):
    ten, seven = (spark.range(n).select(F.col("id").alias(c)) for n, c in ((10, "a"), (7, "b")))
    for x, y in ((ten, seven), (seven, ten)):
        order = x.columns, y.columns
        with pytest.raises(Exception, match="no row on the other side at position"):
            TB.positional_join(x, y, *order).collect()
        assert TB.positional_join(x, y, *order, unmatched="drop").count() == 7
        got = {r.row_idx: (r.a, r.b) for r in TB.positional_join(x, y, *order, unmatched="null").collect()}
        assert got == {i: (i, i if i < 7 else None) for i in range(10)}
    assert TB.positional_join(ten, ten.withColumnRenamed("a", "b"), ["a"], ["b"]).columns == ["row_idx", "a", "b"]


def test_table_helpers(spark):
    df = spark.createDataFrame([(["Anger", "Fear"],)], "n array<string>")
    mh = df.select(TB.multi_hot(F.col("n"))).first()[0]
    assert sum(mh) == 2 and mh[TB.MOVIE_CLASSES.index("Fear")] == 1
    cls = spark.createDataFrame([("joy", 0), ("anger", 1)], "name string, class_id int")
    ok = spark.createDataFrame([("anger",)], "label string")
    assert TB.label_index(ok, "label", cls).first()["class_id"] == 1
    bad = spark.createDataFrame([("fear",)], "label string")
    with pytest.raises(Exception):
        TB.label_index(bad, "label", cls).collect()
    a = spark.createDataFrame([(1,), (2,)], "id int")
    b = spark.createDataFrame([(2,), (3,)], "id int")
    assert TB.intersection_size(a, b, "id").first()["n"] == 1
    assert not TB.is_subset(a, b, "id") and TB.is_subset(a.where("id = 2"), b, "id")
    pj = TB.positional_join(spark.createDataFrame([("x", 2), ("y", 1)], "a string, o int"),
                            spark.createDataFrame([(10.0,), (20.0,)], "v double"), ["o"], ["v"])
    assert sorted((r["a"], r["v"]) for r in pj.collect()) == [("x", 20.0), ("y", 10.0)]
