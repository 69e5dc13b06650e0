"""Model hooks, persistence, stream scoring, sub-word pooling."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinemetric.functions.encoders import HashingEncoder, KeywordLabelScorer, encode_column, label_scores_column
from cinemetric.operators import boxes as B
from cinemetric.operators import captions as C
from cinemetric.operators import coverage as V
from cinemetric.operators import regressor as RG
from cinemetric.operators import tables as TB
from cinemetric.operators import vectors as O
from cinemetric.streaming import stateful as ST


def test_punctuation_hook(spark):
    caps = spark.createDataFrame([("v", 0, "hello there how are", 0.0, 4.0), ("v", 1, "you fine", 4.0, 2.0)],
                                 "video_id string, cap_idx int, text string, start double, duration double")
    words = C.word_times(C.clip_ends(caps))

    def model(ws):  # marks every second word as a sentence end
        return [(w, "." if i % 2 else "0", 0.9) for i, w in enumerate(ws)]

    lab = C.label_words_by_video(words, model)
    sent = C.regroup(lab).orderBy("video_id", "sent_idx").collect()
    assert [r["text"] for r in sent] == ["how are", "you fine"]


def test_detector_hook(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/frames/v1")
    for i in (1, 2):
        with open(f"{tmp_dir}/frames/v1/{i:08d}.jpg", "wb") as f:
            f.write(b"x" * (10 * i))

    def detector(blobs):
        return [[[0, 0, len(b), len(b), 0.9, 0], [1, 1, 2, 2, 0.1, 0], [0, 0, 5, 5, 0.8, 2]] for b in blobs]

    frames = spark.read.format("binaryFile").load(f"{tmp_dir}/frames/v1")
    d = B.detect_boxes(frames, detector).select("path", F.explode("dets").alias("d"))
    d = d.select("path", F.col("d")[4].alias("conf"), F.col("d")[5].alias("cls"))
    kept = B.keep_person(d).collect()
    assert len(kept) == 2 and all(r["conf"] == 0.9 for r in kept)


def test_encoders_and_scorer(spark):
    df = spark.createDataFrame([("happy day",), ("sad day",), (None,)], "t string")
    enc = HashingEncoder(16, seed=1)
    vecs = [r[0] for r in df.select(encode_column("t", enc)).collect()]
    assert np.linalg.norm(vecs[0]) == pytest.approx(1.0) and vecs[2] == [0.0] * 16
    assert vecs[0] == list(enc.encode(["happy day"])[0])
    sc = KeywordLabelScorer({"neutral": ["day"], "joy": ["happy"]})
    rows = df.select(label_scores_column("t", sc).alias("s")).collect()
    neutral = df.select(TB.label_score(label_scores_column("t", sc)).alias("n")).collect()
    assert rows[0]["s"][1]["label"] == "joy" and neutral[1]["n"] > 0.5


def test_regressor_save_load_and_fit(spark, tmp_dir):
    m = RG.Regressor.init(8, seed=3, out_bias=3.0)
    m.save(spark, f"{tmp_dir}/model")
    back = RG.Regressor.load(spark, f"{tmp_dir}/model")
    x = np.random.default_rng(0).normal(size=(5, 8))
    assert back.forward(x) == pytest.approx(m.forward(x))
    df = spark.createDataFrame([(x[i].tolist(),) for i in range(5)], "v array<double>")
    got = [r[0] for r in df.select(RG.predict_column("v", m, spark)).collect()]
    assert got == pytest.approx(list(m.forward(x)))
    rng = np.random.default_rng(1)
    X = rng.normal(size=(200, 4))
    y = 3 + X[:, 0]
    data = spark.createDataFrame([(X[i].tolist(), float(y[i])) for i in range(200)], "x array<double>, y double")
    _, losses = RG.fit(data, "x", "y", lr=1e-2, max_epochs=30)
    assert losses[-1] < losses[0] / 2


def test_gradient_equals_finite_differences(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    data = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(9)
    m = RG.Regressor.init(3, seed=2)
    g, loss, n = RG.gradient(data, m)
    assert n == 60 and loss == pytest.approx(((m.forward(x) - y) ** 2).mean()) and RG.mean_loss(data, m) == pytest.approx(loss)
    for k in RG.WEIGHTS:
        for at in list(np.ndindex(m.params[k].shape))[::173]:
            old = m.params[k][at]
            m.params[k][at] = old + 1e-6
            up = ((m.forward(x) - y) ** 2).mean()
            m.params[k][at] = old - 1e-6
            down = ((m.forward(x) - y) ** 2).mean()
            m.params[k][at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    assert RG.gradient(data.limit(0), m)[2] == 0
    mean, sd = RG.fit_scaler(data, "x")
    assert mean == pytest.approx(x.mean(axis=0)) and sd == pytest.approx(x.std(axis=0))


def test_fit_stops_by_the_held_out_loss(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(80, 6)), rng.normal(size=80)          # nothing to learn: the held-out loss soon rises
    lists = [spark.createDataFrame([(str(i), float(y[i])) for i in part], "text string, rating double") for part in (range(0, 50), range(50, 80))]
    both = RG.unite(*lists)
    assert both.groupBy("part").count().orderBy("part").collect() == [(0, 50), (1, 30)]
    known = spark.createDataFrame([(str(i), x[i].tolist()) for i in range(80)], "text string, v array<double>")
    data = both.join(known, "text").unionByName(spark.createDataFrame([("n", 1.0, 0, None), ("m", None, 0, x[0].tolist())], "text string, rating double, part int, v array<double>"))
    model, losses = RG.fit(data, "v", "rating", lr=1e-2, max_epochs=40, patience=3, held_out=F.col("text").cast("int") % 4 == 0)
    held = np.arange(80) % 4 == 0
    assert len(losses) < 40 and min(losses) < losses[-1]
    assert ((model.forward(x[held]) - y[held]) ** 2).mean() == pytest.approx(min(losses))
    with pytest.raises(ValueError):
        RG.fit(data.limit(0), "v", "rating")


def test_score_stream_matches_batch(spark, tmp_dir):
    rows = spark.createDataFrame([(i, "one two" if i % 2 else "word", 1.0 + (i % 5)) for i in range(20)],
                                 "id long, text string, raw double")
    src = f"{tmp_dir}/exprs"
    rows.write.parquet(src)
    stats = spark.createDataFrame([("Multiword", 3.0, 1.5), ("Single-word", 2.5, 1.0)], "Model_Used string, mu double, sd double")
    stream = spark.readStream.schema(rows.schema).parquet(src)
    out = ST.run_available(ST.score_stream(stream, "text", "raw", stats, 4.0), f"{tmp_dir}/o", f"{tmp_dir}/ck")
    batch = ST.score_stream(rows, "text", "raw", stats, 4.0)
    a = sorted((r["id"], r["Predicted_Concreteness"]) for r in out.collect())
    b = sorted((r["id"], r["Predicted_Concreteness"]) for r in batch.collect())
    assert a == b and all(1 <= v <= 5 for _, v in a)


def test_pool_subwords(spark):
    toks = spark.createDataFrame([(1, 0, "pla", [1.0, 0.0]), (1, 1, "ying</w>", [3.0, 2.0]), (1, 2, "cat</w>", [5.0, 5.0])],
                                 "doc int, pos int, piece string, v array<double>")
    got = {r["word_no"]: r["word_vec"] for r in O.pool_subwords(toks, ["doc"], "pos", "piece", "v").collect()}
    assert got == {0: [2.0, 1.0], 1: [5.0, 5.0]}


def test_useful_frames_anti(spark):
    frames = spark.createDataFrame([("v", i) for i in range(0, 60)], "video_id string, frame_idx long")
    caps = spark.createDataFrame([("v", "ok", 0.0, 1.0), ("v", "[music]", 1.0, 1.0)],
                                 "video_id string, text string, start double, duration double")
    keep = V.useful_frames(frames, caps, fps=24).count()
    drop = V.useful_frames(frames, caps, fps=24, keep=False).count()
    assert keep == 24 and drop == 36
