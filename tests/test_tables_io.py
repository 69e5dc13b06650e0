"""Golden cases for the table helpers, readers and sinks that no registered
query exercises on the driver tables (small files written to a scratch dir)."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cinemetric.operators import boxes as B
from cinemetric.operators import shots as SH
from cinemetric.operators import tables as TB
from cinemetric.sources import readers as RD
from cinemetric.sources import sinks as SK


def test_select_target_and_corrections(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2, 3), (2, 0.3, 0.4, 5)], "id int, v double, a double, cat int")
    modes = {"vad": ["v", "a"], "idx": ["cat"]}
    assert TB.select_target(df, "vad", modes, ["id"]).columns == ["id", "v", "a"]
    with pytest.raises(ValueError):
        TB.select_target(df, "cont", modes, ["id"])
    drops = spark.createDataFrame([(2,)], "id int")
    patches = spark.createDataFrame([(1, 9)], "id int, cat int")
    out = TB.apply_corrections(df, drops, patches, ["id"], "cat").collect()
    assert [(r["id"], r["cat"]) for r in out] == [(1, 9)]
    with pytest.raises(ValueError):
        TB.apply_corrections(df, spark.createDataFrame([(7,)], "id int"), None, ["id"])


def test_select_split_and_audits(spark):
    df = spark.createDataFrame([(k,) for k in "abcd"], "vid string")
    splits = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "test")], "key string, split string")
    pick = lambda s: sorted(r["vid"] for r in TB.select_split(df, splits, "vid", s).collect())
    assert pick("train") == ["a"] and pick("train+val") == ["a", "b"] and pick("all") == ["a", "b", "c"]
    t = spark.createDataFrame([("m", 1, None), ("m", None, None), ("n", 2, 3)], "g string, x int, y int")
    audit = {r["g"]: (r["null_x"], r["null_y"]) for r in TB.audit_nulls(t, "g", ["x", "y"]).collect()}
    assert audit == {"m": (1, 2), "n": (0, 0)}
    clips = spark.createDataFrame([("m", 0, 8, 3), ("m", 5, 13, 9), ("m", 10, 18, 2)],
                                  "movie string, start_frame int, end_frame int, label_frame int")
    totals = spark.createDataFrame([("m", 16)], "movie string, total int")
    bad = sorted(r["start_frame"] for r in TB.audit_clips(clips, totals, "movie").collect())
    assert bad == [5, 10]          # label 9 > 7; end 18 > 16
    kept, dropped = TB.min_frames(clips, "start_frame", "end_frame", 9)
    assert kept.count() == 3 and dropped.first()["n_dropped"] == 0
    kept, dropped = TB.min_frames(clips, "start_frame", "end_frame", 10)
    assert kept.count() == 0 and dropped.first()["n_dropped"] == 3


def test_subsets_boxes_and_categories(spark):
    imgs = spark.createDataFrame([("/d/images/a.jpg",), ("/d/images/b.jpg",)], "path string")
    labels = spark.createDataFrame([("/d/labels/a.txt",)], "file string")
    got = TB.annotated_only(imgs, labels, "path", RD.label_path_for(F.col("path")))
    assert [r["path"] for r in got.collect()] == ["/d/images/a.jpg"]
    rows = spark.createDataFrame([("en", "t", None), ("en", " ", ""), ("de", "t", "d"), ("en", None, "d")],
                                 "lang string, title string, description string")
    assert TB.subset_language(rows, "lang", "en", "title", "description").count() == 2
    geo = spark.createDataFrame([("k1", 1), ("k2", 2)], "cell string, n int")
    countries = spark.createDataFrame([("k1", "FR")], "cell string, country string")
    assert [r["country"] for r in TB.subset_geo(geo, countries, "cell").collect()] == ["FR"]
    frames = spark.createDataFrame([("v", 1), ("v", 2)], "video_id string, frame_idx int")
    boxes = spark.createDataFrame([("v", 1, [[1.0, 2.0, 3.0, 4.0, 0.9]])],
                                  "video_id string, frame_idx int, boxes array<array<double>>")
    soft = {r["frame_idx"]: r["boxes"] for r in TB.attach_boxes(frames, boxes, ["video_id", "frame_idx"]).collect()}
    assert soft == {1: [[1.0, 2.0, 3.0, 4.0, 0.9]], 2: []}
    with pytest.raises(Exception):
        TB.attach_boxes(frames, boxes, ["video_id", "frame_idx"], strict=True).collect()
    words = spark.createDataFrame([("glad",), ("cross",), ("table",)], "word string")
    wmap = spark.createDataFrame([("Happiness", ["glad", "joyful"]), ("Anger", ["cross"])],
                                 "category string, words array<string>")
    cat = {r["word"]: r["category"] for r in TB.nearest_category(words, wmap).collect()}
    assert cat == {"glad": "Happiness", "cross": "Anger", "table": None}


def test_column_helpers(spark):
    df = spark.createDataFrame([([3.0, 1.0], [[2.0, 0.1], [5.0, 0.2]], 640, 480, 6, [3, 1, 3, 2, 1])],
                               "item array<double>, labels array<array<double>>, w int, h int, o int, parts array<int>")
    r = df.select(TB.repeat_item(F.col("item"), 3).alias("clip"), TB.single_class(F.col("labels")).alias("one"),
                  TB.oriented_size(F.col("w"), F.col("h"), F.col("o")).alias("size"),
                  TB.dedupe_keep_first(F.col("parts")).alias("uniq"),
                  TB.has_duplicate_rows(F.col("labels")).alias("dup")).first()
    assert r["clip"] == [[3.0, 1.0]] * 3
    assert r["one"] == [[0.0, 0.1], [0.0, 0.2]]
    assert (r["size"]["w"], r["size"]["h"]) == (480, 640)
    assert r["uniq"] == [3, 1, 2] and r["dup"] is False
    ids = TB.union_ids(spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int"),
                       col="id")
    assert sorted(x["id"] for x in ids.collect()) == [1, 2, 3]
    both = TB.concat_tables(spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(1,)], "id int"))
    assert both.count() == 2


def test_shots_helpers(spark):
    j = spark.createDataFrame([("v", 10, 0), ("v", 12, 0), ("w", 3, 1)], "video_id string, frame int, person_id int")
    got = sorted((r["video_id"], r["frame"]) for r in SH.rebase_frames(j).collect())
    assert got == [("v", 1), ("v", 3), ("w", 1)]
    samples = spark.createDataFrame([("m", 4, "s1"), ("m", 9, "s2")], "movie_id string, label_frame int, sid string")
    ann = spark.createDataFrame([("m", 4, 0.5), ("m", 5, 0.7)], "movie_id string, Time int, valence double")
    got = [(r["sid"], r["valence"]) for r in SH.label_at_time(samples, ann).collect()]
    assert got == [("s1", 0.5)]
    ann2 = spark.createDataFrame([("v", 0, "happy")], "video_id string, person_id int, label string")
    joints = spark.createDataFrame([("v", 0, 1, [(10.2, 20.7, 0.9), (0.0, 0.0, 0.0), (30.5, 5.1, 0.8)])],
                                   "video_id string, person_id int, frame int, "
                                   "joints array<struct<x:double,y:double,conf:double>>")
    pb = B.person_boxes(ann2, joints).first()
    assert pb["label"] == "happy" and list(pb["bbox"]) == [5, 10, 21, 31]     # [y1, x1, y2, x2]
    bx = spark.createDataFrame([([[0.0, 0.0, 1.0, 1.0, 0.4], [0.0, 0.0, 2.0, 2.0, 0.6]],)], "b array<array<double>>")
    assert bx.select(B.boxes_above("b").alias("k")).first()["k"] == [[0.0, 0.0, 2.0, 2.0, 0.6]]


def test_readers_small_files(spark, tmp_dir):
    csv = os.path.join(tmp_dir, "utt.csv")
    with open(csv, "w", encoding="utf-8") as f:
        f.write('Sr No.,Utterance,Dialogue_ID,Utterance_ID\n1,"Hi, there",0,3\n2,"Two\nlines",1,0\n')
    u = {r["clip_key"]: r["Utterance"] for r in RD.read_utterances(spark, csv).collect()}
    assert u == {"dia0_utt3": "Hi, there", "dia1_utt0": "Two\nlines"}
    idx = os.path.join(tmp_dir, "index.json")
    with open(idx, "w") as f:
        json.dump([{"video_id": "b", "start": 1.0}, {"video_id": "a", "start": 2.0}], f)
    ci = RD.read_clip_index(spark, idx).orderBy("row_idx").collect()
    assert [(r["row_idx"], r["video_id"]) for r in ci] == [(0, "b"), (1, "a")]
    root = os.path.join(tmp_dir, "frames")
    for v, names in (("v1", ["00000001.jpg", "00000002.jpg"]), ("v2", ["00000005.jpg", "notes.txt"])):
        os.makedirs(os.path.join(root, v))
        for n in names:
            with open(os.path.join(root, v, n), "wb") as f:
                f.write(b"x")
    man = sorted((r["video_id"], r["frame_idx"]) for r in RD.frame_manifest(spark, root).collect())
    assert man == [("v1", 1), ("v1", 2), ("v2", 5)]
    packed = os.path.join(tmp_dir, "packed")
    SK.pack_frames(spark, root, packed)
    back = spark.read.parquet(packed)
    assert sorted((r["video_id"], r["frame_name"]) for r in back.select("video_id", "frame_name").collect()) == \
        [("v1", "00000001.jpg"), ("v1", "00000002.jpg"), ("v2", "00000005.jpg")]
    pl = os.path.join(tmp_dir, "playlist.json")
    with open(pl, "w") as f:
        json.dump([{"link": "https://www.youtube.com/watch?v=x1", "duration": "45:10", "title": "t"}], f)
    assert RD.read_playlist(spark, pl).first()["duration"] == "45:10"
    side = os.path.join(tmp_dir, "side")
    spark.createDataFrame([(0, [0.1, 0.9]), (1, [0.5, 0.5])], "row_idx int, values array<double>") \
        .write.parquet(side)
    assert [r["values"] for r in RD.read_side_array(spark, side).orderBy("row_idx").collect()] == [[0.1, 0.9], [0.5, 0.5]]
    jp = os.path.join(tmp_dir, "joints")
    spark.createDataFrame([("v", 7, 0, [(1.0, 2.0, 0.9)]), ("v", 9, 0, [(3.0, 4.0, 0.8)])],
                          "video_id string, frame int, person_id int, joints array<struct<x:double,y:double,conf:double>>") \
        .write.parquet(jp)
    assert sorted(r["frame"] for r in RD.read_joints(spark, jp).collect()) == [1, 3]


def test_sinks_small_files(spark, tmp_dir):
    df = spark.createDataFrame([("tree", 4.2, [4.0, 4.5]), ("idea", 1.5, None)],
                               "Expression string, Predicted_Concreteness double, Per_Word_Predictions array<double>")
    for c in SK.PREDICTION_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    out = os.path.join(tmp_dir, "pred")
    SK.write_predictions(df, out, ["Expression"])
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["Expression", *SK.PREDICTION_COLUMNS]
    assert {r["Expression"]: r["Per_Word_Predictions"] for r in back.collect()} == {"tree": "4.00;4.50", "idea": None}
    sp = spark.createDataFrame([(1, "train"), (2, "val"), (3, "train")], "id int, split string")
    SK.write_splits(sp, os.path.join(tmp_dir, "splits"))
    dirs = sorted(d for d in os.listdir(os.path.join(tmp_dir, "splits")) if d.startswith("split="))
    assert dirs == ["split=train", "split=val"]
    crops = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 4.0), (2, 0.0, 0.0, 1.0, 1.0)],
                                  "cls int, x1 double, y1 double, x2 double, y2 double")
    SK.write_crops(crops, os.path.join(tmp_dir, "crops"))
    assert spark.read.parquet(os.path.join(tmp_dir, "crops")).where("cls = 2").count() == 1
    sents = spark.createDataFrame([("v", i, f"s{i}") for i in range(30)] + [("w", 0, "only")],
                                  "video_id string, sent_idx int, text string")
    tp = os.path.join(tmp_dir, "tr")
    SK.write_transcripts(sents, tp)
    v = spark.read.json(os.path.join(tp, "video_id=v"))
    assert sorted(r["sent_idx"] for r in v.collect()) == list(range(30))


def test_clip_index_json_lines_round_trip(spark, tmp_dir):
    rows = [(i, f"v{i % 3}", 2.5 + i, i * 10, i * 10 + 20, f"t{i}", 0.1 * i, 1.0) for i in range(7)]
    idx = spark.createDataFrame(rows, "row_idx long, video_id string, duration double, start_frame int, "
                                      "end_frame int, text string, neutral_score double, has_person double")
    SK.write_clip_index(idx.repartition(3), f"{tmp_dir}/ci")
    back = RD.read_clip_index(spark, f"{tmp_dir}/ci", lines=True).orderBy("row_idx").collect()
    assert [(r["row_idx"], r["video_id"], r["end_frame"]) for r in back] == [(r[0], r[1], r[4]) for r in rows]
