"""Queries and operators whose memory, disk or file count must not grow faster
than their input."""

import os
import re

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinemetric.functions import text as TX
from cinemetric.operators import captions as C
from cinemetric.operators import coverage as V
from cinemetric.operators import sequence as Q
from cinemetric.operators import tokenize as TK
from cinemetric.operators import vectors as O
from cinemetric.plans import catalog_files as CF
from cinemetric.plans import catalog_stream as CS
from cinemetric.plans import catalog_vectors as CV
from cinemetric.session import spread_by_rows
from cinemetric.sources import readers as RD
from cinemetric.streaming import stateful as ST


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _frames(spark):
    return spark.range(3).select(F.col("id").alias("video_id"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("frame_idx")).where(
        "frame_idx <> 20").withColumn("has_box", F.col("frame_idx") % 3 != 0)


def test_frames_are_not_broadcast(spark):
    """Exploded frames look small to the planner."""
    frames = _frames(spark)
    clips = spark.createDataFrame([(0, 1, 8), (1, 16, 23), (2, 30, 40), (7, 1, 2)], "video_id long, a int, b int")
    ok = V.intervals_complete(clips, frames, "a", "b")
    assert sorted((r["video_id"], r["a"]) for r in ok.collect()) == [(0, 1), (2, 30)]
    cap = spark.createDataFrame([(0, 0, 1.0, 2.0), (1, 0, 2.0, 3.0)], "video_id long, cap_idx int, start double, end double")
    for keys in (["video_id", "cap_idx"], None):
        cov = V.frame_coverage(cap, frames, keys=keys)
        assert [(r["video_id"], r["start_frame"], round(r["has_person"], 6)) for r in cov.collect()] == [(0, 8, round(6 / 9, 6))]
        assert "SortMergeJoin [video_id" in _plan(cov)
    assert _plan(ok).count("SortMergeJoin") >= 2


def test_running_sums_broadcast_totals_only(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2), (None, 1)], "k string, x int")
    out = Q.running_sum(rows, ["k"], ["x"], F.col("x"), "s", chunk=F.floor(F.col("x") / 4))
    assert sorted((r["k"], r["x"], r["s"]) for r in out.collect()) == [("a", 1, 1), ("a", 5, 6), ("b", 2, 2)]
    assert "LeftOuter" in _plan(out)


def test_pooling_shuffles_texts_only(spark, tmp_dir):
    """one shuffle, of the texts, before they are cut into pieces."""
    docs = [(1, "abcdefg hi"), (2, ""), (3, None), (4, "x  yz \n klmn")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    q = CV.q_subword_pooling(spark, tmp_dir)
    exchanges = re.findall(r"Exchange \w+", _plan(q))
    assert exchanges == ["Exchange hashpartitioning"]
    got = {(r["doc_id"], r["word_no"]): r["word_vec"] for r in q.collect()}
    assert got == {(1, 0): [pytest.approx(11 / 3, abs=1e-6), 1.0], (1, 1): [6.0, 0.0],
                   (4, 0): [5.0, 0.0], (4, 1): [6.0, 0.0], (4, 2): [4.0, 0.5]}


def test_mean_of_short_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, None), (3, [0.0, 5.0])], "k int, v array<double>")
    for dims in (None, 2):
        got = {r["k"]: list(r["m"]) for r in O.mean_vectors(rows, ["k"], "v", "m", dims=dims).collect()}
        assert got == {1: [2.0, 4.0], 3: [0.0, 5.0]}
    with pytest.raises(Exception, match="not of length 3"):
        O.mean_vectors(rows, ["k"], "v", "m", dims=3).collect()


def test_stream_of_a_folder(spark, tmp_dir):
    """a table may be a folder of files as well as one file."""
    rows = [(i, "word " * (i % 12 + 1), 10 * i) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3).write.parquet(f"{tmp_dir}/documents.parquet")
    assert CS.q_stream_scores(spark, tmp_dir).count() == 40
    ev = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, float(i)) for i in range(60)]
    events = spark.createDataFrame(ev, "event_id long, ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(5, F.col("event_id") % 7).write.parquet(f"{tmp_dir}/events.parquet")
    got = sorted((r["user_id"], r["event_id"]) for r in CS.q_stream_every_nth(spark, tmp_dir).collect())
    assert got == sorted((u, e) for u in range(3) for e in range(u + 9, 60, 12))


def test_images_and_labels_in_archives(spark, tmp_dir):
    """few files, whatever the number of images; keys may repeat."""
    keys = [*range(1, 400), 7, 8]
    spark.createDataFrame([(k, k % 5, f"s{k}") for k in keys], "s_suppkey long, s_nationkey int, s_name string").write.parquet(f"{tmp_dir}/supplier.parquet")
    files = spark.createDataFrame([(k, bytes([65 + k % 20])) for k in keys], "img long, content binary")
    CF._write_tars(files.coalesce(2), f"{tmp_dir}/tars")
    assert sum(n.startswith("files.tar") for n in os.listdir(f"{tmp_dir}/tars")) <= 4
    images = CF.q_image_headers(spark, tmp_dir).collect()
    assert sorted(r["img"] for r in images) == sorted(keys)
    report = {r["status"]: r["n"] for r in CF.q_label_report(spark, tmp_dir).collect()}
    assert report["total"] == sum(n for s, n in report.items() if s != "total") >= len(keys)


def test_labels_of_archive_members(spark, tmp_dir):
    texts = ["", "3 0.5 0.5 0.25 0.125", "x 1", "3 0.1 0.1 0.5 0.1 0.5 0.4 0.1 0.4"]
    files = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "img long, content binary")
    CF._write_tars(files.coalesce(1), f"{tmp_dir}/t")
    got = {int(r["file"].rsplit("/", 1)[1].split("-")[0]): r["rows"] for r in RD.read_detection_labels(spark, f"{tmp_dir}/t", archives="files.tar*").collect()}
    assert got[0] == [] and got[1] == [[3, 0.5, 0.5, 0.25, 0.125]] and got[2] == [[None, 1]]
    assert [round(x, 6) for x in got[3][0]] == [3, 0.3, 0.25, 0.4, 0.3]


def test_report_of_nothing(spark):
    empty = spark.createDataFrame([], "status string")
    assert [(r["status"], r["n"]) for r in RD.label_report(empty).collect()] == [("total", 0)]


def test_runs_reach_the_labeller_in_batches(spark):
    """no pandas group per run, and no call for a run without own words."""
    rows = [(v, c, w, f"w{c}{'.' if w else ''}", (float(c), c + 1.0)) for v in (1, 2, None) for c in range(9) for w in (0, 1)]
    words = spark.createDataFrame(rows, "video_id long, cap_idx int, w_idx int, word string, time_range struct<start double, end double>")

    def model(run):
        if len(run) < 6:            # a run that only looks on is shorter
            raise RuntimeError("called without own words")
        return [(w.rstrip("."), "." if w.endswith(".") else "0", len(run)) for w in run]

    out = C.label_words_by_video(words, model, captions_per_call=3, halo=1)
    assert "FlatMapGroups" not in _plan(out)
    got = sorted((r["video_id"] or 0, r["cap_idx"], r["w_idx"], r["word"], r["punc"], r["time_range"]["end"]) for r in out.collect())
    assert got == sorted((v or 0, c, w, f"w{c}", "." if w else "0", c + 1.0) for v, c, w, _, _ in rows)


def test_tokens_are_looked_up_by_block(spark):
    """No row a token, no Python string a token."""
    docs = spark.createDataFrame([(1, "the other hand hand"), (1, "the"), (2, None), (3, ""), (4, "hand in the other " * 300)], "doc_id long, text string")
    merges = [("t", "h"), ("th", "e</w>"), ("a", "n")]
    by_block = TK.encode_with_dictionary(docs, "doc_id", "text", TK.word_dictionary(docs, "text", merges))
    assert "posexplode" not in _plan(by_block)
    plain = TK.encode_texts(docs, "doc_id", "text", merges)
    assert sorted((r["doc_id"], r["ids"]) for r in by_block.collect()) == sorted((r["doc_id"], r["ids"]) for r in plain.collect())
    m = TK._Merger(merges, "clip")
    lists = pa.array([["the", "x"], None, [], ["the", "hand"]], pa.list_(pa.string()))
    assert m.arrays(lists.slice(1)).to_pylist() == [None, [], m.ids("the") + m.ids("hand")]


def test_parts_of_bounded_rows(spark):
    """rows of one part are dealt to as many as they need."""
    one = spark.range(1000).coalesce(1)
    dealt = spread_by_rows(one, 300)
    assert dealt.rdd.getNumPartitions() == 4 and dealt.count() == 1000
    assert spread_by_rows(one, 1000).rdd.getNumPartitions() == 1 and spread_by_rows(one.limit(0), 1).count() == 0


def test_rows_of_a_key_in_order():
    """by time and id, ties as they came, no time last."""
    rows = pd.DataFrame({"ts": pd.to_datetime([3, None, 1, 1], unit="s"), "id": [1, 2, 9, 4]})
    assert ST._in_order([rows[:2], rows[2:]], ["ts", "id"])["id"].tolist() == [4, 9, 1, 2]


def test_only_the_ends_are_stripped(spark):
    """white space and marks leave both ends, as Python's strip."""
    texts = ["x.\n", "..x.y..", "\u3000\x85 a \u00a0b\t\u2003", "", " \n", None, "a b c", " a b  c d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    r = df.select("i", TX.strip_chars("t", ".").alias("s"), TX.py_strip("t").alias("p"), TX.words("t").alias("w"), TX.translation_audit("t", F.lit("-")).alias("a")).orderBy("i").collect()
    assert [x["s"] for x in r] == [None if t is None else t.strip(".") for t in texts]
    assert [x["p"] for x in r] == [None if t is None else t.strip() for t in texts]
    assert [x["w"] for x in r] == [None if t is None else t.split() for t in texts]
    assert [x["a"] for x in r] == [None, None, None, "empty", "empty", None, None, "long"]
