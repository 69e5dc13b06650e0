"""Two-level (chunked) sequence helpers equal their single-window forms."""

import random

from pyspark.sql import functions as F

from cinemetric.operators import captions as C
from cinemetric.operators.sequence import next_value, row_number


def _rows(seed=7):
    rnd = random.Random(seed)
    rows = []
    for v in range(6):
        idx = sorted(rnd.sample(range(0, 60), rnd.randint(0, 25)))   # gaps -> empty chunks
        for i in idx:
            rows.append((f"v{v}", i, None if rnd.random() < 0.2 else float(rnd.randint(0, 99))))
    return rows


def test_next_value_chunked_equals_lead(spark):
    df = spark.createDataFrame(_rows(), "video string, idx int, x double")
    plain = next_value(df, ["video"], ["idx"], "x", "nx").collect()
    chunked = next_value(df, ["video"], ["idx"], "x", "nx", chunk=F.floor(F.col("idx") / 4)).collect()
    key = lambda r: (r["video"], r["idx"])
    assert sorted(plain, key=key) == sorted(chunked, key=key)
    assert len(chunked) == df.count()


def test_row_number_chunked_equals_window(spark):
    df = spark.createDataFrame(_rows(3), "video string, idx int, x double")
    a = {(r["video"], r["idx"]): r["rn"] for r in row_number(df, ["video"], ["idx"], "rn").collect()}
    b = {(r["video"], r["idx"]): r["rn"]
         for r in row_number(df, ["video"], ["idx"], "rn", chunk=F.floor(F.col("idx") / 5)).collect()}
    assert a == b


def test_clip_ends_and_regroup_chunked(spark, monkeypatch):
    rnd = random.Random(11)
    vocab = ["we", "go.", "now", "then.", "[music]", "ok", "fine."]
    caps = []
    for v in range(3):
        t = 0.0
        for i in range(40):
            caps.append((f"v{v}", i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 4))), t,
                         float(rnd.randint(1, 5))))
            t += rnd.choice([1.0, 3.0, 6.0])
    df = spark.createDataFrame(caps, "video_id string, cap_idx int, text string, start double, duration double")
    ends_a = {(r[0], r[1]): r[2] for r in C.clip_ends(df).select("video_id", "cap_idx", "end").collect()}
    ends_b = {(r[0], r[1]): r[2] for r in C.clip_ends(df, chunk=F.floor(F.col("cap_idx") / 7))
              .select("video_id", "cap_idx", "end").collect()}
    assert ends_a == ends_b
    words = C.word_times(C.clip_ends(df))
    monkeypatch.setattr(C, "SENTENCE_CHUNK", 2)
    plain = sorted(C.regroup(words).collect())
    chunked = sorted(C.regroup(words, chunk=F.floor(F.col("cap_idx") / 5)).collect())
    assert plain == chunked and len(plain) > 3


def test_range_chunks_with_hot_key(spark):
    """One key holds most rows; range chunks split it; results equal the plain window."""
    from cinemetric.operators.sequence import RANGE, rolling_mean, running_sums
    rnd = random.Random(5)
    rows = [("hot", i, float(rnd.randint(0, 9))) for i in range(400)]
    rows += [(f"k{j}", i, float(rnd.randint(0, 9))) for j in range(5) for i in range(rnd.randint(1, 20))]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    key = lambda r: (r["k"], r["i"])
    a = sorted(running_sums(df, ["k"], ["i"], {"s": "x", "n": F.lit(1)}).collect(), key=key)
    b = sorted(running_sums(df, ["k"], ["i"], {"s": "x", "n": F.lit(1)}, chunk=RANGE).collect(), key=key)
    assert a == b
    plain = {key(r): r["m"] for r in rolling_mean(df, ["k"], ["i"], "x", 5, "m", chunk_rows=None).collect()}
    chunked = {key(r): r["m"] for r in rolling_mean(df, ["k"], ["i"], "x", 5, "m", chunk_rows=7).collect()}
    assert plain.keys() == chunked.keys()
    assert all(abs(plain[k] - chunked[k]) < 1e-12 for k in plain)


def test_global_row_index_dense_and_ordered(spark):
    from cinemetric.operators.sequence import global_row_index
    rnd = random.Random(9)
    rows = [(i, rnd.randint(0, 300)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(13)
    got = sorted((r["row_idx"], r["v"], r["id"]) for r in global_row_index(df, ["v", "id"]).collect())
    assert [g[0] for g in got] == list(range(2000))
    assert [(g[1], g[2]) for g in got] == sorted((v, i) for i, v in rows)
    empty = global_row_index(df.where("id < 0"), ["v"])
    assert empty.count() == 0 and "row_idx" in empty.columns
