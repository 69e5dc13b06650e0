"""Readers, sinks, streaming and tokenisation on small fixtures written to a temp dir."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cinemetric.operators import tokenize as TK
from cinemetric.sources import readers as RD
from cinemetric.sources import sinks as SK
from cinemetric.streaming import stateful as ST


def _write(path, text, mode="w", encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, encoding=encoding) as f:
        f.write(text)


def test_expressions_encoding_and_aliases(spark, tmp_dir):
    _write(f"{tmp_dir}/a/u.csv", 'Word,Conc.M\n"café, noir",4.5\nhand,\n,3\n')
    _write(f"{tmp_dir}/a/l.csv", "Word,Conc.M\nnaïve,2\n", encoding="latin-1")
    df = RD.read_expressions(spark, f"{tmp_dir}/a")
    got = sorted((r["expr_text"], r["rating"]) for r in df.collect())
    assert got == [("café, noir", 4.5), ("hand", None), ("naïve", 2.0)]


def test_transcripts_and_boxes(spark, tmp_dir):
    _write(f"{tmp_dir}/v1/transcript.json", json.dumps([{"text": "a b.", "start": 0.0, "duration": 2.0},
                                                         {"text": "c", "start": 2.0, "duration": 1.0}]))
    t = RD.read_transcripts(spark, f"{tmp_dir}/v1/transcript.json").orderBy("cap_idx").collect()
    assert [(r["video_id"], r["cap_idx"], r["text"]) for r in t] == [("v1", 0, "a b."), ("v1", 1, "c")]
    boxes = [{"00000001.jpg": [[1, 2, 3, 4, 0.9]]}, {"00000002.jpg": []}, {"00000001.jpg": [[5, 6, 7, 8, 0.7]]}]
    _write(f"{tmp_dir}/v1/human_boxes.json", json.dumps(boxes))
    b = RD.read_boxes(spark, f"{tmp_dir}/v1/human_boxes.json")
    kept = RD.frames_with_box(b).collect()
    assert [(r["frame_idx"], r["boxes"]) for r in kept] == [(1, [[5.0, 6.0, 7.0, 8.0, 0.7]])]


def test_whitespace_tsv_json_map(spark, tmp_dir):
    _write(f"{tmp_dir}/cuts/m1.txt", "header line\n100 4.1 CUT\n250 10.4 CUT\n")
    w = RD.read_whitespace_table(spark, f"{tmp_dir}/cuts", ["start_frame", "time_stamp", "CUT"], skip_first=True,
                                 types={"start_frame": "int"}).orderBy("line_no").collect()
    assert [(r["line_no"], r["start_frame"]) for r in w] == [(0, 100), (1, 250)]
    _write(f"{tmp_dir}/tsv/MEDIAEVAL_0001_x.txt", "Time\tvalence\tarousal\n0\t0.1\t0.2\n")
    t = RD.read_tsv_per_video(spark, f"{tmp_dir}/tsv").first()
    assert t["video_key"] == "MEDIAEVAL_0001"
    _write(f"{tmp_dir}/labels.json", json.dumps({"tt1": {"0": ["Anger", "Fear"]}}))
    m = RD.read_json_map(spark, f"{tmp_dir}/labels.json", "map<string, array<string>>").first()
    assert m["key"] == "tt1" and m["value"]["0"] == ["Anger", "Fear"]


def test_detection_label_statuses(spark, tmp_dir):
    _write(f"{tmp_dir}/ds/labels/a.txt", "0 0.5 0.5 0.2 0.2\n")
    _write(f"{tmp_dir}/ds/labels/b.txt", "")
    _write(f"{tmp_dir}/ds/labels/c.txt", "0 0.5 0.5 1.2 0.2\n")
    _write(f"{tmp_dir}/ds/labels/d.txt", "0 0.1 0.1 0.3 0.1 0.3 0.3 0.1 0.3\n")
    images = spark.createDataFrame([(f"file:{tmp_dir}/ds/images/{n}.jpg",) for n in "abcde"], "path string")
    labels = RD.read_detection_labels(spark, f"{tmp_dir}/ds/labels")
    st = RD.validate_labels(labels, images, RD.label_path_for(F.col("path")))
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in st.collect()}
    assert got == {"a.jpg": "found", "b.jpg": "empty", "c.jpg": "corrupt", "d.jpg": "found", "e.jpg": "missing"}
    seg = [r["rows"] for r in labels.collect() if r["file"].endswith("d.txt")][0][0]
    assert seg == pytest.approx([0, 0.2, 0.2, 0.2, 0.2])
    rep = {r["status"]: r["n"] for r in RD.label_report(st).collect()}
    assert rep["total"] == 5 and rep["found"] == 2


def test_clip_annotations_and_lists(spark, tmp_dir):
    row = ["vid", "1", "10", "20"] + ["0.6"] * 26 + ["5", "4", "3", "m", "adult", "white", "0.9"]
    _write(f"{tmp_dir}/ann/a.csv", ",".join(row) + "\n")
    a = RD.read_clip_annotations(spark, f"{tmp_dir}/ann")
    assert len(a.columns) == 37
    b = RD.binarize(a, RD.BODY_CLASSES[:2]).first()
    assert b["peace"] == 1
    df = spark.createDataFrame([("(1, 2.5)",), ("[3]",)], "c string")
    assert [r[0] for r in df.select(RD.parse_list_literal("c")).collect()] == [[1.0, 2.5], [3.0]]


def test_media_listing_and_fingerprint(spark, tmp_dir):
    for n in ["b.jpg", "a.png", "c.mp4", "d.txt"]:
        _write(f"{tmp_dir}/media/{n}", "xx")
    got = [(r["path"].rsplit("/", 1)[1], r["media"]) for r in RD.list_media(spark, f"{tmp_dir}/media").collect()]
    assert got == [("a.png", "image"), ("b.jpg", "image"), ("c.mp4", "video")]
    assert RD.fingerprint(spark, [f"{tmp_dir}/media"]).first()["total_bytes"] == 8


def test_prompt_vocab(spark, tmp_dir):
    md = "# P\n\n## Emotions\n\n```bash\nclasses = [\n    ['angry'],\n    ['happy', 'smiling'],\n]\n\n" \
         "templates = [\n    'a photo of a {} face.',\n    \"it's {}.\",\n]\n```\n"
    _write(f"{tmp_dir}/prompts.md", md)
    classes, templates = RD.read_prompt_vocab(spark, f"{tmp_dir}/prompts.md")
    assert [r["names"] for r in classes.orderBy("class_id").collect()] == [["angry"], ["happy", "smiling"]]
    assert [r["template"] for r in templates.orderBy("template_idx").collect()] == ["a photo of a {} face.", "it's {}."]


def test_sinks_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.25), ("b", 0, 1.0)], "video_id string, cap_idx int, s double")
    m = {r["video_id"]: r["scores"] for r in SK.scores_by_video(df, "video_id", "cap_idx", "s").collect()}
    assert m == {"a": [0.25, 0.5], "b": [1.0]}
    SK.write_transcripts(df.withColumnRenamed("cap_idx", "sent_idx"), f"{tmp_dir}/tr")
    assert sorted(d for d in os.listdir(f"{tmp_dir}/tr") if d.startswith("video_id=")) == ["video_id=a", "video_id=b"]
    cache = SK.feature_cache(spark, f"{tmp_dir}/cache", lambda: df)
    assert cache.count() == 3


def test_every_nth_stream_equals_batch(spark, tmp_dir):
    pdf = [(i, i, 1 if i % 2 else 2, float(i)) for i in range(1, 41)]
    src = f"{tmp_dir}/events"
    spark.createDataFrame(pdf, "event_id long, ts long, user_id long, value double").repartition(3) \
        .write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = ST.run_available(ST.every_nth(stream, "user_id", ["ts", "event_id"], 4), f"{tmp_dir}/o", f"{tmp_dir}/ck")
    got = sorted(r["event_id"] for r in out.collect())
    # golden: one source with events 1..9 keeps 4 and 8; here each user's 4th, 8th, ...
    assert len(got) == 10


def test_bpe_and_context_window(spark):
    merges = [("l", "o"), ("lo", "w</w>")]
    assert TK.bpe_word(["l", "o", "w</w>"], {m: i for i, m in enumerate(merges)}) == ["low</w>"]
    assert TK.bpe_word(["l", "o", "l", "o"], {("l", "o"): 0}) == ["lo", "lo"]
    syms = TK.byte_symbols()
    assert len(set(syms.values())) == 256 and syms[ord("a")] == "a" and syms[0] == chr(256)
    vocab = TK.build_vocab(merges)
    assert len(vocab) == 512 + 2 + 2
    df = spark.createDataFrame([(1, "Low &amp;amp; low"), (2, "")], "k int, t string")
    enc = {r["k"]: r["ids"] for r in TK.encode_texts(df, "k", "t", merges).collect()}
    low, amp = vocab["low</w>"], vocab["&</w>"]
    assert enc[1] == [low, amp, low] and enc[2] == []
    ids = spark.createDataFrame([([5] * 80,)], "ids array<int>")
    w = ids.select(TK.context_window(F.col("ids"), 1, 2, mode="truncate")).first()[0]
    assert len(w) == 77 and w[0] == 1 and w[-1] == 2
    w2 = ids.select(TK.context_window(F.col("ids"), 1, 2, mode="truncate_plain")).first()[0]
    assert w2[-1] == 5
    short = spark.createDataFrame([([5],)], "ids array<int>").select(TK.context_window(F.col("ids"), 1, 2)).first()[0]
    assert short[:4] == [1, 5, 2, 0] and len(short) == 77


def test_dictionary_equals_map_only(spark):
    """A hot token (a third of all), nulls, blanks, repeated rows, specials."""
    merges = [("t", "h"), ("th", "e</w>"), ("a", "a"), ("aa", "a</w>")]
    texts = ["the " * 400 + "aaaa é", None, "", "  ", "the aaaaa! 12 don't <|endoftext|> x", "the aaaaa! 12 don't <|endoftext|> x"] + [f"{'z' * (i + 1)} aaa{i}" for i in range(40)]
    df = spark.createDataFrame([(i % 44, t) for i, t in enumerate(texts)], "k int, t string").repartition(3)
    rows = lambda d: sorted((r["k"], r["ids"]) for r in d.collect())
    words = TK.word_dictionary(df, "t", merges)
    assert words.count() == words.select("token").distinct().count() and words.where("token = 'the'").first()["n"] == 402
    want = rows(TK.encode_texts(df, "k", "t", merges))
    assert rows(TK.encode_with_dictionary(df, "k", "t", words)) == want
    half = TK.word_dictionary(df.where("k < 20"), "t", merges)
    grown = TK.word_dictionary(df, "t", merges, known=half)
    assert sorted(map(str, grown.collect())) == sorted(map(str, words.collect()))
    with pytest.raises(Exception, match="not in the dictionary"):
        TK.encode_with_dictionary(df, "k", "t", half).collect()
    assert TK.encode_with_dictionary(df.limit(0), "k", "t", words).count() == 0


def test_every_nth_batchwise_across_batches(spark, tmp_dir):
    """Three files streamed one per trigger (arrival order = time order): the
    versioned per-source counts carry over, and the kept events equal the
    batch answer (every 4th event per source over all rows)."""
    rows = [(i, i, 7 if i % 5 else 3, float(i)) for i in range(1, 61)]   # source 7 is hot
    src = f"{tmp_dir}/events"
    schema = "event_id long, ts long, user_id long, value double"
    for part, lo in enumerate((1, 21, 41)):
        spark.createDataFrame([r for r in rows if lo <= r[0] < lo + 20], schema).coalesce(1) \
            .write.mode("append").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    ST.every_nth_batchwise(stream, "user_id", ["ts", "event_id"], 4, f"{tmp_dir}/o", f"{tmp_dir}/st", f"{tmp_dir}/ck")
    got = sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_dir}/o").collect())
    want = []
    for u in (3, 7):
        ids = [r[0] for r in rows if r[2] == u]
        want += [e for k, e in enumerate(ids, 1) if k % 4 == 0]
    assert got == sorted(want)
    assert len([d for d in os.listdir(f"{tmp_dir}/st") if d.startswith("batch=")]) == 3


def test_rolling_mean_batchwise_across_batches(spark, tmp_dir):
    """Three files streamed one per trigger: the halo of the last k-1 rows per
    source carries over, and the means equal the batch rolling mean."""
    rows = [(i, i, 7 if i % 5 else 3, float((i * 37) % 11)) for i in range(1, 61)]
    src = f"{tmp_dir}/events"
    schema = "event_id long, ts long, user_id long, value double"
    for lo in (1, 21, 41):
        spark.createDataFrame([r for r in rows if lo <= r[0] < lo + 20], schema).coalesce(1) \
            .write.mode("append").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    ST.rolling_mean_batchwise(stream, "user_id", ["ts", "event_id"], "value", "event_id", 5,
                              f"{tmp_dir}/o", f"{tmp_dir}/st", f"{tmp_dir}/ck", chunk_rows=3)
    got = {r["event_id"]: r["rolling"] for r in spark.read.parquet(f"{tmp_dir}/o").collect()}
    want = {}
    for u in (3, 7):
        vals = [(r[0], r[3]) for r in rows if r[2] == u]
        for j, (e, _v) in enumerate(vals):
            win = [v for _, v in vals[max(0, j - 4): j + 1]]
            want[e] = sum(win) / len(win)
    assert got.keys() == want.keys()
    assert all(abs(got[e] - want[e]) < 1e-12 for e in want)


def test_silent_sources_leave_the_state(spark, tmp_dir):
    """Source 2 is silent for two of four micro-batches: with a short time to
    live it starts anew in the last one, with a long one it goes on."""
    batches = [[(1, 1), (2, 2), (3, 2), (4, 1)], [(50, 1)], [(60, 1)], [(70, 2), (71, 2), (72, 1), (73, 2)]]
    for b in batches:
        spark.createDataFrame([(e, e, u, float(e)) for e, u in b], "event_id long, t long, user_id long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_dir}/ev")
    schema = spark.read.parquet(f"{tmp_dir}/ev").schema
    for idle, kept, mean in (("10 seconds", 73, 70.0), ("1 day", 70, 25.0)):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/ev") \
            .select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id", "value")
        name = str(idle).replace(" ", "")
        out = ST.run_available(ST.every_nth(stream, "user_id", ["ts", "event_id"], 3, idle=idle), f"{tmp_dir}/n{name}", f"{tmp_dir}/nc{name}")
        assert {r.event_id for r in out.where("user_id = 2").collect()} == {kept}, idle
        roll = ST.run_available(ST.rolling_mean_stream(stream, "user_id", ["ts", "event_id"], "value", "event_id", 3, idle=idle), f"{tmp_dir}/r{name}", f"{tmp_dir}/rc{name}")
        assert roll.where("event_id = 70").first().rolling == mean
