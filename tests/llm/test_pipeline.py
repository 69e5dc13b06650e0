"""The corpus pipeline's stages on a small table with awkward rows."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from cinemetric.llm.storage import written

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    good = docs.where("doc_id = 6").first().text
    cols = docs.schema
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, good + " more words at the end", "en", "src1", 10),
                                 (9004, good + "\n" + bench, "en", "src2", 10), (9005, 'password = "hunter2hunter2" ' + good[:900], "en", "src2", 928), (None, good[200:1500], "en", None, 5)], cols)
    repeated = docs.where("doc_id = 7")
    now = docs.unionByName(odd).unionByName(repeated).withColumn("kept", F.lit(1)).withColumn("score", F.lit("x"))
    sizes = []
    for name, stage in P.STAGES[:-1]:
        out = written(stage(spark, now, SF), "test")
        assert out.columns == now.columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if "dedup" in name:
            assert 9003 not in ids and 6 in ids and out.where("doc_id = 7").count() == 1
        if "decontamination" in name:
            assert 9004 not in ids
        if "secret" in name:
            r = out.where("doc_id = 9005").collect()
            assert all("hunter2" not in x.text and x.n_chars == 928 + len(x.text) - len('password = "hunter2hunter2" ' + good[:900]) for x in r)
        sizes.append(out.count())
        now = out
    assert sizes == sorted(sizes, reverse=True) and sizes[1] > 700
    mixed = P.STAGES[-1][1](spark, now, SF)
    assert {"doc_id", "shard", "copy", "take"} <= set(mixed.columns)
    assert mixed.groupBy("source").agg(F.sum("take").alias("t"), F.max("target").alias("w")).where("abs(t - w) > 1").count() == 0
    for name, stage in P.STAGES:
        assert stage(spark, now.limit(0), SF).count() == 0, name


def test_repeated_ids(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcdefg"}
    rows = [(3, text["a"], "en"), (5, text["a"], "fr"), (5, text["b"], "en"), (3, text["c"], "en"), (7, text["c"] + " end", "en"), (6, text["d"], "en"), (6, text["d"], "en"),
            (8, text["e"], "en"), (8, text["f"], "en"), (8, text["f"] + " end", "en"), (9, " ", "en"), (9, "", "en"), (9, None, "en"), (4, "", "en"), (None, text["g"], "en"), (None, text["a"], "en")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _row string").repartition(4)
    out = P.near_dedup(spark, docs, SF)
    assert out.schema == docs.schema
    got = sorted(((r.doc_id, r.text, r._row) for r in out.collect()), key=repr)
    assert got == sorted([rows[i] for i in (0, 2, 3, 5, 7, 8, 12, 13, 14, 15)], key=repr)
    assert P.near_dedup(spark, docs.limit(0), SF).count() == 0


def test_entry():
    import __spark_entry__ as E
    assert "pipeline" in E.queries() and "pipeline" not in E.oracle_sql()
