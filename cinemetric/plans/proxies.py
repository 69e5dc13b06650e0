"""Views of the driver tables shaped like the reference's inputs.

Each proxy exists twice: as a Spark DataFrame builder (used by the registered
queries) and as a DuckDB common-table expression (used by the oracle SQL), so
both engines start from the same rows.  Every proxy is derived from the given
tables, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

# Fixed values of the proxies (FIXTURES.md section 3).
FPS = 8
FRAMES_PER_TURN = 48      # frames per caption slot of 6 s at 8 fps
MISSING_FRAME_EVERY = 101  # every 101st frame is missing on disk
BOX_FRAME_EVERY = 3        # frames divisible by 3 carry no person box
TEST_EVERY = 5             # vec_id % 5 = 0 is the test fifth
VEC_BATCH = 50             # vectors per batch


def p_expr(spark: SparkSession, sf: str) -> DataFrame:
    nation = read_table(spark, sf, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
        F.col("n_name").alias("text"), F.lit("en").alias("lang"))
    part = read_table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("text"), F.lit("en").alias("lang"))
    docs = read_table(spark, sf, "documents", spread_rows=True).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text", "lang")
    return nation.unionByName(part).unionByName(docs)


P_EXPR_SQL = """p_expr AS (
  SELECT concat('n', n_nationkey) AS id, n_name AS text, 'en' AS lang FROM nation
  UNION ALL SELECT concat('p', p_partkey), p_name, 'en' FROM part
  UNION ALL SELECT concat('d', doc_id), text, lang FROM documents)"""


def p_score(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("route"),
        (F.lit(1.0) + F.lit(4.0) * (F.col("l_quantity") - 1) / 49).alias("pred"),
        (F.lit(1.0) + F.lit(40.0) * F.col("l_discount")).alias("truth"))


P_SCORE_SQL = """p_score AS (
  SELECT l_orderkey, l_linenumber, l_returnflag AS route,
         1 + 4*(l_quantity-1)/49 AS pred, 1 + 40*l_discount AS truth FROM lineitem)"""


def p_caption(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "conversations", spread_rows=True).select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("cap_idx"), "text",
        (F.col("turn").cast("double") * 6).alias("start"),
        (F.lit(2) + F.length("text") % 7).cast("double").alias("duration"))


P_CAPTION_SQL = """p_caption AS (
  SELECT conv_id AS video_id, turn AS cap_idx, text, CAST(turn AS double)*6 AS start,
         CAST(2 + length(text) % 7 AS double) AS duration FROM conversations)"""


def p_frame(spark: SparkSession, sf: str) -> DataFrame:
    # dealt by a fixed count: the few bytes before the explode would be coalesced
    # into a handful of tasks that then make all frames
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = (read_table(spark, sf, "conversations").select("conv_id", "turn").repartition(parts, "conv_id").groupBy("conv_id")
         .agg(((F.max("turn") + 1) * FRAMES_PER_TURN).cast("long").alias("n")))
    frames = n.select(F.col("conv_id").alias("video_id"),
                      F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1)).alias("frame_idx"))
    return (frames.where(F.col("frame_idx") % MISSING_FRAME_EVERY != 0)
            .withColumn("has_box", F.col("frame_idx") % BOX_FRAME_EVERY != 0))


P_FRAME_SQL = """p_frame AS (
  SELECT video_id, f AS frame_idx, f % 3 <> 0 AS has_box FROM (
    SELECT video_id, unnest(range(1, n)) AS f FROM (
      SELECT conv_id AS video_id, CAST((max(turn)+1)*48 AS bigint) AS n FROM conversations GROUP BY 1))
  WHERE f % 101 <> 0)"""


def p_neutral(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("cap_idx"),
        ((F.length("text") % 100) / 100.0).alias("neutral"))


P_NEUTRAL_SQL = """p_neutral AS (
  SELECT conv_id AS video_id, turn AS cap_idx, (length(text) % 100)/100.0 AS neutral FROM conversations)"""


def p_cut(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("movie_id"), (F.col("event_id") + 1).alias("start_frame"))


P_CUT_SQL = """p_cut AS (SELECT user_id % 10 AS movie_id, event_id + 1 AS start_frame FROM events)"""


def p_box(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    x1 = F.floor(F.abs(e[0]) * 640)
    y1 = F.floor(F.abs(e[1]) * 640)
    return read_table(spark, sf, "embeddings").select(
        "vec_id", "label", x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
        (x1 + 8 + F.floor(F.abs(e[2]) * 400)).cast("double").alias("x2"),
        (y1 + 8 + F.floor(F.abs(e[3]) * 400)).cast("double").alias("y2"),
        F.least(F.lit(1.0), F.abs(e[4]).cast("double") * 4).alias("score"))


P_BOX_SQL = """p_box AS (
  SELECT vec_id, label, CAST(floor(abs(embedding[1])*640) AS double) AS x1,
         CAST(floor(abs(embedding[2])*640) AS double) AS y1,
         CAST(floor(abs(embedding[1])*640)+8+floor(abs(embedding[3])*400) AS double) AS x2,
         CAST(floor(abs(embedding[2])*640)+8+floor(abs(embedding[4])*400) AS double) AS y2,
         least(1.0, CAST(abs(embedding[5]) AS double)*4) AS score FROM embeddings)"""


def p_vec(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
        (F.col("vec_id") % TEST_EVERY == 0).alias("is_test"),
        F.floor(F.col("vec_id") / VEC_BATCH).alias("batch_id"))


P_VEC_SQL = """p_vec AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS double)) AS embedding,
         vec_id % 5 = 0 AS is_test, vec_id // 50 AS batch_id FROM embeddings)"""


def p_logits(spark: SparkSession, sf: str) -> DataFrame:
    return p_vec(spark, sf).select(
        "vec_id", "label", "batch_id", "is_test",
        F.transform(F.slice("embedding", 1, 7), lambda x: x * 10).alias("logits"))


P_LOGITS_SQL = P_VEC_SQL + """,
p_logits AS (
  SELECT vec_id, label, batch_id, is_test,
         list_transform(embedding[1:7], lambda x: x * 10) AS logits FROM p_vec)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
