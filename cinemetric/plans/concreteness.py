"""Expression concreteness scoring as one Spark job graph.

read -> drop null text -> language routing / translation lookup ->
word / multiword / sentence route -> embed each distinct text once ->
regressor per route -> clamp -> z-normalise per route -> sentence path by
words -> tail smoothing over all rows -> clamp -> prediction table.

No row order is carried through the driver: every row keeps its key and the
routes are one DataFrame with a route column (no split and merge by position).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T
from ..functions.encoders import HashingEncoder, encode_column
from ..operators import scoring as S
from ..operators.regressor import Regressor, predict_column
from ..session import scratch_path
from . import proxies as P

SENTENCES_PER_STEP = 64      # sentences whose words are encoded together

OUTPUT_COLUMNS = ["Predicted_Concreteness", "English_Translation", "Detected_Language",
                  "Is_Multiword", "Is_Sentence", "Model_Used", "Per_Word_Predictions"]


class TextEmbedder:
    """Two encoders whose outputs are concatenated (base + affect model)."""

    def __init__(self, base=None, affect=None):
        self.base = base or HashingEncoder(32, seed=1)
        self.affect = affect or HashingEncoder(32, seed=2)

    @property
    def dim(self) -> int:
        return self.base.dim + self.affect.dim

    def embed_distinct(self, df: DataFrame, text: str, out: str = "vec") -> DataFrame:
        """Embed each distinct text once (JN-16) and return (text, vec)."""
        uniq = df.select(text).where(F.col(text).isNotNull()).distinct()
        return uniq.select(text, F.concat(encode_column(text, self.base),
                                          encode_column(text, self.affect)).alias(out))


def translate(df: DataFrame, text: str, lang: str | None, lookup: DataFrame | None) -> DataFrame:
    """Language routing (UDF-02 default): English rows pass unchanged; other rows
    take their translation from ``lookup(lang, text, translation)`` cleaned by
    ``clean_translation``; rows without a translation (the model's failure rule) keep
    their text, are marked not translated and their language becomes
    ``unknown``."""
    lang_col = F.col(lang) if lang else F.lit("en")
    df = df.withColumn("Detected_Language", F.coalesce(lang_col, F.lit("unknown")))
    if lookup is None:
        return df.withColumn("English_Translation", F.col(text)).withColumn("was_translated", F.lit(False))
    # one translation per (language, text): a lookup with repeated keys must
    # not multiply the input rows (the smallest cleaned text is kept)
    lk = (lookup.select(F.col("lang").alias("_l"), F.col("text").alias("_t"),
                        T.clean_translation("translation").alias("_tr"))
          .groupBy("_l", "_t").agg(F.min("_tr").alias("_tr")))
    j = df.join(lk, (F.col("Detected_Language") == F.col("_l")) & (F.col(text) == F.col("_t")), "left")
    is_en = F.col("Detected_Language") == "en"
    return (j.withColumn("English_Translation", F.when(is_en | F.col("_tr").isNull(), F.col(text)).otherwise(F.col("_tr")))
            .withColumn("was_translated", ~is_en & F.col("_tr").isNotNull())
            .withColumn("Detected_Language", F.when(is_en | F.col("_tr").isNotNull(), F.col("Detected_Language")).otherwise("unknown"))
            .drop("_l", "_t", "_tr"))


def predict_expressions(df: DataFrame, key: str, text: str, lang: str | None = None, *,
                        single_model: Regressor, multi_model: Regressor,
                        embedder: TextEmbedder | None = None, lookup: DataFrame | None = None,
                        sentence_norm: str = "corpus", quantile_method: str = "distributed") -> DataFrame:
    """Score every expression; returns the input columns plus ``OUTPUT_COLUMNS``.

    ``sentence_norm``: ``sentence`` z-normalises the word scores inside each
    sentence before the mean (faithful: every sentence then scores 3.0);
    ``corpus`` normalises them over all sentence words (default).
    """
    spark = df.sparkSession
    embedder = embedder or TextEmbedder()
    base = translate(df.dropna(subset=[text]), text, lang, lookup)
    tr = F.col("English_Translation")
    # the word count of a (possibly very long) text is computed once per row
    base = base.withColumn("_nw", T.n_words(tr))
    nw = F.col("_nw")
    base = (base.withColumn("Is_Multiword", nw > T.MULTIWORD_MIN_WORDS)
            .withColumn("Is_Sentence", nw > T.SENTENCE_MIN_WORDS)
            .withColumn("Model_Used", T.route_of_count(nw)).drop("_nw"))
    phrases = base.where(F.col("Model_Used") != T.ROUTE_SENTENCE)
    vecs = embedder.embed_distinct(phrases, "English_Translation")
    raw = F.when(F.col("Model_Used") == T.ROUTE_SINGLE, predict_column("vec", single_model, spark)) \
           .otherwise(predict_column("vec", multi_model, spark))
    phrases = (phrases.join(vecs, "English_Translation").withColumn("_p", S.clamp(raw)).drop("vec")
               .withColumn("_ws", F.lit(None).cast("array<double>")))
    # a word's score depends on its sentence and itself: one call per batch of
    # sentences encodes every distinct word once, so no (sentence, word) table
    # is joined or shuffled and a word that stands in most texts is no hot key
    sentences = base.where(F.col("Model_Used") == T.ROUTE_SENTENCE) \
        .withColumn("_p", F.lit(None).cast("double")) \
        .withColumn("_ws", word_scores_column(tr, T.words(tr), embedder, single_model, spark))
    # written once as Parquet: the encoders and regressors run a single time,
    # and the statistics and the tail quantile read only the score columns
    path = scratch_path(spark, "scores")
    phrases.unionByName(sentences).write.parquet(path)
    rows = spark.read.parquet(path)
    is_sentence = F.col("Model_Used") == T.ROUTE_SENTENCE
    by_route = S.znorm(rows.where(~is_sentence), "_p", by=["Model_Used"], fixed_groups=True).drop("norm_degenerate", "_ws") \
        .withColumn("Per_Word_Predictions", F.lit(""))
    sent = rows.where(is_sentence)
    if sentence_norm == "sentence":
        sent = sent.withColumn("_ws", _normalised_within("_ws"))
    else:
        ws = sent.select(F.explode("_ws").alias("w")).agg(
            F.struct(F.avg("w").alias("mu"), F.stddev_samp("w").alias("sd")).alias("s")).scalar()
        sent = sent.withColumn("_st", ws).withColumn("_ws", _normalised("_ws", F.col("_st.mu"), F.col("_st.sd"))).drop("_st")
    sent = (sent.withColumn("_p", F.coalesce(F.try_divide(F.aggregate("_ws", F.lit(0.0), lambda a, x: a + x), F.size("_ws")),
                                             F.lit(S.TARGET_MEAN)))
            .withColumn("Per_Word_Predictions", F.coalesce(T.format_scores("_ws"), F.lit("3.0"))).drop("_ws"))
    allrows = S.smooth_tail(by_route.unionByName(sent), "_p", quantile_method=quantile_method)
    return allrows.withColumn("Predicted_Concreteness", S.clamp("_p")).drop("_p", "was_translated")


def _normalised(values: str, mu: Column, sd: Column) -> Column:
    """Array z-normalised with the given statistics (no spread: all 3.0)."""
    z = F.transform(values, lambda x: (x - mu) / sd * S.TARGET_SD + S.TARGET_MEAN)
    return F.when(sd.isNull() | (sd == 0), F.transform(values, lambda x: F.lit(S.TARGET_MEAN))).otherwise(z)


def _normalised_within(values: str) -> Column:
    """Array z-normalised with its own mean and sample deviation."""
    n = F.size(values)
    mu = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    square = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mu) * (x - mu))
    return _normalised(values, mu, F.sqrt(F.try_divide(square, n - 1)))


def word_scores_column(sentence: Column, words: Column, embedder: TextEmbedder, model: Regressor,
                       spark: SparkSession) -> Column:
    """Clamped score of every word (in order) given its sentence: the regressor
    on (base vector of the word, affect vector of the sentence)."""
    bc = spark.sparkContext.broadcast(model.params)

    @F.pandas_udf(ST.ArrayType(ST.DoubleType()))
    def _scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = Regressor(bc.value)
        for texts, word_lists in batches:
            out = []
            for lo in range(0, len(texts), SENTENCES_PER_STEP):
                lists = [list(w) for w in word_lists.iloc[lo:lo + SENTENCES_PER_STEP]]
                number, distinct = pd.factorize(np.array([w for ws in lists for w in ws], dtype=object))
                right = embedder.affect.encode(texts.iloc[lo:lo + SENTENCES_PER_STEP].fillna("").tolist())
                left = m.hidden_left(np.asarray(embedder.base.encode(list(distinct)), float)) if len(distinct) else None
                at = 0
                for ws, vec in zip(lists, right):
                    ids, back = np.unique(number[at:at + len(ws)], return_inverse=True)
                    at += len(ws)
                    scores = m.forward_pairs(left, ids, vec) if len(ids) else np.zeros(0)
                    out.append(np.clip(scores, S.SCORE_MIN, S.SCORE_MAX)[back])
            yield pd.Series(out, dtype=object)

    return _scores(sentence, words)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Expressions of the driver tables scored by fixed-weight regressors."""
    embedder = TextEmbedder()
    single = Regressor.init(embedder.dim, seed=11, out_bias=3.0, out_gain=40.0)
    multi = Regressor.init(embedder.dim, seed=12, out_bias=3.0, out_gain=40.0)
    df = P.p_expr(spark, sf)
    res = predict_expressions(df, "id", "text", "lang", single_model=single, multi_model=multi, embedder=embedder)
    return res.select("id", *OUTPUT_COLUMNS)
