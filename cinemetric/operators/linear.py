"""Linear probes on vector columns with MLlib (distributed fitting).

The objectives are matched to the usual scikit-learn ones:

* ridge ``||y - Xw - b||^2 + alpha ||w||^2`` = Spark ``LinearRegression`` with
  ``standardization=False``, ``elasticNetParam=0`` and
  ``regParam = alpha * sd_pop(y) / n`` (Spark scales the loss by ``1/2n`` and
  the label by its standard deviation);
* logistic ``C * sum(logloss) + ||w||^2 / 2`` = Spark ``LogisticRegression``
  with ``regParam = 1 / (C * n)``, no standardisation.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Regularisation grid of the reference probes.
RIDGE_ALPHA = 1.0
LOGISTIC_C = {"single_label": 8.0, "multi_label": 3.16, "small": 2.5, "large": 10.0}


def _features(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vec)))


def fit_ridge(train: DataFrame, vec: str, label: str, alpha: float = RIDGE_ALPHA):
    st = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("sd")).first()
    reg = alpha * (st["sd"] or 0.0) / st["n"]
    lr = LinearRegression(featuresCol="features", labelCol=label, solver="normal", standardization=False,
                          elasticNetParam=0.0, regParam=reg, fitIntercept=True)
    return lr.fit(_features(train, vec))


def ridge_predict(train: DataFrame, test: DataFrame, vec: str, labels: list[str], alpha: float = RIDGE_ALPHA,
                  keys: list[str] | None = None) -> DataFrame:
    """One ridge fit per output column; returns keys + ``pred_<label>``."""
    keys = keys or []
    out = _features(test, vec).select(*keys, "features", *labels)
    for lab in labels:
        model = fit_ridge(train.where(F.col(lab).isNotNull()), vec, lab, alpha)
        out = model.setPredictionCol(f"pred_{lab}").transform(out)
    return out.drop("features")


def fit_logistic(train: DataFrame, vec: str, label: str, C: float, family: str = "auto",
                 max_iter: int = 2000, tol: float = 1e-10):
    n = train.count()
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (C * n),
                            elasticNetParam=0.0, standardization=False, family=family,
                            maxIter=max_iter, tol=tol)
    return lr.fit(_features(train, vec))


def logistic_scores(train: DataFrame, test: DataFrame, vec: str, label: str, C: float,
                    keys: list[str] | None = None) -> DataFrame:
    """Multinomial fit; test rows with ``probs`` (array) and ``pred`` (argmax)."""
    keys = keys or []
    model = fit_logistic(train.withColumn(label, F.col(label).cast("double")), vec, label, C, "multinomial")
    res = model.transform(_features(test, vec))
    return res.select(*keys, label, vector_to_array("probability").alias("probs"),
                      F.col("prediction").cast("int").alias("pred"))


def one_vs_rest_scores(train: DataFrame, test: DataFrame, vec: str, labels: list[str], C: float,
                       keys: list[str]) -> DataFrame:
    """Independent binary fit per label column (multi-label); long output
    ``keys, cls, y, score`` for the ranking metrics.  Spark's ``OneVsRest`` is
    multi-class, not multi-label, so it is not used."""
    parts = None
    for i, lab in enumerate(labels):
        model = fit_logistic(train.withColumn(lab, F.col(lab).cast("double")), vec, lab, C, "binomial")
        res = model.transform(_features(test, vec)).select(
            *keys, F.lit(i).alias("cls"), F.col(lab).cast("int").alias("y"),
            vector_to_array("probability")[1].alias("score"))
        parts = res if parts is None else parts.unionByName(res)
    return parts
