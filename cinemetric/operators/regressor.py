"""Scaled 3-layer ReLU regressor (d -> 128 -> 64 -> 1) on vector columns.

Scoring (ML-01) is an Arrow pandas UDF doing NumPy matrix products on whole
batches; the weights travel once per executor as a broadcast variable.
Fitting (ML-02) is full-batch gradient descent with Adam: each epoch one Spark
job computes partial gradients per partition (``mapInArrow``) and adds them up
in two levels of vector aggregates; one gradient reaches the driver, however
many partitions there are.  Weights are stored as Parquet rows
``(name, shape, values)`` (SNK-10), never pickled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread_by_rows

# Layer widths and training settings of the reference regressor.
HIDDEN = (128, 64)
LEARNING_RATE = 5e-4
MAX_EPOCHS = 100
PATIENCE = 5
ORDER = ["scale_mean", "scale_sd", "w1", "b1", "w2", "b2", "w3", "b3"]


@dataclass
class Regressor:
    params: dict = field(default_factory=dict)

    @staticmethod
    def init(dim: int, seed: int = 0, out_bias: float = 0.0, out_gain: float = 1.0) -> "Regressor":
        """Uniform(-1/sqrt(fan_in), 1/sqrt(fan_in)) weights; ``out_bias``/``out_gain``
        place an untrained net's output on the rating scale."""
        rng = np.random.default_rng(seed)
        p = {"scale_mean": np.zeros(dim), "scale_sd": np.ones(dim)}
        sizes = [dim, *HIDDEN, 1]
        for i, (a, b) in enumerate(zip(sizes[:-1], sizes[1:]), start=1):
            bound = 1.0 / np.sqrt(a)
            p[f"w{i}"] = rng.uniform(-bound, bound, size=(a, b))
            p[f"b{i}"] = rng.uniform(-bound, bound, size=(b,))
        p["w3"] *= out_gain
        p["b3"] = p["b3"] * out_gain + out_bias
        return Regressor(p)

    @property
    def dim(self) -> int:
        return int(self.params["w1"].shape[0])

    def forward(self, x: np.ndarray) -> np.ndarray:
        p = self.params
        z = (x - p["scale_mean"]) / p["scale_sd"]
        h1 = np.maximum(z @ p["w1"] + p["b1"], 0)
        h2 = np.maximum(h1 @ p["w2"] + p["b2"], 0)
        return (h2 @ p["w3"] + p["b3"])[:, 0]

    def hidden_left(self, left: np.ndarray) -> np.ndarray:
        """First-layer share of the leading input columns (reused for every
        right half these are paired with)."""
        p, d = self.params, left.shape[1]
        return ((left - p["scale_mean"][:d]) / p["scale_sd"][:d]) @ p["w1"][:d]

    def forward_pairs(self, left: np.ndarray, ids: np.ndarray, right: np.ndarray, step: int = 8192) -> np.ndarray:
        """``forward`` of the rows (left vector ``ids[i]``, right vector), with
        ``left`` from ``hidden_left``; ``step`` rows are held at once."""
        p, d = self.params, len(self.params["scale_mean"]) - len(right)
        share = ((right - p["scale_mean"][d:]) / p["scale_sd"][d:]) @ p["w1"][d:] + p["b1"]
        out = np.empty(len(ids))
        for lo in range(0, len(ids), step):
            h1 = np.maximum(left[ids[lo:lo + step]] + share, 0)
            h2 = np.maximum(h1 @ p["w2"] + p["b2"], 0)
            out[lo:lo + step] = (h2 @ p["w3"] + p["b3"])[:, 0]
        return out

    def grads(self, x: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        """Sum (not mean) of squared-error gradients over the rows."""
        p = self.params
        z = (x - p["scale_mean"]) / p["scale_sd"]
        a1 = z @ p["w1"] + p["b1"]
        h1 = np.maximum(a1, 0)
        a2 = h1 @ p["w2"] + p["b2"]
        h2 = np.maximum(a2, 0)
        out = (h2 @ p["w3"] + p["b3"])[:, 0]
        err = out - y
        d3 = (2 * err)[:, None]
        g = {"w3": h2.T @ d3, "b3": d3.sum(0)}
        d2 = (d3 @ p["w3"].T) * (a2 > 0)
        g["w2"], g["b2"] = h1.T @ d2, d2.sum(0)
        d1 = (d2 @ p["w2"].T) * (a1 > 0)
        g["w1"], g["b1"] = z.T @ d1, d1.sum(0)
        return g, float((err ** 2).sum())

    # ------------------------------------------------------------ persistence
    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, list(map(int, self.params[k].shape)), self.params[k].ravel().astype(float).tolist())
                for k in ORDER]
        return spark.createDataFrame(rows, "name string, shape array<int>, values array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Regressor":
        # The artefact is eight small rows; reading it on the driver is bounded.
        rows = spark.read.parquet(path).collect()
        return Regressor({r["name"]: np.array(r["values"], dtype=float).reshape(r["shape"]) for r in rows})


def predict_column(vec: Column | str, model: Regressor, spark: SparkSession) -> Column:
    """Raw regressor output for an ``array<double>`` column."""
    bc = spark.sparkContext.broadcast(model.params)

    @F.pandas_udf(T.DoubleType())
    def _predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Regressor(bc.value)
        for s in batches:
            if len(s) == 0:
                yield pd.Series([], dtype=float)
                continue
            x = np.vstack(s.to_numpy()).astype(float)
            yield pd.Series(m.forward(x))

    return _predict(F.col(vec) if isinstance(vec, str) else vec)


def fit_scaler(df: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """Per-dimension mean and population sd (sd 0 -> 1), by one vector aggregate."""
    moments = Summarizer.metrics("mean", "variance", "count").summary(F.col("_v"))
    r = df.select(array_to_vector(F.col(vec)).alias("_v")).agg(moments.alias("s")).select("s.*").first()
    m, n = r["mean"].toArray(), r["count"]
    s = np.sqrt(r["variance"].toArray() * (n - 1) / n)
    return m, np.where(s > 0, s, 1.0)


WEIGHTS = ["w1", "b1", "w2", "b2", "w3", "b3"]


def _partials(params: dict, batch_rows: int = 4096):
    def run(batches):
        m = Regressor(params)
        acc, loss, n = None, 0.0, 0
        for b in batches:
            for lo in range(0, b.num_rows, batch_rows):
                part = b.slice(lo, batch_rows)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                g, more = m.grads(x, part.column("y").to_numpy(zero_copy_only=False))
                flat = np.concatenate([g[k].ravel() for k in WEIGHTS])
                acc = flat if acc is None else acc + flat
                loss, n = loss + more, n + part.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"g": [acc.tolist()], "loss": [loss], "n": [n]})
    return run


def gradient(data: DataFrame, model: Regressor) -> tuple[dict, float, int]:
    """(mean squared-error gradient per weight, mean loss, rows) over ``data``
    (x, y), summed as a tree: partitions, groups of them, the total."""
    parts = data.select("x", "y").mapInArrow(_partials(model.params), "g array<double>, loss double, n long")
    fan = max(1, int(np.sqrt(data.rdd.getNumPartitions())))
    total = Summarizer.sum(F.col("g")).alias("g")
    sums = [F.sum("loss").alias("loss"), F.sum("n").alias("n")]
    some = parts.select(F.pmod(F.spark_partition_id(), F.lit(fan)).alias("k"), array_to_vector("g").alias("g"), "loss", "n").groupBy("k").agg(total, *sums)
    r = some.groupBy(F.lit(0).alias("all")).agg(total, *sums).first()      # grouped: no row, not an error, without rows
    if r is None:
        return {k: np.zeros_like(model.params[k]) for k in WEIGHTS}, 0.0, 0
    flat, out, at = r["g"].toArray() / r["n"], {}, 0
    for k in WEIGHTS:
        size = model.params[k].size
        out[k] = flat[at:at + size].reshape(model.params[k].shape)
        at += size
    return out, r["loss"] / r["n"], r["n"]


def mean_loss(data: DataFrame, model: Regressor) -> float:
    """Mean squared error over ``data`` (x, y)."""
    p = predict_column("x", model, data.sparkSession)
    return data.select((p - F.col("y")).alias("e")).agg(F.avg(F.col("e") * F.col("e"))).first()[0]


def unite(*labelled: DataFrame) -> DataFrame:
    """Labelled lists (text, rating) as one training list, each row with the
    number of its list (``part``); every list keeps its repeated texts."""
    return reduce(DataFrame.unionByName, [d.select("text", F.col("rating").cast("double").alias("rating"), F.lit(i).alias("part")) for i, d in enumerate(labelled)])


def fit(df: DataFrame, vec: str, label: str, seed: int = 0, lr: float = LEARNING_RATE, max_epochs: int = MAX_EPOCHS,
        patience: int = PATIENCE, held_out: Column | str | None = None) -> tuple[Regressor, list[float]]:
    """Full-batch MSE training with Adam and early stopping: after ``patience``
    epochs without a better loss.  The loss is that of the training rows, as in
    the reference, or of the rows where ``held_out`` is true, which are then not
    learned from.  Keeps the best weights (the reference keeps the last ones
    because of a shallow copy).  Rows with a null vector or label are left out.
    Returns the model and the training (or held-out) loss of every epoch."""
    out = F.lit(False) if held_out is None else F.coalesce(F.expr(held_out) if isinstance(held_out, str) else held_out, F.lit(False))
    # kept in parts of a bounded size: a task reads its part once an epoch
    data = spread_by_rows(df).select(F.col(vec).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), out.alias("held")) \
        .where("x is not null and y is not null").persist()
    learned, judged = data.where("not held"), data.where("held")
    head = learned.first()
    if head is None:
        raise ValueError("no labelled row to learn from")
    model = Regressor.init(len(head["x"]), seed)
    model.params["scale_mean"], model.params["scale_sd"] = fit_scaler(learned, "x")
    m1 = {k: np.zeros_like(model.params[k]) for k in WEIGHTS}
    m2 = {k: np.zeros_like(model.params[k]) for k in WEIGHTS}
    b1_, b2_, eps = 0.9, 0.999, 1e-8
    best, best_params, bad, losses = np.inf, None, 0, []
    for epoch in range(1, max_epochs + 1):
        grad, loss, _ = gradient(learned, model)
        if held_out is not None:
            loss = mean_loss(judged, model)
            if loss is None:
                raise ValueError("no held-out row to stop by")
        losses.append(loss)
        if loss < best - 1e-12:
            best, bad = loss, 0
            best_params = {k: v.copy() for k, v in model.params.items()}
        else:
            bad += 1
            if bad >= patience:
                break
        for k in WEIGHTS:
            m1[k] = b1_ * m1[k] + (1 - b1_) * grad[k]
            m2[k] = b2_ * m2[k] + (1 - b2_) * grad[k] ** 2
            mh, vh = m1[k] / (1 - b1_ ** epoch), m2[k] / (1 - b2_ ** epoch)
            model.params[k] = model.params[k] - lr * mh / (np.sqrt(vh) + eps)
    data.unpersist()
    return Regressor(best_params or model.params), losses
