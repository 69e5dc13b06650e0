"""Vector-table operators: per-dimension statistics, class prototypes,
item x class scoring, ranking and zero-shot classification.

Per-dimension statistics are ``posexplode`` + grouped aggregation; mean vectors
are one vector aggregate per key, so partial aggregation happens map-side.  Item x class scoring never forms pairs as rows: the class matrix
(size checked, bounded by the number of classes) is a scalar subquery that
Spark evaluates once and ships with the tasks; each item row computes its
score array in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as TX
from ..functions import vectors as V
from ..session import cut_lineage
from .sequence import RANGE, global_row_index, running_sum

# Largest class matrix (classes x vector width) carried by one scalar subquery.
MAX_MATRIX_VALUES = 4_000_000


def explode_dims(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vec).alias("dim", "x"))


def scaler_fit(df: DataFrame, vec: str) -> DataFrame:
    """Per-dimension mean and population sd (sd 0 -> 1): rows (dim, mean, sd)."""
    return (explode_dims(df, [], vec).groupBy("dim")
            .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("_sd"))
            .select("dim", "mean", F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd")).alias("sd")))


def scaler_apply(df: DataFrame, vec: str, stats: DataFrame, out: str | None = None) -> DataFrame:
    """``(x - mean) / sd`` with the fitted arrays as scalar subqueries (size = dims)."""
    a = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "sd"))).alias("a")).select(
        F.struct(F.transform("a", lambda s: s["mean"]).alias("m"), F.transform("a", lambda s: s["sd"]).alias("s"))
    ).scalar()
    # Subqueries may not sit inside higher-order functions: project them first.
    tmp = df.withColumn("_st", a).withColumn("_mean", F.col("_st.m")).withColumn("_sd", F.col("_st.s")).drop("_st")
    return tmp.withColumn(out or vec, V.scale(vec, "_mean", "_sd")).drop("_mean", "_sd")


def mean_vectors(df: DataFrame, keys: list[str], vec: str, out: str = "mean_vec",
                 normalize_input: bool = False, normalize_output: bool = False, dims: int | None = None) -> DataFrame:
    """Per-key mean vector (temporal mean of frames, class prototype of prompts):
    one vector aggregate, so a task hands on one partial sum per key.  Null
    vectors are left out.  For very many keys of short vectors, ``dims`` (their
    length, any other is an error) averages each component by itself, which
    Spark does in a plain hash aggregate."""
    v = (V.l2_normalize(vec) if normalize_input else F.col(vec)).cast("array<double>")
    if dims:
        wrong = F.raise_error(F.lit(f"a vector is not of length {dims}")).cast("array<double>")
        parts = df.select(*keys, v.alias("_a")).where("_a is not null").withColumn("_a", F.when(F.size("_a") == dims, F.col("_a")).otherwise(wrong))
        res = (parts.groupBy(*keys).agg(*[F.avg(F.col("_a")[i]).alias(f"_m{i}") for i in range(dims)])
               .select(*keys, F.array(*[f"_m{i}" for i in range(dims)]).alias(out)))
        return res.withColumn(out, V.l2_normalize(out)) if normalize_output else res
    mean = vector_to_array(Summarizer.mean(F.col("_v")))
    res = (df.select(*keys, v.alias("_a")).where("_a is not null").select(*keys, array_to_vector("_a").alias("_v"))
           .groupBy(*keys).agg(mean.alias(out)))
    return res.withColumn(out, V.l2_normalize(out)) if normalize_output else res


def class_prototypes(prompts: DataFrame, cls: str, vec: str, out: str = "prototype") -> DataFrame:
    """Normalise each prompt vector, average per class, normalise again."""
    return mean_vectors(prompts, [cls], vec, out, normalize_input=True, normalize_output=True)


def _class_matrix(classes: DataFrame, cls: str, vec: str) -> Column:
    """All class vectors, sorted by class id, as one scalar subquery (the
    caller has checked its size)."""
    arr = classes.agg(F.array_sort(F.collect_list(F.struct(F.col(cls).alias("c"), F.col(vec).alias("v")))).alias("m"))
    return arr.select("m").scalar()


def _score_block(items: DataFrame, vec: str, classes: DataFrame, cls: str, cvec: str, out: str,
                 scale: float, engine: str) -> DataFrame:
    items = items.withColumn("_cm", _class_matrix(classes, cls, cvec))
    ids = F.transform("_cm", lambda s: s["c"])
    if engine == "sql":
        sc = F.transform("_cm", lambda s: F.lit(scale) * V.dot(F.col(vec), s["v"]))
        return items.withColumn(out, sc).withColumn("class_ids", ids).drop("_cm")
    rows = classes.select(cls, cvec).orderBy(cls).collect()  # one block: size checked by the caller
    mat = np.array([r[cvec] for r in rows], dtype=float).T * scale
    bc = items.sparkSession.sparkContext.broadcast(mat)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _mm(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = bc.value
        for s in batches:
            if len(s) == 0:
                yield pd.Series([], dtype=object)
                continue
            yield pd.Series(list(np.vstack(s.to_numpy()) @ w))

    return items.withColumn(out, _mm(F.col(vec))).withColumn("class_ids", ids).drop("_cm")


def score_matrix(items: DataFrame, vec: str, classes: DataFrame, cls: str, cvec: str,
                 out: str = "scores", scale: float = 100.0, engine: str = "sql",
                 max_values: int = MAX_MATRIX_VALUES) -> DataFrame:
    """Add ``out`` = array of ``scale * <item, class>`` in class order (classes
    sorted by id) and ``class_ids`` (the order).  Vectors are expected to be
    normalised already (cosine).  ``engine='numpy'`` runs the products as an
    Arrow batch matrix multiply.

    The class matrix shipped with the tasks holds at most ``max_values``
    numbers (classes x width, checked with a bounded probe).  A larger class
    table is cut into blocks of that size in class order; each block is scored
    the same way, and the per-block score arrays of an item (one row per
    block) are concatenated in block order, so the result is exact and no
    task or broadcast holds more than one block."""
    # one aggregate job gives both the class count and the vector width
    st = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(cvec)).alias("w")).first()
    per_block = max(1, int(max_values) // int(st["w"] or 1))
    if st["n"] <= per_block:
        return _score_block(items, vec, classes, cls, cvec, out, scale, engine)
    # fixed item ids and block assignment, written once (every block reads them)
    keyed = cut_lineage(items.withColumn("_item", F.monotonically_increasing_id()))
    blocked = cut_lineage(global_row_index(classes.select(cls, cvec), [cls], "_ci")
                          .withColumn("_blk", F.floor(F.col("_ci") / per_block)))
    n_blocks = int(blocked.agg(F.max("_blk").alias("b")).first()["b"]) + 1
    parts = None
    for b in range(n_blocks):
        part = _score_block(keyed.select("_item", vec), vec, blocked.where(F.col("_blk") == b), cls, cvec,
                            "_s", scale, engine)
        part = part.select("_item", F.lit(b).alias("_blk"), "_s", F.col("class_ids").alias("_ids"))
        parts = part if parts is None else parts.unionByName(part)
    merged = (parts.groupBy("_item")          # one row per block for each item: bounded
              .agg(F.array_sort(F.collect_list(F.struct("_blk", "_s", "_ids"))).alias("_p"))
              .select("_item", F.flatten(F.transform("_p", lambda p: p["_s"])).alias(out),
                      F.flatten(F.transform("_p", lambda p: p["_ids"])).alias("class_ids")))
    return keyed.join(merged, "_item").drop("_item")


def _top_of_block(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row the columns of the k largest scores, largest first; of equal
    scores the later column first."""
    n, k = scores.shape[1], min(k, scores.shape[1])
    if n > 4 * k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        tied = (scores >= least[:, None]).sum(axis=1) > k           # more candidates than places
        cols = np.argpartition(scores, n - k, axis=1)[:, n - k:]
        for i in np.flatnonzero(tied):
            cols[i] = n - 1 - np.argsort(-scores[i, ::-1], kind="stable")[:k]
        order = np.lexsort((-cols, -np.take_along_axis(scores, cols, 1)), axis=1)
        return np.take_along_axis(cols, order, 1)
    return n - 1 - np.argsort(-scores[:, ::-1], axis=1, kind="stable")[:, :k]


def _block_scorer(block, first: int, k: int, scale: float, kind: pa.DataType):
    """One block of classes (broadcast: matrix with a column per class, ids) and
    batches of items with the vector ``_x``: every other column, the k best
    classes as (negative score, negative class position, id), and the parts of
    the log-sum-exp."""
    def run(batches):
        w, ids = block.value
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            scores = scale * (x @ w)
            cols = _top_of_block(scores, k)
            peak = scores.max(axis=1)
            total = np.exp(scores - peak[:, None]).sum(axis=1)
            offsets = np.arange(0, cols.size + 1, cols.shape[1], dtype=np.int32)
            flat = cols.ravel()
            best = pa.StructArray.from_arrays([pa.array(-np.take_along_axis(scores, cols, 1).ravel()), pa.array(-(flat.astype(np.int64) + first)),
                                               pa.array([ids[i] for i in flat.tolist()], kind)], names=["ns", "ni", "c"])
            rest = b.drop_columns(["_x"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.ListArray.from_arrays(pa.array(offsets), best), pa.array(peak), pa.array(total)],
                                             names=[*rest.schema.names, "_top", "_peak", "_total"])
    return run


def top_classes(items: DataFrame, vec: str, classes: DataFrame, cls: str, cvec: str, k: int = 5, scale: float = 100.0,
                max_values: int = MAX_MATRIX_VALUES) -> DataFrame:
    """Add ``top`` = array of (rank, class_id, score) of the ``k`` best classes
    by ``scale * <item, class>`` and ``lse``, the log-sum-exp over all classes
    (so ``exp(score - lse)`` is the softmax).  Ties go to the later class in id
    order.

    Classes are cut into blocks of at most ``max_values`` numbers (classes x
    width).  A block is broadcast and multiplied with batches of items; what an
    item keeps of a block is k pairs and two numbers, whatever the number of
    classes is, and the blocks' pairs are merged per item.  With one block it is
    a map-only pass.  Without a class there is an empty ``top`` and a null ``lse``."""
    spark = items.sparkSession
    st = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(cvec)).alias("w")).first()
    kind = classes.schema[cls].dataType
    entry = f"struct<rank:int,class_id:{kind.simpleString()},score:double>"
    if not st["n"]:
        return items.withColumn("top", F.array().cast(f"array<{entry}>")).withColumn("lse", F.lit(None).cast("double"))
    per_block = max(1, int(max_values) // int(st["w"] or 1))
    numbered = classes.select(F.col(cls).alias("class_id"), F.col(cvec).cast("array<double>").alias("_v"))
    one = st["n"] <= per_block
    if not one:
        numbered = cut_lineage(global_row_index(numbered, ["class_id"], "_ci"))
    keyed = items if one else cut_lineage(items.withColumn("_item", F.monotonically_increasing_id()))
    x = F.col(vec).cast("array<double>").alias("_x")
    kept = keyed.select("*", x) if one else keyed.select("_item", x)
    best = T.StructType([T.StructField("ns", T.DoubleType()), T.StructField("ni", T.LongType()), T.StructField("c", kind)])
    schema = T.StructType([*[f for f in kept.schema if f.name != "_x"], T.StructField("_top", T.ArrayType(best)),
                           T.StructField("_peak", T.DoubleType()), T.StructField("_total", T.DoubleType())])
    parts = []
    for first in range(0, st["n"], per_block):
        mine = numbered.orderBy("class_id") if one else numbered.where((F.col("_ci") >= first) & (F.col("_ci") < first + per_block)).orderBy("_ci")
        block = mine.collect()                                   # at most max_values numbers
        matrix = spark.sparkContext.broadcast((np.array([r["_v"] for r in block], dtype=float).T, [r["class_id"] for r in block]))
        parts.append(kept.mapInArrow(_block_scorer(matrix, first, k, scale, to_arrow_type(kind)), schema))
    top = F.transform("_top", lambda t, i: F.struct((i + 1).cast("int").alias("rank"), t["c"].alias("class_id"), (-t["ns"]).alias("score"))).alias("top")
    if one:
        return parts[0].select(*items.columns, top, (F.col("_peak") + F.log("_total")).alias("lse"))
    peak = F.array_max(F.transform("_p", lambda p: p["_peak"]))
    merged = reduce(DataFrame.unionByName, parts).groupBy("_item").agg(F.collect_list(F.struct("_top", "_peak", "_total")).alias("_p")) \
        .select("_item", "_p", F.slice(F.array_sort(F.flatten(F.transform("_p", lambda p: p["_top"]))), 1, k).alias("_top"), peak.alias("_peak")) \
        .select("_item", top, (F.col("_peak") + F.log(F.aggregate("_p", F.lit(0.0), lambda a, p: a + p["_total"] * F.exp(p["_peak"] - F.col("_peak"))))).alias("lse"))
    return keyed.join(merged, "_item").drop("_item")


def top_pairs(df: DataFrame, keys: list[str], with_prob: bool = True) -> DataFrame:
    """One row per (item, rank) of ``top_classes``: class, score and softmax
    probability."""
    out = df.select(*keys, "lse", F.explode("top").alias("_t")).select(*keys, "lse", "_t.*")
    return (out.withColumn("prob", F.exp(F.col("score") - F.col("lse"))) if with_prob else out).drop("lse")


def top_hit_rates(df: DataFrame, label: str, ks=(1, 5), by: list[str] | None = None) -> DataFrame:
    """Share of items whose true label is among their best ``k`` (``top_classes``
    with the largest of ``ks``)."""
    hits = [F.avg(F.exists(F.slice("top", 1, k), lambda t: t["class_id"] == F.col(label)).cast("double")).alias(f"top{k}") for k in ks]
    return df.groupBy(*by).agg(*hits) if by else df.agg(*hits)


def ranked_classes(scores: Column, class_ids: Column) -> Column:
    """Array of (rank, class, score) sorted by score desc; ties go to the higher
    class index (classes are held in ascending id order)."""
    pairs = F.arrays_zip(scores.alias("s"), class_ids.alias("c"))
    srt = F.array_sort(F.transform(pairs, lambda p, i: F.struct((-p["s"]).alias("ns"), (-i).alias("ni"),
                                                                  p["c"].alias("c"), p["s"].alias("s"))))
    return F.transform(srt, lambda p, i: F.struct((i + 1).alias("rank"), p["c"].alias("class_id"),
                                                  p["s"].alias("score")))


def top_labels(df: DataFrame, keys: list[str], scores: str = "scores", k: int = 5,
               with_prob: bool = True) -> DataFrame:
    """One row per (item, rank <= k) with class, score and softmax probability."""
    r = ranked_classes(F.col(scores), F.col("class_ids"))
    base = df.select(*keys, F.slice(r, 1, k).alias("_top"),
                     (V.logsumexp(scores) if with_prob else F.lit(None)).alias("_lse"))
    out = base.select(*keys, "_lse", F.explode("_top").alias("_t"))
    cols = [*keys, F.col("_t.rank").alias("rank"), F.col("_t.class_id").alias("class_id"),
            F.col("_t.score").alias("score")]
    if with_prob:
        cols.append(F.exp(F.col("_t.score") - F.col("_lse")).alias("prob"))
    return out.select(*cols)


def topk_hits(df: DataFrame, label: str, scores: str = "scores", ks=(1, 5)) -> DataFrame:
    """Add ``hit_k`` columns: true label among the top k (ties to the higher class)."""
    r = ranked_classes(F.col(scores), F.col("class_ids"))
    for k in ks:
        df = df.withColumn(f"hit_{k}", F.exists(F.slice(r, 1, k), lambda t: t["class_id"] == F.col(label)))
    return df


def topk_accuracy(df: DataFrame, label: str, scores: str = "scores", ks=(1, 5), by: list[str] | None = None) -> DataFrame:
    h = topk_hits(df, label, scores, ks)
    aggs = [F.avg(F.col(f"hit_{k}").cast("double")).alias(f"top{k}") for k in ks]
    return h.groupBy(*by).agg(*aggs) if by else h.agg(*aggs)


def prompt_grid(classes: DataFrame, cls: str, names: str, templates: list[str]) -> DataFrame:
    """Class x template prompt texts: each class row expands over the (fixed,
    small) template list; synonyms in ``names`` (array) expand too."""
    tl = F.array(*[F.lit(t) for t in templates])
    return (classes.select(cls, F.explode(names).alias("name"))
            .select(cls, "name", F.posexplode(tl).alias("template_idx", "template"))
            .withColumn("prompt", TX.fill_template(F.col("template"), F.col("name"))))


def zero_shot(items: DataFrame, keys: list[str], vec: str, prompts: DataFrame, cls: str, pvec: str,
              k: int = 5) -> DataFrame:
    """Prototype per class from prompt vectors, cosine x 100 scores, top-k labels."""
    protos = class_prototypes(prompts, cls, pvec)
    return top_pairs(top_classes(items.withColumn(vec, V.l2_normalize(vec)), vec, protos, cls, "prototype", k), keys)


def word_numbers(tokens: DataFrame, keys: list[str], order: str, piece: str, end_marker: str = "</w>",
                 out: str = "word_no", chunk=RANGE) -> DataFrame:
    """Sub-token -> word number (WN-09): a word ends at a piece carrying the
    end-of-word marker, so the word number is the count of such pieces before
    this one.  Special tokens and padding should be removed first.  The count
    is two-level over range chunks, so one very long text is not one task."""
    ends = F.col(piece).endswith(end_marker).cast("long")
    return running_sum(tokens, keys, [order], ends, out, inclusive=False, chunk=chunk)


def pool_subwords(tokens: DataFrame, keys: list[str], order: str, piece: str, vec: str,
                  out: str = "word_vec", chunk=RANGE, dims: int | None = None) -> DataFrame:
    """Word vector = mean of its sub-token vectors (AG-13)."""
    numbered = word_numbers(tokens, keys, order, piece, chunk=chunk)
    return mean_vectors(numbered, [*keys, "word_no"], vec, out, dims=dims)
