"""Zero-shot classification from prompt texts, and forward selection of
prompt templates.

prompts (class x template, JN-10) -> text encoder (UDF-01) -> class
prototypes (AG-12) -> item x class scores (JN-11) -> top-k (SM-05) ->
accuracy (AG-15).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.encoders import HashingEncoder, encode_column
from ..operators import vectors as O
from ..operators.sequence import global_row_index
from ..session import cut_lineage


def prompt_prototypes(classes: DataFrame, cls: str, names: str, templates: list[str], encoder) -> DataFrame:
    grid = O.prompt_grid(classes, cls, names, templates)
    # each distinct prompt text is encoded once
    texts = grid.select("prompt").distinct()
    enc = texts.select("prompt", encode_column("prompt", encoder).alias("pvec"))
    vecs = grid.join(enc, "prompt")
    return O.class_prototypes(vecs, cls, "pvec")


def zero_shot_accuracy(items: DataFrame, key: str, text: str, label: str, classes: DataFrame, cls: str,
                       names: str, templates: list[str], encoder=None, ks=(1, 5)) -> DataFrame:
    encoder = encoder or HashingEncoder(64, seed=3)
    protos = prompt_prototypes(classes, cls, names, templates, encoder)
    # a Python UDF may not sit inside a higher-order function: encode first, then normalise
    iv = items.select(key, label, encode_column(text, encoder).alias("ivec")) \
        .withColumn("ivec", V.l2_normalize("ivec"))
    return O.top_hit_rates(O.top_classes(iv, "ivec", protos, cls, "prototype", max(ks)), label, ks)


def template_sums(classes: DataFrame, cls: str, names: str, templates: list[str], encoder) -> DataFrame:
    """(template_idx, class_id, vec): per template and class the sum of the
    normalised vectors of its prompts.  A prototype of any set of templates is
    the normalised sum of theirs, so prompts are encoded once for all sets."""
    grid = O.prompt_grid(classes, cls, names, templates)
    enc = grid.select("prompt").distinct().select("prompt", encode_column("prompt", encoder).alias("v"))
    vecs = grid.join(enc, "prompt").select("template_idx", F.col(cls).alias("class_id"), array_to_vector(V.l2_normalize("v")).alias("v"))
    return vecs.groupBy("template_idx", "class_id").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("vec"))


def _best_of_block(block, first: int, whole: bool):
    """Items against one block of classes under every candidate: the best class
    of the block, or, if it is the only block, the hits per candidate."""
    def run(batches):
        candidates, ids, matrices = block.value                  # one classes x width matrix per candidate
        place = {c: i for i, c in enumerate(ids)}
        hits, n = np.zeros(len(candidates), np.int64), 0
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            at = np.array([place.get(c, -1) for c in b.column("label").to_pylist()])
            n += len(at)
            out = []
            for t, m in enumerate(matrices):
                scores = x @ m.T
                best = scores.shape[1] - 1 - scores[:, ::-1].argmax(axis=1)       # of equal ones the later class
                if whole:
                    hits[t] += int((best == at).sum())
                else:
                    out.append(pa.RecordBatch.from_arrays([b.column("item"), pa.array([candidates[t]] * len(at), pa.int32()), pa.array(scores[np.arange(len(at)), best]),
                                                           pa.array(best + first), pa.array(best == at)], names=["item", "candidate", "score", "place", "hit"]))
            yield from out
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array(candidates, pa.int32()), pa.array(hits), pa.array([n] * len(candidates), pa.int64())], names=["candidate", "hits", "n"])
    return run


def candidate_accuracy(items: DataFrame, prototypes: DataFrame, max_values: int = O.MAX_MATRIX_VALUES) -> dict[int, float]:
    """Top-1 accuracy of ``items`` (item, label, x) under every candidate of
    ``prototypes`` (candidate, class_id, vec), in one job over the items.
    Classes are cut into blocks so that all candidates of a block hold at most
    ``max_values`` numbers; items without label are left out."""
    spark = items.sparkSession
    st = prototypes.agg(F.count_distinct("candidate").alias("t"), F.count_distinct("class_id").alias("c"), F.max(F.size("vec")).alias("w")).first()
    per_block = max(1, int(max_values) // max(1, st["t"] * (st["w"] or 1)))
    known = items.where("label is not null")
    whole = st["c"] <= per_block
    order = prototypes
    if not whole:
        numbers = global_row_index(prototypes.select("class_id").distinct(), ["class_id"], "ci")
        order = cut_lineage(prototypes.join(numbers, "class_id"))
    parts = []
    for first in range(0, max(1, st["c"]), per_block):
        rows = (order if whole else order.where((F.col("ci") >= first) & (F.col("ci") < first + per_block))).orderBy("candidate", "class_id").collect()   # one block
        candidates, ids = sorted({r["candidate"] for r in rows}), sorted({r["class_id"] for r in rows})
        vecs = {(r["candidate"], r["class_id"]): r["vec"] for r in rows}
        block = spark.sparkContext.broadcast((candidates, ids, [np.array([vecs[t, c] for c in ids], float) for t in candidates]))
        schema = "candidate int, hits long, n long" if whole else "item long, candidate int, score double, place long, hit boolean"
        parts.append(known.mapInArrow(_best_of_block(block, first, whole), schema))
    if whole:
        rates = parts[0].groupBy("candidate").agg((F.sum("hits") / F.sum("n")).alias("top1"))
    else:
        best = reduce(DataFrame.unionByName, parts).groupBy("item", "candidate").agg(F.max(F.struct("score", "place", "hit")).alias("b"))
        rates = best.groupBy("candidate").agg(F.avg(F.col("b.hit").cast("double")).alias("top1"))
    return {r["candidate"]: r["top1"] for r in rates.collect()}


def select_templates(items: DataFrame, key: str, text: str, label: str, classes: DataFrame, cls: str,
                     names: str, templates: list[str], encoder=None, max_templates: int | None = None,
                     max_values: int = O.MAX_MATRIX_VALUES):
    """Greedy forward selection: at each step add the template whose addition
    gives the best top-1 accuracy (of equal ones the first); stop when no
    candidate improves it.  Items and prompts are encoded once; the chosen
    templates' sums are kept as a table, to which every candidate's are added,
    and a step is one job over the items for all its candidates.  Returns
    ``[(step, template, top1)]``."""
    encoder = encoder or HashingEncoder(64, seed=3)
    encoded = items.select(F.monotonically_increasing_id().alias("item"), F.col(label).alias("label"), encode_column(text, encoder).alias("x"))
    encoded = cut_lineage(encoded.withColumn("x", V.l2_normalize("x")))
    sums = cut_lineage(template_sums(classes, cls, names, templates, encoder))
    base, best, history, remaining = None, -1.0, [], list(range(len(templates)))
    while remaining and (max_templates is None or len(history) < max_templates):
        added = sums.where(F.col("template_idx").isin(remaining))
        if base is not None:
            added = added.join(base, "class_id").withColumn("vec", F.zip_with("vec", "base", lambda a, b: a + b))
        rates = candidate_accuracy(encoded, added.select(F.col("template_idx").cast("int").alias("candidate"), "class_id", V.l2_normalize("vec").alias("vec")), max_values)
        if not rates:
            break
        t = max(rates, key=lambda c: (rates[c], -c))
        if rates[t] <= best:
            break
        best = rates[t]
        base = cut_lineage(added.where(F.col("template_idx") == t).select("class_id", F.col("vec").alias("base")))
        remaining.remove(t)
        history.append((len(history) + 1, templates[t], float(best)))
    return history
