"""Bounded, repeatable training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """About ``limit`` labelled rows outside the held-out third (all of them if
    there are fewer), chosen by a hash of doc_id: the columns of ``docs`` and
    ``y``.  The sample of labels is what is broadcast, so its size is bounded
    by ``limit``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")) \
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    if n > limit:
        steps = 1 << 20
        share = steps * limit / n
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(steps)) < max(1, int(share)))
        if share < 1:                    # a second hash for the part of the last step
            known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1 << 40)) < max(1, int(share * (1 << 40))))
    return docs.join(F.broadcast(known), "doc_id")
