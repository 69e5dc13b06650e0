"""Mixing sources to target weights with a hypergeometric splitting tree.

Documents of a source stand in a random order that a hash of the seed and
doc_id fixes.  Consecutive documents form blocks; a source's target is met by
whole passes over its blocks and a last partial one, so the number of blocks
that each source gives is an exact quota.  The quotas are split among the
output shards by a binary tree: at each node the left half's share of every
source is one multivariate hypergeometric draw, so each shard holds what a
random sample of all blocks without replacement would hold, and quotas add up
exactly.  A shard's blocks are disjoint ranges of the source's permuted
sequence; inside a shard rows are shuffled locally.

Sums run in three levels (blocks, runs of blocks, source), so a source with a
third of all rows is no single task.  The tree holds one count per source and
node: it needs the list of sources, not of documents, in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequence import running_sums
from .storage import written

WEIGHTS = (5, 2, 1)        # by the source's rank, repeating
SHARE = 1.5                # words of the mix per word of the input
MOST = 2                   # a source's target stops at so many times its size
BLOCK_DOCS = 256
SHARD_BLOCKS = 64
BITS = 60


def word_count(text: Column) -> Column:
    """Number of runs outside white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Water filling: with sources sorted by size per weight, those below the
    level get ``most`` times their size and the rest the level times their
    weight.  ``share`` of all words is exact in halves."""
    by_code = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(by_code) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w.cast("long"))
    total = Window.partitionBy()
    fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").cast("binary").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("budget", F.lit(share) * F.sum("source_size").over(total))
         .withColumn("full_before", F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0)))
         .withColumn("weight_left", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    level = (F.col("budget") - F.col("full_before")) / F.col("weight_left")
    # the first source, in this order, that stays below its stop sets the level
    s = s.withColumn("level", level).withColumn("stops", F.lit(most) * F.col("source_size") <= F.col("level") * F.col("weight"))
    s = s.withColumn("final", F.min(F.when(~F.col("stops"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("level").alias("level"))))
                     .over(total)["level"])
    target = F.when(F.col("stops") | F.col("final").isNull(), (F.lit(most) * F.col("source_size")).cast("double")) \
        .otherwise(F.col("final") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def split_tree(lo: int, hi: int, counts: np.ndarray, total: int, shards: int, seed: int, down_to: int = 1):
    """Shares of the shards lo..hi-1 (stops at ranges of ``down_to`` shards):
    yields (lo, hi, counts)."""
    stack = [(lo, hi, counts)]
    while stack:
        lo, hi, counts = stack.pop()
        if hi - lo <= down_to:
            yield lo, hi, counts
            continue
        mid = (lo + hi) // 2
        take = mid * total // shards - lo * total // shards
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = rng.multivariate_hypergeometric(counts, take, method="marginals")
        stack += [(mid, hi, counts - left), (lo, mid, left)]


def quotas(draws: DataFrame, shards: int, total: int, seed: int) -> DataFrame:
    """(source, shard, n) from (source, draws): the leaves of the splitting tree."""
    coarse = max(1, shards // 64)

    def top(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                for lo, hi, c in split_tree(0, shards, np.array(r["counts"], np.int64), total, shards, seed, coarse):
                    yield pd.DataFrame({"lo": [lo], "hi": [hi], "sources": [r["sources"]], "counts": [c.tolist()]})

    def leaves(batches):
        for pdf in batches:
            for lo, hi, names, c in zip(pdf["lo"], pdf["hi"], pdf["sources"], pdf["counts"]):
                for shard, _, n in split_tree(int(lo), int(hi), np.array(c, np.int64), total, shards, seed):
                    some = np.flatnonzero(n)
                    yield pd.DataFrame({"source": [names[i] for i in some], "shard": shard, "n": n[some]})

    one = draws.groupBy().agg(F.sort_array(F.collect_list(F.struct("sk", "source", "draws"))).alias("x")) \
        .select(F.col("x.sk").alias("sources"), F.col("x.draws").alias("counts"))
    nodes = one.mapInPandas(top, "lo long, hi long, sources array<string>, counts array<long>")
    return nodes.repartition("lo").mapInPandas(leaves, "source string, shard long, n long")


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), ident))
    return docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("_size"),
                       F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("_u"),
                       F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")).alias("_sk"))


def mix(docs: DataFrame, seed: int = 1, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """All columns of ``docs`` and: size, source_size, target (its source's),
    draws (array of (copy, shard, take): the copies that the mix takes and how
    many leading words of each) and taken (their sum).

    Null, empty and blank texts have size 0 and take 0; a null source is a
    source of its own, ranked last; rows that share a doc_id are ordered by
    size, so reruns agree; a null doc_id is ordered by its text.  A column of
    ``docs`` that has one of the added names is replaced.  An empty table
    gives an empty result."""
    added = {"size", "source_size", "target", "draws", "taken"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    keyed = _keyed(docs, seed)
    slim = written(keyed.drop("_doc"), "sizes")
    per = slim.groupBy("_sk").agg(F.first("source").alias("source"), F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BLOCK_DOCS))).cast("int")
    plan = targets(per.select("source", "source_size"), weights, share, most)
    source_key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    plan = per.select("_sk", bits.alias("bits")).join(plan.withColumn("_sk", source_key).drop("source"), "_sk")
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")) \
        .withColumn("rest", (F.round("target").cast("long") - F.col("passes") * F.col("source_size")))
    plan = written(plan, "plan")
    block = F.expr(f"shiftright(_u, {BITS} - bits)")
    sums = slim.join(plan.select("_sk", "bits"), "_sk").withColumn("block", block) \
        .groupBy("_sk", "block").agg(F.sum("_size").alias("words"))
    sums = running_sums(sums, ["_sk"], ["block"], {"before": "words"}, inclusive=False, chunk=F.shiftright("block", 8))
    sums = sums.join(plan.select("_sk", "bits", "passes", "rest"), "_sk")
    # the draws of a source: its blocks once per pass, then those the rest reaches
    used = (F.col("before") < F.col("rest")) & (F.col("words") > 0)
    sums = sums.withColumn("copies", F.col("passes") + F.when(used, 1).otherwise(0))
    blocks = written(sums.select("_sk", "block", "before", "rest", "passes", "copies"), "blocks")
    numbered = running_sums(blocks, ["_sk"], ["block"], {"first": "copies"}, inclusive=False, chunk=F.shiftright("block", 8))
    draws = blocks.groupBy("_sk").agg(F.sum("copies").alias("draws")).select(F.col("_sk").alias("sk"), F.col("_sk").alias("source"), "draws")
    total = int(draws.agg(F.coalesce(F.sum("draws"), F.lit(0)).alias("n")).first()["n"])
    shards = max(1, -(-total // SHARD_BLOCKS))
    share_of = quotas(draws, shards, total, seed) if total else draws.select("source", F.lit(0).cast("long").alias("shard"), "draws").withColumnRenamed("draws", "n")
    share_of = written(share_of, "quotas")
    ranges = running_sums(share_of.withColumnRenamed("source", "_sk"), ["_sk"], ["shard"], {"first": "n"}, inclusive=False, chunk=F.shiftright("shard", 8))
    places = ranges.where("n > 0").select("_sk", "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("x"))
    drawn = numbered.where("copies > 0").select("_sk", "block", F.explode(F.expr("sequence(first, first + copies - 1)")).alias("x"), "first")
    where = drawn.join(places, ["_sk", "x"]).groupBy("_sk", "block") \
        .agg(F.sort_array(F.collect_list(F.struct((F.col("x") - F.col("first")).cast("int").alias("copy"), "shard"))).alias("places"))
    table = written(blocks.join(where, ["_sk", "block"], "left").select("_sk", "block", F.col("before").alias("_before"), F.col("rest").alias("_rest"),
                                                                        F.col("passes").alias("_passes"), F.col("places").alias("_places")), "draws")
    out = keyed.join(plan.select("_sk", "bits", "source_size", "target"), "_sk") \
        .withColumn("block", block).join(table, ["_sk", "block"])
    inside = Window.partitionBy("_sk", "block").orderBy("_u", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_before") - F.coalesce(F.sum("_size").over(inside), F.lit(0))))
    out = out.withColumn("_extra", extra)
    take = lambda p: F.when(p["copy"] < F.col("_passes"), F.col("_size")).otherwise(F.col("_extra"))
    made = F.filter(F.transform(F.coalesce("_places", F.array().cast("array<struct<copy:int,shard:bigint>>")),
                                lambda p: F.struct(p["copy"].alias("copy"), p["shard"].alias("shard"), take(p).alias("take"))), lambda p: p["take"] > 0)
    out = out.withColumn("draws", made).withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, p: a + p["take"]))
    return out.withColumn("size", F.col("_size")).select("_doc.*", "size", "source_size", "target", "draws", "taken")


def shards(mixed: DataFrame, seed: int = 1) -> DataFrame:
    """The mix itself: one row per drawn copy with shard, copy and take, rows
    shuffled within their shard."""
    cols = [c for c in mixed.columns if c not in ("draws", "taken")]
    rows = mixed.select(*cols, F.explode("draws").alias("_d")).select(*cols, "_d.shard", "_d.copy", "_d.take")
    order = F.xxhash64(F.lit(seed), F.col("shard"), F.col("copy"), F.col("doc_id"))
    return rows.repartition("shard").sortWithinPartitions("shard", order)
