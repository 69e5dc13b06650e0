"""Corpus pipeline: quality filter, near-duplicate removal, benchmark
decontamination, secret removal, mixing.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.  Every stage takes null
ids, texts, sources and metadata, empty and very long texts, repeated rows,
empty tables and extra columns; what becomes of them is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinemetric.llm import containment, factormachine, mixing, secretscan, superminhash
from cinemetric.llm.queries import table
from cinemetric.llm.storage import written
from cinemetric.operators.sequence import global_row_index


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine gives 0.5 or more; null and
    empty texts are scored like any other.  Without a labelled row nothing can
    be judged and every document stays."""
    model = factormachine.train(docs, table(spark, sf_dir, "labels"))
    name = "_quality"
    while name in docs.columns or name == "score":
        name += "_"
    scored = factormachine.score(docs.withColumnsRenamed({"score": name}), model, [c if c != "score" else name for c in docs.columns])
    return scored.where("score >= 0.5").drop("score").withColumnsRenamed({name: "score"}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8): the
    one with the smallest doc_id; of rows that share a doc_id the one with the
    smallest text.  Rows are judged one by one: different texts under one doc_id
    are different documents.  Blank texts have no copies and stay, one for each
    doc_id; null ids stay."""
    ids = F.col("doc_id").cast("long")
    again = docs.select(ids.alias("doc_id")).where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if again.limit(1).count():
        return _dedup_rows(docs, ids).select(*docs.columns)
    groups = written(superminhash.near_duplicates(docs, k=5, percent=80).select("doc_id", "kept"), "groups")
    gone = groups.where("not kept").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)       # the same plan at every size


def _dedup_rows(docs: DataFrame, ids: Column) -> DataFrame:
    """``near_dedup`` of a table with repeated doc_ids: every row gets a number in
    the order of (doc_id, text), which stands for its doc_id."""
    row, key = "_row", "_id"
    while row in docs.columns or key in docs.columns:
        row, key = row + "_", key + "_"
    rows = written(global_row_index(docs.withColumn(key, ids), [key, "text"], row), "rows")
    named = F.when(F.col(key).isNotNull(), F.col(row))
    groups = written(superminhash.near_duplicates(rows.select(named.alias("doc_id"), "text"), k=5, percent=80)
                     .where("doc_id is not null").select(F.col("doc_id").alias(row), "n_shingles", "kept"), "groups")
    blank = rows.select(row, key).join(groups.where("n_shingles = 0").select(row), row)
    first = blank.groupBy(key).agg(F.min(row).alias("_first"))
    gone = groups.where("not kept").select(row).union(blank.join(first, key).where(F.col(row) > F.col("_first")).select(row))
    return rows.join(gone.hint("merge"), row, "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of ``benchmark`` (containment 0.8)."""
    return containment.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark and n_chars
    changed by as much; texts without secrets and nulls stay as they are."""
    return secretscan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: one row per drawn copy of a document with its shard,
    copy number and how many leading words to take, shuffled within shards.
    Documents without words, and those beyond their source's target, are not
    drawn; a null source is a source of its own."""
    return mixing.shards(mixing.mix(docs))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
]

#: The classifier and the hypergeometric tree have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return docs
