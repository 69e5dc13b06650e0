"""Token counts kept as delta-maintained rollups.

A batch of changes inserts, deletes or revises documents' token counts.  A
ledger holds the current count of every (document, tokenizer version); a batch
turns each change into signed differences against it, and only the summed
differences by source, language and tokenizer version are added to the totals.
A batch is committed once: its tables are written under its number and its last
file, the success marker of the totals' differences, is the commit.  A repeated
batch finds the marker and changes nothing; a batch cut off half way is written
anew.

What a commit costs follows the batch.  The ledger lies in buckets of documents,
and a batch reads those that it touches.  After a commit the segments of the
ledger and of the differences are merged like the digits of a binary counter,
the last two while the later one covers as many batches, so n batches are at
most ``log2(n) + 1`` segments and a row is rewritten as often.  A merged segment
counts once its success marker is there; until then its parts do.

Counting runs public byte-pair vocabularies (their folder is a parameter) in a
map-only pass over whole texts.
"""

from __future__ import annotations

import base64
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import written

# fixed value: the vocabularies' split pattern
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")
TOKENIZERS = "/opt/tokenizers"
BUCKETS = 64                 # of the ledger; fixed for the life of a state
KEYS = ["source", "lang", "version"]
LEDGER = "doc_id long, source string, lang string, version string, n_tokens long, alive boolean, batch long"
DELTA = "source string, lang string, version string, n_docs long, n_tokens long"


def _counts(ranks: dict[str, bytes]):
    def run(batches):
        import tiktoken
        made = {v: tiktoken.Encoding(v, pat_str=PATTERN, special_tokens={}, mergeable_ranks={
            base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}) for v, raw in ranks.items()}
        for b in batches:
            texts = b.column("_text").to_pylist()
            rest = b.drop_columns(["_text"])
            for v, enc in made.items():
                n = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
                yield rest.append_column("version", pa.array([v] * len(n), pa.string())).append_column("n_tokens", pa.array(n, pa.int64()))
    return run


def count_tokens(docs: DataFrame, versions: tuple = VERSIONS, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, source, lang, version, n_tokens for each row and tokenizer
    version.  Null and empty texts count 0 tokens.  The vocabulary files (about
    a megabyte each) are read on the driver and shipped with the task."""
    ranks = {}
    for v in versions:
        with open(f"{folder}/{v}.tiktoken", "rb") as f:
            ranks[v] = f.read()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(_counts(ranks), "doc_id long, source string, lang string, version string, n_tokens long")


def estimated_counts(docs: DataFrame, versions: tuple = VERSIONS) -> DataFrame:
    """Provisional counts (a quarter of the bytes, rounded up) in the same form."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                       F.explode(F.array(*[F.lit(v) for v in versions])).alias("version"),
                       F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).cast("long").alias("n_tokens"))


def _done(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def _folders(spark: SparkSession, top: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []


def committed(spark: SparkSession, state: str) -> list[int]:
    """Numbers of the committed batches, in order."""
    names = [x for x in _folders(spark, f"{state}/deltas") if x.startswith("batch-")]
    return sorted(n for n in (int(x.removeprefix("batch-")) for x in names) if _done(spark, f"{state}/deltas/batch-{n}"))


def segments(spark: SparkSession, state: str, kind: str, batches: list[int]) -> list[tuple[str, int]]:
    """(folder, batches covered) of the fewest segments that hold ``batches``,
    in order; ``kind`` is ``ledger`` or ``deltas``."""
    merged: dict[int, list[int]] = {}
    for name in _folders(spark, f"{state}/{kind}"):
        if name.startswith("merged-"):
            lo, hi = (int(x) for x in name.removeprefix("merged-").split("_"))
            merged.setdefault(lo, []).append(hi)
    out, at = [], 0
    while at < len(batches):
        ends = sorted((hi for hi in merged.get(batches[at], []) if hi in batches), reverse=True)
        hi = next((h for h in ends if _done(spark, f"{state}/{kind}/merged-{batches[at]}_{h}")), None)
        n = batches.index(hi) + 1 - at if hi is not None else 1
        out.append((f"{state}/{kind}/" + (f"merged-{batches[at]}_{hi}" if hi is not None else f"batch-{batches[at]}"), n))
        at += n
    return out


def _bucket(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


def _write_ledger(rows: DataFrame, path: str) -> None:
    rows.withColumn("bucket", _bucket("doc_id")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _latest(rows: DataFrame) -> DataFrame:
    """Of every (document, version) the last batch's row."""
    fields = ["source", "lang", "n_tokens", "alive", "batch"]
    return rows.groupBy("doc_id", "version").agg(F.max_by(F.struct(*fields), "batch").alias("x")).select("doc_id", "version", *[f"x.{c}" for c in fields])


def _ledger(spark: SparkSession, state: str, batches: list[int], buckets: list[int] | None = None) -> DataFrame:
    """Current row of every (document, version), of the given buckets."""
    if not batches:
        return spark.createDataFrame([], LEDGER)
    parts = [spark.read.schema(LEDGER + ", bucket int").parquet(path) for path, _ in segments(spark, state, "ledger", batches)]
    rows = reduce(DataFrame.unionByName, parts)
    return _latest((rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket"))


def _merge(spark: SparkSession, state: str, batches: list[int]) -> None:
    """Merge the last segments while the later one covers as many batches."""
    for kind in ("ledger", "deltas"):
        while True:
            parts = segments(spark, state, kind, batches)
            if len(parts) < 2 or parts[-2][1] > parts[-1][1]:
                break
            lo, hi = batches[len(batches) - parts[-1][1] - parts[-2][1]], batches[-1]
            path = f"{state}/{kind}/merged-{lo}_{hi}"
            if kind == "ledger":
                _write_ledger(_latest(reduce(DataFrame.unionByName, [spark.read.schema(LEDGER + ", bucket int").parquet(p) for p, _ in parts[-2:]]).drop("bucket")), path)
            else:
                _summed(spark, [p for p, _ in parts[-2:]]).write.mode("overwrite").parquet(path)


def _summed(spark: SparkSession, paths: list[str]) -> DataFrame:
    parts = [spark.read.schema(DELTA).parquet(p) for p in paths]
    rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], DELTA)
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def commit(spark: SparkSession, state: str, batch: int, changes: DataFrame) -> bool:
    """Apply one batch of ``changes`` (op, doc_id, source, lang, version,
    n_tokens) to the rollup kept under ``state``; False if it is already there.

    op is ``insert`` or ``revise`` (both set the document's count, source and
    language, whatever it had) or ``delete`` (of nothing: no change).  Several
    rows of a batch for one (doc_id, version) count once: a delete loses against
    a count, and of two counts the larger stays.  A null doc_id cannot be found
    again: its inserts add and its deletes subtract, its revisions are ignored.
    Null source or language is a group of its own.  Batches are applied in the
    order of their numbers; an older number than the last one is refused."""
    if _done(spark, f"{state}/deltas/batch-{batch}"):
        return False
    before = committed(spark, state)
    if before and before[-1] > batch:
        raise ValueError(f"batch {batch} is older than the last committed one, {before[-1]}")
    fields = ["source", "lang", "n_tokens"]
    changes = written(changes.select("op", F.col("doc_id").cast("long").alias("doc_id"), *fields, "version"), "changes")
    named = changes.where("doc_id is not null")
    new = named.groupBy("doc_id", "version").agg(F.max(F.struct((F.col("op") != "delete").alias("alive"), "n_tokens", "source", "lang")).alias("x")) \
        .select("doc_id", "version", F.struct("x.source", "x.lang", "x.n_tokens", "x.alive").alias("new"))
    touched = [r["b"] for r in named.select(_bucket("doc_id").alias("b")).distinct().collect()]
    old = _ledger(spark, state, before, touched).select("doc_id", "version", F.struct(*fields, "alive").alias("old"))
    both = written(new.join(old, ["doc_id", "version"], "left"), "differences")
    ledger = both.select("doc_id", "new.source", "new.lang", "version", "new.n_tokens", "new.alive", F.lit(batch).cast("long").alias("batch"))
    _write_ledger(ledger, f"{state}/ledger/batch-{batch}")
    signed = both.select("version", F.explode(F.array(
        F.struct(F.lit(1).alias("sign"), F.col("new").alias("row")), F.struct(F.lit(-1).alias("sign"), F.col("old").alias("row")))).alias("s")) \
        .where("s.row.alive").select("s.row.source", "s.row.lang", "version", "s.sign", "s.row.n_tokens")
    loose = changes.where("doc_id is null and op in ('insert', 'delete')").select(
        "source", "lang", "version", F.when(F.col("op") == "insert", 1).otherwise(-1).alias("sign"), "n_tokens")
    delta = signed.unionByName(loose).groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
    delta.where("n_docs <> 0 or n_tokens <> 0").write.mode("overwrite").parquet(f"{state}/deltas/batch-{batch}")
    _merge(spark, state, [*before, batch])
    return True


def totals(spark: SparkSession, state: str) -> DataFrame:
    """source, lang, version, n_docs, n_tokens: the sum of all committed differences."""
    return _summed(spark, [p for p, _ in segments(spark, state, "deltas", committed(spark, state))])


def corpus_totals(docs: DataFrame, state: str, versions: tuple = VERSIONS, folder: str = TOKENIZERS) -> DataFrame:
    """Rollup of a whole table kept under ``state``: estimates are inserted,
    then revised to the tokenizers' counts, and the revision is sent twice, as
    a retried job would (documents without doc_id are inserted with their
    counts in the second batch).  Texts of any length are counted whole; other
    columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    first = estimated_counts(docs.where("doc_id is not null"), versions).withColumn("op", F.lit("insert"))
    commit(spark, state, 1, first)
    counts = count_tokens(docs, versions, folder).withColumn("op", F.when(F.col("doc_id").isNull(), "insert").otherwise("revise"))
    counts = written(counts, "counts")
    commit(spark, state, 2, counts)
    commit(spark, state, 2, counts)
    return totals(spark, state)
