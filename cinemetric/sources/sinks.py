"""Writers: prediction CSV, clip index JSON, per-video transcripts, score maps,
feature caches, incremental outputs, packed frames, splits, crops and model
weights.  Everything is a DataFrame write; arrays are formatted only at the
sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import format_scores
from .archives import read_archives

PREDICTION_COLUMNS = ["Predicted_Concreteness", "English_Translation", "Detected_Language", "Is_Multiword",
                      "Is_Sentence", "Model_Used", "Per_Word_Predictions"]


def write_predictions(df: DataFrame, path: str, input_columns: list[str]) -> None:
    """Input columns + prediction columns as CSV with a header (SNK-01).
    ``Per_Word_Predictions`` may be an array of doubles; it is formatted as
    ``%.2f`` joined by ``;`` here."""
    out = df
    if dict(df.dtypes).get("Per_Word_Predictions", "string").startswith("array"):
        out = out.withColumn("Per_Word_Predictions", format_scores("Per_Word_Predictions"))
    out.select(*input_columns, *PREDICTION_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_clip_index(index: DataFrame, path: str) -> None:
    """Clip index as JSON lines ordered by ``row_idx`` (SNK-02); a range sort,
    so each output file holds a contiguous slice of the order."""
    index.orderBy("row_idx").write.mode("overwrite").json(path)


def write_transcripts(sentences: DataFrame, path: str, video: str = "video_id", order: str = "sent_idx") -> None:
    """Cleaned transcript per video (SNK-03): one directory per video with the
    sentences as JSON lines sorted by position.  Range partitioning on
    (video, position) gives each task a contiguous slice, so a long video is
    written by several tasks as several files whose part numbers follow the
    sentence order, instead of by one task."""
    n = int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (sentences.repartitionByRange(n, video, order).sortWithinPartitions(video, order)
     .write.mode("overwrite").partitionBy(video).json(path))


def scores_by_video(scores: DataFrame, video: str, order: str, score: str) -> DataFrame:
    """``video -> array of scores in caption order`` (SNK-04)."""
    return (scores.groupBy(video).agg(F.array_sort(F.collect_list(F.struct(order, score))).alias("_s"))
            .select(video, F.transform("_s", lambda s: s[score]).alias("scores")))


def write_scores(scores: DataFrame, path: str, video: str, order: str, score: str) -> None:
    scores_by_video(scores, video, order, score).write.mode("overwrite").json(path)


def feature_cache(spark: SparkSession, path: str, build, refresh: bool = False) -> DataFrame:
    """Write features once, reuse them afterwards (SNK-05).  Only a folder with
    its success marker is a cache; a half-written one is built anew."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not refresh and marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def incremental(todo: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose output already exists are skipped (SNK-06)."""
    return todo.join(existing.select(*keys).distinct(), keys, "left_anti")


def write_incremental(df: DataFrame, path: str, partition_cols: list[str]) -> None:
    """Overwrite only the partitions present in ``df`` (dynamic overwrite)."""
    spark = df.sparkSession
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.write.mode("overwrite").partitionBy(*partition_cols).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)


def pack_frames(spark: SparkSession, root: str, out: str, glob: str | None = "*.jpg", archives: str | None = None) -> None:
    """Frames -> Parquet partitioned by video (SNK-07): one container per video
    directory, bytes kept as ``content``.  ``glob`` selects frame files,
    ``archives`` tar files (plain or gzip) whose members are frames; the video is
    the folder that holds the file or the archive.  Of a name that an archive
    holds twice the last one is packed.  Damaged archives give the frames before
    the damage; ``archives.archive_report`` lists them."""
    parts = []
    folder = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("video_id")
    if glob:
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
        parts.append(files.select(folder, F.regexp_extract("path", r"([^/]+)$", 1).alias("frame_name"), "content"))
    if archives:
        inside = read_archives(spark, root, archives).where("error is null").withColumnRenamed("archive", "path")
        parts.append(inside.select(folder, "frame_name", "content"))
    packed = reduce(DataFrame.unionByName, parts)
    # range slices of (video, frame): a video with many frames is packed by
    # several tasks (several files in its directory), never by one
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed.repartitionByRange(n, "video_id", "frame_name").sortWithinPartitions("video_id", "frame_name") \
        .write.mode("overwrite").partitionBy("video_id").parquet(out)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One directory per split (SNK-08)."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_crops(crops: DataFrame, path: str, cls: str = "cls") -> None:
    """Crop geometry rows, one directory per class (SNK-09)."""
    crops.write.mode("overwrite").partitionBy(cls).parquet(path)
