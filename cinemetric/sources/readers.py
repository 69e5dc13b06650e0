"""Readers for the reference's file formats, all as Spark scans.

Whole-file reads (``wholetext``) are used only where line order inside a small
file is data; every other reader is a splittable line/CSV/JSON scan, also of
files that are one JSON document or hold quoted line ends (``splits``).  Orders
that matter (caption order, index row order) become explicit columns, never row
order.
"""

from __future__ import annotations

import ast
import csv
import io
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .archives import read_archives
from .splits import CsvScanner, elements, entering_states, json_elements

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
# Column aliases of the expression CSV, in order of preference.
TEXT_COLUMNS = ["Expression", "Word"]
RATING_COLUMNS = ["Mean_C", "Conc.M"]
# The 26 body-language categories, in file column order.
BODY_CLASSES = [
    "peace", "affection", "esteem", "anticipation", "engagement", "confidence", "happiness",
    "pleasure", "excitement", "surprise", "sympathy", "doubt confusion", "disconnection",
    "fatigue", "embarrassment", "yearning", "disapproval", "aversion", "annoyance", "anger",
    "sensitivity", "sadness", "disquietment", "fear", "pain", "suffering",
]
# Media suffixes accepted by the media listing.
IMAGE_SUFFIXES = ["bmp", "jpg", "jpeg", "png", "tif", "tiff", "dng", "webp", "mpo"]
VIDEO_SUFFIXES = ["mov", "avi", "mp4", "mpg", "mpeg", "m4v", "wmv", "mkv"]

BOX_ARRAY = "array<array<double>>"


def resolve_column(columns: list[str], candidates: list[str], required: bool = True) -> str | None:
    """First candidate present in ``columns`` (SRC-02)."""
    for c in candidates:
        if c in columns:
            return c
    if required:
        raise ValueError(f"none of {candidates} in {columns}")
    return None


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _header_names(head: str, utf8: bool) -> list[str]:
    """Column names of a header record as Spark's CSV reader would name them:
    ``_c<i>`` for an empty name, a position behind a repeated one."""
    text = head.encode("latin-1").decode("utf-8" if utf8 else "latin-1").removeprefix("\ufeff").rstrip("\r")
    names = next(csv.reader(io.StringIO(text, newline="")), [])
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_csv_records(spark: SparkSession, path) -> DataFrame:
    """CSV files with a header, every column a string (SRC-01): quoted fields may
    hold line ends, a file that is not UTF-8 as a whole is read as Latin-1, and
    files are united by column name.  One file is read by many tasks
    (``splits``): whether a line end lies inside quotes, and whether all ranges
    of its file are UTF-8, is known from a summary per byte range.  Lines end
    with LF or CR LF.  The driver holds the distinct headers."""
    scanner = CsvScanner()
    states = cut_lineage(entering_states(spark, path, scanner))
    heads = states.where("block = 0").select("head", "utf8").distinct().collect()
    rows = elements(spark, path, scanner, states).where("row_idx > 0")
    rows = rows.join(F.broadcast(states.where("block = 0").select("file", "head", "utf8")), "file")
    frames = []
    for h in sorted(heads, key=lambda h: (h["head"] or "", h["utf8"])):
        if h["head"] is None:
            continue
        names = _header_names(h["head"], h["utf8"])
        mine = rows.where(F.col("head").eqNullSafe(h["head"]) & (F.col("utf8") == F.lit(h["utf8"])))
        # guarded by the file's own flag: the optimizer may run this before the filter
        text = F.when(F.col("utf8"), F.col("text").cast("string")).otherwise(F.decode("text", "ISO-8859-1"))
        parsed = F.from_csv(text, ", ".join(f"`{n.replace('`', '``')}` string" for n in names), {"escape": '"', "multiLine": "true"})
        frames.append(mine.select(parsed.alias("r")).select("r.*"))
    if not frames:
        raise ValueError(f"no header in {path}")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def read_expressions(spark: SparkSession, path: str) -> DataFrame:
    """Expression CSV (SRC-01/02, FLT-01): header, quoted fields, per-file
    encoding.  Adds ``expr_text`` and (when a rating column exists) ``rating``;
    rows without text are dropped."""
    df = read_csv_records(spark, path)
    text = resolve_column(df.columns, TEXT_COLUMNS)
    rating = resolve_column(df.columns, RATING_COLUMNS, required=False)
    df = df.withColumn("expr_text", _q(text)).dropna(subset=["expr_text"])
    if rating:
        df = df.withColumn("rating", _q(rating).try_cast("double"))
    return df


def clip_annotation_schema() -> T.StructType:
    fields = [T.StructField("video_id", T.StringType()), T.StructField("person_id", T.IntegerType()),
              T.StructField("start_frame", T.IntegerType()), T.StructField("end_frame", T.IntegerType())]
    fields += [T.StructField(c, T.DoubleType()) for c in BODY_CLASSES]
    fields += [T.StructField(c, T.DoubleType()) for c in ("valence", "arousal", "dominance")]
    fields += [T.StructField(c, T.StringType()) for c in ("gender", "age", "ethnicity")]
    fields += [T.StructField("confidence_score", T.DoubleType())]
    return T.StructType(fields)


def read_clip_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Headerless 37-column annotation CSV with the given schema (SRC-03)."""
    return spark.read.schema(clip_annotation_schema()).option("header", False).csv(path)


def binarize(df: DataFrame, cols: list[str], threshold: float = 0.5) -> DataFrame:
    """Multi-label scores to 0/1 at ``>= threshold`` (FLT-21)."""
    for c in cols:
        df = df.withColumn(c, (F.col(c) >= threshold).cast("int"))
    return df


def parse_list_literal(col: Column | str) -> Column:
    """Cell holding a list literal such as ``[1, 2]`` or ``(1, 2)`` -> array<double>
    (SRC-04); parsed as JSON, never evaluated."""
    c = F.col(col) if isinstance(col, str) else col
    js = F.regexp_replace(F.regexp_replace(c, r"\(", "["), r"\)", "]")
    return F.from_json(js, "array<double>")


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    """Dialogue CSV with header (SRC-05); ids as ints and the clip key (PRJ-02)."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.withColumn("Dialogue_ID", F.col("Dialogue_ID").try_cast("int")) \
           .withColumn("Utterance_ID", F.col("Utterance_ID").try_cast("int"))
    return df.withColumn("clip_key", F.format_string("dia%d_utt%d", "Dialogue_ID", "Utterance_ID"))


def read_whitespace_table(spark: SparkSession, path: str, names: list[str], skip_first: bool = False,
                          types: dict | None = None) -> DataFrame:
    """Whitespace-separated text (SRC-06).  Line order matters (line number is
    the row id), so each small per-movie file is read whole and its lines
    numbered; ``file`` and ``line_no`` (0-based, after the skip) are added."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.posexplode(F.split(F.col("value"), r"\r?\n")).alias("ln", "line"))
    raw = raw.where(F.trim("line") != "")
    if skip_first:
        raw = raw.where(F.col("ln") > 0)
    w = F.split(F.trim("line"), r"\s+")
    cols = [F.try_element_at(w, F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    out = raw.select("file", "ln", *cols)
    from pyspark.sql import Window
    out = out.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("ln")) - 1).drop("ln")
    for n, t in (types or {}).items():
        out = out.withColumn(n, F.col(n).try_cast(t))
    return out


def read_tsv_per_video(spark: SparkSession, path: str) -> DataFrame:
    """One TSV per video; the video key is the first two ``_`` parts of the file name (SRC-07)."""
    df = spark.read.option("header", True).option("sep", "\t").option("inferSchema", False).csv(path)
    return df.withColumn("video_key", F.regexp_extract(F.col("_metadata.file_name"), r"^([^_]*_[^_.]*)", 1))


def read_json_map(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """JSON documents that are one map ``{key: value}`` -> rows (key, value)
    (SRC-08); of a key that a document holds twice the last value counts."""
    entry = json_elements(spark, path, "{")
    rows = entry.select("file", "row_idx", F.explode(F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), f"map<string, {value_type}>")).alias("key", "value"))
    return rows.groupBy("file", "key").agg(F.max_by(F.struct("value"), "row_idx").alias("last")).select("key", "last.value")


def _parent(file) -> Column:
    return F.regexp_extract(file, r"/([^/]+)/[^/]+$", 1)


CAPTION_TYPE = "struct<text:string, start:double, duration:double>"


def read_transcripts(spark: SparkSession, path: str, video_from: str = "dir") -> DataFrame:
    """Transcript JSON arrays, one file per video (SRC-09): rows
    (video_id, cap_idx, text, start, duration); the video id is the parent
    directory name (or the file stem)."""
    entry = json_elements(spark, path, objects=True)
    vid = _parent("file") if video_from == "dir" else F.regexp_extract("file", r"([^/]*)\.[^./]+$", 1)
    return entry.select(vid.alias("video_id"), F.col("row_idx").alias("cap_idx"), F.from_json("value", CAPTION_TYPE).alias("c")) \
        .select("video_id", "cap_idx", "c.text", "c.start", "c.duration")


def read_boxes(spark: SparkSession, path: str, keyed_by_video: bool = False) -> DataFrame:
    """Person boxes (SRC-10) -> rows (video_id, frame_name, frame_idx, boxes).

    Per-video files hold a list of one-key maps ``[{"00001321.jpg": [[x1,y1,x2,y2,s],...]}, ...]``;
    a later entry for the same frame wins (SET-08).  The whole-set form is one
    map ``{video: {frame: boxes}}``."""
    if keyed_by_video:
        rows = read_json_map(spark, path, f"map<string, {BOX_ARRAY}>").select(F.col("key").alias("video_id"), F.explode("value").alias("frame_name", "boxes"))
    else:
        entry = json_elements(spark, path, objects=True)
        ex = entry.select(_parent("file").alias("video_id"), F.col("row_idx").alias("pos"),
                          F.explode(F.from_json("value", f"map<string, {BOX_ARRAY}>")).alias("frame_name", "boxes"))
        rows = ex.groupBy("video_id", "frame_name").agg(F.max_by("boxes", "pos").alias("boxes"))
    return rows.withColumn("frame_idx", F.regexp_extract("frame_name", r"(\d+)\.", 1).cast("long"))


def frames_with_box(boxes: DataFrame) -> DataFrame:
    """Drop frames whose box list is empty (FLT-13)."""
    return boxes.where(F.size("boxes") > 0)


CLIP_TYPE = ("struct<video_id:string, duration:double, start_frame:int, end_frame:int, text:string, "
             "neutral_score:double, has_person:double>")


def read_clip_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Clip index; ``row_idx`` keeps the file order (SRC-11).  The reference
    format is one JSON array per file, of which many tasks read a range each;
    ``lines=True`` reads the JSON-lines form written by
    ``sinks.write_clip_index`` (rows carry ``row_idx``)."""
    if lines:
        return spark.read.schema(f"row_idx long, {CLIP_TYPE[len('struct<'):-1].replace(':', ' ')}").json(path)
    return json_elements(spark, path, objects=True).select("row_idx", F.from_json("value", CLIP_TYPE).alias("r")).select("row_idx", "r.*")


def frame_manifest(spark: SparkSession, root: str, glob: str = "*.jpg") -> DataFrame:
    """Frame files present per video (SRC-12): (video_id, frame_name, frame_idx).
    Only the path is selected, so the file bytes are never read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", True).load(root).select("path"))
    return files.select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("video_id"),
                        F.regexp_extract("path", r"([^/]+)$", 1).alias("frame_name")) \
        .withColumn("frame_idx", F.regexp_extract("frame_name", r"(\d+)\.", 1).cast("long"))


def _label_rows(value: Column) -> Column:
    """Rows of a label file's text, polygons as their bounding boxes."""
    lines = F.filter(F.split(F.trim(value), r"\r?\n"), lambda l: F.trim(l) != "")
    parsed = F.transform(lines, lambda l: F.transform(F.split(F.trim(l), r"\s+"), lambda x: x.try_cast("double")))
    is_seg = F.exists(parsed, lambda r: F.size(r) > 8)

    def seg_to_box(r):
        pts = F.slice(r, 2, F.size(r) - 1)
        xs = F.filter(pts, lambda v, i: i % 2 == 0)
        ys = F.filter(pts, lambda v, i: i % 2 == 1)
        x1, x2, y1, y2 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
        return F.array(r[0], (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1)

    return F.when(is_seg, F.transform(parsed, seg_to_box)).otherwise(parsed)


def read_detection_labels(spark: SparkSession, path: str, archives: str | None = None) -> DataFrame:
    """Label text per image (SRC-14): ``cls x y w h`` rows, or polygon rows
    (more than 8 fields) turned into their bounding ``x y w h``.  Output: one
    row per file with ``rows`` = array of double arrays (``null`` on a parse
    error) and ``file``.  With ``archives`` the label files are the members of
    the tar files of that pattern below ``path`` (``file``: archive and member);
    of a damaged archive those before the damage."""
    if archives:
        inside = read_archives(spark, path, archives).where("error is null")
        return inside.select(F.concat("archive", F.lit("/"), "frame_name").alias("file"), _label_rows(F.col("content").cast("string")).alias("rows"))
    # binaryFile keeps empty files (a text scan yields no row for them)
    doc = spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("file"), F.col("content").cast("string").alias("value"))
    parsed_rows = doc.select("file", _label_rows(F.col("value")).alias("rows"))
    # zero-length files are skipped by file scans but kept in the file index:
    # they are the "empty" label files (file names only, one row per file)
    listed = spark.createDataFrame([(f.replace("file:///", "file:/"),) for f in doc.inputFiles()], "file string")
    return listed.join(parsed_rows, "file", "left").select(
        "file", F.coalesce("rows", F.array().cast("array<array<double>>")).alias("rows"))


def validate_labels(labels: DataFrame, images: DataFrame, label_path: Column) -> DataFrame:
    """Status per image (FLT-15): ``missing`` (no label file), ``empty``,
    ``corrupt`` (not 5 columns, a negative, a coordinate above 1, a duplicate
    row or an unparsable number) or ``found``.  ``images`` needs ``path``;
    ``label_path`` maps it to the label file path.  With a column ``problem``
    (``images.image_audit``: unreadable, below 10 pixels, unknown format) an
    image that has one is ``corrupt`` whatever its labels are."""
    im = images.withColumn("label_file", label_path)
    j = im.join(labels.withColumnRenamed("file", "label_file"), "label_file", "left")
    r = F.col("rows")
    bad = (F.exists(r, lambda x: (F.size(x) != 5) | F.exists(x, lambda v: v.isNull() | (v < 0)))
           | F.exists(r, lambda x: F.exists(F.slice(x, 2, 4), lambda v: v > 1))
           | (F.size(F.array_distinct(r)) != F.size(r)))
    image = F.col("problem").isNotNull() if "problem" in images.columns else F.lit(False)
    status = (F.when(image, F.lit("corrupt")).when(r.isNull(), F.lit("missing")).when(F.size(r) == 0, F.lit("empty"))
              .when(bad, F.lit("corrupt")).otherwise(F.lit("found")))
    return j.withColumn("status", status)


def label_report(status: DataFrame) -> DataFrame:
    """Counts per status plus the total (AG-26); the files are audited once and
    the counts, a handful of rows, kept."""
    per = cut_lineage(status.groupBy("status").agg(F.count(F.lit(1)).alias("n")))
    return per.unionByName(per.agg(F.lit("total").alias("status"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def label_path_for(image_path: Column) -> Column:
    """``/images/`` -> ``/labels/`` (first occurrence), suffix -> ``.txt`` (JN-13)."""
    swapped = F.regexp_replace(image_path, r"^(.*?)/images/", "$1/labels/")
    return F.regexp_replace(swapped, r"\.[^./]+$", ".txt")


def list_media(spark: SparkSession, root: str, list_file: str | None = None) -> DataFrame:
    """Media files (SRC-15): images first then videos, each sorted by path.
    With ``list_file`` the paths come from a text file, ``./`` resolved
    against the list file's folder."""
    if list_file:
        lf = spark.read.text(list_file).select(F.trim("value").alias("p"), F.col("_metadata.file_path").alias("lf"))
        base = F.regexp_extract("lf", r"^(.*)/[^/]+$", 1)
        paths = lf.where(F.col("p") != "").select(
            F.when(F.col("p").startswith("./"), F.concat(base, F.lit("/"), F.substring("p", 3, 1 << 20)))
            .otherwise(F.col("p")).alias("path"))
    else:
        paths = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
                 .select("path"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ext.isin(IMAGE_SUFFIXES), F.lit(0)).when(ext.isin(VIDEO_SUFFIXES), F.lit(1))
    return paths.withColumn("kind", kind).where(F.col("kind").isNotNull()) \
        .withColumn("media", F.when(F.col("kind") == 0, F.lit("image")).otherwise(F.lit("video"))) \
        .orderBy("kind", "path").drop("kind")


def fingerprint(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Sum of file sizes (AG-27); only file metadata is read."""
    return spark.read.format("binaryFile").load(paths).agg(F.sum("length").alias("total_bytes"))


def _parse_vocab_block(block: str):
    """Small per-row helper: the ``classes = [...]`` / ``templates = [...]``
    literals of one dataset section, parsed as Python literals (no eval)."""
    out = {"classes": None, "templates": None}
    for name in out:
        i = block.find(f"{name} = [")
        if i < 0:
            continue
        start, depth = block.index("[", i), 0
        for j in range(start, len(block)):
            depth += block[j] == "["
            depth -= block[j] == "]"
            if depth == 0:
                out[name] = ast.literal_eval(block[start:j + 1])
                break
    classes = [c if isinstance(c, list) else [c] for c in (out["classes"] or [])]
    return classes, out["templates"] or []


def read_prompt_vocab(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Prompt vocabularies from a markdown file of ``## Dataset`` sections with
    ``classes`` and ``templates`` lists (SRC-16).  Returns
    (dataset, class_id, names array) and (dataset, template_idx, template)."""
    schema = T.StructType([T.StructField("classes", T.ArrayType(T.ArrayType(T.StringType()))),
                           T.StructField("templates", T.ArrayType(T.StringType()))])
    parse = F.udf(lambda b: _parse_vocab_block(b or ""), schema)
    doc = spark.read.text(path, wholetext=True)
    sections = doc.select(F.posexplode(F.split("value", r"\n## ")).alias("i", "sec")).where("i > 0")
    ds = sections.select(F.trim(F.split("sec", "\n")[0]).alias("dataset"), parse("sec").alias("v"))
    classes = ds.select("dataset", F.posexplode("v.classes").alias("class_id", "names"))
    templates = ds.select("dataset", F.posexplode("v.templates").alias("template_idx", "template"))
    return classes, templates


def read_playlist(spark: SparkSession, path: str) -> DataFrame:
    """Playlist metadata: JSON array of entries with ``link`` and ``duration`` (SRC-17)."""
    return spark.read.option("multiLine", True).schema("link string, duration string, title string").json(path)


def read_side_array(spark: SparkSession, path: str, name: str = "values") -> DataFrame:
    """Row-aligned side arrays stored as Parquet (row_idx, values) (SRC-18)."""
    return spark.read.parquet(path).select(F.col("row_idx").cast("long"), F.col(name))


def read_joints(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Joint rows ``(video_id, frame, person_id, joints array<struct<x,y,conf>>)``
    with frames re-based to start at 1 per video (SRC-13, WN-06)."""
    from ..operators.shots import rebase_frames
    df = spark.read.format(fmt).load(path)
    return rebase_frames(df, "video_id", "frame")
