"""Registered round-trip queries for the file formats of single documents:
whitespace tables, per-video TSV, JSON maps, person boxes, label text, prompt
vocabularies, playlists, frame folders, transcripts, model weights.

Each query writes a whole driver table in the format into the shared scratch
folder and reads it back.  Formats of one document per file are written with
one bounded document a file (``maxRecordsPerFile=1``), never one document for
the whole table.
"""

from __future__ import annotations

import io
import struct
import tarfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tables as TB
from ..operators.sequence import global_row_index
from ..session import cut_lineage, read_table, scratch_path, spread
from ..sources import readers as RD
from ..sources import sinks as SK
from ..sources.archives import archive_report, read_archives
from ..sources.images import image_audit
from . import proxies as P
from .catalog_index import SQL_CLIP_INDEX, q_clip_index

ROWS_PER_DOCUMENT = 200
# every task moves its own files to their place, not the driver all of them
# (the folders are fresh and read only after the whole write)
MANY_FILES = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}


def _documents(docs: DataFrame, path: str, *folders: str) -> None:
    """Write the text column ``value``, one file per row."""
    w = docs.write.options(**MANY_FILES)
    (w.partitionBy(*folders) if folders else w).text(path)


def q_whitespace_table(spark, sf):
    """Events as whitespace-separated text with a header line in every file,
    read back with line numbers, which must follow the file's order (SRC-06)."""
    ev = read_table(spark, sf, "events").select("event_id", "user_id")
    lines = ev.groupBy(F.floor(F.col("event_id") / ROWS_PER_DOCUMENT)).agg(
        F.array_sort(F.collect_list(F.struct("event_id", "user_id"))).alias("r"))
    body = F.transform("r", lambda s: F.concat(F.lit("  "), s["event_id"].cast("string"), F.lit(" \t "), s["user_id"].cast("string")))
    path = scratch_path(spark, "whitespace")
    _documents(lines.select(F.concat(F.lit("event user\n"), F.array_join(body, "\n")).alias("value")), path)
    back = RD.read_whitespace_table(spark, path, ["event_id", "user_id"], skip_first=True,
                                    types={"event_id": "long", "user_id": "long"})
    return back.select("event_id", "user_id", F.col("line_no").cast("long").alias("line_no"))


SQL_WHITESPACE_TABLE = f"""
SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id,
       row_number() OVER (PARTITION BY event_id // {ROWS_PER_DOCUMENT} ORDER BY event_id) - 1 AS line_no FROM events"""

TSV_VIDEOS = 4


def q_tsv_per_video(spark, sf):
    """Captions as one set of TSV files per video name, read back with the
    video key of the file names (SRC-07)."""
    c = read_table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"),
        F.length("text").cast("string").alias("size"), (F.col("conv_id") % TSV_VIDEOS).alias("v"))
    path = scratch_path(spark, "tsv")
    for v in range(TSV_VIDEOS):
        (c.where(F.col("v") == v).drop("v").write.mode("append").option("header", True).option("sep", "\t")
         .option("mapreduce.output.basename", f"video_{v}_captions").csv(path))
    back = RD.read_tsv_per_video(spark, path)
    return back.select(F.col("conv").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.col("size").cast("long").alias("size"), "video_key")


SQL_TSV_PER_VIDEO = f"""
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(length(text) AS BIGINT) AS size,
       'video_' || (conv_id % {TSV_VIDEOS}) AS video_key FROM conversations"""


def q_json_map(spark, sf):
    """Part names as JSON maps ``{key: name}``, read back as rows (SRC-08)."""
    part = read_table(spark, sf, "part")
    maps = part.groupBy(F.floor(F.col("p_partkey") / ROWS_PER_DOCUMENT)).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), "p_name"))).alias("m"))
    path = scratch_path(spark, "json-map")
    _documents(maps.select(F.to_json("m").alias("value")), path)
    return RD.read_json_map(spark, path, "string").select("key", "value")


SQL_JSON_MAP = "SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS value FROM part"


def _box_entries(rows: DataFrame):
    """One-key maps per frame; every frame appears twice, first with a wrong box."""
    box = F.array("x1", "y1", "x2", "y2", "score")
    name = F.concat(F.lpad(F.col("vec_id").cast("string"), 8, "0"), F.lit(".jpg"))
    return rows.select("vec_id", F.floor(F.col("vec_id") / ROWS_PER_DOCUMENT).alias("v"),
                       F.create_map(name, F.array(F.transform(box, lambda x: x + 1000))).alias("old"),
                       F.create_map(name, F.array(box)).alias("new"))


def q_boxes_json(spark, sf):
    """Person boxes as lists of one-key maps per video folder; the later entry
    of a frame wins (SRC-10, SET-08)."""
    lists = _box_entries(P.p_box(spark, sf)).groupBy("v").agg(
        F.concat(F.collect_list("old"), F.collect_list("new")).alias("l"))
    path = scratch_path(spark, "boxes")
    _documents(lists.select("v", F.to_json("l").alias("value")), path, "v")
    back = RD.read_boxes(spark, path).withColumn("b", F.element_at("boxes", 1))
    return back.select(F.col("video_id").substr(3, 20).cast("long").alias("video"), "frame_idx", "frame_name",
                       F.size("boxes").alias("n"), *[F.round(F.element_at("b", i + 1), 6).alias(c)
                                                     for i, c in enumerate(["x1", "y1", "x2", "y2", "score"])])


SQL_BOXES_JSON = P.with_ctes(P.P_BOX_SQL) + f"""
SELECT CAST(vec_id // {ROWS_PER_DOCUMENT} AS BIGINT) AS video, CAST(vec_id AS BIGINT) AS frame_idx,
       lpad(CAST(vec_id AS VARCHAR), 8, '0') || '.jpg' AS frame_name, 1 AS n, round(x1, 6) AS x1, round(y1, 6) AS y1,
       round(x2, 6) AS x2, round(y2, 6) AS y2, round(score, 6) AS score FROM p_box"""


IMAGE_KINDS = 11


def _image_bytes(kind: int, width: int, height: int) -> bytes:
    """The smallest file of one of eleven kinds: five formats, a format that the
    scan does not take, a small, a damaged, a turned, an unknown and a double one."""
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    def directory(order, *tags):
        return {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "IH", 8, len(tags)) + b"".join(
            struct.pack(order + "HHIHH", tag, 3, 1, value, 0) for tag, value in tags) + bytes(4)

    def jpeg(*segments):
        frame = (b"\xc0", struct.pack(">BHHB", 8, height, width, 3) + bytes(9))
        return b"\xff\xd8" + b"".join(b"\xff" + m + struct.pack(">H", len(x) + 2) + x for m, x in (*segments, frame)) + b"\xff\xd9"
    if kind in (0, 7):
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")
        return png if kind == 0 else png[:20] + b"!" + png[21:]
    if kind == 2:
        return b"BM" + bytes(12) + struct.pack("<Iii", 40, width, -height) + bytes(28)
    if kind == 3:
        return directory("<", (0x100, width), (0x101, height))
    if kind == 4:
        return b"RIFF" + bytes(4) + b"WEBPVP8X" + struct.pack("<I", 10) + bytes(4) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
    if kind == 5:
        return b"GIF89a" + struct.pack("<HH", width, height) + bytes(3)
    if kind == 8:
        return jpeg((b"\xe1", b"Exif\0\0" + directory(">", (0x112, 6))))
    if kind == 9:
        return b"not an image"
    if kind == 10:
        return jpeg((b"\xe2", b"MPF\0" + bytes(8)))
    return jpeg()


def _image_rows(batches):
    for pdf in batches:
        content = [_image_bytes(k, w, h) for k, w, h in zip(pdf["kind"], pdf["width"], pdf["height"])]
        yield pdf[["img"]].assign(content=content)


def _tars(batches):
    for pdf in batches:
        for at in range(0, len(pdf), ROWS_PER_DOCUMENT):
            some = pdf.iloc[at:at + ROWS_PER_DOCUMENT]
            names = [f"{img}-{i}" for i, img in enumerate(some["img"])]
            yield pd.DataFrame({"value": [_tar(names, [bytes(c) for c in some["content"]], tarfile.GNU_FORMAT)]})


def _write_tars(files: DataFrame, path: str) -> None:
    """Files (img, content) as members ``<img>-<number>`` of tar archives of at
    most ROWS_PER_DOCUMENT files, written as Spark text like ``_frame_archives``."""
    tars = files.select("img", "content").mapInPandas(_tars, "value binary")
    tars.select(F.col("value").cast("string")).write.options(**MANY_FILES).option("mapreduce.output.basename", "files.tar").text(path, lineSep="\0")


def _member_key(name: str):
    return F.regexp_extract(name, r"([^/]+)-\d+$", 1).cast("long")


def _images(spark, sf):
    """(img, format, width, height, problem) of one image file per supplier,
    written into tar archives and read back."""
    s = read_table(spark, sf, "supplier", spread_rows=True).select(F.col("s_suppkey").alias("img"))
    kind = (F.col("img") % IMAGE_KINDS).cast("int")
    made = s.select("img", kind.alias("kind"), F.when(kind == 6, 9).otherwise(100 + F.col("img") % 50).cast("int").alias("width"),
                    (10 + F.col("img") % 70).cast("int").alias("height")).mapInPandas(_image_rows, "img long, content binary")
    path = scratch_path(spark, "images")
    _write_tars(made, path)
    files = read_archives(spark, path, "files.tar*").withColumnRenamed("frame_name", "path")
    return image_audit(files).select(_member_key("path").alias("img"), "format", "width", "height", "problem")


def q_image_headers(spark, sf):
    """Format, shown size and fault of image files by their headers (FLT-15)."""
    return _images(spark, sf)


SQL_IMAGE_HEADERS = f"""
WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS img, s_suppkey % {IMAGE_KINDS} AS k, CASE s_suppkey % {IMAGE_KINDS} WHEN 6 THEN 9 ELSE 100 + s_suppkey % 50 END AS w,
                  10 + s_suppkey % 70 AS h FROM supplier)
SELECT img, CASE k WHEN 0 THEN 'png' WHEN 2 THEN 'bmp' WHEN 3 THEN 'tiff' WHEN 4 THEN 'webp' WHEN 5 THEN 'gif' WHEN 10 THEN 'mpo'
                   WHEN 7 THEN NULL WHEN 9 THEN NULL ELSE 'jpeg' END AS format,
       CAST(CASE WHEN k IN (7, 9) THEN NULL WHEN k = 8 THEN h ELSE w END AS BIGINT) AS width,
       CAST(CASE WHEN k IN (7, 9) THEN NULL WHEN k = 8 THEN w ELSE h END AS BIGINT) AS height,
       CASE k WHEN 5 THEN 'format gif' WHEN 6 THEN 'too small' WHEN 7 THEN 'bad checksum' WHEN 9 THEN 'unknown format' END AS problem FROM s"""


def _label_status(spark, sf):
    """Label text files of seven kinds (by supplier key modulo 7) and image files
    of eleven kinds, both in tar archives, audited per image."""
    s = read_table(spark, sf, "supplier", spread_rows=True).select(F.col("s_suppkey").alias("img"))
    kind = F.col("img") % 7
    good = F.when(F.col("img") % 2 == 0, "3 0.5 0.5 0.25 0.125").otherwise("3 0.1 0.1 0.5 0.1 0.5 0.4 0.1 0.4")
    text = (F.when(kind == 1, "").when(kind == 2, "3 0.5 0.5 0.25").when(kind == 3, "3 -0.5 0.5 0.25 0.125")
            .when(kind == 4, "3 1.5 0.5 0.25 0.125").when(kind == 5, "3 0.5 0.5 0.25 0.125\n3 0.5 0.5 0.25 0.125").otherwise(good))
    path = scratch_path(spark, "labels")
    _write_tars(s.where(kind != 0).select("img", F.encode(text, "UTF-8").alias("content")), path)
    labels = RD.read_detection_labels(spark, path, archives="files.tar*")
    images = s.join(labels.select(_member_key("file").alias("img"), F.col("file").alias("lf")), "img", "left").join(_images(spark, sf).select("img", "problem"), "img", "left")
    return RD.validate_labels(labels, images, F.coalesce("lf", F.lit("none")))


def q_label_statuses(spark, sf):
    """Label and image file audit: missing, empty, corrupt or found (SRC-14, FLT-15)."""
    first = F.try_element_at("rows", F.lit(1))
    return _label_status(spark, sf).select(F.col("img").cast("long").alias("img"), "status", "problem",
                                           F.round(F.try_element_at(first, F.lit(4)), 6).alias("w"))


SQL_LABEL_STATUSES = f"""
SELECT img, CASE WHEN problem IS NOT NULL THEN 'corrupt' ELSE CASE img % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'empty' WHEN 6 THEN 'found' ELSE 'corrupt' END END AS status,
       problem, CASE WHEN img % 7 < 2 THEN NULL WHEN img % 7 = 6 AND img % 2 = 1 THEN 0.4 ELSE 0.25 END::DOUBLE AS w
FROM ({SQL_IMAGE_HEADERS})"""


def q_label_report(spark, sf):
    """Counts per label status and the total (AG-26)."""
    return RD.label_report(_label_status(spark, sf))


SQL_LABEL_REPORT = f"""
WITH s AS ({SQL_LABEL_STATUSES})
SELECT status, count(*) AS n FROM s GROUP BY status UNION ALL SELECT 'total', count(*) FROM s"""

VOCAB_TEMPLATES = ["a photo of {}.", "it's {}"]


def _vocab(spark, sf):
    part = read_table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    names = F.transform("r", lambda s: F.concat(F.lit("    ['"), s["p_name"], F.lit("', '"), s["p_brand"], F.lit("'],")))
    sets = part.groupBy(F.floor(F.col("p_partkey") / ROWS_PER_DOCUMENT).alias("g")).agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_brand"))).alias("r"))
    text = F.concat(F.lit("# Prompts\n\n## set"), F.col("g").cast("string"), F.lit("\n\nclasses = [\n"), F.array_join(names, "\n"),
                    F.lit("\n]\n\ntemplates = [\n" + "".join(f"    {t!r},\n" for t in VOCAB_TEMPLATES) + "]\n"))
    path = scratch_path(spark, "vocab")
    _documents(sets.select(text.alias("value")), path)
    return RD.read_prompt_vocab(spark, path)


def q_prompt_vocab(spark, sf):
    """Part names and brands as markdown prompt vocabularies, read back as
    prompts of every class, name and template (SRC-16)."""
    classes, templates = _vocab(spark, sf)
    n = classes.select("dataset", F.col("class_id").cast("long").alias("class_id"), F.explode("names").alias("name"))
    return n.join(templates, "dataset").select("dataset", "class_id", "name", F.col("template_idx").cast("long").alias("template_idx"), "template")


SQL_PROMPT_VOCAB = f"""
WITH p AS (SELECT 'set' || (p_partkey // {ROWS_PER_DOCUMENT}) AS dataset, p_name, p_brand,
                  row_number() OVER (PARTITION BY p_partkey // {ROWS_PER_DOCUMENT} ORDER BY p_partkey) - 1 AS class_id FROM part),
n AS (SELECT dataset, class_id, unnest([p_name, p_brand]) AS name FROM p)
SELECT dataset, class_id, name, template_idx, template
FROM n, (VALUES (0::BIGINT, 'a photo of {{}}.'), (1::BIGINT, 'it''s {{}}')) AS t(template_idx, template)"""


def q_playlist_json(spark, sf):
    """Documents as playlist entries in JSON arrays, read back (SRC-17)."""
    d = read_table(spark, sf, "documents")
    lists = d.groupBy(F.floor(F.col("doc_id") / ROWS_PER_DOCUMENT)).agg(F.collect_list(F.struct(
        F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("link"), F.col("n_chars").cast("string").alias("duration"),
        F.col("source").alias("title"))).alias("l"))
    path = scratch_path(spark, "playlist")
    _documents(lists.select(F.to_json("l").alias("value")), path)
    return RD.read_playlist(spark, path)


SQL_PLAYLIST_JSON = "SELECT 'v' || doc_id AS link, CAST(n_chars AS VARCHAR) AS duration, source AS title FROM documents"


def q_media_list(spark, sf):
    """Media named in a list file: other suffixes dropped, ``./`` resolved
    against the list's folder, images before videos (SRC-15)."""
    d = read_table(spark, sf, "documents").select("doc_id")
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("JPG", "mp4", "txt", "png")]), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, "./m/").otherwise("/far/"), F.col("doc_id").cast("string"), F.lit("."), suffix)
    path = scratch_path(spark, "media")
    d.select(name.alias("value")).write.text(path)
    listed = RD.list_media(spark, path, list_file=path)
    near = F.regexp_extract("path", r"/media-[0-9a-f]+/m/([^/]+)$", 1)
    return listed.select("media", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), (near != "").alias("resolved"))


SQL_MEDIA_LIST = """
SELECT CASE doc_id % 4 WHEN 1 THEN 'video' ELSE 'image' END AS media,
       doc_id || '.' || CASE doc_id % 4 WHEN 0 THEN 'JPG' WHEN 1 THEN 'mp4' ELSE 'png' END AS name, doc_id % 3 = 0 AS resolved
FROM documents WHERE doc_id % 4 <> 2"""


def _frame_files(spark, sf) -> str:
    """One file per supplier in the folder of its nation."""
    path = scratch_path(spark, "frames")
    _documents(read_table(spark, sf, "supplier", spread_rows=True).select("s_nationkey", F.col("s_name").alias("value")), path, "s_nationkey")
    return path


def q_frame_files(spark, sf):
    """Frame files listed per video folder without reading them (SRC-12)."""
    m = RD.frame_manifest(spark, _frame_files(spark, sf), glob="*.txt")
    return m.groupBy(F.split("video_id", "=")[1].cast("long").alias("video")).agg(F.count("frame_name").alias("n_frames"))


SQL_FRAME_FILES = "SELECT CAST(s_nationkey AS BIGINT) AS video, count(*) AS n_frames FROM supplier GROUP BY 1"


def _tar(names: list[str], contents: list[bytes], form: int) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=form) as t:
        for name, content in zip(names, contents):
            member = tarfile.TarInfo(name)
            member.size = len(content)
            t.addfile(member, io.BytesIO(content))
    return out.getvalue()


def _frame_archives(rows: DataFrame, path: str, damage: bool = False) -> None:
    """Tar files of at most ROWS_PER_DOCUMENT suppliers in the folder of their
    nation, written as Spark text (its line end is a zero byte behind the
    archive's end mark): by nation plain or gzip, GNU or POSIX, some names longer
    than a header's field.  With ``damage`` two nations of five are cut off in
    the last member or hit in the second header."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s_suppkey")
        nation = int(pdf["s_nationkey"].iloc[0])
        names = [("folder/" * 20 if k % 3 == 0 and not damage else "frames/") + f"{k:08d}.jpg" for k in pdf["s_suppkey"]]
        raw = _tar(names, [n.encode() for n in pdf["s_name"]], tarfile.GNU_FORMAT if nation % 2 else tarfile.PAX_FORMAT)
        if damage and nation % 5 == 2:
            raw = raw[:1024 * (len(pdf) - 1) + 512]
        if damage and nation % 5 == 3:
            raw = raw[:1024 + 7] + b"!" + raw[1024 + 8:]
        return pd.DataFrame({"s_nationkey": [nation], "g": [int(pdf["g"].iloc[0])], "value": [raw]})
    tars = rows.withColumn("g", F.floor(F.col("s_suppkey") / ROWS_PER_DOCUMENT)).groupBy("s_nationkey", "g") \
        .applyInPandas(pack, "s_nationkey long, g long, value binary")
    tars = spread(cut_lineage(tars.withColumn("value", F.col("value").cast("string"))))
    for packed, kind in ((F.col("s_nationkey") % 4 < 2, None), (F.col("s_nationkey") % 4 >= 2, "gzip")):
        tars.where(packed).drop("g").write.mode("append").options(**MANY_FILES).option("mapreduce.output.basename", "frames.tar") \
            .partitionBy("s_nationkey").text(path, compression=kind, lineSep="\0")


def q_packed_frames(spark, sf):
    """Frames packed per video with their bytes, read back (SNK-07): suppliers
    with an even key lie as files in a folder, the others in tar archives."""
    suppliers = read_table(spark, sf, "supplier", spread_rows=True).select("s_suppkey", "s_nationkey", "s_name")
    path, out = scratch_path(spark, "frames"), scratch_path(spark, "packed")
    _documents(suppliers.where("s_suppkey % 2 = 0").select("s_nationkey", F.col("s_name").alias("value")), path, "s_nationkey")
    _frame_archives(suppliers.where("s_suppkey % 2 = 1"), f"{path}/archives")
    SK.pack_frames(spark, path, out, glob="part*", archives="frames.tar*")
    back = spark.read.parquet(out)
    return back.select(F.regexp_extract(F.col("video_id").cast("string"), r"(\d+)$", 1).cast("long").alias("video"),
                       F.when(F.col("frame_name").endswith(".jpg"), F.col("frame_name")).alias("member"),
                       F.trim(F.translate(F.decode("content", "UTF-8"), "\n", "")).alias("frame"))


SQL_PACKED_FRAMES = """
SELECT CAST(s_nationkey AS BIGINT) AS video, CASE WHEN s_suppkey % 2 = 1 THEN lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '.jpg' END AS member,
       trim(s_name) AS frame FROM supplier"""


def q_archive_report(spark, sf):
    """Frames, bytes and damage of frame archives (SNK-07)."""
    path = scratch_path(spark, "archives")
    _frame_archives(read_table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_name"), path, damage=True)
    report = archive_report(spark, path, "frames.tar*")
    return report.groupBy(F.regexp_extract("archive", r"=(\d+)/[^/]+$", 1).cast("long").alias("video"), "error") \
        .agg(F.count(F.lit(1)).alias("n_archives"), F.sum("n_frames").alias("n_frames"), F.sum("n_bytes").alias("n_bytes"))


SQL_ARCHIVE_REPORT = f"""
WITH m AS (SELECT s_nationkey AS v, s_suppkey // {ROWS_PER_DOCUMENT} AS g, strlen(s_name) AS b,
                  row_number() OVER (PARTITION BY s_nationkey, s_suppkey // {ROWS_PER_DOCUMENT} ORDER BY s_suppkey) AS i,
                  count(*) OVER (PARTITION BY s_nationkey, s_suppkey // {ROWS_PER_DOCUMENT}) AS n FROM supplier),
k AS (SELECT v, g, CASE v % 5 WHEN 2 THEN 'member cut off' WHEN 3 THEN 'bad header checksum' END AS error,
             CASE v % 5 WHEN 2 THEN i < n WHEN 3 THEN i = 1 ELSE true END AS whole, b FROM m)
SELECT CAST(v AS BIGINT) AS video, error, count(DISTINCT g) AS n_archives, CAST(count(*) FILTER (whole) AS BIGINT) AS n_frames,
       CAST(coalesce(sum(b) FILTER (whole), 0) AS BIGINT) AS n_bytes FROM k GROUP BY v, error"""


def q_fingerprint(spark, sf):
    """Sum of the frame files' sizes (AG-27)."""
    return RD.fingerprint(spark, [f"{_frame_files(spark, sf)}/*"])


SQL_FINGERPRINT = "SELECT CAST(sum(strlen(s_name) + 1) AS BIGINT) AS total_bytes FROM supplier"


def q_sentences_json(spark, sf):
    """Captions written by the transcript sink, one folder per video, read back (SNK-03)."""
    path = scratch_path(spark, "sentences")
    SK.write_transcripts(P.p_caption(spark, sf).select("video_id", "cap_idx", "text"), path, order="cap_idx")
    back = spark.read.schema("cap_idx long, text string, video_id long").json(path)
    return back.select("video_id", "cap_idx", "text")


SQL_SENTENCES_JSON = "SELECT CAST(conv_id AS BIGINT) AS video_id, CAST(turn AS BIGINT) AS cap_idx, text FROM conversations"


def q_clip_index_lines(spark, sf):
    """Clip index written as JSON lines and read by the clip index reader (SRC-11)."""
    idx = global_row_index(q_clip_index(spark, sf), ["video_id", "cap_idx"], "row_idx").drop("cap_idx")
    path = scratch_path(spark, "clip-lines")
    SK.write_clip_index(idx.withColumn("video_id", F.col("video_id").cast("string")), path)
    return RD.read_clip_index(spark, path, lines=True)


SQL_CLIP_INDEX_LINES = f"""
SELECT row_number() OVER (ORDER BY video_id, cap_idx) - 1 AS row_idx, CAST(video_id AS VARCHAR) AS video_id, duration,
       CAST(start_frame AS INTEGER) AS start_frame, CAST(end_frame AS INTEGER) AS end_frame, text, neutral_score, has_person
FROM ({SQL_CLIP_INDEX})"""


def q_clip_index_array(spark, sf):
    """Clip index documents, one JSON array a file, read by byte ranges with
    every clip's place in its file (SRC-11)."""
    idx = q_clip_index(spark, sf).withColumn("doc", F.floor(F.col("video_id") / ROWS_PER_DOCUMENT))
    fields = ["video_id", "duration", "start_frame", "end_frame", "text", "neutral_score", "has_person"]
    row = F.struct("video_id", "cap_idx", F.struct(F.col("video_id").cast("string").alias("video_id"), *fields[1:]).alias("clip"))
    docs = idx.groupBy("doc").agg(F.array_sort(F.collect_list(row)).alias("r"))
    path = scratch_path(spark, "clip-arrays")
    _documents(docs.select("doc", F.to_json(F.transform("r", lambda x: x["clip"])).alias("value")), path, "doc")
    return RD.read_clip_index(spark, path).withColumn("text", F.coalesce("text", F.lit("")))


SQL_CLIP_INDEX_ARRAY = f"""
SELECT row_number() OVER (PARTITION BY video_id // {ROWS_PER_DOCUMENT} ORDER BY video_id, cap_idx) - 1 AS row_idx, CAST(video_id AS VARCHAR) AS video_id, duration,
       CAST(start_frame AS INTEGER) AS start_frame, CAST(end_frame AS INTEGER) AS end_frame, coalesce(text, '') AS text, neutral_score, has_person
FROM ({SQL_CLIP_INDEX})"""


def q_geo_subset(spark, sf):
    """Customers whose nation is in a country table (FLT-20)."""
    nations = read_table(spark, sf, "nation").where("n_regionkey = 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return TB.subset_geo(read_table(spark, sf, "customer"), nations, "c_nationkey").select("c_custkey", "n_name")


SQL_GEO_SUBSET = "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3"


def q_word_categories(spark, sf):
    """Customers' nation names mapped to the category that lists them (SC-28)."""
    nation = read_table(spark, sf, "nation")
    lists = (nation.where("n_regionkey <> 2").join(read_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
             .groupBy(F.col("r_name").alias("category")).agg(F.collect_list("n_name").alias("words")))
    words = read_table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("word"))
    return TB.nearest_category(words, lists).select("c_custkey", "word", "category")


SQL_WORD_CATEGORIES = """
SELECT c_custkey, n_name AS word, CASE WHEN n_regionkey <> 2 THEN r_name END AS category
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

QUERIES = {
    "whitespace_table": (q_whitespace_table, SQL_WHITESPACE_TABLE),
    "tsv_per_video": (q_tsv_per_video, SQL_TSV_PER_VIDEO),
    "json_map": (q_json_map, SQL_JSON_MAP),
    "boxes_json": (q_boxes_json, SQL_BOXES_JSON),
    "image_headers": (q_image_headers, SQL_IMAGE_HEADERS),
    "label_statuses": (q_label_statuses, SQL_LABEL_STATUSES),
    "label_report": (q_label_report, SQL_LABEL_REPORT),
    "prompt_vocab": (q_prompt_vocab, SQL_PROMPT_VOCAB),
    "playlist_json": (q_playlist_json, SQL_PLAYLIST_JSON),
    "media_list": (q_media_list, SQL_MEDIA_LIST),
    "frame_files": (q_frame_files, SQL_FRAME_FILES),
    "packed_frames": (q_packed_frames, SQL_PACKED_FRAMES),
    "archive_report": (q_archive_report, SQL_ARCHIVE_REPORT),
    "fingerprint": (q_fingerprint, SQL_FINGERPRINT),
    "sentences_json": (q_sentences_json, SQL_SENTENCES_JSON),
    "clip_index_lines": (q_clip_index_lines, SQL_CLIP_INDEX_LINES),
    "clip_index_array": (q_clip_index_array, SQL_CLIP_INDEX_ARRAY),
    "geo_subset": (q_geo_subset, SQL_GEO_SUBSET),
    "word_categories": (q_word_categories, SQL_WORD_CATEGORIES),
}
