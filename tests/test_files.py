"""Tar archives, image headers, and JSON and CSV files read by byte ranges."""

import csv
import gzip
import io
import json
import os
import random
import struct
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from cinemetric.plans.catalog_files import _image_bytes
from cinemetric.sources import archives as AR
from cinemetric.sources import images as IM
from cinemetric.sources import readers as RD
from cinemetric.sources import sinks as SK
from cinemetric.sources import splits as SP


def _save(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def _tar(entries, form=tarfile.GNU_FORMAT, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode, format=form) as t:
        for name, data in entries:
            m = tarfile.TarInfo(name)
            if data is None:
                m.type = tarfile.DIRTYPE
            elif isinstance(data, str):
                m.type, m.linkname = tarfile.SYMTYPE, data
            else:
                m.size = len(data)
            t.addfile(m, io.BytesIO(data) if isinstance(data, bytes) else None)
    return out.getvalue()


ENTRIES = [("v", None), ("v/1.jpg", b"one"), ("v/empty.jpg", b""), ("v/" + "n" * 300 + ".jpg", b"long" * 400), ("v/é.jpg", b"\0\xff" * 256),
           ("v/link", "1.jpg"), ("w/1.jpg", b"again"), ("d/" * 60 + "x.jpg", b"deep")]


@pytest.mark.parametrize("form", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress, lambda x: gzip.compress(x[:3000]) + gzip.compress(x[3000:]) + bytes(7)])
def test_archive_members(form, pack):
    raw = pack(_tar(ENTRIES, form))
    assert [(n, c) for _, n, c in AR.members(raw)] == [(n, c) for n, c in ENTRIES if isinstance(c, bytes)]
    got = {n: c for _, n, c, e in AR.frames(raw)}
    assert got == {"1.jpg": b"again", "empty.jpg": b"", "n" * 300 + ".jpg": b"long" * 400, "é.jpg": b"\0\xff" * 256, "x.jpg": b"deep"}


def test_prefixed_names_and_large_numbers():
    raw = _tar([("p" * 90 + "/" + "q" * 60, b"z")], tarfile.USTAR_FORMAT)
    assert [n for _, n, _ in AR.members(raw)] == ["p" * 90 + "/" + "q" * 60]
    assert AR._number(b"\x80" + bytes(6) + b"\x01\x02\x03\x04\x05") == 0x0102030405 and AR._number(b"0000017\0") == 15


def test_damaged_archives_keep_what_precedes():
    raw = _tar([("a", b"x" * 600), ("b", b"y" * 600), ("c", b"z" * 10)])
    cases = {"member cut off": raw[:512 + 1024 + 512 + 100], "header cut off": raw[:512 + 1024 + 300], "bad header checksum": raw[:1536 + 3] + b"?" + raw[1536 + 4:],
             "bad number in a header": raw[:1536 + 148] + b"zz" + raw[1536 + 150:]}
    for error, data in cases.items():
        rows = list(AR.frames(data))
        assert [(r[1], r[3]) for r in rows] == [("a", None), (None, error)], error
    noise = random.Random(1).randbytes(5000)
    packed = gzip.compress(_tar([("a", noise), ("b", noise[::-1])]))
    assert [r[3] for r in AR.frames(packed[:8000])] == [None, "gzip data ends early"]
    assert list(AR.frames(packed[:12] + b"\xff\xff" + packed[14:]))[-1][3] is not None
    assert list(AR.frames(b"")) == [] and list(AR.frames(bytes(10240))) == []
    assert list(AR.frames(b"no archive at all" * 40))[-1][3] is not None


def test_pack_frames_from_folders_and_archives(spark, tmp_dir):
    _save(f"{tmp_dir}/in/v1/1.jpg", b"f1")
    _save(f"{tmp_dir}/in/v1/frames.tar.gz", gzip.compress(_tar([("v1", None), ("v1/2.jpg", b"f2"), ("v1/3.jpg", b"f3")])))
    _save(f"{tmp_dir}/in/v2/frames.tar", _tar([("9.jpg", b"f9"), ("8.jpg", b"f8")])[:1024 + 512])
    SK.pack_frames(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", archives="*.tar*")
    got = sorted((r.video_id, r.frame_name, bytes(r.content)) for r in spark.read.parquet(f"{tmp_dir}/out").collect())
    assert got == [("v1", "1.jpg", b"f1"), ("v1", "2.jpg", b"f2"), ("v1", "3.jpg", b"f3"), ("v2", "9.jpg", b"f9")]
    report = sorted((r.archive.rsplit("/", 2)[1], r.n_frames, r.n_bytes, r.error) for r in AR.archive_report(spark, f"{tmp_dir}/in").collect())
    assert report == [("v1", 2, 4, None), ("v2", 1, 2, "member cut off")]


def test_image_headers():
    kinds = ["png", "jpeg", "bmp", "tiff", "webp", "gif", "jpeg", None, "jpeg", None, "mpo"]
    for k, name in enumerate(kinds):
        got = IM.audit(_image_bytes(k, 120, 40))
        assert got[0] == name and got[1:3] == ((None, None) if name is None else (40, 120) if k == 8 else (120, 40)), k
    assert IM.audit(_image_bytes(1, 9, 40))[3] == IM.audit(_image_bytes(8, 40, 9))[3] == "too small" and IM.audit(_image_bytes(1, 10, 10))[3] is None
    lossy = b"RIFF\0\0\0\0WEBPVP8 " + bytes(7) + b"\x9d\x01\x2a" + struct.pack("<HH", 0x4000 | 300, 200)
    lossless = b"RIFF\0\0\0\0WEBPVP8L" + bytes(4) + b"\x2f" + ((300 - 1) | (200 - 1) << 14).to_bytes(4, "little") + bytes(5)
    for data in (lossy, lossless):
        assert IM.audit(data)[:3] == ("webp", 300, 200)
    old_bmp = b"BM" + bytes(12) + struct.pack("<IHH", 12, 50, 60)
    assert IM.audit(old_bmp)[:3] == ("bmp", 50, 60)
    big = b"MM\0*" + struct.pack(">IH", 8, 2) + struct.pack(">HHII", 0x100, 4, 1, 70) + struct.pack(">HHII", 0x101, 4, 1, 80)
    assert IM.audit(big)[:3] == ("tiff", 70, 80)
    body = b"eXIf"
    exif = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHIHH", 0x112, 3, 1, 8, 0)
    png = _image_bytes(0, 30, 20)
    turned = png[:33] + struct.pack(">I", len(exif)) + body + exif + struct.pack(">I", zlib.crc32(body + exif)) + png[33:]
    assert IM.audit(turned)[:3] == ("png", 20, 30)
    assert IM.audit(b"")[3] == "empty file"


def test_cut_off_images_are_reported():
    for k in (0, 1, 2, 3, 4, 8, 10):
        whole = _image_bytes(k, 120, 40)
        for n in range(len(whole)):
            kind, *_, problem = IM.audit(whole[:n])
            assert problem is not None or (kind, n) and IM.audit(whole[:n])[:3] == IM.audit(whole)[:3]


def test_image_audit_of_rows(spark):
    rows = [("a", _image_bytes(0, 20, 20)), ("b", None), ("c", b""), ("d", b"x" * 100), ("a", _image_bytes(0, 20, 20))]
    got = sorted((r.path, r.format or "", r.width or 0, r.problem or "") for r in IM.image_audit(spark.createDataFrame(rows, "path string, content binary")).collect())
    assert got == [("a", "png", 20, ""), ("a", "png", 20, ""), ("b", "", 0, "empty file"), ("c", "", 0, "empty file"), ("d", "", 0, "unknown format")]
    assert IM.image_audit(spark.createDataFrame([], "path string, content binary")).count() == 0
    images = spark.createDataFrame([("i1", "too small"), ("i2", None)], "path string, problem string")
    labels = spark.createDataFrame([("i1", [[0.0, 0.5, 0.5, 0.1, 0.1]]), ("i2", [[0.0, 0.5, 0.5, 0.1, 0.1]])], "file string, rows array<array<double>>")
    assert {r.path: r.status for r in RD.validate_labels(labels, images, F.col("path")).collect()} == {"i1": "corrupt", "i2": "found"}


@pytest.fixture()
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "1511", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _value(rng, deep=0):
    kind = rng.random()
    if deep < 3 and kind < 0.2:
        return [_value(rng, deep + 1) for _ in range(rng.randint(0, 3))]
    if deep < 3 and kind < 0.4:
        return {rng.choice(["a", 'b"', "c,}", "d\\"]): _value(rng, deep + 1) for _ in range(rng.randint(0, 3))}
    return rng.choice([1, None, True, -2.5, "x", 'q"uo"te', "back\\slash\\", "}{][,:", "é😀", "\n\t", "z" * rng.randint(0, 2000)])


def test_json_arrays_by_ranges(spark, tmp_dir, small_ranges):
    rng = random.Random(3)
    anything, objects = [_value(rng) for _ in range(300)], [{"i": i, "v": _value(rng)} for i in range(300)]
    table = {f'k{i}"': _value(rng) for i in range(200)}
    _save(f"{tmp_dir}/a.json", json.dumps(anything, ensure_ascii=False).encode())
    _save(f"{tmp_dir}/o.json", json.dumps(objects, indent=1).encode())
    _save(f"{tmp_dir}/m.json", b" \n" + json.dumps(table).encode() + b"\n")

    def rows(df):
        got = sorted((r.row_idx, r.value) for r in df.collect())
        assert [i for i, _ in got] == list(range(len(got)))
        return [v for _, v in got]
    assert SP._pieces(spark, f"{tmp_dir}/a.json", 44).rdd.getNumPartitions() > 20
    assert [json.loads(v) for v in rows(SP.json_elements(spark, f"{tmp_dir}/a.json"))] == anything
    assert [json.loads(v) for v in rows(SP.json_elements(spark, f"{tmp_dir}/o.json", objects=True))] == objects
    assert [json.loads(v) for v in rows(SP.json_elements(spark, f"{tmp_dir}/o.json"))] == objects
    assert [json.loads("{" + v + "}") for v in rows(SP.json_elements(spark, f"{tmp_dir}/m.json", "{"))] == [{k: v} for k, v in table.items()]


def test_small_and_broken_json(spark, tmp_dir):
    for name, text in (("e", "[]"), ("f", "[ ]\n"), ("g", "[1]"), ("h", "[[], {}]"), ("i", '["a,b" , null]')):
        _save(f"{tmp_dir}/s/{name}.json", text.encode())
    got = sorted((r.file[-6], r.row_idx, r.value) for r in SP.json_elements(spark, f"{tmp_dir}/s").collect())
    assert got == [("g", 0, "1"), ("h", 0, "[]"), ("h", 1, "{}"), ("i", 0, '"a,b"'), ("i", 1, "null")]
    for text in ('[{"a":1}, {"b":', '[{"a":1}', '[{"a":"x}]', '{"a":1}]'):
        _save(f"{tmp_dir}/bad.json", text.encode())
        with pytest.raises(Exception, match="whole JSON document|does not start"):
            SP.json_elements(spark, f"{tmp_dir}/bad.json", objects=True).collect()


def test_clip_index_by_ranges(spark, tmp_dir, small_ranges):
    rows = [{"video_id": f"v{i}", "duration": i / 2, "start_frame": i, "end_frame": i + 9, "text": "} {\\\" , [" * (i % 7), "neutral_score": 0.5, "has_person": 1.0} for i in range(400)]
    _save(f"{tmp_dir}/index.json", json.dumps(rows).encode())
    got = RD.read_clip_index(spark, f"{tmp_dir}/index.json").orderBy("row_idx").collect()
    assert [(r.row_idx, r.video_id, r.text, r.end_frame) for r in got] == [(i, r["video_id"], r["text"], r["end_frame"]) for i, r in enumerate(rows)]
    _save(f"{tmp_dir}/map.json", b'{"a": 1, "b": 2, "a": 3}')
    assert {(r.key, r.value) for r in RD.read_json_map(spark, f"{tmp_dir}/map.json", "int").collect()} == {("a", 3), ("b", 2)}


def test_csv_by_ranges(spark, tmp_dir, small_ranges):
    rng = random.Random(5)
    words = ["plain", "com,ma", 'quo"te', "two\nlines", "crlf\r\nin", '"', 'a""b', "x" * 900, "end\n\n\nof", "café", "a\"b,c"]
    rows = [[str(i), rng.choice(words) + rng.choice(words), str(i % 5)] for i in range(300)]
    text = io.StringIO(newline="")
    csv.writer(text).writerows([["id", "Word", "Conc.M"], *rows])
    _save(f"{tmp_dir}/c/u.csv", text.getvalue().encode())
    other = [["x" + r[0], r[1], r[2]] for r in rows]
    text = io.StringIO(newline="")
    csv.writer(text, lineterminator="\n").writerows([["Conc.M", "id", "Word"], *[[r[2], r[0], r[1]] for r in other]])
    _save(f"{tmp_dir}/c/l.csv", text.getvalue().encode("latin-1"))
    assert SP._pieces(spark, f"{tmp_dir}/c", 10).rdd.getNumPartitions() > 20
    got = {r.id: (r.expr_text, r.rating) for r in RD.read_expressions(spark, f"{tmp_dir}/c").collect()}
    assert got == {r[0]: (r[1], float(r[2])) for r in rows + other}


def test_csv_edges(spark, tmp_dir):
    _save(f"{tmp_dir}/a.csv", b"\xef\xbb\xbfWord,Conc.M,,Word\n\nx\"y,1,2,3\n" + b'"open, to the end\n and on,4\n')
    got = RD.read_csv_records(spark, f"{tmp_dir}/a.csv")
    assert got.columns == ["Word0", "Conc.M", "_c2", "Word3"]
    assert [r[0] for r in sorted(got.collect(), key=lambda r: r[0] or "")][1] == 'x"y' and got.count() == 2
    _save(f"{tmp_dir}/h.csv", b"Word,Conc.M")
    assert RD.read_expressions(spark, f"{tmp_dir}/h.csv").count() == 0
