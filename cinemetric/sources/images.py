"""Format, size and orientation of image files from their headers.

Nothing is decoded: the size stands in the first bytes of every format (after
the application segments in JPEG, in the first directory of TIFF).  What is
checked beyond that is what makes a file unreadable: cut off headers, unknown
formats, and the checksums of PNG chunks.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: formats accepted by the label scan, the smallest side, EXIF tags
FORMATS = ["bmp", "jpeg", "png", "tiff", "webp", "mpo"]
SMALLEST = 10
ORIENTATION, WIDTH_TAG, HEIGHT_TAG = 0x0112, 0x0100, 0x0101
TURNED = (6, 8)              # orientations that swap width and height in the scan


class ImageError(ValueError):
    """What is wrong with an image file."""


def _need(data: bytes, n: int) -> None:
    if len(data) < n:
        raise ImageError("header cut off")


def _directory(data: bytes, start: int = 0) -> dict[int, int]:
    """Tags with one short or long value of the first TIFF directory whose
    header is at ``start``."""
    _need(data, start + 8)
    order = {b"II": "<", b"MM": ">"}.get(data[start:start + 2])
    if not order or struct.unpack(order + "H", data[start + 2:start + 4])[0] != 42:
        raise ImageError("bad directory")
    at = start + struct.unpack(order + "I", data[start + 4:start + 8])[0]
    _need(data, at + 2)
    count = struct.unpack(order + "H", data[at:at + 2])[0]
    _need(data, at + 2 + 12 * count)
    out = {}
    for i in range(count):
        entry = data[at + 2 + 12 * i:at + 14 + 12 * i]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if n == 1 and kind in (3, 4):
            out[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8:10 if kind == 3 else 12])[0]
    return out


def _exif(block: bytes) -> int:
    """Orientation of an EXIF block, 1 where it has none or can't be read."""
    try:
        return _directory(block[6:] if block[:6] == b"Exif\0\0" else block).get(ORIENTATION, 1)
    except ImageError:
        return 1


def _png(data: bytes) -> tuple[str, int, int, int]:
    at, size, turn = 8, None, 1
    while True:
        _need(data, at + 12)
        length, kind = struct.unpack(">I4s", data[at:at + 8])
        _need(data, at + 12 + length)
        body = data[at + 8:at + 8 + length]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + length:at + 12 + length])[0]:
            raise ImageError("bad checksum")
        if size is None:
            if kind != b"IHDR" or length != 13:
                raise ImageError("no header chunk")
            size = struct.unpack(">II", body[:8])
        if kind == b"eXIf":
            turn = _exif(body)
        if kind == b"IEND":
            return ("png", *size, turn)
        at += 12 + length


def _jpeg(data: bytes) -> tuple[str, int, int, int]:
    at, turn, several = 2, 1, False
    while True:
        _need(data, at + 4)
        if data[at] != 0xFF:
            raise ImageError("bad marker")
        marker = data[at + 1]
        if marker == 0xFF:                                   # fill byte
            at += 1
            continue
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:         # no length
            at += 2
            continue
        length = struct.unpack(">H", data[at + 2:at + 4])[0]
        if marker in (0xD9, 0xDA) or length < 2:
            raise ImageError("no frame header")
        _need(data, at + 2 + length)
        body = data[at + 4:at + 2 + length]
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            turn = _exif(body)
        if marker == 0xE2 and body[:4] == b"MPF\0":
            several = True
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            _need(body, 5)
            height, width = struct.unpack(">HH", body[1:5])
            return "mpo" if several else "jpeg", width, height, turn
        at += 2 + length


def _bmp(data: bytes) -> tuple[str, int, int, int]:
    _need(data, 18)
    size = struct.unpack("<I", data[14:18])[0]
    if size == 12:
        _need(data, 22)
        return ("bmp", *struct.unpack("<HH", data[18:22]), 1)
    if size not in (40, 52, 56, 64, 108, 124):
        raise ImageError("unknown bitmap header")
    _need(data, 26)
    width, height = struct.unpack("<ii", data[18:26])
    return "bmp", width, abs(height), 1


def _webp(data: bytes) -> tuple[str, int, int, int]:
    _need(data, 30)
    kind = data[12:16]
    if kind == b"VP8 ":
        if data[23:26] != b"\x9d\x01\x2a":
            raise ImageError("no frame header")
        width, height = struct.unpack("<HH", data[26:30])
        return "webp", width & 0x3FFF, height & 0x3FFF, 1
    if kind == b"VP8L":
        if data[20] != 0x2F:
            raise ImageError("no frame header")
        bits = int.from_bytes(data[21:25], "little")
        return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 1
    if kind != b"VP8X":
        raise ImageError("unknown chunk")
    width, height = (int.from_bytes(data[i:i + 3], "little") + 1 for i in (24, 27))
    at, turn = 12, 1
    while data[20] & 0x08 and at + 8 <= len(data):           # it says that EXIF follows
        name, length = data[at:at + 4], int.from_bytes(data[at + 4:at + 8], "little")
        if name == b"EXIF":
            turn = _exif(data[at + 8:at + 8 + length])
            break
        at += 8 + length + length % 2
    return "webp", width, height, turn


def _tiff(data: bytes) -> tuple[str, int, int, int]:
    tags = _directory(data)
    if WIDTH_TAG not in tags or HEIGHT_TAG not in tags:
        raise ImageError("no size")
    return "tiff", tags[WIDTH_TAG], tags[HEIGHT_TAG], 1      # the scan turns no TIFF


def header(data: bytes) -> tuple[str, int, int, int]:
    """(format, width, height, orientation) of an image file's bytes."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:3] == b"\xff\xd8\xff":
        return _jpeg(data)
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _webp(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return _tiff(data)
    if data[:6] in (b"GIF87a", b"GIF89a"):
        _need(data, 10)
        return ("gif", *struct.unpack("<HH", data[6:10]), 1)
    raise ImageError("unknown format" if data else "empty file")


def audit(data: bytes) -> tuple:
    """(format, width, height, problem): the size as shown, that is turned by
    the orientation; problem is null where the scan accepts the image."""
    try:
        kind, width, height, turn = header(data)
    except ImageError as e:
        return None, None, None, str(e)
    if turn in TURNED:
        width, height = height, width
    problem = f"format {kind}" if kind not in FORMATS else None
    if width < SMALLEST or height < SMALLEST:
        problem = "too small"
    return kind, width, height, problem


def _audits(batches):
    for pdf in batches:
        rows = [(path, *audit(bytes(data))) for path, data in zip(pdf["path"], pdf["content"])]
        out = pd.DataFrame(rows, columns=["path", "format", "width", "height", "problem"])
        yield out.astype({"width": "Int64", "height": "Int64"})


def image_audit(files: DataFrame) -> DataFrame:
    """path, format, width, height, problem for every row of ``files`` (path,
    content), as ``spark.read.format("binaryFile")`` gives them.  A null or empty
    content is an empty file."""
    rows = files.select("path", F.coalesce("content", F.lit(b"")).alias("content"))
    return rows.mapInPandas(_audits, "path string, format string, width long, height long, problem string")
