"""Frames inside tar archives (plain or gzip), one row per member.

An archive is read front to back: 512-byte headers with checksums, names in the
short, prefixed, GNU long and POSIX extended forms, sizes in octal or base 256.
Gzip data is inflated as it is read, so a task holds the stored archive, one
member and a batch of members of bounded size, not the unpacked archive.  A
damaged archive is data, not a failure: the members before the damage come out
and one more row says what is wrong.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 512
BATCH_BYTES = 32 << 20
STEP = 1 << 20
#: Spark hands a file over as one value, which ends at 2 GiB.
LARGEST = (1 << 31) - (1 << 20)


class ArchiveError(ValueError):
    """What is wrong with an archive."""


class _Unpacked:
    """Sequential reads of an archive's bytes, inflated if they are gzip."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.ready = memoryview(raw), 0, bytearray()
        self.inflate = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None
        self.gzip = self.inflate is not None

    def _more(self) -> bool:
        if not self.gzip:
            self.ready += self.raw[self.at:self.at + STEP]
            self.at += STEP
            return self.at - STEP < len(self.raw)
        if self.inflate is None or self.inflate.eof:       # the next gzip member; zeros after one are padding
            while self.at < len(self.raw) and self.raw[self.at] == 0:
                self.at += 1
            if self.at >= len(self.raw):
                return False
            self.inflate = zlib.decompressobj(31)
        piece = self.inflate.unconsumed_tail
        if not piece:
            piece = self.raw[self.at:self.at + STEP]
            self.at += len(piece)
        if not len(piece):
            raise ArchiveError("gzip data ends early")
        try:
            self.ready += self.inflate.decompress(piece, STEP)
        except zlib.error as e:
            raise ArchiveError(f"bad gzip data ({str(e).split(':')[0].strip().lower()})") from None
        if self.inflate.eof:
            self.at -= len(self.inflate.unused_data)
        return True

    def read(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end."""
        while len(self.ready) < n and self._more():
            pass
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def skip(self, n: int) -> int:
        """Pass over ``n`` bytes; returns how many there were."""
        left = n
        while left:
            got = len(self.read(min(left, STEP)))
            if not got:
                break
            left -= got
        return n - left


def _number(field: bytes) -> int:
    if field[0] & 0x80:                                     # base 256
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
    digits = field.split(b"\0")[0].strip()
    try:
        return int(digits, 8) if digits else 0
    except ValueError:
        raise ArchiveError("bad number in a header") from None


def _text(field: bytes) -> str:
    return field.split(b"\0")[0].decode("utf-8", "replace")


def _extended(data: bytes) -> dict[str, str]:
    """Records ``length key=value`` of a POSIX extended header."""
    out, at = {}, 0
    while at < len(data) and data[at:at + 1] != b"\0":
        space = data.find(b" ", at, at + 20)
        if space < 0 or not data[at:space].isdigit() or int(data[at:space]) <= space - at:
            raise ArchiveError("bad extended header")
        key, _, value = data[space + 1:at + int(data[at:space]) - 1].partition(b"=")
        out[key.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
        at += int(data[at:space])
    return out


def members(raw: bytes, wanted=None):
    """(position, name, content) of the regular files of an archive in order;
    content is None where ``wanted(position)`` is false.  Folders, links and
    devices hold no frame.  Raises ArchiveError at the damage."""
    source = _Unpacked(raw)
    long_name, pending, always, position = None, {}, {}, 0
    while True:
        head = source.read(BLOCK)
        if not head or head.count(0) == BLOCK:              # the end mark, or simply the end
            return
        if len(head) < BLOCK:
            raise ArchiveError("header cut off")
        plain = head[:148] + b" " * 8 + head[156:]
        if _number(head[148:156]) not in (sum(plain), sum(b - 256 if b > 127 else b for b in plain)):
            raise ArchiveError("bad header checksum")
        kind, size = head[156:157], _number(head[124:136])
        padding = -size % BLOCK
        if kind in (b"L", b"K", b"x", b"g"):
            data = source.read(size)
            if len(data) < size or source.skip(padding) < padding:
                raise ArchiveError("header cut off")
            if kind == b"L":
                long_name = _text(data)
            elif kind == b"x":
                pending = _extended(data)
            elif kind == b"g":
                always = {**always, **_extended(data)}
            continue
        extra = {**always, **pending}
        name = _text(head[:100])
        if head[257:262] == b"ustar" and head[257:265] != b"ustar  \0" and head[345]:
            name = f"{_text(head[345:500])}/{name}"
        name = extra.get("path") or long_name or name
        if "size" in extra:
            if not extra["size"].isdigit():
                raise ArchiveError("bad extended header")
            size = int(extra["size"])
            padding = -size % BLOCK
        if kind == b"S" or any(k.startswith("GNU.sparse") for k in extra):
            raise ArchiveError("sparse member")
        long_name, pending = None, {}
        regular = kind in (b"0", b"\0", b"7") and not name.endswith("/")
        stored = size if regular or kind not in (b"1", b"2", b"3", b"4", b"5", b"6") else 0
        if not stored:
            padding = 0
        content = None
        if regular and (wanted is None or wanted(position)):
            content = source.read(stored)
            whole = len(content) == stored
        else:
            whole = source.skip(stored) == stored
        if not whole:
            raise ArchiveError("member cut off")
        if regular:
            yield position, name, content
            position += 1
        source.skip(padding)


def _base(name: str) -> str:
    return name.rstrip("/").rsplit("/", 1)[-1]


def frames(raw: bytes):
    """(position, frame name, content, error): members by their base name; of
    members with one name the last stays, as when files are unpacked over each
    other.  The last row has the error of a damaged archive."""
    last: dict[str, int] = {}
    error = None
    try:
        for position, name, _ in members(raw, lambda _: False):
            last[_base(name)] = position
    except ArchiveError as e:
        error = str(e)
    keep = set(last.values())
    try:
        for position, name, content in members(raw, keep.__contains__):
            if content is not None:
                yield position, _base(name), content, None
    except ArchiveError:
        pass
    if error:
        yield len(last), None, None, error


SCHEMA = "archive string, position long, frame_name string, content binary, error string"


def _unpack(batches):
    columns = ["archive", "position", "frame_name", "content", "error"]
    for pdf in batches:
        for path, raw in zip(pdf["path"], pdf["content"]):
            rows, held = [], 0
            for row in frames(raw):
                rows.append((path, *row))
                held += len(row[2] or b"")
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)


def _summarise(batches):
    for pdf in batches:
        out = []
        for path, raw in zip(pdf["path"], pdf["content"]):
            names, size, error = set(), 0, None
            source = members(raw)
            try:
                for _, name, content in source:
                    names.add(_base(name))
                    size += len(content)
            except ArchiveError as e:
                error = str(e)
            out.append((path, len(names), size, error))
        yield pd.DataFrame(out, columns=["archive", "n_frames", "n_bytes", "error"])


def _stored(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)


def read_archives(spark: SparkSession, root: str, glob: str = "*.tar*") -> DataFrame:
    """Members of all archives below ``root``: archive, position, frame_name,
    content, error.  A damaged archive, or one of 2 GiB and more (which no task
    can be handed), has a last row with ``error`` and nothing else."""
    files = _stored(spark, root, glob)
    rows = files.where(F.col("length") <= LARGEST).select("path", "content").mapInPandas(_unpack, SCHEMA)
    large = files.where(F.col("length") > LARGEST).select("path").select(
        F.col("path").alias("archive"), F.lit(0).cast("long").alias("position"), F.lit(None).cast("string").alias("frame_name"),
        F.lit(None).cast("binary").alias("content"), F.lit("too large").alias("error"))
    return rows.unionByName(large)


def archive_report(spark: SparkSession, root: str, glob: str = "*.tar*") -> DataFrame:
    """One row per archive: archive, n_frames (distinct names), n_bytes of its
    whole members, error (null if it is whole)."""
    files = _stored(spark, root, glob)
    rows = files.where(F.col("length") <= LARGEST).select("path", "content").mapInPandas(_summarise, "archive string, n_frames long, n_bytes long, error string")
    large = files.where(F.col("length") > LARGEST).select(F.col("path").alias("archive"), *[F.lit(0).cast("long").alias(c) for c in ("n_frames", "n_bytes")],
                                                          F.lit("too large").alias("error"))
    return rows.unionByName(large)
