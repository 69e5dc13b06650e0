"""Records of one large text file read by many tasks.

Spark cuts a text file into byte ranges and reads it by a separator, but a
separator may stand inside quotes, so a range alone can't tell where a record
ends.  Three passes settle it without sending the text anywhere:

1. every range is scanned for each state it may be entered in, which gives a
   summary of a few numbers (where it leaves from, how many records end in it);
2. the summaries of a file, one row per range, are composed in file order into
   the true state, and the number of records before, at every range's start;
3. the ranges are scanned again from their true states.  Records inside a range
   come out at once; the pieces of records that straddle ranges, two per range,
   are grouped and joined.

The start of a range decides its state, so a second pass cut differently either
finds its starts among the first one's or stops with an error.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE, ESCAPE = ord('"'), ord("\\")


class FormatError(ValueError):
    """What is wrong with a file."""


def _buffer(values: pa.Array, sep: int) -> tuple[np.ndarray, np.ndarray]:
    """The values' bytes with a separator behind each, and where each ends."""
    values = values.cast(pa.large_binary())
    _, off, data = values.buffers()
    offsets = np.frombuffer(off, np.int64, len(values) + 1, values.offset * 8)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    out = np.full(len(raw) + len(size), sep, np.uint8)
    if len(raw):
        out[np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)] = raw
    return out, np.cumsum(size + 1)


class JsonScanner:
    """Elements of a document that is one array or one map.  ``sep`` is ``,`` or,
    for arrays of objects, ``}`` (fewer and longer pieces).  The state is (inside
    a string, depth)."""

    def __init__(self, sep: str = ",", container: str = "["):
        self.sep, self.container, self.start = ord(sep), container, (0, 0)

    def _marks(self, buf: np.ndarray, inside: int):
        """(quotes, depth relative to the start, structural separators) when
        the buffer is entered inside a string or not."""
        at = np.flatnonzero(buf == QUOTE)
        if len(at) and (buf == ESCAPE).any():
            place = np.arange(len(buf))
            plain = np.maximum.accumulate(np.where(buf != ESCAPE, place, -1))
            before = np.where(at > 0, plain[at - 1], -1)
            at = at[(at - 1 - before) % 2 == 0]             # an odd run of escapes takes the quote
        flip = np.zeros(len(buf), np.int8)
        flip[at] = 1
        outside = (np.cumsum(flip) + inside) % 2 == 0
        step = np.zeros(len(buf), np.int64)
        step[((buf == ord("[")) | (buf == ord("{"))) & outside] = 1
        step[((buf == ord("]")) | (buf == ord("}"))) & outside] = -1
        depth = np.cumsum(step)
        return len(at), depth, np.flatnonzero((buf == self.sep) & outside)

    def summary(self, buf: np.ndarray, ends: np.ndarray, have: dict | None) -> dict:
        """Summary of a range; ``have`` is that of the part already read."""
        have = have or {"quotes": 0, "delta": [0, 0], "levels": [{}, {}]}
        for s in (0, 1):
            quotes, depth, seps = self._marks(buf, (s + have["quotes"]) % 2)
            levels, counts = np.unique(depth[seps] + have["delta"][s], return_counts=True)
            for level, n in zip(levels.tolist(), counts.tolist()):
                have["levels"][s][str(level)] = have["levels"][s].get(str(level), 0) + n
            have["delta"][s] += int(depth[-1]) if len(depth) else 0
        have["quotes"] += quotes
        return have

    def compose(self, state: tuple, summary: dict) -> tuple[tuple, int]:
        """(state behind a range entered in ``state``, elements that end in it)."""
        s, d = state
        return ((s + summary["quotes"]) % 2, d + summary["delta"][s]), summary["levels"][s].get(str(1 - d), 0)

    def check(self, state: tuple, path: str) -> None:
        if state != (0, -1 if self.sep == ord("}") else 0):   # the last piece has no separator, but counts as if
            raise FormatError(f"{path} is not one whole JSON document")

    def scan(self, buf: np.ndarray, ends: np.ndarray, state: tuple) -> tuple[np.ndarray, tuple]:
        """(ends of elements in the buffer, state behind it)."""
        s, d = state
        quotes, depth, seps = self._marks(buf, s)
        return seps[depth[seps] + d == 1] + 1, ((s + quotes) % 2, d + (int(depth[-1]) if len(depth) else 0))

    def clean(self, text: bytes, index: int, closed: bool) -> bytes | None:
        """An element without what surrounds it; None if it is none."""
        text = text.strip()
        if index == 0:
            if text[:1] != self.container.encode():
                raise FormatError(f"a document does not start with {self.container}")
            text = text[1:].lstrip()
        if self.sep == ord("}"):
            return text.removeprefix(b",").lstrip() if closed and index else text if closed else None
        text = text[:-1].rstrip()                             # its separator
        if not closed:
            text = text[:-1].rstrip()                         # the container's end
        return text or None


class CsvScanner:
    """Records of a CSV file: lines, unless a quoted field goes on behind the
    line's end.  A field is quoted if it starts with a quote; a doubled quote in
    it is a quote.  The state is (inside a quoted field,)."""

    sep, start = ord("\n"), (0,)

    @staticmethod
    def _after(line: bytes, inside: int) -> int:
        at = 0
        while True:
            if inside:
                at = line.find(b'"', at)
                if at < 0:
                    return 1
                if line[at + 1:at + 2] == b'"':
                    at += 2
                    continue
                inside, at = 0, line.find(b",", at + 1)
                if at < 0:
                    return 0
                at += 1
            elif line[at:at + 1] == b'"':
                inside, at = 1, at + 1
            else:
                at = line.find(b',"', at)
                if at < 0:
                    return 0
                inside, at = 1, at + 2

    def _states(self, buf: np.ndarray, ends: np.ndarray, inside: int) -> np.ndarray:
        """State behind every line."""
        quoted = np.unique(np.searchsorted(ends, np.flatnonzero(buf == QUOTE), "right"))
        out = np.zeros(len(ends), np.int8)
        done = 0
        for i in quoted.tolist():
            out[done:i] = inside
            inside = self._after(buf[ends[i - 1] if i else 0:ends[i] - 1].tobytes(), inside)
            out[i] = inside
            done = i + 1
        out[done:] = inside
        return out

    def summary(self, buf: np.ndarray, ends: np.ndarray, have: dict | None) -> dict:
        first = have is None
        have = have or {"to": [0, 1], "n": [0, 0], "utf8": True, "head": None}
        for s in (0, 1):
            if len(ends):
                states = self._states(buf, ends, have["to"][s])
                have["to"][s] = int(states[-1])
                have["n"][s] += int((states == 0).sum())
                if first and s == 0 and (states == 0).any():
                    have["head"] = buf[:ends[np.argmax(states == 0)] - 1].tobytes().decode("latin-1")
        try:                                                  # no character straddles a line end
            have["utf8"] = have["utf8"] and bool(buf.tobytes().decode("utf-8") or True)
        except UnicodeDecodeError:
            have["utf8"] = False
        return have

    def compose(self, state: tuple, summary: dict) -> tuple[tuple, int]:
        return (summary["to"][state[0]],), summary["n"][state[0]]

    def check(self, state: tuple, path: str) -> None:
        """A quote that is never closed takes the rest of the file."""

    def scan(self, buf: np.ndarray, ends: np.ndarray, state: tuple) -> tuple[np.ndarray, tuple]:
        states = self._states(buf, ends, state[0])
        return ends[states == 0], (int(states[-1]) if len(states) else state[0],)

    def clean(self, text: bytes, index: int, closed: bool) -> bytes | None:
        text = text[:-1].removesuffix(b"\r")
        return text or None


def _pieces(spark: SparkSession, path, sep: int) -> DataFrame:
    """The text between separators, in file order inside every byte range."""
    return spark.read.option("lineSep", chr(sep)).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _runs(batch: pa.RecordBatch):
    """(first row, end row) of the parts of a batch that lie in one range."""
    file = pc.dictionary_encode(batch.column("file")).indices.to_numpy()
    block = batch.column("block").to_numpy()
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    return zip(edges[:-1], edges[1:]) if batch.num_rows else ()


def _summaries(scanner):
    def run(batches):
        key, have = None, None
        for b in batches:
            out = []
            for lo, hi in _runs(b):
                at = (b.column("file")[lo].as_py(), b.column("block")[lo].as_py())
                if at != key:
                    if key is not None:
                        out.append((*key, json.dumps(have)))
                    key, have = at, None
                have = scanner.summary(*_buffer(b.column("value").slice(lo, hi - lo), scanner.sep), have)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(("file", "block", "summary"), map(list, zip(*out)))))
        if key is not None:
            yield pa.RecordBatch.from_pydict({"file": [key[0]], "block": [key[1]], "summary": [json.dumps(have)]})
    return run


def entering_states(spark: SparkSession, path, scanner) -> DataFrame:
    """One row per byte range: file, block (its first byte), state at its start,
    before (elements that end earlier), and for CSV the file's head and whether
    all of it is UTF-8."""
    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        state, before, rows = scanner.start, 0, []
        summaries = [json.loads(s) for s in pdf["summary"]]
        for file, block, s in zip(pdf["file"], pdf["block"], summaries):
            rows.append((file, block, list(state), before, summaries[0].get("head"), all(x.get("utf8", True) for x in summaries)))
            state, n = scanner.compose(state, s)
            before += n
        scanner.check(state, pdf["file"].iloc[0])
        return pd.DataFrame(rows, columns=["file", "block", "state", "before", "head", "utf8"])
    found = _pieces(spark, path, scanner.sep).mapInArrow(_summaries(scanner), "file string, block long, summary string")
    return found.groupBy("file").applyInPandas(compose, "file string, block long, state array<int>, before long, head string, utf8 boolean")


_ELEMENT = "file string, row_idx long, block long, closed boolean, text binary"


def _elements(scanner, whole: bool):
    """The whole elements of every range, or the pieces of those that straddle."""
    def run(batches):
        key, state, n, tail, inner = None, None, 0, [], False

        def rest():
            return [(*key[:1], n, key[1], False, b"".join(tail))] if key and tail and not whole else []
        for b in batches:
            out = []
            for lo, hi in _runs(b):
                at = (b.column("file")[lo].as_py(), b.column("block")[lo].as_py())
                if at != key:
                    out += rest()
                    entered = b.column("state")[lo].as_py()
                    if entered is None:
                        raise RuntimeError(f"{at[0]} was cut into other ranges by the second pass; read it again")
                    # what precedes the first end in a later range belongs to an earlier one
                    key, state, n, tail, inner = at, tuple(entered), b.column("before")[lo].as_py(), [], at[1] == 0
                buf, line_ends = _buffer(b.column("value").slice(lo, hi - lo), scanner.sep)
                ends, state = scanner.scan(buf, line_ends, state)
                data, done = buf.tobytes(), 0
                for e in ends.tolist():
                    if inner == whole:
                        text = b"".join(tail) + data[done:e]
                        if not whole:
                            out.append((key[0], n, key[1], True, text))
                        elif (text := scanner.clean(text, n, True)) is not None:
                            out.append((key[0], n, key[1], True, text))
                    tail, done, n, inner = [], e, n + 1, True
                if done < len(data):
                    tail.append(data[done:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (
                    pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["file", "row_idx", "block", "closed", "text"])
        out = rest()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (
                pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["file", "row_idx", "block", "closed", "text"])
    return run


def elements(spark: SparkSession, path, scanner, states: DataFrame | None = None) -> DataFrame:
    """file, row_idx (0-based position of the element in its file), text (bytes)
    for every element of the files at ``path``; with CSV also head and utf8.
    One row per byte range is broadcast, a few dozen bytes for 128 MB of text."""
    known = F.broadcast(entering_states(spark, path, scanner) if states is None else states)
    rows = _pieces(spark, path, scanner.sep).join(known.select("file", "block", "state", "before"), ["file", "block"], "left")
    inside = rows.mapInArrow(_elements(scanner, True), _ELEMENT).select("file", "row_idx", "text")
    parts = rows.mapInArrow(_elements(scanner, False), _ELEMENT).groupBy("file", "row_idx").agg(
        F.array_sort(F.collect_list(F.struct("block", F.col("text").cast("string").alias("text")))).alias("p"), F.max("closed").alias("closed"))
    joined = parts.select("file", "row_idx", "closed", F.array_join(F.transform("p", lambda x: x["text"]), "").cast("binary").alias("text"))

    def clean(batches):
        for pdf in batches:
            text = [scanner.clean(bytes(t), n, bool(c)) for t, n, c in zip(pdf["text"], pdf["row_idx"], pdf["closed"])]
            out = pdf[["file", "row_idx"]].assign(text=text)
            yield out[[t is not None for t in text]]
    return inside.unionByName(joined.mapInPandas(clean, "file string, row_idx long, text binary"))


def json_elements(spark: SparkSession, path, container: str = "[", objects: bool = False) -> DataFrame:
    """file, row_idx, value (JSON text) for every element of the arrays (or
    ``"key": value`` entries of the maps) at ``path``.  ``objects``: all elements
    of the arrays are objects.  A file that is not one whole document fails."""
    rows = elements(spark, path, JsonScanner("}" if objects else ",", container))
    return rows.select("file", "row_idx", F.col("text").cast("string").alias("value"))
