"""Secret scan by assignment-aware lexing.

Source and configuration syntax is read as pairs of a name and an expression:
``name = "x"``, ``name: x``, ``"name": "x"``, ``name := 'x'``, ``NAME=x``,
``m["name"] = "x"``, ``name => "x"``, ``set("name", "x")``, ``set name "x"``,
``#define NAME "x"``, ``<name>x</name>``, and block scalars behind ``name: |``.
An expression is made of literals (quoted, triple quoted or bare) and names,
joined by ``+``, ``or``, ``||``, ``??`` or by standing side by side, in brackets,
as arguments of a call, and over several lines where a bracket, an operator or a
backslash says so.  Names that were given an expression earlier in the text are
constants, so ``A = "..."`` followed by ``password = A`` reports the literal at
A.  A literal is scored by how sensitive its target name is and by its form.
Three plain patterns (assignments to secret words, access key ids, long
hexadecimal runs) are always reported as well.

Expressions are nodes that refer to other nodes; a node's literals are offsets,
and what scoring needs of them is added up once per node.  An expression ends
where the next assignment begins, and a bare value goes on there by reference.
So time and memory follow the text's length, whatever it refers to.

The scan is a map-only pass; Python's ``re`` runs over whole texts, and the
lexer only over texts that hold a part of a sensitive name.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as T

KINDS = ("assign", "access", "hex", "named")
# fixed values: the three base patterns
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# fixed values: words and word pairs that make a target name sensitive
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 0.9, "token": 0.8, "apikey": 1.0, "credential": 0.8,
             "credentials": 0.8, "privatekey": 1.0, "accesskey": 0.9, "authkey": 0.9, "bearer": 0.7, "passcode": 0.9}
PAIRS = {("api", "key"): 1.0, ("access", "key"): 0.9, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("signing", "key"): 0.9,
         ("encryption", "key"): 0.9, ("auth", "key"): 0.9, ("connection", "string"): 0.7, ("client", "secret"): 1.0}
PLACEHOLDER = re.compile(r"(?i)^(change_?me|example|your[_-].*|x{4,}|\*{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\).*|none|null|true|false|todo.*|test|dummy|redacted|\[.*\])$")

_SEPARATOR = re.compile(r":=|=>|(?<![=!<>:])=(?![=>])|:(?![:=])")
_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
_TAIL = _HEAD | frozenset("0123456789.-")
# fixed values: a part of every sensitive name
STEMS = ("pass", "pwd", "secret", "token", "credential", "bearer", "key", "connection")

_STRING = re.compile(r"(?s:\"\"\"((?:[^\"\\]|\\.|\"(?!\"\"))*+)\"\"\"|'''((?:[^'\\]|\\.|'(?!''))*+)''')|\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`")
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+(?![A-Za-z0-9_.+/=\-@!#$%^&*])")
_PREFIX = re.compile(r"[bBfFrRuU]{1,2}(?=[\"'])")
_CALL = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+[ \t]*\(")
_BARE = re.compile(r"[^\s,;\"'`(){}\[\]<>|]+")
_BLANK, _BLANKS = re.compile(r"(?:[ \t]|\\\r?\n)*+"), re.compile(r"(?:\s|\\\n)*+")
_JOIN = re.compile(r"\+(?!\+)|\|\||\?\?|or(?![A-Za-z0-9_])")
_NEXT_LINE = re.compile(r"\s*+(?=\+|\|\||\?\?)")
_BLOCK = re.compile(r"[ \t]*+[|>][+-]?[0-9]?[ \t]*+\r?\n")
_XML = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*+)(?:\s[^<>]*+)?>([^<>]++)</\1\s*+>")
_ARGUMENT = re.compile(r"\(\s*+([\"'])([A-Za-z_][A-Za-z0-9_.-]*+)\1\s*+,\s*+(?=[\"'])")
_SET = re.compile(r"(?m)^[ \t]*+(?:set|export|setenv|\#[ \t]*+define|define)[ \t]++([A-Za-z_][A-Za-z0-9_.-]*+)[ \t]++(?=[\"'])")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
CUT = 0.85


def name_weight(name: str) -> float:
    """Sensitivity of a target name, by its words and neighbouring words."""
    parts = [w.lower() for w in _CAMEL.findall(name)]
    best = max((SENSITIVE.get(w, 0.0) for w in parts), default=0.0)
    best = max([best, *(PAIRS.get(p, 0.0) for p in zip(parts, parts[1:]))])
    return max(best, SENSITIVE.get("".join(parts), 0.0))


class Form:
    """What scoring needs of a text or of several ones in a row."""
    __slots__ = ("n", "literals", "spaced", "quoted", "chars", "one")
    MOST = 1 << 40               # counts end here, so that sums of sums stay numbers

    def __init__(self) -> None:
        self.n = self.literals = self.spaced = 0
        self.quoted, self.chars, self.one = False, {}, None

    def add(self, value: str, quoted: bool) -> None:
        self.one = value if not self.literals else None
        self.n += len(value)
        self.literals += 1
        self.spaced += " " in value.strip()
        self.quoted |= quoted
        for c, k in Counter(value).items():
            c = c if c < "\x80" else chr(128 + ord(c) % 64)       # as many kinds of characters at most
            self.chars[c] = self.chars.get(c, 0) + k

    def join(self, other: "Form") -> None:
        self.one = other.one if not self.literals else None if other.literals else self.one
        self.n, self.literals = min(self.MOST, self.n + other.n), min(self.MOST, self.literals + other.literals)
        self.spaced = min(self.MOST, self.spaced + other.spaced)
        self.quoted |= other.quoted
        for c, k in other.chars.items():
            self.chars[c] = min(self.MOST, self.chars.get(c, 0) + k)

    def weight(self) -> float:
        """How much it looks like a secret rather than words (0 to 1)."""
        if self.n < 6 or 2 * self.spaced >= self.literals or self.one is not None and PLACEHOLDER.match(self.one):
            return 0.0
        n = sum(self.chars.values())
        entropy = -sum(c / n * math.log2(c / n) for c in self.chars.values())
        kinds = "".join(self.chars)
        digits = any(c.isdigit() for c in kinds)
        odd = any(not c.isalnum() for c in kinds)
        mixed = any(c.islower() for c in kinds) and any(c.isupper() for c in kinds)
        return min(1.0, 0.35 * self.quoted + 0.3 * digits + 0.15 * odd + 0.1 * mixed + 0.25 * (entropy >= 2.8) + 0.15 * (self.n >= 12))


def literal_weight(value: str, quoted: bool) -> float:
    """``Form.weight`` of one literal."""
    form = Form()
    form.add(value, quoted)
    return form.weight()


def target(text: str, at: int) -> str:
    """The name that ends before the separator at ``at``, or an empty string;
    a walk back that no other separator's walk shares."""
    while at and text[at - 1] in " \t":
        at -= 1
    if at and text[at - 1] == "]":
        at -= 1
    if at and text[at - 1] in "\"'`":
        at -= 1
    first = at
    while first and text[first - 1] in _TAIL:
        first -= 1
    while first < at and text[first] not in _HEAD:
        first += 1
    return text[first:at]


class Node:
    """An assignment: its target name and the parts of its expression, which are
    literals (start, end, quoted) or other nodes."""
    __slots__ = ("name", "parts", "form")

    def __init__(self, name: str):
        self.name, self.parts, self.form = name, [], None


def _lines(text: str, start: int, end: int):
    """Literals of a text of several lines: each line without its margins."""
    while start < end:
        stop = text.find("\n", start, end)
        stop = end if stop < 0 else stop
        a, b = start, stop
        while a < b and text[a] in " \t\r":
            a += 1
        while a < b and text[b - 1] in " \t\r":
            b -= 1
        if a < b:
            yield a, b, True
        start = stop + 1


def _block(text: str, at: int, separator: int) -> list[tuple[int, int, bool]]:
    """Literals of the block scalar whose lines start at ``at``: those indented
    more than the line of its name."""
    line = text.rfind("\n", 0, separator) + 1
    indent = len(text[line:separator]) - len(text[line:separator].lstrip(" -"))
    first = at
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        body = text[at:stop].strip(" \t\r")
        if body and stop - at - len(text[at:stop].lstrip(" ")) <= indent:
            break
        at = stop + 1
    return list(_lines(text, first, min(at, len(text))))


def _expression(text: str, at: int, end: int, known: dict[str, Node]) -> tuple[list, bool]:
    """(parts, whether a bare value runs on into the next assignment) of the
    expression at ``at``; ``end`` is where the next assignment's separator
    stands, which ends it outside quotes."""
    parts: list = []
    depth, joined, last = 0, True, None             # joined: an operator or bracket calls for another term
    while at < len(text):
        at = (_BLANKS if depth or joined and parts else _BLANK).match(text, at).end()
        if at >= len(text) or at >= end:
            break
        if m := _PREFIX.match(text, at):
            at = m.end()
        c = text[at]
        if c in "\"'`" and (m := _STRING.match(text, at)):
            if not joined and last != "string":
                break
            g = m.lastindex
            parts += list(_lines(text, *m.span(g))) if g < 3 else [(*m.span(g), True)]
            at, joined, last = m.end(), False, "string"
        elif c in "([":
            depth, joined, at = depth + 1, True, at + 1
        elif c in ")]":
            depth, joined, at = depth - 1, False, at + 1
            if depth < 0:
                break
            last = "bracket"
        elif c == "," and depth:
            joined, at = True, at + 1
        elif c == "\n" or c == "\r":
            m = _NEXT_LINE.match(text, at)
            if not m or m.end() >= end:
                break
            at = m.end()
        elif (m := _JOIN.match(text, at)) and not joined:
            joined, at = True, m.end()
        elif not joined:
            break
        elif m := _CALL.match(text, at, end):
            depth, joined, at, last = depth + 1, True, m.end(), "call"
        elif (m := _WORD.match(text, at)) and m.end() <= end:
            stop = _BLANK.match(text, m.end()).end()
            if stop >= end and m.end() < end or m.end() == end:
                # the next assignment's target, unless a bare value runs on
                if m.end() == end and not depth:
                    parts.append((*m.span(), False))
                    return parts, True
                break
            found = known.get(m.group()) or ("." in m.group() and known.get(m.group().rsplit(".", 1)[1])) or None
            parts.append(found or (*m.span(), False))
            at, joined, last = m.end(), False, "word"
        elif m := _BARE.match(text, at, end):
            parts.append((*m.span(), False))
            if m.end() == end:
                return parts, True
            at, joined, last = m.end(), False, "bare"
        else:
            break
    return parts, False


def pairs(text: str) -> list[tuple[str, Node]]:
    """(name, node) of each assignment, in the order of their kinds and places,
    with constants resolved to the nodes before them."""
    nodes: list[Node] = []
    known: dict[str, Node] = {}
    seps = list(_SEPARATOR.finditer(text))
    before: Node | None = None                       # whose bare value runs on into this assignment
    for i, m in enumerate(seps):
        end = seps[i + 1].start() if i + 1 < len(seps) else len(text) + 1
        name = target(text, m.start())
        block = _BLOCK.match(text, m.end()) if m.group() == ":" else None
        if not name and before is None:
            continue
        node = Node(name)
        if block:
            node.parts, on = _block(text, block.end(), m.start()), False
        else:
            node.parts, on = _expression(text, m.end(), end, known)
        if before is not None:
            before.parts.append(node)
        before = node if on else None
        if name and node.parts:
            known[name] = known[name.rsplit(".", 1)[-1]] = node
            nodes.append(node)
    for m in _XML.finditer(text):
        node = Node(m.group(1))
        node.parts = list(_lines(text, *m.span(2)))
        nodes.append(node)
    for pattern, group in ((_ARGUMENT, 2), (_SET, 1)):
        for m in pattern.finditer(text):
            t = _STRING.match(text, m.end())
            if t:
                node = Node(m.group(group))
                node.parts = list(_lines(text, *t.span(t.lastindex))) if t.lastindex < 3 else [(*t.span(t.lastindex), True)]
                nodes.append(node)
    return [(n.name, n) for n in nodes if n.parts]


def _form(text: str, node: Node) -> Form:
    """The form of a node's whole expression; every node's is made once, and a
    node that refers back to itself counts once."""
    stack = [node]
    open_ = set()
    while stack:
        top = stack[-1]
        waiting = [p for p in top.parts if isinstance(p, Node) and p.form is None and id(p) not in open_] if id(top) not in open_ else []
        open_.add(id(top))
        if waiting:
            stack += waiting
            continue
        stack.pop()
        if top.form is None:
            form = Form()
            for p in top.parts:
                if not isinstance(p, Node):
                    form.add(text[p[0]:p[1]], p[2])
                elif p.form is not None:
                    form.join(p.form)
            top.form = form
    return node.form


def _literals(node: Node, done: set[int]):
    """Literals of a node and of those it refers to, each node's once."""
    stack = [node]
    while stack:
        top = stack.pop()
        if id(top) in done:
            continue
        done.add(id(top))
        for p in top.parts:
            if isinstance(p, Node):
                stack.append(p)
            else:
                yield p[0], p[1]


def _named(text: str, base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Literals given to sensitive names, without those that overlap a base span."""
    starts, reach, found, done = [], [], set(), set()
    for a, b in sorted(base):
        starts.append(a)
        reach.append(max(b, reach[-1] if reach else 0))
    for name, node in pairs(text):
        weight = name_weight(name)
        if weight < 0.7 or weight * 0.5 + 0.5 * _form(text, node).weight() < CUT - 0.1:
            continue
        for a, b in _literals(node, done):
            at = bisect_left(starts, b)
            if a < b and not (at and reach[at - 1] > a):
                found.add((a, b))
    return sorted(found)


def scan(text: str | None) -> list[tuple[str, int, int, int, int]]:
    """Spans (kind, start, end, first and last code point of the secret
    itself), by start, then kind in the order of ``KINDS``."""
    if not text:
        return []
    out = []
    seps = "=" in text or ":" in text
    if seps:
        out += [("assign", m.start(), m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    low = text.lower()
    if any(stem in low for stem in STEMS):
        out += [("named", a, b, a, b) for a, b in _named(text, [x[1:3] for x in out])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def redacted(text: str, spans: list[tuple], mark: str = "[SECRET]") -> str:
    """The text with every secret replaced by ``mark`` (overlaps once)."""
    out, at = [], 0
    for a, b in sorted((s[3], s[4]) for s in spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def _reports(batches):
    for b in batches:
        rows = []
        for t in b.column("_text").to_pylist():
            s = scan(t)
            n = Counter(x[0] for x in s)
            base = [x for x in s if x[0] != "named"]
            rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(s), n["named"]))
        cols = zip(*rows) if rows else [[]] * 6
        out = b.drop_columns(["_text"])
        for name, col, t in zip(("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named"), cols,
                                (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())):
            out = out.append_column(name, pa.array(col, t))
        yield out


def secret_spans(docs: DataFrame, keep: tuple = ("doc_id",)) -> DataFrame:
    """Per row: columns ``keep``, n_assign, n_access, n_hex, base_sha256 (of the
    base spans ``kind:start:end``), spans (all, also ``named`` ones) and n_named.
    Offsets are code points, ends exclusive.  Null and empty texts have no
    spans (the hash of an empty string); repeated rows report alike; other
    columns, also of the result's names, are ignored; an empty table gives an
    empty result.  Texts of any length are scanned whole, in time and memory
    that follow their length."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(_reports, fields + ", n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long")


def _redactions(batches):
    for b in batches:
        at, size = b.schema.get_field_index("text"), b.schema.get_field_index("n_chars")
        texts = b.column(at).to_pylist()
        new = [redacted(t, scan(t)) if t else t for t in texts]
        if size >= 0:
            n = [c if c is None or t is None else c + len(x) - len(t) for c, t, x in zip(b.column(size).to_pylist(), texts, new)]
            b = b.set_column(size, b.schema.field(size), pa.array(n, b.schema.field(size).type))
        yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by a mark; no row is
    dropped, and texts without secrets (and nulls) stay as they are.  A column
    n_chars changes by as much as the text."""
    return docs.mapInArrow(_redactions, docs.schema)
