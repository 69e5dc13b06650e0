"""Duplicate passages by a distributed merge sort of front-coded suffix runs.

Every byte covered by a ``width``-byte string that also starts in a document
with a smaller doc_id is removed.  Only *anchored* suffixes are sorted: a
position is an anchor when its ``gram``-byte hash is the smallest of ``span``
neighbouring ones, and with ``gram + span - 1 == width`` every ``width``-byte
string holds an anchor, at the same place in each of its copies.  So two copies
of a string always meet at an anchor, and one suffix in about ``span / 2``
positions is enough for an exact answer.

Steps (documents are dealt to blocks by a hash of doc_id):

1. each block sends the sorted hashes of its anchors' grams to hash buckets
   (4 bytes each); a bucket replies with those that occur in two documents;
2. each block sorts the suffixes at the repeated anchors.  Equal contexts keep
   their smallest doc_id; the others are removed on the spot.  The sorted run
   is cut at splitters, front-coded (length shared with the suffix before, and
   the rest) and sent to range mergers;
3. a merger combines its runs with a loser tree that keeps, for every run, the
   prefix length shared with the last output, and compares bytes only beyond
   it.  Sorted order and shared lengths give, for every split of the window
   around the anchor, the suffixes with the same right part; the left parts
   are ranked alike.  Where a smaller doc_id has both, the window is marked;
4. marked spans go back to the documents' blocks, where they are joined.

All tables that move are rows of byte strings whose number is about blocks x
mergers; no document is copied but by the shuffle into blocks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as T
from .storage import total_bytes, written

WIDTH, GRAM = 50, 24
SPAN = WIDTH - GRAM + 1            # 27 grams per window
LEFT = WIDTH - GRAM                # bytes of a window that can lie before its anchor
BLOCK_BYTES = 6 << 20              # text in a block
PIECE = 1 << 20
SAMPLE = 256                       # suffixes a block gives to find the splitters


def _sliding(x: np.ndarray, w: int, fn) -> np.ndarray:
    """fn over every window of w values (len(x) - w + 1 results), by doubling."""
    size = 1
    while size * 2 <= w:
        x = fn(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return fn(x[:-rest], x[rest:]) if rest else x


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of a text's anchors (none below ``WIDTH``
    bytes), in pieces that overlap by a window."""
    n = len(text)
    at, hs = [], []
    lo = 0
    while n - lo >= WIDTH:
        piece = text[lo:lo + PIECE + 2 * WIDTH]
        p, up = T.prefix_hash(piece)
        g = len(piece) - GRAM + 1
        h = np.maximum(T.mix((p[GRAM:] - p[:-GRAM]) * up[:g]), T.U(1))
        least = _sliding(h, SPAN, np.minimum)          # one per window start
        pad = np.zeros(SPAN - 1, np.uint64)
        most = _sliding(np.concatenate([pad, least, pad]), SPAN, np.maximum)
        i = np.flatnonzero(most == h)
        last = lo + len(piece) >= n
        i = i[i < (g if last else PIECE + WIDTH)]
        at.append(i + lo)
        hs.append(h[i])
        if last:
            break
        lo += PIECE
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, hs = np.concatenate(at), np.concatenate(hs)
    if len(at) > 1:
        at, first = np.unique(at, return_index=True)
        hs = hs[first]
    return at, hs


def _packed(blocks: int):
    """Deal texts to blocks by a hash of doc_id: one row per batch and block
    with the compressed texts, which keeps the shuffles of whole texts small."""
    def run(batches):
        codec = pa.Codec("zstd", compression_level=3)
        for b in batches:
            if not b.num_rows:
                continue
            raw, offsets = T.text_bytes(b.column("text"))
            ids = b.column("doc_id").to_numpy()
            block = (T.mix(ids.view(np.uint64) + T.U(17)) % T.U(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1]])).tolist()
            rows = []
            for lo, hi in zip(cut, [*cut[1:], len(order)]):
                at = order[lo:hi]
                texts = [raw[offsets[i]:offsets[i + 1]] for i in at]
                sizes = np.array([len(x) for x in texts], np.int64)
                rows.append((int(block[at[0]]), ids[at].tobytes(), sizes.tobytes(),
                             codec.compress(np.concatenate(texts).tobytes(), asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                                             ["block", "ids", "sizes", "texts"])
    return run


def _block_texts(pdf: pd.DataFrame) -> tuple[list[int], list[np.ndarray]]:
    codec = pa.Codec("zstd")
    ids, texts = [], []
    for i, s, t in zip(pdf["ids"], pdf["sizes"], pdf["texts"]):
        ids += np.frombuffer(i, np.int64).tolist()
        cut = np.concatenate([[0], np.cumsum(np.frombuffer(s, np.int64))])
        raw = np.frombuffer(codec.decompress(t, decompressed_size=int(cut[-1])), np.uint8)
        texts += [raw[lo:hi] for lo, hi in zip(cut[:-1], cut[1:])]
    return ids, texts


def _block_anchors(ids: list[int], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, position, hash) of a block's anchors.  Short texts
    are hashed together: windows across two texts are dropped."""
    joined = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
    sizes = np.array([len(x) for x in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    doc, pos, hs = [], [], []
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + PIECE, "right")) - 1)
        if hi == lo + 1:
            a, h = anchors(texts[lo])
            doc.append(np.full(len(a), lo, np.int64))
            pos.append(a)
            hs.append(h)
        else:
            piece = joined[start[lo]:start[hi]]
            if len(piece) >= WIDTH:
                p, up = T.prefix_hash(piece)
                g = len(piece) - GRAM + 1
                h = np.maximum(T.mix((p[GRAM:] - p[:-GRAM]) * up[:g]), T.U(1))
                least = _sliding(h, SPAN, np.minimum)
                owner = np.repeat(np.arange(lo, hi), sizes[lo:hi])
                w = len(piece) - WIDTH + 1
                least[owner[:w] != owner[WIDTH - 1:]] = 0      # the window crosses a text's end
                pad = np.zeros(SPAN - 1, np.uint64)
                most = _sliding(np.concatenate([pad, least, pad]), SPAN, np.maximum)
                i = np.flatnonzero((most == h) & (h > 0))
                doc.append(owner[i])
                pos.append(i + start[lo] - start[owner[i]])
                hs.append(h[i])
        lo = hi
    cat = (lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t))
    return cat(doc, np.int64), cat(pos, np.int64), cat(hs, np.uint64)


def _bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket and the top 32 bits that a hash has within its bucket (two
    hashes that share both are only candidates more)."""
    width = -(-2**64 // buckets)
    bucket = h // T.U(width)
    fine = (h - bucket * T.U(width)) >> T.U(max(0, (width - 1).bit_length() - 32))
    return bucket.astype(np.int64), fine.astype(np.uint32)


def _send_hashes(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, texts = _block_texts(pdf)
        block = int(pdf["block"].iloc[0])
        doc, pos, h = _block_anchors(ids, texts)
        step = max(1, len(h) // SAMPLE)
        pick = b"".join(texts[d][p:p + GRAM].tobytes() for d, p in zip(doc[::step].tolist(), pos[::step].tolist()))
        rows = [(-1 - block, block, pick, np.array([len(h)], np.int64).tobytes())]
        who = np.array(ids, np.int64)[doc] if len(doc) else np.zeros(0, np.int64)
        order = np.lexsort((who, h))
        h, who = h[order], who[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(first)
        last = np.concatenate([at[1:], [len(h)]]) - 1 if len(at) else at
        twice = who[at] != who[last]               # in two documents of this block
        bucket, fine = _bucket(h[at], buckets)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)]):
            rows.append((int(bucket[lo]), block, fine[lo:hi].tobytes(), np.packbits(twice[lo:hi]).tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "block", "hashes", "twice"])
    return run


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per block the bucket's hashes that occur in two documents; sampled
    grams (negative buckets) pass through."""
    if int(pdf["bucket"].iloc[0]) < 0:
        return pdf[["block", "bucket", "hashes", "twice"]]
    hs = [np.frombuffer(x, np.uint32) for x in pdf["hashes"]]
    h = np.concatenate(hs)
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)) for x, v in zip(pdf["twice"], hs)]).astype(bool)
    both = np.sort(np.concatenate([h, h[twice]]))
    again = both[1:][both[1:] == both[:-1]]
    again = again[np.concatenate([[True], again[1:] != again[:-1]])] if len(again) else again
    found = np.searchsorted(again, h)
    mine = again[np.minimum(found, len(again) - 1)] == h if len(again) else np.zeros(len(h), bool)
    rows, lo = [], 0
    for block, v in zip(pdf["block"], hs):
        m = mine[lo:lo + len(v)]
        lo += len(v)
        if m.any():
            rows.append((int(block), int(pdf["bucket"].iloc[0]), v[m].tobytes(), b""))
    return pd.DataFrame(rows, columns=["block", "bucket", "hashes", "twice"])


def _candidates(pdf: pd.DataFrame, replies: pd.DataFrame, buckets: int):
    """Anchors of the block whose gram is repeated, with their contexts:
    (document index, position, right part, reversed left part, lengths)."""
    ids, texts = _block_texts(pdf)
    doc, pos, h = _block_anchors(ids, texts)
    keep = np.zeros(len(h), bool)
    order = np.argsort(h, kind="stable")
    bucket, fine = _bucket(h[order], buckets)
    for b, blob in zip(replies["bucket"], replies["hashes"]):
        lo, hi = np.searchsorted(bucket, b, "left"), np.searchsorted(bucket, b, "right")
        keep[order[lo:hi]] = np.isin(fine[lo:hi], np.frombuffer(blob, np.uint32))
    doc, pos = doc[keep], pos[keep]
    pad = np.zeros(WIDTH, np.uint8)
    joined = np.concatenate([pad, *texts, pad])
    sizes = np.array([len(x) for x in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])[:-1] + WIDTH
    at = start[doc] + pos if len(doc) else np.zeros(0, np.int64)
    llen = np.minimum(pos, LEFT)
    rlen = np.minimum((sizes[doc] if len(doc) else pos) - pos, WIDTH)
    right = joined[at[:, None] + np.arange(WIDTH)]
    right[np.arange(WIDTH) >= rlen[:, None]] = 0
    left = joined[at[:, None] - 1 - np.arange(LEFT)]
    left[np.arange(LEFT) >= llen[:, None]] = 0
    who = np.array(ids, np.int64)[doc] if len(doc) else np.zeros(0, np.int64)
    return who, pos, right, left, rlen.astype(np.uint8), llen.astype(np.uint8)


def _as_strings(m: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(m).view(f"S{m.shape[1]}").reshape(-1)


def _shared(m: np.ndarray) -> np.ndarray:
    """Length that each row of a byte matrix shares with the row before."""
    out = np.zeros(len(m), np.int64)
    if len(m) > 1:
        differ = m[1:] != m[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return out


def _joined(s: np.ndarray) -> np.ndarray:
    """Spans (document, start, end), overlapping or touching ones joined."""
    if not len(s):
        return s
    s = s[np.lexsort((s[:, 1], s[:, 0]))]
    doc = np.cumsum(np.concatenate([[0], s[1:, 0] != s[:-1, 0]]))
    shift = doc * (int(s[:, 2].max()) + 2)                # keeps documents apart in one number line
    reach = np.maximum.accumulate(s[:, 2] + shift)
    new = np.concatenate([[True], s[1:, 1] + shift[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    end = reach[np.concatenate([at[1:], [len(s)]]) - 1] - shift[at]
    return np.stack([s[at, 0], s[at, 1], end], axis=1)


def _front_coded(buckets: int, splitters: np.ndarray):
    """The block's sorted run, cut at the splitters and front-coded, and the
    spans that are decided within the block (a row without suffixes)."""
    def run(key, pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        who, pos, right, left, rlen, llen = _candidates(pdf, replies, buckets)
        block, rows = int(key[0]), []
        ctx = np.concatenate([right, left, rlen[:, None], llen[:, None]], axis=1)
        order = np.lexsort((pos, who, _as_strings(np.concatenate([ctx, np.ones((len(ctx), 1), np.uint8)], axis=1)))) if len(ctx) else np.zeros(0, np.int64)
        who, pos, right, left, rlen, llen, ctx = (x[order] for x in (who, pos, right, left, rlen, llen, ctx))
        new = np.ones(len(who), bool)
        new[1:] = (ctx[1:] != ctx[:-1]).any(axis=1)
        group = np.cumsum(new) - 1
        least = who[new][group] if len(who) else who
        gone = (who > least) & (rlen.astype(int) + llen >= WIDTH)
        spans = np.stack([who[gone], pos[gone] - llen[gone], pos[gone] + rlen[gone]], axis=1).astype(np.int64)
        rows.append((block % (len(splitters) + 1), block, b"", b"", _joined(spans).tobytes()))
        keep = (who == least) & (rlen.astype(int) + llen >= WIDTH)
        who, pos, right, left, rlen, llen = (x[keep] for x in (who, pos, right, left, rlen, llen))
        merger = np.searchsorted(splitters, _as_strings(right[:, :GRAM]), "right") if len(who) else np.zeros(0, np.int64)
        cut = np.flatnonzero(np.concatenate([[True], merger[1:] != merger[:-1]])) if len(merger) else np.zeros(0, np.int64)
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(merger)]):
            x, m = slice(lo, hi), int(merger[lo])
            shared = _shared(right[x])
            rest = right[x][np.arange(WIDTH) >= shared[:, None]]
            heads = np.concatenate([shared.astype(np.uint8)[:, None], rlen[x][:, None], llen[x][:, None], left[x]], axis=1)
            rows.append((m, block, heads.tobytes(), rest.tobytes(), np.stack([who[x], pos[x]], axis=1).astype(np.int64).tobytes()))
        return pd.DataFrame(rows, columns=["merger", "block", "heads", "rest", "who"])
    return run


def decode(shared: np.ndarray, rest: np.ndarray) -> list[bytes]:
    """Suffixes of a front-coded run."""
    out, before, at = [], b"", 0
    raw = rest.tobytes()
    for k in shared.tolist():
        before = before[:k] + raw[at:at + WIDTH - k]
        at += WIDTH - k
        out.append(before)
    return out


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs of equal-length strings with a loser tree.

    ``runs`` holds (strings, shared length with the string before).  Each leaf
    keeps the prefix length that its string shares with the last winner.  Of
    two leaves the one sharing more is smaller; only on equal lengths are
    bytes compared, from that length on, and the loser keeps the new length.
    Returns (run, index in run, length shared with the output before)."""
    k = len(runs)
    size = 1 << max(1, (k - 1).bit_length())
    strings = [r[0] for r in runs] + [[]] * (size - k)
    shared = [r[1] for r in runs] + [[]] * (size - k)
    at = [0] * size
    length = [0 if strings[i] else -1 for i in range(size)]    # -1: the run is used up
    tree = [0] * size

    def loses(a: int, b: int) -> bool:
        """True if run a's string is larger than run b's; sets the loser's length."""
        la, lb = length[a], length[b]
        if la != lb:
            return la < lb
        if la < 0:
            return a > b
        x, y = strings[a][at[a]], strings[b][at[b]]
        if x[la:] == y[la:]:
            low, big = len(x), a > b
        else:
            low, high = la, len(x)                           # first differing byte by bisection
            while high - low > 1:
                mid = (low + high) // 2
                if x[low:mid] == y[low:mid]:
                    low = mid
                else:
                    high = mid
            big = x[low] > y[low]
        length[a if big else b] = low
        return big

    def build(node: int) -> int:
        if node >= size:
            return node - size
        a, b = build(2 * node), build(2 * node + 1)
        if loses(a, b):
            a, b = b, a
        tree[node] = b
        return a

    winner = build(1)
    out_run, out_at, out_len = [], [], []
    while length[winner] >= 0:
        i = at[winner]
        out_run.append(winner)
        out_at.append(i)
        out_len.append(length[winner])
        at[winner] = i = i + 1
        length[winner] = shared[winner][i] if i < len(strings[winner]) else -1
        node = (winner + size) >> 1
        while node:
            other = tree[node]
            lw, lo = length[winner], length[other]
            if lw < lo or (lw == lo and loses(winner, other)):
                tree[node], winner = winner, other
            node >>= 1
    if out_len:
        out_len[0] = 0
    return out_run, out_at, out_len


def _merger(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merge the runs of one range and mark its windows; spans that blocks
    decided themselves pass through."""
    done = pdf[pdf["heads"].str.len() == 0]
    passed = [(int(b), x) for b, x in zip(done["block"], done["who"]) if len(x)]
    pdf = pdf[pdf["heads"].str.len() > 0].sort_values("block")
    if not len(pdf):
        return pd.DataFrame(passed, columns=["block", "spans"])
    heads = [np.frombuffer(x, np.uint8).reshape(-1, 3 + LEFT) for x in pdf["heads"]]
    who = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in pdf["who"]]
    runs = [(decode(h[:, 0], np.frombuffer(r, np.uint8)), h[:, 0].tolist()) for h, r in zip(heads, pdf["rest"])]
    run, at, shared = (np.array(x, np.int64) for x in merge(runs))
    first = np.concatenate([[0], np.cumsum([len(h) for h in heads])])
    pick = first[run] + at
    heads, who = np.concatenate(heads)[pick], np.concatenate(who)[pick]
    block = pdf["block"].to_numpy()[run]
    # suffixes that share a gram with nothing of another document are done
    gram = np.cumsum(shared < GRAM)
    doc = who[:, 0]
    low, high = (fn.reduceat(doc, np.flatnonzero(shared < GRAM)) for fn in (np.minimum, np.maximum))
    mixed = low[gram - 1] != high[gram - 1]
    shared = np.where(mixed & (np.concatenate([[False], mixed[:-1]])), shared, 0)[mixed]
    heads, who, block, doc = heads[mixed], who[mixed], block[mixed], doc[mixed]
    n = len(doc)
    best = np.full(n, 255, np.int64)                         # smallest and largest left part of a marked window
    most = np.full(n, -1, np.int64)
    if n:
        rlen, llen, left = heads[:, 1].astype(np.int64), heads[:, 2].astype(np.int64), heads[:, 3:]
        by_left = np.argsort(_as_strings(np.concatenate([left, np.ones((n, 1), np.uint8)], axis=1)), kind="stable")
        lshared = _shared(left[by_left])
        lclass = np.zeros(n, np.int64)
        for j in range(LEFT + 1):
            ok = np.flatnonzero((llen >= j) & (rlen >= WIDTH - j))
            if not len(ok):
                continue
            rclass = np.cumsum(shared < WIDTH - j)
            if j:
                lclass[by_left] = np.cumsum(lshared < j)
            key = rclass[ok] * (n + 1) + lclass[ok]
            order = np.argsort(key, kind="stable")
            sk = key[order]
            cut = np.flatnonzero(np.concatenate([[True], sk[1:] != sk[:-1]]))
            least = np.minimum.reduceat(doc[ok][order], cut)
            low = np.repeat(least, np.diff(np.concatenate([cut, [len(sk)]])))
            hit = ok[order[doc[ok][order] > low]]
            best[hit] = np.minimum(best[hit], j)
            most[hit] = np.maximum(most[hit], j)
    hit = np.flatnonzero(most >= 0)
    spans = np.stack([doc[hit], who[hit, 1] - most[hit], who[hit, 1] - best[hit] + WIDTH], axis=1)
    rows = [(int(b), spans[block[hit] == b].astype(np.int64).tobytes()) for b in np.unique(block[hit])]
    return pd.DataFrame(passed + rows, columns=["block", "spans"])


def _finish(key, pdf: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    s = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(x, np.int64).reshape(-1, 3) for x in spans["spans"])])
    s = _joined(s)
    out = []
    for doc, raw in zip(*_block_texts(pdf)):
        raw = raw.tobytes()
        joined = s[np.searchsorted(s[:, 0], doc, "left"):np.searchsorted(s[:, 0], doc, "right"), 1:].tolist()
        kept, at = [], 0
        for a, b in joined:
            kept.append(raw[at:a])
            at = b
        kept = b"".join([*kept, raw[at:]])
        out.append((doc, len(raw), len(raw) - len(kept), len(joined), hashlib.sha256(kept).hexdigest(), kept))
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def splitters(hashes: DataFrame, mergers: int) -> np.ndarray:
    """Range bounds of the mergers: quantiles of the sampled anchor grams (at
    most 2 x ``SAMPLE`` per block, weighted by the block's anchors).  Only the
    ``mergers - 1`` bounds come to the driver."""
    if mergers < 2:
        return np.zeros(0, f"S{GRAM}")

    def grams(batches):
        for pdf in batches:
            for g, n in zip(pdf["hashes"], pdf["twice"]):
                each = [g[i:i + GRAM] for i in range(0, len(g), GRAM)]
                yield pd.DataFrame({"gram": each, "w": [int(np.frombuffer(n, np.int64)[0]) / max(1, len(each))] * len(each)})

    got = hashes.where("bucket < 0").select("hashes", "twice").mapInPandas(grams, "gram binary, w double")
    part = written(got.repartitionByRange("gram").withColumn("p", F.spark_partition_id()), "splitters")
    sums = {r["p"]: r["w"] for r in part.groupBy("p").agg(F.sum("w").alias("w")).collect()}
    run, offset = 0.0, {}
    for p in sorted(sums):
        offset[p], run = run, run + sums[p]
    step = run / mergers

    def cuts(pdf: pd.DataFrame) -> pd.DataFrame:
        after = offset[int(pdf["p"].iloc[0])] + pdf.sort_values("gram")["w"].cumsum()
        turn = np.floor(after / step).diff().fillna(0) > 0
        return pdf.sort_values("gram")[turn][["gram"]]

    return np.array(sorted({bytes(r["gram"]) for r in part.groupBy("p").applyInPandas(cuts, "gram binary").collect()}), f"S{GRAM}")


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs) and kept_sha256 (and ``kept``, the remaining bytes, with
    ``keep_text``).

    A null or empty text has no bytes and no spans; texts below 50 bytes lose
    nothing; a null doc_id is taken as larger than any and its matches with
    other null ones do not count; rows that share a doc_id are one document
    for the rule (what they share is not removed).  Other columns are ignored;
    an empty table gives an empty result."""
    none = 2**63 - 1
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = total_bytes(docs, "text")
    blocks = max(2, math.ceil(size / BLOCK_BYTES))
    buckets = mergers = blocks
    dealt = docs.mapInArrow(_packed(blocks), "block long, ids binary, sizes binary, texts binary")
    hashes = dealt.groupBy("block").applyInPandas(_send_hashes(buckets), "bucket long, block long, hashes binary, twice binary")
    answers = written(hashes.groupBy("bucket").applyInPandas(_repeated, "block long, bucket long, hashes binary, twice binary"), "repeated")
    bounds = splitters(answers, mergers)
    replies = answers.where("bucket >= 0").select("block", "bucket", "hashes")
    runs = dealt.groupBy("block").cogroup(replies.groupBy("block")) \
        .applyInPandas(_front_coded(buckets, bounds), "merger long, block long, heads binary, rest binary, who binary")
    spans = written(runs.groupBy("merger").applyInPandas(_merger, "block long, spans binary"), "spans")
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = dealt.groupBy("block").cogroup(spans.groupBy("block")).applyInPandas(_finish, fields)
    out = out.withColumn("doc_id", F.when(F.col("doc_id") != none, F.col("doc_id")))
    return out if keep_text else out.drop("kept")
