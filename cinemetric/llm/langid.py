"""Language identification by hierarchical discrimination.

The language family of a text is predicted first, by one linear support vector
machine per family against the rest.  Within the family, one machine per pair of
its languages votes (one-versus-one), so closely related languages are told
apart by weights that were learned from them alone.

A text is the bag of the character n-grams (1 to 4 bytes, words bounded by a
space) and whole words it is made of, hashed into buckets, as shares of their
number.  A machine's margin is thus the mean of its bucket weights over the
text: scoring adds up table rows, word by distinct word, over whole texts, and
what is shipped has a fixed size per machine.  Training (squared hinge loss,
features weighted by their log odds) runs in one task on a bounded sample that
is spread evenly over the languages; every sampled text also gives a short
piece, so that short texts are known too.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as T

BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
TRAIN_ROWS = 3_000           # documents learned from, at most (about), over all languages
SCALE = 32.0                 # of the shares, so that a text has a length of about one
STEPS = 60
RIDGE = 3e-3
SLICE = 1 << 20
UNKNOWN = "und"

# fixed values: ISO 639 codes by language family; a code that is not here is a family of its own
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "semitic": "ar he am mt",
    "indo-aryan": "hi ur bn mr gu pa ne si",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "malayo-polynesian": "id ms tl jv mg",
    "sinitic": "zh yue",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    """Family of a language code (a region or script behind it is ignored)."""
    code = re.split(r"[-_]", lang.strip().lower())[0]
    return _FAMILY.get(code, lang)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (T.mix(h) >> T.U(64 - 15)).astype(np.int64)


def _distinct(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of every distinct word, word number of every word)."""
    _, at, number = np.unique(w.hashes, return_index=True, return_inverse=True)
    return at, number


def word_grams(w: T.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the words ``at`` and of the words themselves,
    and the bounds per word."""
    size = w.ends[at] - w.starts[at]
    first = np.cumsum(size + 1) - size                          # a space before every word and at the end
    text = np.full(int(size.sum() + len(at)) + max(GRAMS), 32, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(first, size) + inside] = T._LOWER[w.raw[np.repeat(w.starts[at], size) + inside]]
    per = {n: size if n == 1 else np.maximum(size + 3 - n, 0) for n in GRAMS}
    bound = np.concatenate([[0], np.cumsum(1 + sum(per.values()))])
    out = np.zeros(int(bound[-1]), np.int64)
    out[bound[:-1]] = _bucket(w.hashes[at])
    to = bound[:-1] + 1
    code = np.zeros(len(text), np.uint64)
    for n in GRAMS:
        code[:len(text) - n + 1] |= text[n - 1:].astype(np.uint64) << T.U(8 * (n - 1))
        m = per[n]
        inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        grams = code[np.repeat(first - (n > 1), m) + inner]
        out[np.repeat(to, m) + inner] = _bucket(grams | T.U(n << 56))
        to = to + m
    return out, bound


def _fit(idx: np.ndarray, val: np.ndarray, bound: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine for rows ``idx[bound]``, ``val`` and
    labels ``y`` of 1 and -1: squared hinge loss, both labels weigh alike,
    features scaled by their log odds, accelerated gradient steps."""
    row = np.repeat(np.arange(len(y)), np.diff(bound))
    seen = [np.bincount(idx[y[row] == s], val[y[row] == s], BUCKETS) + 0.05 for s in (1, -1)]
    odds = np.log(seen[0] / seen[0].sum()) - np.log(seen[1] / seen[1].sum())
    x = val * odds[idx]
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == -1).sum()))

    def times(w):
        return np.bincount(row, x * w[idx], len(y))
    # the largest curvature, by the power method
    p = np.ones(BUCKETS) / np.sqrt(BUCKETS)
    for _ in range(6):
        p = np.bincount(idx, x * (share * times(p))[row], BUCKETS)
        norm = float(np.linalg.norm(p)) or 1.0
        p /= norm
    step = 1 / (2 * (norm + 1) + RIDGE)
    w, b, w0, b0 = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 0.0
    for t in range(STEPS):
        fast = t / (t + 3)
        u, c = w + fast * (w - w0), b + fast * (b - b0)
        slack = np.maximum(0, 1 - y * (times(u) + c)) * y * share
        w0, b0 = w, b
        w = u + step * (2 * np.bincount(idx, x * slack[row], BUCKETS) - RIDGE * u)
        b = c + step * 2 * float(slack.sum())
    return w * odds, b


def _rows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (bucket, scaled share, bounds) of texts."""
    w = T.words(pa.array(texts, pa.large_string()))
    at, number = _distinct(w)
    grams, bound = word_grams(w, at)
    ids, vals, ends = [], [], [0]
    for d in range(len(texts)):
        mine, count = np.unique(number[w.first[d]:w.first[d + 1]], return_counts=True)
        m = bound[mine + 1] - bound[mine]
        flat = grams[np.repeat(bound[mine] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
        u, inv = np.unique(flat, return_inverse=True)
        total = np.bincount(inv, np.repeat(count, m), len(u))
        ids.append(u)
        vals.append(SCALE * total / max(1.0, total.sum()))
        ends.append(ends[-1] + len(u))
    return np.concatenate([*ids, np.zeros(0, np.int64)]), np.concatenate([*vals, np.zeros(0)]), np.array(ends)


def fit(texts: list[str], langs: list[str], seed: int = 13) -> dict:
    """Model of whole texts: names, families, and the machines' weights."""
    names = sorted(set(langs))
    groups: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        groups.setdefault(family(name), []).append(i)
    groups_in_order = sorted(groups.values())
    rng = np.random.default_rng(seed)
    short = []
    for t in texts:                                             # a piece of 1 to 12 words
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = int(rng.integers(1, 13))
        at = int(rng.integers(0, max(1, len(words) - n + 1)))
        short.append(" ".join(words[at:at + n]))
    idx, val, bound = _rows_of([*texts, *short])
    label = np.array([names.index(x) for x in langs] * 2)
    group = np.zeros(len(names), np.int64)
    for g, members in enumerate(groups_in_order):
        group[members] = g

    def machine(rows: np.ndarray, y: np.ndarray):
        m = np.diff(bound)[rows]
        flat = np.repeat(bound[rows] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        return _fit(idx[flat], val[flat], np.concatenate([[0], np.cumsum(m)]), y)
    weights, bias, families, pairs = [], [], [], []
    everyone = np.arange(len(label))
    for g in range(len(groups_in_order) if len(groups_in_order) > 1 else 0):
        families.append(g)
        w, b = machine(everyone, np.where(group[label] == g, 1, -1))
        weights.append(w)
        bias.append(b)
    for members in groups_in_order:
        for i, j in combinations(members, 2):
            pairs.append((i, j))
            rows = np.flatnonzero((label == i) | (label == j))
            w, b = machine(rows, np.where(label[rows] == i, 1, -1))
            weights.append(w)
            bias.append(b)
    table = np.array(weights, np.float32).T * np.float32(SCALE) if weights else np.zeros((BUCKETS, 0), np.float32)
    return {"names": names, "group": group.tolist(), "n_families": len(families), "pairs": pairs, "bias": bias, "table": np.ascontiguousarray(table)}


def margins(model: dict, col: pa.Array) -> np.ndarray:
    """Margins of every machine (columns) for every text (rows); a text without
    words has the biases."""
    w = T.words(col)
    at, number = _distinct(w)
    table = model["table"]
    machines = table.shape[1]
    out = np.zeros((len(w.first) - 1, machines))
    total, grams = np.zeros((len(at), machines)), np.zeros(len(at))
    at = at[np.argsort(w.starts[at], kind="stable")]           # distinct words in text order, a few at a time
    place = np.empty(len(at), np.int64)
    place[number[at]] = np.arange(len(at))
    size = np.cumsum(w.ends[at] - w.starts[at] + 1)
    lo = 0
    while lo < len(at):
        done = int(size[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, done + SLICE // max(1, machines), "right")))
        ids, bound = word_grams(w, at[lo:hi])
        run = np.zeros(len(ids) + 1)
        for k in range(machines):
            np.cumsum(table[ids, k], out=run[1:], dtype=np.float64)
            total[lo:hi, k] = run[bound[1:]] - run[bound[:-1]]
        grams[lo:hi] = np.diff(bound)
        lo = hi
    full = np.flatnonzero(np.diff(w.first) > 0)
    if len(full):
        word = place[number]
        n = np.add.reduceat(grams[word], w.first[:-1][full])
        for k in range(machines):
            out[full, k] = np.add.reduceat(total[word, k], w.first[:-1][full]) / n
    return out + np.array(model["bias"])


def decide(model: dict, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language number, score) from margins: the family with the largest
    margin, in it the language with most votes (then the largest sum of
    margins); the score is the logistic of the family's lead times the mean
    logistic of the winner's pairwise margins."""
    def logistic(x):
        return 1 / (1 + np.exp(-np.clip(3 * x, -30, 30)))
    n, group = len(m), np.array(model["group"])
    chosen, score = np.zeros(n, np.int64), np.ones(n)
    if model["n_families"]:
        f = m[:, :model["n_families"]]
        chosen = f.argmax(axis=1)
        score = logistic(np.sort(f, axis=1)[:, -1] - np.sort(f, axis=1)[:, -2])
    votes, sums = np.zeros((n, len(group))), np.zeros((n, len(group)))
    probs, count = np.zeros((n, len(group))), np.bincount(group)[group] - 1
    for k, (i, j) in enumerate(model["pairs"]):
        x = m[:, model["n_families"] + k]
        for lang, margin in ((i, x), (j, -x)):
            votes[:, lang] += (margin > 0) + 0.5 * (margin == 0)
            sums[:, lang] += margin
            probs[:, lang] += logistic(margin)
    votes[group[None, :] != chosen[:, None]] = -1
    rank = np.lexsort((np.broadcast_to(-np.arange(len(group)), votes.shape), sums, votes), axis=1)
    best = rank[:, -1]
    inner = probs[np.arange(n), best] / np.maximum(1, count[best])
    return best, score * np.where(count[best] > 0, inner, 1.0)


def _train(batches):
    pdf = pd.concat([*batches, pd.DataFrame({"doc_id": [], "lang": [], "text": []})]).sort_values("doc_id")
    if len(pdf):
        m = fit(pdf["text"].tolist(), pdf["lang"].tolist())
        yield pd.DataFrame({"names": [m["names"]], "group": [m["group"]], "n_families": [m["n_families"]], "pairs": [[list(p) for p in m["pairs"]]],
                            "bias": [m["bias"]], "weights": [m["table"].tobytes()]})


def train(docs: DataFrame, limit: int = TRAIN_ROWS) -> dict | None:
    """The model from at most about ``limit`` documents with a letter, a non-null
    lang and a doc_id outside the held-out fifth: as many of each language, all
    of a rarer one's.  They are chosen by a hash of doc_id; of rows that share a
    doc_id the smallest (lang, text) is learned from.  None if there are none.
    The driver holds one count per language and the model."""
    lang = F.col("lang").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text")) \
        .where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    left, wanted = limit, {}
    for i, (name, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        wanted[name] = min(n, max(1, left // (len(counts) - i)))
        left -= wanted[name]
    steps = 1 << 53
    cuts = docs.sparkSession.createDataFrame([(name, steps * w // counts[name]) for name, w in wanted.items()], "lang string, cut long")
    picked = rows.join(F.broadcast(cuts), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(steps)) < F.col("cut")) \
        .groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x")).select("doc_id", "x.lang", "x.text")
    got = picked.repartition(1).mapInPandas(_train, "names array<string>, `group` array<long>, n_families int, pairs array<array<int>>, bias array<double>, weights binary").collect()
    if not got:
        return None
    m = got[0].asDict()
    return {**m, "pairs": [tuple(p) for p in m["pairs"]], "table": np.frombuffer(m.pop("weights"), np.float32).reshape(BUCKETS, -1) if m["bias"] else np.zeros((BUCKETS, 0), np.float32)}


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _predictions(model: dict):
    names = np.array(model["names"], object)

    def run(batches):
        for whole in batches:
            _, offsets = T.text_bytes(whole.column("_text"))
            langs, scores = [], []
            for lo, hi in T.row_slices(offsets, SLICE):
                part = whole.slice(lo, hi - lo)
                best, score = decide(model, margins(model, part.column("_text")))
                known = part.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
                langs += np.where(known, names[best], UNKNOWN).tolist()
                scores.append(np.where(known, score, 0.0))
            yield whole.drop_columns(["_text", "_letter"]).append_column("lang_pred", pa.array(langs, pa.string())) \
                .append_column("score", pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64()))
    return run


def identify(docs: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id,
    text, and lang to learn from).

    Null texts and texts without a letter are ``und`` with score 0, as are all
    texts when no row can be learned from.  With one learned language every
    other text is in it, with score 1.  A null doc_id is neither held out nor
    learned from; a null text is not learned from.  Repeated rows are predicted
    alike; texts of any length are read whole.  An empty table gives no rows.
    Other columns are ignored."""
    model = train(docs, limit)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("_text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.withColumn("_letter", has_letter(F.col("_text"))).mapInArrow(
        _predictions(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
