"""Centroid clustering against plain Lloyd rounds in Python's whole numbers;
language identification against a plain scorer and by held-out accuracy."""

import hashlib
import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from cinemetric.llm import langid, rotatedclusters
from cinemetric.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>, label int, v string, lead string, cluster int"


def lloyd(rows, k=8, rounds=10, width=64):
    kept = [(i, [math.floor(1024 * c) if abs(c) < 2**53 else int(c) * 1024 for c in e]) for i, e in rows
            if e is not None and len(e) == width and all(c is not None and math.isfinite(c) for c in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(b"3:%d" % (r[0] or 0)).hexdigest(), np.array(r[1], "<i8").tobytes() if max(map(abs, r[1])) < 2**62 else b""))
    cents = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        mine = [[] for _ in cents]
        for _, v in kept:
            mine[nearest(v)[1]].append(v)
        cents = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(mine, cents)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = {j: sum(d for _, c, d in found if c == j) for _, j, _ in found}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i is not None, i or 0), c, d, per[c], sum(per.values()), digest[c]) for i, c, d in found)


def got(df):
    return sorted(((r.vec_id is not None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "v", "l", 9) for i, e in rows], VECTORS).repartition(4)


def test_clusters_whole_table(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(0, 1, (5, 64))
    rows = [(i, (centre[i % 5] + rng.normal(0, 0.3, 64)).tolist()) for i in range(160)]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(3, rows[3][1]), (3, rows[9][1])]                       # copies, repeated ids
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [0.0] * 63), (904, [float("nan")] * 64), (905, [float("inf")] + [0.0] * 63), (None, [0.5] * 64)]
    rows += [(910, [0.0] * 64), (911, [-0.0005] * 64)]
    assert got(rotatedclusters.cluster(frame(spark, rows))) == lloyd(rows)


def test_clusters_small_and_empty(spark):
    assert rotatedclusters.cluster(frame(spark, [])).count() == 0
    assert rotatedclusters.cluster(frame(spark, [(1, None), (2, [1.0])])).count() == 0
    few = [(i, [float(i % 2)] * 64) for i in range(5)]
    assert got(rotatedclusters.cluster(frame(spark, few))) == lloyd(few)


def test_clusters_of_large_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (1e16 + rng.integers(-9, 9, 64) * 4.0).tolist()) for i in range(12)]
    assert got(rotatedclusters.cluster(frame(spark, rows))) == lloyd(rows)
    mixed = [(i, (rng.normal(0, 30000, 64)).tolist()) for i in range(30)]
    assert got(rotatedclusters.cluster(frame(spark, mixed))) == lloyd(mixed)


def test_bounds_leave_out_and_never_lie():
    rng = np.random.default_rng(7)
    centre = rng.normal(0, 900, (8, 64))
    v = np.floor(centre[rng.integers(0, 8, 4000)] + rng.normal(0, 40, (4000, 64))).astype(np.int64)
    x = v / 1024
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, ::-1][:, :16]
    lead, rest = rotatedclusters._turned(v, mean, axes)
    cents = v[:8]
    cluster, best, measured = rotatedclusters.assign(v, lead, rest, cents, mean, axes)
    d = ((v[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (cluster == d.argmin(axis=1)).all()
    assert measured < 0.5 * d.size


def plain_margins(model, text):
    """Mean bucket weight over every n-gram and word, one at a time."""
    words = [bytes(b + 32 if 65 <= b < 91 else b for b in w) for w in _words(text.encode())]
    total, n = np.zeros(model["table"].shape[1]), 0
    for w in words:
        ids = [int(langid._bucket(_word_hash(w))[0])]
        padded = b" " + w + b" "
        for g in langid.GRAMS:
            for piece in ([w[i:i + 1] for i in range(len(w))] if g == 1 else [padded[i:i + g] for i in range(len(padded) - g + 1)]):
                ids.append(int(langid._bucket(np.array([int.from_bytes(piece, "little") | g << 56], np.uint64))[0]))
        total += model["table"][ids].astype(np.float64).sum(axis=0)
        n += len(ids)
    return (total / n if n else total) + np.array(model["bias"])


def _words(raw):
    import re
    return re.findall(rb"[^\x20\x09-\x0D]+", raw)


def _word_hash(w):
    from cinemetric.llm import textarrays as T
    return T.words(pa.array([w.decode()], pa.large_string())).hashes


@pytest.fixture(scope="module")
def model():
    rows = duckdb.sql("SELECT text, lang FROM '/root/testdata/sf0.001/documents.parquet' WHERE doc_id % 3 = 0").fetchall()
    return langid.fit([r[0] for r in rows], [r[1] for r in rows])


def test_margins_equal_the_plain_scorer(model):
    texts = ["Von.", "", "The and of the", "é à l'été " * 40, "x" * 3000, "a\tb\nc", " \n", "Straße STRASSE größer ñandú ciónes"]
    got = langid.margins(model, pa.array(texts, pa.large_string()))
    assert np.allclose(got, [plain_margins(model, t) for t in texts], atol=1e-5)


def test_decision_stays_in_the_family(model):
    assert [langid.family(x) for x in ("en-GB", "pt_BR", "tlh")] == ["germanic", "romance", "tlh"]
    rng = np.random.default_rng(2)
    best, score = langid.decide(model, rng.normal(0, 2, (500, model["table"].shape[1])))
    group = np.array(model["group"])
    assert set(best.tolist()) == set(range(len(group))) and (score >= 0).all() and (score <= 1).all()
    m = np.zeros((1, model["table"].shape[1]))
    assert langid.decide(model, m)[0][0] == 0                    # ties: the first family, its first language


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op13_family_svm"][0](spark, "/root/testdata/sf0.01").collect()}
    truth = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    assert set(got) == set(truth)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    out = [i for i in truth if got[i].held_out]
    assert sum(got[i].lang_pred == truth[i] for i in out) >= 0.97 * len(out)


DOCS = "doc_id long, text string, lang string, source string, score string, lang_pred int, _letter string"


def test_language_edges(spark):
    def run(rows):
        return {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame([(*r, "s", "x", 1, "y") for r in rows], DOCS)).collect()}
    assert run([]) == {}
    got = run([(1, "hello there", None), (2, None, "en"), (3, "1234 !", "en")])
    assert {x[1:] for x in got.values()} == {("und", 0.0)}
    one = run([(i, "some text", "en") for i in range(12)] + [(50, None, "en"), (51, "99", "en"), (52, "другое", None), (None, "text", "de")])
    assert one[52][1:] == ("en", 1.0) and one[50][1:] == one[51][1:] == ("und", 0.0) and one[None] == (False, "en", 1.0)
    many = run([(i % 40, ("der und die " if i % 2 else "the and of ") * (1 + i % 30), "de" if i % 2 else "en") for i in range(300)] + [(400, "die und der " * 60000, None), (401, "the of", None)])
    assert many[400][1] == "de" and many[401][1] == "en"
