"""Embedding near-duplicates on a robust-pruned flat graph.

Equal vectors are one class.  Classes go to their nearest clusters on two levels
(centres are fitted on bounded samples and kept apart, so a tight group is not
cut); every class goes to several clusters.  Each cluster shard builds a flat
graph: nearest and random candidates, pruned robustly (a neighbour is dropped
when a kept one is closer to it by the factor ``ALPHA``), with reverse edges.
A class's adjacency lists from its shards are united.  Then every class is
searched in its shards: a greedy beam search from the shard's medoids, whose
range expands through all vectors that may reach the threshold until none is
left unexpanded.  Links are verified in double precision, counted in one shard
only (the first that two classes share) and joined by union-find, first those of
a task (its forest leaves the task as one link per class), then all.

Recall is measured in every run, whether the table holds links or not: a sample
of vectors is turned by known angles within the threshold, and these planted
queries are searched like any class; the share that finds the vector it was
made of is one figure.  The other compares a sample of classes, drawn before
the search, with all vectors.  Both samples have a fixed size.  If a figure is
below the goal, the overlap is widened and the search repeated; the last search
answers, with its figure, unless ``exact`` asks for a comparison of all.

A shard above ``SHARD`` members is cut into parts; each part has its graph, and
the members search all parts, so no task holds more than two parts.
"""

from __future__ import annotations

import hashlib
import logging
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import written

log = logging.getLogger(__name__)

SHARD = 2000
SAMPLE = 4000              # vectors the centres of a level are fitted on, at most (about)
ALPHA = 1.2
DEGREE = 32
NEAR, RANDOM = 64, 24
BEAM = 48
SLACK = 0.1                # the search also walks through vectors this far below the threshold
AUDIT = 200                # classes compared with all vectors, about
PLANTED = 400              # vectors turned and searched for, about
ENOUGH = 20                # audited classes with about as many links, for their recall to count
CHUNK = 20_000             # vectors that meet a coarse cluster's centres at once
GOAL = 0.95
APART = 0.8                # centres more similar than this are one


def _clean(batches):
    for b in batches:
        ids, rows = [], []
        for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()):
            x = np.array([np.nan if e is None else e for e in v], np.float64) if v else np.zeros(0)
            n = np.sqrt(np.dot(x / np.abs(x).max(), x / np.abs(x).max())) * np.abs(x).max() if len(x) and np.isfinite(x).all() and x.any() else 0.0
            ok = i is not None and n > 0 and np.isfinite(n)
            ids.append(i)
            rows.append(((x / n).tobytes(), hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest()) if ok else (None, None))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                                         ["vec_id", "unit", "key"])


def _matrix(units) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1) if len(units) else np.zeros((0, 0))


def centres(units: np.ndarray, k: int, seed: int = 2) -> np.ndarray:
    """About ``k`` spherical k-means centres, no two of them close."""
    rng = np.random.default_rng(seed)
    c: list[np.ndarray] = []
    for i in rng.permutation(len(units)):
        if len(c) == k:
            break
        if not c or (np.array(c) @ units[i]).max() < APART:
            c.append(units[i])
    m = np.array(c)
    for _ in range(4):
        near = (units @ m.T).argmax(axis=1)
        new = np.stack([units[near == j].sum(axis=0) if (near == j).any() else m[j] for j in range(len(m))])
        m = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
    keep: list[int] = []
    for j in range(len(m)):
        if not keep or (m[keep] @ m[j]).max() < APART:
            keep.append(j)
    return m[keep]


def prune(sims_to: np.ndarray, cand: np.ndarray, pair_sims) -> np.ndarray:
    """Robust pruning of sorted candidate lists (nodes x candidates) to at most
    ``DEGREE`` neighbours each, -1 for none."""
    n, c = cand.shape
    alive = cand >= 0
    out = np.full((n, DEGREE), -1, np.int64)
    rows = np.arange(n)
    far = 2 - 2 * sims_to
    for r in range(DEGREE):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = alive.argmax(axis=1)
        chosen = cand[rows, pick]
        out[some, r] = chosen[some]
        near = 2 - 2 * pair_sims(np.where(some, chosen, 0), np.maximum(cand, 0))
        alive &= ALPHA * ALPHA * near > far
        alive[rows, pick] = False
    return out


def build(x: np.ndarray, seed: int) -> np.ndarray:
    """Adjacency (nodes x up to 2 * DEGREE, -1 for none) of one shard."""
    n = len(x)
    if n < 2:
        return np.full((n, 1), -1, np.int64)
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    near = min(NEAR, n - 1)
    cands, sims = [], []
    for lo in range(0, n, 512):
        s = x[lo:lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        top = np.argpartition(-s, near - 1, axis=1)[:, :near]
        c = np.concatenate([top, rng.integers(0, n, (len(s), RANDOM))], axis=1)
        v = np.take_along_axis(s, c, 1)
        order = np.argsort(-v, axis=1)
        cands.append(np.take_along_axis(c, order, 1))
        sims.append(np.take_along_axis(v, order, 1))
    cand, sim = np.concatenate(cands), np.concatenate(sims)
    cand[sim < -1.5] = -1
    out = []
    for lo in range(0, n, 256):
        out.append(prune(sim[lo:lo + 256], cand[lo:lo + 256], lambda a, b: np.einsum("nd,ncd->nc", x[a], x[b])))
    adj = np.concatenate(out)
    # reverse edges, up to as many again
    a, b = np.repeat(np.arange(n), DEGREE), adj.reshape(-1)
    a, b = a[b >= 0], b[b >= 0]
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    rank = np.arange(len(b)) - np.searchsorted(b, b, "left")
    back = np.full((n, DEGREE), -1, np.int64)
    ok = rank < DEGREE
    back[b[ok], rank[ok]] = a[ok]
    return np.concatenate([adj, back], axis=1)


def search(x: np.ndarray, adj: np.ndarray, starts: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs of similarity >= threshold that a beam search from
    ``starts`` with an expanding range meets, for a block of queries."""
    nq, n = len(q), len(x)
    sim = np.full((nq, n), -3.0, np.float32)              # met nodes' similarities
    done = np.zeros((nq, n), bool)
    x32, q32 = x.astype(np.float32), q.astype(np.float32)

    def meet(qi: np.ndarray, ni: np.ndarray) -> None:
        key = np.unique(qi * n + ni)
        qi, ni = key // n, key % n
        new = sim[qi, ni] < -2
        qi, ni = qi[new], ni[new]
        for lo in range(0, len(qi), 1 << 16):
            a, b = qi[lo:lo + (1 << 16)], ni[lo:lo + (1 << 16)]
            sim[a, b] = np.einsum("ij,ij->i", q32[a], x32[b])

    meet(np.repeat(np.arange(nq), len(starts)), np.tile(starts, nq))
    beam = min(BEAM, n)
    while True:
        best = np.argpartition(-sim, beam - 1, axis=1)[:, :beam] if beam < n else np.tile(np.arange(n), (nq, 1))
        s = np.take_along_axis(sim, best, 1)
        todo = (s > -2) & ~np.take_along_axis(done, best, 1)
        # the best few of the beam, and everything within range
        rank = np.argsort(-np.where(todo, s, -9), axis=1)[:, :8]
        qi = np.repeat(np.arange(nq), rank.shape[1])
        ok = np.take_along_axis(todo, rank, 1).reshape(-1)
        qi, ni = qi[ok], np.take_along_axis(best, rank, 1).reshape(-1)[ok]
        wide = np.nonzero((sim >= threshold - SLACK) & ~done)
        qi, ni = np.concatenate([qi, wide[0]]), np.concatenate([ni, wide[1]])
        if not len(qi):
            break
        done[qi, ni] = True
        nb = adj[ni]
        qq = np.repeat(qi, nb.shape[1])
        nb = nb.reshape(-1)
        meet(qq[nb >= 0], nb[nb >= 0])
    qi, ni = np.nonzero(sim >= threshold - 1e-3)
    exact = np.einsum("ij,ij->i", q[qi], x[ni]) >= threshold       # verified in double precision
    return qi[exact], ni[exact]


def medoids(x: np.ndarray, seed: int) -> np.ndarray:
    """The vector nearest to the mean, and those nearest to a few centres."""
    rng = np.random.default_rng(seed)
    k = min(len(x), 16)
    c = np.concatenate([x.mean(axis=0, keepdims=True), x[rng.choice(len(x), k, replace=False)]])
    near = (x @ c[1:].T).argmax(axis=1)
    for j in range(k):
        if (near == j).any():
            c[j + 1] = x[near == j].mean(axis=0)
    return np.unique((x @ c.T).argmax(axis=0))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep")
    x, ids = _matrix(pdf["unit"]), pdf["rep"].to_numpy()
    adj = build(x, int(pdf["shard"].iloc[0]) % 2**31)
    return pd.DataFrame({"rep": ids, "near": [ids[a[a >= 0]] for a in adj]})


class Forest:
    """Union-find over the classes of a task, with their numbers of links."""

    def __init__(self, *ids: np.ndarray):
        self.ids = np.unique(np.concatenate(ids))
        self.tree = np.arange(len(self.ids))
        self.n = np.zeros(len(self.ids), np.int64)

    def link(self, rep: int, others: np.ndarray, n: int) -> None:
        at = np.searchsorted(self.ids, rep)
        trees = np.unique(self.tree[np.append(np.searchsorted(self.ids, others), at)])
        if len(trees) > 1:
            self.tree[np.isin(self.tree, trees[1:])] = trees[0]
        self.n[at] += n

    def rows(self) -> pd.DataFrame:
        """One row per linked class: the smallest class of its tree and the count."""
        some = np.bincount(self.tree, minlength=len(self.tree))[self.tree] > 1
        return pd.DataFrame({"rep": self.ids[some], "other": self.ids[self.tree[some]], "n": self.n[some]})


def _search(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        index = pdf[pdf["role"] == 0].sort_values("rep").reset_index(drop=True)
        query = pdf[pdf["role"] == 1].sort_values("rep").reset_index(drop=True)
        if not len(index) or not len(query):
            return pd.DataFrame({"rep": [], "other": [], "n": [], "planted": []})
        plant, query = query[query["n"] == 0], query[query["n"] > 0].reset_index(drop=True)
        x, ids, size = _matrix(index["unit"]), index["rep"].to_numpy(), index["n"].to_numpy()
        lists = [np.asarray(a, np.int64) for a in index["near"]]
        flat = np.concatenate(lists)
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        row = np.repeat(np.arange(len(ids)), [len(a) for a in lists])
        at, row = at[ids[at] == flat], row[ids[at] == flat]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        adj = np.full((len(ids), int(rank.max()) + 1 if len(rank) else 1), -1, np.int64)
        adj[row, rank] = at
        starts = medoids(x, shard % 2**31)
        theirs = [frozenset(s) for s in index["shards"]]
        q_all, q_ids = _matrix(query["unit"]), query["rep"].to_numpy()
        forest = Forest(ids, q_ids)
        for lo in range(0, len(query), 256):
            qi, ni = search(x, adj, starts, q_all[lo:lo + 256], threshold)
            keep = q_ids[lo + qi] != ids[ni]
            qi, ni = qi[keep], ni[keep]
            for j in np.unique(qi).tolist():
                mine = ni[qi == j]
                own = frozenset(query["shards"][lo + j])
                # a pair counts in the first shard that both are in
                first = [min(own & theirs[i]) == shard for i in mine.tolist()]
                forest.link(int(q_ids[lo + j]), ids[mine], int(size[mine][np.array(first, bool)].sum()))
        p_all, p_ids, met = _matrix(plant["unit"]), plant["rep"].to_numpy(), [np.zeros(0, np.int64)]
        for lo in range(0, len(plant), 256):
            qi, ni = search(x, adj, starts, p_all[lo:lo + 256], threshold)
            met.append(p_ids[lo + qi][p_ids[lo + qi] == ids[ni]])
        met = np.unique(np.concatenate(met))
        return pd.concat([forest.rows().assign(planted=False), pd.DataFrame({"rep": met, "other": met, "n": 1, "planted": True})])
    return run


def _nearest(c: np.ndarray, overlap: int):
    def run(batches):
        for pdf in batches:
            s = _matrix(pdf["unit"]) @ c.T
            near = np.argsort(-s, axis=1)[:, :overlap]
            yield pd.DataFrame({"rep": np.repeat(pdf["rep"].to_numpy(), near.shape[1]), "n": np.repeat(pdf["n"].to_numpy(), near.shape[1]),
                                "unit": np.repeat(pdf["unit"].to_numpy(), near.shape[1]), "coarse": near.reshape(-1)})
    return run


def _fine_centres(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep")
    c = centres(_matrix(pdf["unit"]), int(pdf["k"].iloc[0]))
    return pd.DataFrame({"coarse": [int(pdf["coarse"].iloc[0])], "centres": [c.tobytes()]})


def _fine(overlap: int):
    def run(pdf: pd.DataFrame, centre: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"rep": [], "n": [], "unit": [], "shard": []})
        x = _matrix(pdf["unit"])
        c = np.frombuffer(centre["centres"].iloc[0], np.float64).reshape(-1, x.shape[1])
        near = np.argsort(-(x @ c.T), axis=1)[:, :overlap]
        return pd.DataFrame({"rep": np.repeat(pdf["rep"].to_numpy(), near.shape[1]), "n": np.repeat(pdf["n"].to_numpy(), near.shape[1]),
                             "unit": np.repeat(pdf["unit"].to_numpy(), near.shape[1]), "shard": int(pdf["coarse"].iloc[0]) * (1 << 20) + near.reshape(-1)})
    return run


def shards(classes: DataFrame, n: int, overlap: int) -> DataFrame:
    """(rep, n, unit, shard): every class in its nearest clusters on two levels."""
    k1 = max(1, math.ceil(math.sqrt(n / SHARD)))
    h = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 20))
    known = classes.where("n > 0")
    sample = known.where(h < max(1, int((1 << 20) * min(1.0, SAMPLE / n)))).select("rep", "unit").toPandas().sort_values("rep")
    if not len(sample):
        sample = known.select("rep", "unit").limit(1).toPandas()
    top = centres(_matrix(sample["unit"]), k1)
    coarse = written(classes.select("rep", "n", "unit").mapInPandas(_nearest(top, overlap), "rep long, n long, unit binary, coarse long"), "coarse")
    sizes = coarse.groupBy("coarse").agg(F.count(F.lit(1)).alias("m")).withColumn("k", F.ceil(F.col("m") / SHARD).cast("long"))
    sizes = F.broadcast(written(sizes, "sizes"))             # one row per coarse centre
    pick = coarse.where("n > 0").join(sizes, "coarse").where(h < F.lit(1 << 20) * F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("m")))
    fine = written(pick.groupBy("coarse").applyInPandas(_fine_centres, "coarse long, centres binary"), "centres")
    # a cluster's centres meet its members once per chunk, not on every row
    chunks = F.ceil(F.col("m") / CHUNK)
    left = coarse.join(sizes, "coarse").select("rep", "n", "unit", "coarse", F.pmod(F.xxhash64("rep", F.lit(7)), chunks).alias("chunk"))
    right = fine.join(sizes, "coarse").select(F.col("coarse").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("d"), "centres")
    return left.groupBy("coarse", "chunk").cogroup(right.groupBy("c", "d")).applyInPandas(_fine(overlap), "rep long, n long, unit binary, shard long")


def _compare(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        index, query = (pdf[pdf["role"] == r].sort_values("rep") for r in (0, 1))
        x, ids, size = _matrix(index["unit"]), index["rep"].to_numpy(), index["n"].to_numpy()
        q, q_ids = _matrix(query["unit"]), query["rep"].to_numpy()
        forest = Forest(ids, q_ids)
        for lo in range(0, len(q) if len(x) else 0, 256):
            s = q[lo:lo + 256] @ x.T
            s[q_ids[lo:lo + 256, None] == ids[None, :]] = -2
            qi, ni = np.nonzero(s >= threshold - 1e-9)
            ok = np.einsum("ij,ij->i", q[lo + qi], x[ni]) >= threshold
            qi, ni = qi[ok], ni[ok]
            for j in np.unique(qi).tolist():
                mine = ni[qi == j]
                forest.link(int(q_ids[lo + j]), ids[mine], int(size[mine].sum()))
        return forest.rows()
    return run


def exact_links(queries: DataFrame, classes: DataFrame, m: int, n: int, threshold: float) -> DataFrame:
    """(rep, other, n) as from ``_links``, by comparing about ``m`` of the ``n``
    classes with all of them in blocks."""
    qs, xs = max(1, math.ceil(m / (2 * SHARD))), max(1, math.ceil(n / (2 * SHARD)))
    own = lambda parts: F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    index = classes.select(every(qs).alias("i"), own(xs).alias("j"), F.lit(0).alias("role"), "rep", "n", "unit")
    query = queries.select(own(qs).alias("i"), every(xs).alias("j"), F.lit(1).alias("role"), "rep", "n", "unit")
    return written(index.union(query).groupBy("i", "j").applyInPandas(_compare(threshold), "rep long, other long, n long"), "exact")


def _hash_share(classes: DataFrame, salt: int, m: int, n: int) -> DataFrame:
    """About ``m`` of the ``n`` classes, by a hash of the class alone."""
    h = F.pmod(F.xxhash64("rep", F.lit(salt)), F.lit(1 << 40))
    return classes.where(h < math.ceil((1 << 40) * min(1.0, m / n)))


def truth(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """All links of about ``AUDIT`` classes."""
    return exact_links(_hash_share(classes, 9, AUDIT, n), classes, min(AUDIT, n), n, threshold)


def _turn(threshold: float):
    """Unit vectors turned by an angle whose cosine lies evenly between the
    threshold and 1, in a direction drawn for the class."""
    def run(batches):
        for pdf in batches:
            units = []
            for rep, unit in zip(pdf["rep"], pdf["unit"]):
                rng, u = np.random.default_rng(int(rep) % 2**63), np.frombuffer(unit, np.float64)
                w = rng.normal(size=len(u))
                w -= (w @ u) * u
                c = threshold + (1 - threshold) * rng.uniform(0.01, 1)
                size = np.linalg.norm(w)
                units.append((c * u + np.sqrt(max(0.0, 1 - c * c)) * w / size).tobytes() if size > 1e-9 else unit)
            yield pd.DataFrame({"rep": pdf["rep"], "n": 0, "unit": units})
    return run


def planted(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """About ``PLANTED`` turned vectors (rep of the class they were made of, n = 0)."""
    return written(_hash_share(classes, 13, PLANTED, n).select("rep", "unit").mapInPandas(_turn(threshold), "rep long, n long, unit binary"), "planted")


def audit(true: DataFrame, links: DataFrame) -> float | None:
    """Recall of ``links`` on the sample ``true``: per class the share of its
    links that was found, averaged over classes with about as many links (powers
    of four); the lowest of the averages over at least ``ENOUGH`` classes, so
    that neither a hot group's links nor its classes stand for pairs, and none
    hangs on a few classes.  None if there is none."""
    true = true.groupBy("rep").agg(F.sum("n").alias("all")).where(F.col("all") > 0)
    both = true.join(links.groupBy("rep").agg(F.sum("n").alias("found")), "rep", "left")
    share = F.least("all", F.coalesce("found", F.lit(0))) / F.col("all")
    bins = both.groupBy(F.floor(F.log2("all") / 2).alias("size")).agg(F.avg(share).alias("recall"), F.count(F.lit(1)).alias("classes"))
    return bins.where(F.col("classes") >= ENOUGH).agg(F.min("recall")).first()[0]


def width_links(classes: DataFrame, n: int, threshold: float, overlap: int, report: list | None = None, exact: bool = False) -> DataFrame:
    """Links of the classes of one width, searched in the graph with ``overlap``
    clusters a class, then twice and four times as many while the measured
    recall is below ``GOAL``.  Only with ``exact``, and if that does not reach it
    either, all classes are compared with each other."""
    true, turned = truth(classes, n, threshold), planted(classes, n, threshold)
    asked, wide = turned.count(), overlap
    while True:
        got = _links(classes, n, threshold, wide, turned)
        links = got.where("not planted").drop("planted")
        found = got.where("planted").select("rep").distinct().count() / asked if asked else 1.0
        seen = audit(true, links)
        recall = found if seen is None else min(found, seen)
        last = recall >= GOAL or wide >= 4 * overlap
        log.info("%d vectors: %.4f of %d planted ones found, audit %s, at overlap %d", n, found, asked, seen, wide)
        if report is not None:
            report.append({"classes": n, "planted": found, "audit": seen, "overlap": wide, "recall": recall, "used": last and (recall >= GOAL or not exact)})
        if last:
            break
        wide *= 2
    if recall >= GOAL:
        return links
    log.warning("%d vectors: recall %.4f is below %.2f at overlap %d", n, recall, GOAL, wide)
    if not exact:
        return links
    if report is not None:
        report.append({"classes": n, "planted": 1.0, "audit": 1.0, "overlap": None, "recall": 1.0, "used": True})
    return exact_links(classes, classes, n, n, threshold)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, overlap: int = 2, report: list | None = None, exact: bool = False) -> DataFrame:
    """One row per input row: vec_id, n_links (other vectors with cosine >=
    ``threshold``), component_id (smallest vec_id that links reach), kept.

    Null or empty vectors, zero vectors and those with null or non-finite
    components link with nothing, as do rows with a null vec_id (their
    component is null and they are kept); equal vectors (also repeated rows)
    are linked with each other; only vectors of the same width are compared.
    Other columns are ignored; an empty table gives an empty result.  The measured
    recall of every search is logged and appended to ``report``.  ``exact``: where
    it stays below the goal, all vectors are compared, which takes the square of
    their number (overlap None in ``report``)."""
    spark = vectors.sparkSession
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
                   .mapInArrow(_clean, "vec_id long, unit binary, key binary"), "vectors")
    classes = written(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit")), "classes")
    widths = [(r["w"], r["n"]) for r in classes.groupBy(F.octet_length("unit").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()]
    found = [width_links(classes.where(F.octet_length("unit") == width), n, threshold, overlap, report, exact) for width, n in sorted(widths)]
    links = found[0] if found else spark.createDataFrame([], "rep long, other long, n long")
    for more in found[1:]:
        links = links.union(more)
    roots = components(links, "rep", "other").withColumnRenamed("node", "rep")
    counts = links.groupBy("rep").agg(F.sum("n").alias("links"))
    label = classes.select("key", "rep", "n").join(roots, "rep", "left").join(counts, "rep", "left") \
        .select("key", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    out = rows.select("vec_id", "key").join(label, "key", "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(classes: DataFrame, n: int, threshold: float, overlap: int, turned: DataFrame | None = None) -> DataFrame:
    """(rep, other, n, planted): per linked class and pair of shard parts the
    smallest class that links found there reach, and the number of vectors linked
    in this shard first; and (planted true) every class that a vector of
    ``turned`` was made of and found."""
    every = classes.select("rep", "n", "unit")
    placed = written(shards(every if turned is None else every.union(turned.select("rep", "n", "unit")), n, overlap).distinct(), "placed")
    sizes = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (2 * SHARD)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts"))
    placed = placed.join(sizes, "shard").withColumn("part", part)
    members = placed.where("n > 0")
    lists = members.groupBy("shard", "part").applyInPandas(_build, "rep long, near array<long>")
    united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    where = members.groupBy("rep").agg(F.collect_set("shard").alias("shards"))
    nodes = members.join(written(united.join(where, "rep"), "graph"), "rep")
    fan = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cols = ["shard", "i", "j", "role", "rep", "n", "unit", "near", "shards"]
    none = F.lit(None).cast("array<long>")
    asked = nodes.withColumn("near", none).unionByName(placed.where("n = 0").withColumn("near", none).withColumn("shards", none), allowMissingColumns=True)
    index = nodes.withColumn("j", F.col("part")).withColumn("i", fan).withColumn("role", F.lit(0)).select(*cols)
    query = asked.withColumn("i", F.col("part")).withColumn("j", fan).withColumn("role", F.lit(1)).select(*cols)
    rows = index.withColumn("j", F.col("j").cast("int")).withColumn("i", F.col("i").cast("int")) \
        .union(query.withColumn("i", F.col("i").cast("int")).withColumn("j", F.col("j").cast("int")))
    return written(rows.groupBy("shard", "i", "j").applyInPandas(_search(threshold), "rep long, other long, n long, planted boolean"), "links")
