"""MinHash near-duplicates with SuperMinHash signatures.

Every element of a set walks through the signature's positions in its own
random order and offers ``rank + random`` at each; a position keeps the
smallest offer.  Because an element's ranks are a permutation, the positions
are negatively correlated and the similarity estimate has a lower variance than
independent hashes.  A set is finished (early stop) as soon as every position
holds an offer below the next rank: long sets need one or two ranks.

Distribution: documents with the same set are one class (a grouped minimum).
Signatures of the classes are banded; bucket rows are range-partitioned on
(bucket, random order), so a bucket holding a third of all rows is cut over
many tasks.  Neighbours in a bucket are candidates; their whole sets confirm
the link; union-find groups the links.  In buckets whose members are still in
different groups, the members outside the largest group meet all others in
blocks of bounded size (signatures first, then whole sets), so every pair that
shares a bucket ends in one group or is tested; only links leave a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as T
from .components import components
from .storage import written

BANDS, ROWS = 42, 6          # at 80 % similarity a pair misses all buckets with probability 3e-6
POSITIONS = BANDS * ROWS
ELEMENTS = 250_000           # set elements handled at once
BLOCK = 1024                 # bucket members compared with each other in one task
SLACK = 0.13                 # five standard errors of the signature estimate at 80 %


def signatures(elements: np.ndarray, first: np.ndarray, m: int = POSITIONS) -> np.ndarray:
    """SuperMinHash signatures (sets x m) of sets of 64-bit hashes; an empty
    set's row is infinite."""
    sets = len(first) - 1
    sizes = np.diff(first)
    best = np.full((sets, m), np.inf)
    live = np.repeat(np.arange(sets), sizes)
    x = elements
    perm = None
    previous = None
    for rank in range(m):
        if not len(x):
            break
        rnd = T.mix(x + T.U((rank * 0xD1342543DE82EF95 + 1) % 2**64))
        jump = rank + (((rnd & T.U(0xFFFFFFFF)) * T.U(m - rank)) >> T.U(32)).astype(np.int64)
        offer = rank + (rnd >> T.U(32)).astype(np.float64) * 2.0**-32
        if rank == 0:
            place, previous = jump, jump
        elif rank == 1:
            place = np.where(jump == previous, 0, jump)
        else:
            rows = np.arange(len(x))
            place = perm[rows, jump].astype(np.int64)
            perm[rows, jump] = perm[rows, rank]
        np.minimum.at(best.reshape(-1), live * m + place, offer)
        open_sets = (best.max(axis=1) > rank + 1) & (sizes > 0)
        keep = open_sets[live]
        if rank == 1:           # the order so far, kept only for sets that need more ranks
            k0, k1 = previous[keep], jump[keep]
            perm = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(k0), m)).copy()
            rows = np.arange(len(k0))
            perm[rows, k0] = 0
            perm[rows, k1] = perm[rows, 1]
            x, live = x[keep], live[keep]
        elif not keep.all():
            x, live = x[keep], live[keep]
            if rank == 0:
                previous = previous[keep]
            else:
                perm = perm[keep]
    return best


def _sets(w: T.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text and their bounds."""
    h, first = T.shingles(w, k)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(first)), "left").astype(np.int64)


def _slices(batch: pa.RecordBatch, limit: int = 4 << 20):
    _, offsets = T.text_bytes(batch.column("text"))
    for lo, hi in T.row_slices(offsets, limit):
        yield batch.slice(lo, hi - lo)


def _features(k: int):
    def run(batches):
        for whole in batches:
            for batch in _slices(whole):
                h, first = _sets(T.words(batch.column("text")), k)
                n = np.diff(first)
                sums = np.zeros((2, len(n)), np.uint64)
                full = np.flatnonzero(n > 0)
                if len(full):
                    for i in range(2):
                        sums[i][full] = np.add.reduceat(T.mix(h + T.U(i * 0x5851F42D4C957F2D + 7)), first[:-1][full])
                bands = np.zeros((len(n), BANDS), np.uint64)
                sig = np.zeros((len(n), POSITIONS), np.uint8)
                lo = 0
                while lo < len(n):
                    hi = max(lo + 1, int(np.searchsorted(first, first[lo] + ELEMENTS, "right")) - 1)
                    s = signatures(h[first[lo]:first[hi]], first[lo:hi + 1] - first[lo])
                    v = T.mix(s.view(np.uint64))
                    sig[lo:hi] = (v >> T.U(56)).astype(np.uint8)
                    key = np.zeros((hi - lo, BANDS), np.uint64)
                    for r in range(ROWS):
                        key = T.mix(key * T.BASE + v.reshape(hi - lo, BANDS, ROWS)[:, :, r])
                    bands[lo:hi] = T.mix(key + np.arange(BANDS, dtype=np.uint64) * T.BASE)
                    lo = hi
                digest = np.concatenate([sums.T, n[:, None].astype(np.uint64)], axis=1)
                ids = batch.column("doc_id").cast(pa.int64())
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(n, pa.int64()),
                    pa.array([digest[i].tobytes() for i in range(len(n))], pa.binary()),
                    pa.array([sig[i].tobytes() for i in range(len(n))], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * BANDS + 1, BANDS), pa.int32()),
                                             pa.array(bands.view(np.int64).reshape(-1)))],
                    ["doc_id", "n_shingles", "digest", "sig", "bands"])
    return run


def _neighbours(batches):
    """Sorted bucket rows of one range partition: (bucket, member, the member
    before it in the bucket); only rows of buckets with two members, and the
    partition's first and last row, whose bucket may go on elsewhere."""
    last = None
    held = None
    out = {"bucket": [], "rep": [], "before": [], "edge": []}

    def emit(key, rep, before, edge):
        out["bucket"].append(key)
        out["rep"].append(rep)
        out["before"].append(before)
        out["edge"].append(edge)

    for b in batches:
        keys, reps = b.column("bucket").to_numpy(), b.column("rep").to_numpy()
        if not len(keys):
            continue
        if last is not None:
            keys, reps = np.concatenate([[last[0]], keys]), np.concatenate([[last[1]], reps])
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = keys[1:] == keys[:-1]
        lo = 0 if last is None else 1
        for i in (np.flatnonzero(same[:-1] | same[1:])).tolist():
            if i >= lo:
                emit(int(keys[i]), int(reps[i]), int(reps[i - 1]) if same[i] else None, 0)
            elif same[i + 1] and not held:      # the carried row had no partner so far
                emit(int(keys[i]), int(reps[i]), None, 0)
        if last is None:
            emit(int(keys[0]), int(reps[0]), None, 1)
        held = bool(same[len(keys) - 1])
        last = (keys[-1], reps[-1])
    if last is not None:
        emit(int(last[0]), int(last[1]), None, 2)
    yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int64()), pa.array(out["rep"], pa.int64()),
                                      pa.array(out["before"], pa.int64()), pa.array(out["edge"], pa.int32())],
                                     ["bucket", "rep", "before", "edge"])


def _set_blobs(k: int):
    def run(batches):
        for whole in batches:
            for batch in _slices(whole):
                h, first = _sets(T.words(batch.column("text")), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([h[first[i]:first[i + 1]].tobytes() for i in range(len(first) - 1)], pa.binary())],
                    ["rep", "elements"])
    return run


def _confirm(percent: int):
    def run(batches):
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["ea"], pdf["eb"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            out = pdf[["a", "b"]].copy()
            out["linked"] = np.array(ok, bool)
            yield out
    return run


def _runs(batches, keys: list[str]):
    """Complete runs of equal keys of sorted Arrow batches, as Arrow tables."""
    carry = None
    for b in batches:
        t = pa.Table.from_batches([b]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([b])])
        if not len(t):
            continue
        new = np.zeros(len(t), bool)
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(new).tolist()
        for lo, hi in zip([0, *cuts[:-1]], cuts):
            yield t.slice(lo, hi - lo)
        carry = t.slice(cuts[-1] if cuts else 0)
    if carry is not None and len(carry):
        yield carry


def _similar_blocks(percent: int):
    """Members of the blocks in which a member outside the bucket's largest
    group may reach the threshold with a member of another group, by set sizes
    and signature agreement."""
    def run(batches):
        for t in _runs(batches, ["bucket", "i", "j"]):
            side, root, n, rep = (t.column(c).to_numpy() for c in ("side", "root", "n_shingles", "rep"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(t), POSITIONS)
            right, left = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            keep = np.zeros(len(t), bool)
            for x in left.tolist():
                at = right[(root[right] != root[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
                if len(at):
                    at = at[(sig[at] == sig[x]).mean(axis=1) >= percent / 100 - SLACK]
                    if len(at):
                        keep[x] = True
                        keep[at] = True
            if keep.any():
                yield from t.filter(pa.array(keep)).select(["bucket", "i", "j", "side", "rep", "root"]).to_batches()
    return run


def _exact_blocks(percent: int):
    """One confirmed link for each left member and each other group that it
    reaches within its block, on whole sets."""
    def run(batches):
        for t in _runs(batches, ["bucket", "i", "j"]):
            side, root, rep = (t.column(c).to_numpy() for c in ("side", "root", "rep"))
            sets = [np.frombuffer(x, np.uint64) for x in t.column("elements").to_pylist()]
            right = np.flatnonzero(side == 0)
            if not len(right):
                continue
            sizes = np.array([len(sets[y]) for y in right])
            names, code = np.unique(np.concatenate([sets[y] for y in right]), return_inverse=True)
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mark = np.zeros(len(names), np.int64)
            a, b = [], []
            for x in np.flatnonzero(side == 1).tolist():
                at = np.searchsorted(names, sets[x])
                at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == sets[x])]
                mark[at] = 1
                both = np.add.reduceat(mark[code], start)
                mark[at] = 0
                hit = right[(100 * both >= percent * (sizes + len(sets[x]) - both)) & (root[right] != root[x])]
                _, one = np.unique(root[hit], return_index=True)
                a += [int(rep[x])] * len(one)
                b += rep[hit[one]].tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose sets of ``k``-word shingles are similar.

    Two documents are linked when ``100 * |A and B| >= percent * |A or B|`` on
    their whole sets.  Returns one row per input row: doc_id, n_shingles,
    component_id (smallest doc_id that links reach) and kept (doc_id equals
    component_id).  A null or blank text has an empty set, links with nothing
    and is kept; rows with equal texts (also repeated rows) share a component;
    rows that share a doc_id are one node, whose links are those of all its
    texts, and get one component; a null doc_id takes part in no link, gets a null component and is kept; other columns
    are ignored.  An empty table gives an empty result."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = written(docs.mapInArrow(_features(k), "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>"),
                    "features")
    classes = (feats.where("n_shingles > 0 and doc_id is not null").groupBy("digest")
               .agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"),
                    F.first("bands").alias("bands")))
    classes = written(classes, "classes")
    rows = classes.select("rep", F.explode("bands").alias("bucket"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = F.xxhash64("rep", "bucket")
    ranged = rows.withColumn("ord", order).repartitionByRange(parts, "bucket", "ord").sortWithinPartitions("bucket", "ord")
    members = written(ranged.select("bucket", "rep").mapInArrow(_neighbours, "bucket long, rep long, before long, edge int")
                      .withColumn("part", F.spark_partition_id()), "members")
    # a bucket that goes on in the next range partition: last row there, first row here
    ends = members.where("edge > 0").groupBy("part").agg(*[
        F.max(F.when(F.col("edge") == e, F.struct("bucket", "rep"))).alias(name) for e, name in ((1, "head"), (2, "tail"))])
    nxt = ends.select((F.col("part") - 1).alias("part"), F.col("head").alias("next"))
    stitched = ends.join(nxt, "part").where("tail.bucket = next.bucket").select(
        F.col("tail.bucket").alias("bucket"), F.col("tail.rep").alias("a"), F.col("next.rep").alias("b"))
    pairs = (members.where("before is not null").select(F.col("before").alias("a"), F.col("rep").alias("b"))
             .union(stitched.select("a", "b")).where("a <> b")
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    in_buckets = written(members.select("bucket", "rep").distinct()
                         .join(members.select("bucket", "rep").distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
                               .where("size > 1"), "bucket"), "buckets")
    wanted = in_buckets.select("rep").distinct()
    sets = written(docs.join(wanted.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id", "left_semi")   # the same plan at every size
                   .mapInArrow(_set_blobs(k), "rep long, elements binary"), "sets")
    light = written(classes.join(wanted, "rep", "left_semi").select("rep", "n_shingles", "sig"), "light")

    def confirm(p: DataFrame) -> DataFrame:
        """Size and signature bounds first, then the whole sets."""
        p = (p.join(light.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na")), "a")
             .join(light.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb")), "b")
             .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b"))
        p = (p.join(sets.select(F.col("rep").alias("a"), F.col("elements").alias("ea")), "a")
             .join(sets.select(F.col("rep").alias("b"), F.col("elements").alias("eb")), "b"))
        return written(p.select("a", "b", "ea", "eb").mapInPandas(_confirm(percent), "a long, b long, linked boolean"), "tested")

    tested = confirm(pairs)
    links = tested.where("linked").select("a", "b")
    roots = components(links)
    # Buckets whose members are still in different groups: the members outside
    # the largest group meet all members, block by block.
    m = in_buckets.where("size > 2").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    m = m.withColumn("root", F.coalesce("root", "rep"))
    groups = m.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    rest = F.sum("n") - F.max("n")
    main = groups.groupBy("bucket").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("groups"),
                                        F.ceil(rest / BLOCK).cast("int").alias("left_blocks"),
                                        F.ceil(F.sum("n") / BLOCK).cast("int").alias("right_blocks")).where("groups > 1")
    m = m.join(main, "bucket")
    h = F.xxhash64("rep")
    left = m.where("root <> main").withColumn("i", F.pmod(h, F.col("left_blocks"))) \
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("right_blocks") - 1))).withColumn("side", F.lit(1))
    right = m.withColumn("j", F.pmod(h, F.col("right_blocks"))) \
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1))).withColumn("side", F.lit(0))
    cols = ["bucket", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "side", "rep", "root"]
    block = ["bucket", "i", "j"]
    both = left.select(*cols).unionByName(right.select(*cols)).join(light, "rep")
    near = written(both.repartition(parts, *block).sortWithinPartitions(*block)
                   .mapInArrow(_similar_blocks(percent), "bucket long, i long, j long, side int, rep long, root long"), "open")
    more = written(near.join(sets, "rep").repartition(parts, *block).sortWithinPartitions(*block)
                   .mapInArrow(_exact_blocks(percent), "a long, b long").distinct(), "more")
    roots = components(links.union(more))
    label = classes.select("digest", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("digest", F.coalesce("root", "rep").alias("root"))
    out = feats.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")) \
        .join(label, "digest", "left").withColumn("component_id", F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
