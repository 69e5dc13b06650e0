"""Centroid clustering in whole numbers, filtered by PCA-rotated coordinates.

Every vector becomes whole numbers ``floor(1024 * x)``.  Its leading coordinates
after a rotation onto the principal axes, and the norm of what the rotation
leaves over, are stored beside them.  For a centroid treated alike, the squared
distance of the leading coordinates plus the squared difference of the two
residual norms can't exceed the squared distance of the vectors.  The centroid
with the smallest bound is measured first, in whole numbers; of the others only
those whose bound does not exceed that distance are measured too, so the
assignment is exact whatever the rotation is.  A wide margin covers rounding.

A round is one pass over the stored table: tasks assign their vectors and add
up the components per centroid, and what comes back is one row per centroid.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

WIDTH = 64           # components of a vector that is kept
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
LEADING = 16         # rotated coordinates that are stored
SEED = 3
#: Components beyond this are summed and measured in Python's whole numbers.
SAFE = 1 << 25


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles as whole numbers of any size."""
    if (np.abs(x) < 2.0 ** 40).all():
        return np.floor(x * SCALE).astype(np.int64)           # times a power of two: exact
    return np.array([[int(c) * SCALE if abs(c) >= 2.0 ** 53 else int(np.floor(c * SCALE)) for c in row] for row in x.tolist()], object)


def _packed(v: np.ndarray) -> pa.Array:
    """Rows of whole numbers as bytes: 8 bytes a component, or as text with
    commas (of any other length) where one does not fit."""
    if v.dtype != object:
        return pa.array([r.tobytes() for r in np.ascontiguousarray(v, "<i8")], pa.binary())
    texts = [",".join(map(str, r)).encode() for r in v.tolist()]
    return pa.array([t + b"," if len(t) == 8 * v.shape[1] else t for t in texts], pa.binary())


def _unpacked(col: pa.Array, width: int) -> np.ndarray:
    raw = col.to_pylist()
    if all(len(r) == 8 * width for r in raw):
        return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), width)
    return np.array([np.frombuffer(r, "<i8").tolist() if len(r) == 8 * width else [int(x) for x in r.decode().rstrip(",").split(",")] for r in raw], object)


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _keep(vectors: DataFrame, width: int) -> DataFrame:
    """Rows with exactly ``width`` components, none null or non-finite."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where((F.size("e") == width) & F.coalesce(fine, F.lit(False)))


def _moments(batches):
    """Per task: number of rows, sums and products of the components."""
    n, total, products = 0, 0.0, 0.0
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column("e"))
            n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
    if n:
        yield pa.RecordBatch.from_pydict({"i": list(range(len(total) + 1)), "n": [n] * (len(total) + 1), "x": [total.tolist(), *products.tolist()]})


def rotation(kept: DataFrame, width: int, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, leading principal axes) of all rows, from one pass; what comes
    back is a matrix of ``width`` squared numbers."""
    sums = [F.sum(F.element_at("x", j + 1)).alias(f"x{j}") for j in range(width)]
    rows = kept.select("e").mapInArrow(_moments, "i long, n long, x array<double>").groupBy("i").agg(F.sum("n").alias("n"), *sums).orderBy("i").collect()
    if not rows:
        return np.zeros(width), np.eye(width)[:, :leading]
    m = np.array([[r[f"x{j}"] for j in range(width)] for r in rows])
    mean = m[0] / rows[0]["n"]
    spread = m[1:] / rows[0]["n"] - np.outer(mean, mean)
    if not np.isfinite(spread).all():                         # any axes are right, only slower
        return np.zeros(width), np.eye(width)[:, :leading]
    _, axes = np.linalg.eigh((spread + spread.T) / 2)
    return mean, axes[:, ::-1][:, :leading]


def _turned(v: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates of whole numbers and the residuals' norms."""
    x = v.astype(np.float64) - SCALE * mean
    lead = x @ axes
    rest = x - lead @ axes.T
    return lead, np.sqrt((rest * rest).sum(axis=1))


def _store(mean: np.ndarray, axes: np.ndarray):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = _whole(_matrix(b.column("e")))
            lead, rest = _turned(v, mean, axes)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), _packed(v), pa.array([r.tobytes() for r in lead], pa.binary()), pa.array(rest, pa.float64())],
                                             names=["vec_id", "v", "lead", "rest"])
    return run


def _squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one centroid (or to one each), exact."""
    if v.dtype != object and c.dtype != object and max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < SAFE:
        d = v - c
        return np.einsum("ij,ij->i", d, d)
    d = v.astype(object) - c.astype(object)
    return (d * d).sum(axis=1)


def assign(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, distances measured) of every row;
    of equally near centroids the one with the smaller number."""
    c_lead, c_rest = _turned(centroids, mean, axes)
    bound = (lead * lead).sum(axis=1)[:, None] + (c_lead * c_lead).sum(axis=1) - 2 * lead @ c_lead.T + (rest[:, None] - c_rest) ** 2
    margin = 1e-9 * ((lead * lead).sum(axis=1) + rest * rest + (c_lead * c_lead).sum(axis=1).max() + c_rest.max() ** 2) + 1
    cluster = bound.argmin(axis=1)
    first = cluster.copy()
    best = _squares(v, centroids[cluster])
    measured = len(v)
    for k in range(len(centroids)):
        left = np.flatnonzero((first != k) & ~(bound[:, k] - margin > best.astype(np.float64) * (1 + 1e-12)))
        if len(left):
            measured += len(left)
            d = _squares(v[left], centroids[k])
            if best.dtype != d.dtype:
                best = best.astype(object)
            nearer = (d < best[left]) | ((d == best[left]) & (k < cluster[left]))
            best[left[nearer]], cluster[left[nearer]] = d[nearer], k
    return cluster, best, measured


def _rows(batches, centroids, mean, axes):
    for b in batches:
        if b.num_rows:
            v = _unpacked(b.column("v"), centroids.shape[1])
            lead = np.frombuffer(b"".join(b.column("lead").to_pylist()), np.float64).reshape(len(v), -1)
            yield b, v, *assign(v, lead, b.column("rest").to_numpy(), centroids, mean, axes)[:2]


def _add_up(centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray):
    """Per task and centroid: number of vectors and sums of their components."""
    def run(batches):
        count, total = [0] * len(centroids), [[0] * centroids.shape[1] for _ in centroids]
        for _, v, cluster, _ in _rows(batches, centroids, mean, axes):
            for k in np.unique(cluster).tolist():
                mine = v[cluster == k]
                count[k] += len(mine)
                big = mine.dtype == object or np.abs(mine).max() >= 1 << 40
                total[k] = [a + int(b) for a, b in zip(total[k], (mine.astype(object) if big else mine).sum(axis=0).tolist())]
        yield pa.RecordBatch.from_pydict({"k": list(range(len(count))), "n": count, "total": [[str(x) for x in t] for t in total]})
    return run


def _distances(centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray):
    def run(batches):
        for b, _, cluster, best in _rows(batches, centroids, mean, axes):
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster, pa.int32()), pa.array([int(x) for x in best.tolist()], pa.int64())],
                                             names=["vec_id", "cluster", "distance"])
    return run


def _next_centroids(stored: DataFrame, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Means of the assigned vectors, rounded down; an empty centroid stays."""
    parts = stored.mapInArrow(_add_up(centroids, mean, axes), "k long, n long, total array<string>")
    sums = [F.sum(F.element_at("total", j + 1).cast("decimal(38,0)")).alias(f"x{j}") for j in range(centroids.shape[1])]
    out = centroids.tolist()
    for r in parts.groupBy("k").agg(F.sum("n").alias("n"), *sums).collect():
        if r["n"]:
            out[r["k"]] = [int(r[f"x{j}"]) // r["n"] for j in range(len(out[r["k"]]))]
    return _as_array(out)


def _as_array(rows: list[list[int]]) -> np.ndarray:
    fits = all(abs(x) < 1 << 62 for r in rows for x in r)
    return np.array(rows, np.int64 if fits else object)


def _starts(stored: DataFrame, k: int, width: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes; of rows that share a vec_id
    (and so a hash) the smaller packed components come first."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    rows = stored.select(digest.alias("digest"), "v").orderBy(F.col("digest").asc_nulls_last(), "v").limit(k).collect()
    return _as_array([[int(x) for x in r] for r in _unpacked(pa.array([bytes(r["v"]) for r in rows], pa.binary()), width).tolist()])


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, leading: int = LEADING) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for
    every kept row of ``vectors`` (vec_id, embedding).

    Kept are rows with exactly ``width`` components, none null or non-finite;
    null vectors and others are left out.  Repeated vec_ids are vectors of their
    own; rows with a null vec_id are clustered, but come last as starting
    centroids.  Fewer than ``k`` kept rows are as many centroids.  An empty
    table, or one without a kept row, gives no rows.  Ties go to the smaller
    centroid number.  Components of any finite size are computed exactly;
    distances or sums beyond 64 bits are an error, not a wrong number.  Other
    columns are ignored.  The driver holds ``k`` centroids and the rotation."""
    kept = _keep(vectors, width)
    mean, axes = rotation(kept, width, leading)
    stored = written(kept.mapInArrow(_store(mean, axes), "vec_id long, v binary, lead binary, rest double"), "rotated")
    centroids = _starts(stored, k, width)
    fields = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], fields)
    for _ in range(rounds):
        centroids = _next_centroids(stored, centroids, mean, axes)
    out = written(stored.mapInArrow(_distances(centroids, mean, axes), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    if sum(sums.values()) >= 1 << 63:
        raise OverflowError("the inertia does not fit 64 bits")

    def by_cluster(values: dict):
        return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("cluster"))
    digests = {i: hashlib.sha256(",".join(str(int(x)) for x in centroids[i]).encode()).hexdigest() for i in sums}
    return out.select("vec_id", "cluster", "distance", by_cluster({i: str(d) for i, d in sums.items()}).cast("long").alias("cluster_inertia"),
                      F.lit(sum(sums.values())).cast("long").alias("inertia"), by_cluster(digests).alias("centroid_sha256"))
