"""Prefix trie of conversations with subtree totals by time-forward processing.

A node is a distinct sequence of leading turns.  It is named by its smallest
member conversation and its depth, so the nodes of one conversation are the
lower end of its path, and a parent always stands before its children in the
order (conversation, depth).  Nodes are dealt into shards by ranges of that
order.  Inside a shard they come sorted by reverse level order (Spark's
external sort) and every node sends its totals to its parent through a priority
queue that spills sorted runs; what is addressed to a node of another shard
leaves as one summed message per target.  The messages of the shards form a
much smaller forest, one node per shard and outside target: its totals are
passed on by doubling (after round k a message holds what lies less than
``2**k`` messages below it), so a chain of shards costs logarithmically many
rounds.  A second pass through the shards takes the finished messages in.

No step holds a whole conversation, a whole level or all members of a node:
positions and prefix keys are two-level running sums, members are counted by
partial aggregates, and the list behind ``ends_sha256`` is hashed as a stream
of blobs.  A node's key is its depth and the sum of 128 hash bits of every
(position, turn) on its path.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequence import range_chunks, running_sums
from .storage import written

GROUP = 100          # conversations of one hundred share the first turns of its first one
HEADS = 6            # ... fewer than six of them
QUEUE = 1 << 18      # messages a queue holds in memory
BLOB = 4096          # members joined per blob
SUMS = ["s1", "s2", "s3", "s4"]
KEY = ["depth", *SUMS]
_MESSAGE = struct.Struct("<5q")


class MessageQueue:
    """Priority queue of summed messages, keyed (depth, conversation), taken in
    descending order of keys.  More than ``limit`` keys are spilled as a sorted
    run into an unnamed file of the task, which goes with it."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.sums, self.heads = limit, {}, []

    def add(self, key: tuple[int, int], children: int, leaves: int, saved: int) -> None:
        have = self.sums.get(key)
        if have is None:
            if len(self.sums) >= self.limit:
                self._spill()
            self.sums[key] = [children, leaves, saved]
        else:
            have[0] += children
            have[1] += leaves
            have[2] += saved

    def _spill(self) -> None:
        run = tempfile.TemporaryFile()
        for key in sorted(self.sums, reverse=True):
            run.write(_MESSAGE.pack(*key, *self.sums[key]))
        self.sums = {}
        run.seek(0)
        self._next(run)

    def _next(self, run) -> None:
        got = run.read(_MESSAGE.size)
        if got:
            m = _MESSAGE.unpack(got)
            heapq.heappush(self.heads, ((-m[0], -m[1]), id(run), m[2:], run))
        else:
            run.close()

    def take(self, key: tuple[int, int]) -> list[int]:
        """Sum of the messages to ``key`` (zeros if there are none)."""
        total = self.sums.pop(key, None) or [0, 0, 0]
        at = (-key[0], -key[1])
        while self.heads and self.heads[0][0] == at:
            _, _, m, run = heapq.heappop(self.heads)
            total = [a + b for a, b in zip(total, m)]
            self._next(run)
        return total


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): every turn of the rebuilt conversations with its
    depth, and one row per conversation with its length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.length(text).cast("long").alias("size"))
    order = ["turn", "role", "digest"]
    rows = range_chunks(rows, ["conv_id"], order, "part")
    head, base = F.crc32(F.col("conv_id").cast("string")) % HEADS, F.col("conv_id") - F.col("conv_id") % GROUP
    w = Window.partitionBy("conv_id").orderBy("part")
    parts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("n", F.sum("n").over(Window.partitionBy("conv_id"))).withColumn("head", head).withColumn("base", base)
    first = parts.where("conv_id = base").groupBy(F.col("conv_id").alias("base")).agg(F.max("n").alias("base_n"))
    parts = parts.join(first, "base", "left") \
        .withColumn("shared", F.least("head", F.coalesce("base_n", F.lit(0)))) \
        .withColumn("length", F.col("shared") + F.greatest(F.col("n") - F.col("head"), F.lit(0))) \
        .select("conv_id", "part", "before", "base", "head", "shared", "length")
    parts = written(parts, "trie-parts")
    at = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    placed = written(rows.withColumn("at", at).join(parts, ["conv_id", "part"])
                     .select("conv_id", "part", (F.col("before") + F.col("at")).alias("pos"), "base", "head", "shared", "length", "digest", "size"), "trie-rows")
    convs = parts.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in ("base", "shared", "length")])
    own = placed.where("pos > head").select("conv_id", "part", (F.col("pos") - F.col("head") + F.col("shared")).alias("depth"), "length", "digest", "size")
    lent = placed.where(f"conv_id = base and pos < {HEADS}").select("base", F.col("pos").alias("depth"), "digest", "size")
    heads = convs.join(lent, "base").where("depth <= shared").select("conv_id", F.lit(-1).alias("part"), "depth", "length", "digest", "size")
    return own.unionByName(heads), convs


def _table(columns: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(columns, map(list, zip(*rows)))))


def _blobs(batches):
    """Members of a node in order -> their decimal ids joined, BLOB at a time."""
    names, key, ids, done = [*KEY, "first", "ids"], None, [], []
    for b in batches:
        for *k, c in zip(*[b.column(x).to_pylist() for x in [*KEY, "conv_id"]]):
            if k != key or len(ids) == BLOB:
                if ids:
                    done.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = k, []
            ids.append(c)
        if done:
            yield _table(names, done)
            done = []
    if ids:
        yield _table(names, [(*key, ids[0], ",".join(map(str, ids)))])


def _hashes(batches):
    """Blobs of a node in order -> one row per node with the hash of them all."""
    names, key, state, done = [*KEY, "ends_sha256"], None, None, []
    for b in batches:
        for *k, ids in zip(*[b.column(x).to_pylist() for x in [*KEY, "ids"]]):
            if k != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield _table(names, done)
            done = []
    if key is not None:
        yield _table(names, [(*key, state.hexdigest())])


def _nodes(conversations: DataFrame) -> DataFrame:
    """One row per node: its name, parent's conversation and own counts."""
    turns, convs = _rebuilt(conversations)
    hashes = [F.xxhash64(F.lit(salt), F.col("depth"), F.col("digest")) for salt in (1, 2)]
    bits = {s: half for s, half in zip(SUMS, (x for h in hashes for x in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))))}
    turns = turns.select("*", *[x.alias("p" + s) for s, x in bits.items()])
    turns = running_sums(turns, ["conv_id"], ["depth"], {s: F.col("p" + s) for s in SUMS}, chunk=F.col("part"))
    turns = written(turns.select("conv_id", F.col("depth").cast("long").alias("depth"), (F.col("depth") == F.col("length")).alias("end"), "size",
                                 *SUMS, *[(F.col(s) - F.col("p" + s)).alias("u" + s) for s in SUMS]), "trie-turns")
    ends = turns.where("end").select(*KEY, "conv_id") \
        .unionByName(convs.where("length = 0").select(*[F.lit(0).cast("long").alias(k) for k in KEY], "conv_id"))
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ", ".join(f"{k} long" for k in KEY)
    blobs = ends.repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_blobs, keys + ", first long, ids string")
    hashed = blobs.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashes, keys + ", ends_sha256 string")
    up = F.struct((F.col("depth") - 1).alias("depth"), *[F.col("u" + s).alias(s) for s in SUMS])
    inner = turns.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("end").cast("long")).alias("n_ends"),
                                    F.max("size").alias("size"), F.any_value(up).alias("up"))
    root = convs.groupBy().agg(*[F.lit(0).cast("long").alias(k) for k in KEY], F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                               F.sum((F.col("length") == 0).cast("long")).alias("n_ends"), F.lit(0).cast("long").alias("size")).where("conv_id is not null") \
        .withColumn("up", F.lit(None).cast(f"struct<{', '.join(k + ': bigint' for k in KEY)}>"))
    nodes = written(inner.unionByName(root).join(hashed, KEY, "left"), "trie-nodes")
    # only the top of a conversation's own nodes has another conversation's node as
    # parent; below the root that one is looked up by its key
    smallest = nodes.where("depth = 0").agg(F.min("conv_id")).first()[0]
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("depth"), F.min_by("up", "depth").alias("up")).where("depth > 1") \
        .select("conv_id", "depth", *[F.col("up." + k).alias("k_" + k) for k in KEY])
    names = nodes.select(*[F.col(k).alias("k_" + k) for k in KEY], F.col("conv_id").alias("above"))
    found = tops.join(names.hint("merge"), ["k_" + k for k in KEY]).select("conv_id", "depth", "above")
    parent = F.when(F.col("depth") == 1, F.lit(smallest).cast("long")).when(F.col("depth") > 1, F.coalesce("above", "conv_id"))
    return nodes.join(found, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", (F.col("n_ends") == F.col("n_convs")).alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


_COLUMNS = ["shard", "depth", "conv_id", "parent_conv_id", "leaf", "saved"]


_SENT = ["shard", "label", "home", "conv_id", "to_conv", "to_depth", "children", "leaves", "saved"]


def _send(bounds: list, limit: int):
    """First pass over shards in reverse level order: the summed messages to
    nodes of other shards (``label`` false, ``home`` is the target's shard), and
    for every conversation of the shard the outside node that its nodes' totals
    end up at (``label`` true; none for the root's)."""
    homes = [s for s, b in enumerate(bounds) if b]
    starts = [bounds[s] for s in homes]

    def run(batches):
        shard, queue, out, above, low = None, None, {}, {}, None

        def finish():
            rows = [(shard, False, homes[bisect_right(starts, target) - 1], None, *target, *sums) for target, sums in out.items()]
            ends: dict[int, tuple | None] = {}
            for conv in sorted(above):                # a conversation's parent comes before it
                up = above[conv]
                ends[conv] = up if not isinstance(up, int) else ends[up]
                rows.append((shard, True, None, conv, *(ends[conv] or (None, None)), 0, 0, 0))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                zip(*rows), [pa.int32(), pa.bool_(), pa.int32(), *[pa.int64()] * 6])], names=_SENT)
        for b in batches:
            for s, d, c, p, leaf, own in zip(*[b.column(x).to_pylist() for x in _COLUMNS]):
                if s != shard:
                    if shard is not None:
                        yield finish()
                    shard, queue, out, above, low = s, MessageQueue(limit), {}, {}, bounds[s]
                _, leaves, saved = queue.take((d, c))
                leaves, saved = leaves + leaf, saved + own
                if p is None:
                    above[c] = None
                elif (p, d - 1) >= low:
                    queue.add((d - 1, p), 1, leaves, saved)
                    if p != c:
                        above[c] = p
                else:
                    have = out.setdefault((p, d - 1), [0, 0, 0])
                    for i, x in enumerate((1, leaves, saved)):
                        have[i] += x
                    above[c] = (p, d - 1)
        if shard is not None:
            yield finish()
    return run


def _receive(bounds: list, limit: int):
    """Second pass: whole totals of every node.  Rows without ``leaf`` are the
    finished messages from other shards; they precede their node."""
    def run(batches):
        shard, queue = None, None
        for b in batches:
            counts = []
            for s, d, c, p, leaf, own, inside, more in zip(*[b.column(x).to_pylist() for x in [*_COLUMNS, "children", "leaves"]]):
                if s != shard:
                    shard, queue = s, MessageQueue(limit)
                if leaf is None:
                    queue.add((d, c), inside, more, own)
                    counts.append((0, 0, 0))
                    continue
                children, leaves, saved = queue.take((d, c))
                leaves, saved = leaves + leaf, saved + own
                if p is not None and (p, d - 1) >= bounds[s]:
                    queue.add((d - 1, p), 1, leaves, saved)
                counts.append((children, leaves, saved))
            node = b.column("leaf").is_valid()
            kept = [b.column(x) for x in ("conv_id", "depth", "parent_conv_id", "n_convs")]
            sums = [pa.array(x, pa.int64()) for x in (zip(*counts) if counts else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([*kept, *sums, b.column("ends_sha256")], names=[
                "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]).filter(node)
    return run


def _pass_on(messages: DataFrame) -> DataFrame:
    """Whole totals of the shards' messages (shard, to_conv, to_depth; children,
    leaves, saved; up_*: the message that this one is part of, or nulls)."""
    name, up = ["shard", "to_conv", "to_depth"], ["up_shard", "up_conv", "up_depth"]
    while messages.where("up_conv is not null").limit(1).count():
        below = messages.where("up_conv is not null").groupBy(*[F.col(u).alias(n) for u, n in zip(up, name)]) \
            .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        next_up = messages.select(*[F.col(n).alias(u) for u, n in zip(up, name)], *[F.col(u).alias("next_" + u) for u in up])
        messages = written(messages.join(below, name, "left").join(next_up, up, "left").select(
            *name, "home", *[F.col("next_" + u).alias(u) for u in up], "children",
            *[(F.col(c) + F.coalesce("more_" + c, F.lit(0))).alias(c) for c in ("leaves", "saved")]), "trie-messages")
    return messages


def prefix_trie(conversations: DataFrame, shards: int | None = None, queue: int = QUEUE) -> DataFrame:
    """One row per trie node of the rebuilt conversations: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null role and text are empty; a null turn comes first.  Turns of equal
    number are ordered by role, then by the hash of role and text; repeated rows
    are repeated turns.  Rows without conv_id belong to no conversation and are
    left out.  ``conv_id % 100`` is SQL's remainder (the sign of conv_id).
    Texts are only hashed and measured, so their length does not matter.  An
    empty table has no nodes, not even the root.  Other columns are ignored.
    ``shards`` is the number of shards (the session's shuffle partitions);
    their first nodes, one pair of numbers each, are what the driver holds."""
    spark = conversations.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = _nodes(conversations).repartitionByRange(n, "conv_id", "depth").withColumn("shard", F.spark_partition_id())
    nodes = written(nodes, "trie-shards")
    low = nodes.groupBy("shard").agg(F.min(F.struct("conv_id", "depth")).alias("low")).orderBy("shard").collect()
    count = max((r["shard"] for r in low), default=-1) + 1
    bounds: list = [None] * count
    for r in low:
        bounds[r["shard"]] = (r["low"]["conv_id"], r["low"]["depth"])
    order = ["shard", F.desc("depth"), F.desc("conv_id")]
    sent = written(nodes.select(*_COLUMNS).repartition(n, "shard").sortWithinPartitions(*order).mapInArrow(
        _send(bounds, queue), "shard int, label boolean, home int, conv_id long, to_conv long, to_depth long, children long, leaves long, saved long"), "trie-sent")
    labels = sent.where("label").select(F.col("shard").alias("home"), F.col("conv_id").alias("to_conv"), F.col("to_conv").alias("up_conv"), F.col("to_depth").alias("up_depth"))
    messages = sent.where("not label").drop("label", "conv_id").join(labels, ["home", "to_conv"], "left")
    done = _pass_on(written(messages.withColumn("up_shard", F.when(F.col("up_conv").isNotNull(), F.col("home"))), "trie-messages"))
    inject = done.groupBy(F.col("home").alias("shard"), F.col("to_depth").alias("depth"), F.col("to_conv").alias("conv_id")) \
        .agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
    both = nodes.unionByName(inject, allowMissingColumns=True)
    return both.repartition(n, "shard").sortWithinPartitions(*order, F.col("leaf").asc_nulls_first()).mapInArrow(
        _receive(bounds, queue), "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
