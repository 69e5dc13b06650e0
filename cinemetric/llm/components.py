"""Connected components of a link table: union-find inside each partition,
then hooking to the smallest neighbour and pointer jumping between them.

Neither links nor components are collected.  The partition-local union-find
turns the links of a partition into a star per local component; every round
hooks each remaining node to its smallest neighbour (a grouped minimum with
partial aggregation, so a hub is no hot task), follows the hooks to their roots
and contracts the links.  A round at least halves the nodes that still have
links, so the number of rounds is logarithmic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def local_union_find(batches):
    """Star links (root, node) equivalent to the partition's links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            ra, rb = find(a), find(b)
            parent.setdefault(ra, ra)
            parent.setdefault(rb, rb)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    roots = [find(x) for x in nodes]
    out = pd.DataFrame({"a": np.array(roots, np.int64), "b": np.array(nodes, np.int64)})
    yield out[out["a"] != out["b"]]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``: root is the smallest node that
    can be reached.  Links with a null end or equal ends are ignored."""
    e = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    e = written(e.mapInPandas(local_union_find, "a long, b long").distinct(), "links")
    labels = None
    while True:
        ends = e.union(e.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
        hooks = written(ends.select(F.col("a").alias("x"), F.least("a", "b").alias("p")), "hooks")
        while True:                              # follow hooks to the roots
            up = hooks.select(F.col("x").alias("p"), F.col("p").alias("p2"))
            hooks = written(hooks.join(up, "p").select("x", F.col("p2").alias("p"), (F.col("p2") != F.col("p")).alias("moved")), "hooks")
            if hooks.where("moved").limit(1).count() == 0:
                break
            hooks = hooks.drop("moved")
        hooks = hooks.drop("moved")
        if labels is None:
            labels = hooks.select(F.col("x").alias("node"), F.col("p").alias("root"))
        else:
            up = hooks.select(F.col("x").alias("root"), F.col("p").alias("top"))
            labels = written(labels.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        up = hooks.select("x", "p")
        e = (e.join(up.withColumnsRenamed({"x": "a", "p": "ra"}), "a").join(up.withColumnsRenamed({"x": "b", "p": "rb"}), "b")
             .where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        e = written(e, "links")
        if e.limit(1).count() == 0:
            return labels
