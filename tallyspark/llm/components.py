"""Connected components of an edge table, by distributed union of roots.

Every round hooks each root to its smallest neighbour, shortens the chains by pointer jumping, and
replaces the ends of all edges by their roots; each round is saved to the checkpoint folder and its
tables go once the next one has read them. A root has at least one edge, so at least half the roots go
in a round. When at most FEW_EDGES edges are left, counted, one task unites their ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, hinted, saved

#: Edges (32 bytes each with 128-bit nodes) that one task unites.
FEW_EDGES = 100_000


def _united(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) of one partition to (node, to): the smallest node that each is connected with."""
    root: dict = {}
    schema = None

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in rows:
        schema = batch.schema
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(a) if a in root else root.setdefault(a, a), find(b) if b in root else root.setdefault(b, b)
            root[max(x, y)] = min(x, y)
    if schema is not None:
        kind = schema.field("a").type
        yield pa.RecordBatch.from_arrays([pa.array(list(root), kind), pa.array([find(x) for x in root], kind)], ["node", "to"])


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), saved; root is the smallest node of the component."""
    live = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    kind = live.schema["a"].dataType.simpleString()
    labels, ended = None, False
    while not ended:
        ended = live.limit(few + 1).count() <= few
        if ended:
            hook = saved(live.coalesce(1).mapInArrow(_united, f"node {kind}, to {kind}"))
        else:
            both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
            hook = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")))
            while True:
                step = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
                jumped = saved(hook.join(step, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
                drop(hook)
                hook = jumped
                if jumped.where("moved").isEmpty():
                    break
        old = labels
        if labels is None:
            labels = saved(hook.select("node", F.col("to").alias("root")))
        else:
            up = hinted(hook.select(F.col("node").alias("root"), "to"), few)
            labels = saved(labels.join(up, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
            drop(old)
        if not ended:
            ends = live.join(hook.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(hook.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            rest = saved(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
            drop(live)
            live = rest
        drop(hook)
    drop(live)
    return labels
