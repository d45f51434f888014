"""Connected components by contraction: every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, drop

#: Edges that one task joins by union-find: 1 MB of them, whatever the input.
LOCAL = 1 << 16


def _join(batches):
    """At most LOCAL edges to (a, to): each node and the least node of its component."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "to"])


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(a, b) longs to (node, root), one row a node that has an edge to another; nodes of a component share their root.

    Each round, every node points to the neighbour of least hash if that is under its own, and the
    edges move to the nodes pointed to. The hash is salted by round, so chains shrink by a constant
    factor whatever their order; rounds grow with the logarithm of the largest component. Counts
    per node are combined before the shuffle, and moving edges is a plain join, so a node with
    many edges is no hot task. Once LOCAL edges or fewer are left, one task joins them, which saves
    the long tail of rounds over hardly any edges. Self-loops and repeated edges are ignored; no
    edges: no rows.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    maps = []
    while left := e.count():
        if left <= local:
            maps.append(cut(e.repartition(1).mapInArrow(_join, "a long, to long"), "map"))
            break
        rank = lambda c, k=len(maps): F.xxhash64(F.lit(k), F.col(c))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("h"), F.col("b").alias("to"))).alias("m"))
        to = cut(best.select("a", F.when(F.col("m.h") < rank("a"), F.col("m.to")).otherwise(F.col("a")).alias("to")), "map")
        maps.append(to)
        moved = e.join(to.withColumnRenamed("to", "ta"), "a").join(to.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
        nxt = cut(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b").distinct(), "edges")
        drop(e)
        e = nxt
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for m in maps[1:]:
        step = m.select(F.col("a").alias("root"), F.col("to").alias("_to"))
        out = out.join(step, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return cut(out, "components")
