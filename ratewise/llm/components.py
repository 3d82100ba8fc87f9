"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm import common


#: Nodes that a task holds before it hands their edges on.
HELD = 500_000


def _forest(batches):
    """Of a partition's edges, one edge from each node to the smallest node that this partition ties it to, in portions of HELD nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def found():
        rows = [(x, r) for x in parent if (r := root(x)) != x]
        parent.clear()
        for i in range(0, len(rows), 10_000):
            part = rows[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield from found()
    yield from found()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it is tied to) for every node of edges (a, b), longs without nulls.

    Nodes without an edge to another node are left out. A round ties every node's larger neighbours to its smallest
    one, then the same for its smaller ones; it ends when every edge leads to its component's smallest node.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = common.staged(edges.mapInArrow(_forest, "a long, b long").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = common.staged(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        tied = large.join(least, F.col("a") == F.col("u"))
        small = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(tied.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = common.staged(small, "edges")
        # done: every node has one edge, and no node that an edge leads to has one of its own
        if edges.groupBy("a").count().filter("count > 1").isEmpty() and edges.join(edges.select(F.col("a").alias("x")), F.col("b") == F.col("x"), "left_semi").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
