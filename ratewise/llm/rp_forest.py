"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample; their depth grows with the number of vectors, so that a leaf holds about LEAF of
them, and every vector is put into one leaf of each tree. A query walks all trees through one priority queue: the branch
that lies least far on the wrong side of its splits (sum of squares) comes next, whichever tree it is in, until the
query's budget of leaves is spent. The budget grows with the 2/3 power of a tree's leaves, so the share of the vectors that
a query meets falls as they grow. The candidates of those leaves are ranked by their exact cosine. Equal vectors are one
candidate with its smallest ids, so that copies fill no leaf.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.llm import common

#: Vectors that the trees are fitted on, about.
SAMPLE = 100_000
TREES = 8
#: Vectors of a leaf, about.
LEAF = 128
#: Depth of a tree, at most: the sample must reach every leaf; beyond 2**MOST_DEPTH * LEAF vectors, leaves grow.
MOST_DEPTH = 12
#: Leaves that a query searches, over all trees: this times the 2/3 power of a tree's leaves.
REACH = 4.4
#: Vectors that one task group holds, about.
BLOCK = 4096


@dataclass(frozen=True)
class Forest:
    directions: np.ndarray  # trees, 2**depth - 1, dimensions
    splits: np.ndarray  # trees, 2**depth - 1

    @property
    def leaves(self) -> int:
        return self.splits.shape[1] + 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in each tree."""
        out = np.zeros((len(x), len(self.splits)), np.int64)
        for t in range(len(self.splits)):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < self.splits.shape[1]:
                side = np.einsum("ij,ij->i", x, self.directions[t][node]) > self.splits[t][node]
                node = 2 * node + 1 + side
            out[:, t] = node - self.splits.shape[1]
        return out

    def search(self, q: np.ndarray, budget: int) -> list[tuple[int, int]]:
        """The first budget leaves (tree, leaf) that the shared queue reaches from q."""
        margins = self.directions @ q - self.splits
        inner, out = self.splits.shape[1], []
        queue = [(0.0, t, 0) for t in range(len(self.splits))]
        while queue and len(out) < budget:
            off, t, node = heapq.heappop(queue)
            if node >= inner:
                out.append((t, node - inner))
                continue
            m = margins[t, node]
            heapq.heappush(queue, (off, t, 2 * node + 1 + int(m > 0)))
            heapq.heappush(queue, (off + m * m, t, 2 * node + 2 - int(m > 0)))
        return out


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_forest(x: np.ndarray, trees: int, depth: int, seed: int = 13) -> Forest:
    """Random directions, split at the median of the rows of x that reach the node."""
    rng = np.random.default_rng(seed)
    inner = (1 << depth) - 1
    directions = rng.standard_normal((trees, inner, x.shape[1]))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    splits = np.zeros((trees, inner))
    for t in range(trees):
        rows = {0: np.arange(len(x))}
        for node in range(inner):
            at = rows.pop(node)
            p = x[at] @ directions[t, node]
            splits[t, node] = np.median(p) if len(p) else 0.0
            rows[2 * node + 1], rows[2 * node + 2] = at[p <= splits[t, node]], at[p > splits[t, node]]
    return Forest(directions, splits)


def neighbours(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, reach: float = REACH, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, its k nearest rows found by cosine.

    Ties go to the smaller id. Vectors that are null, empty, zero, or hold null or non-finite components take no part,
    nor do vectors whose length is not the most common one (they have no cosine with the others), nor null ids. Rows that repeat an id with another
    vector are rows of their own. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kind = vectors.select(vector_col).schema[0].dataType.simpleString() if vectors.columns.count(vector_col) == 1 else ""
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].cast(kind).alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    schema = "query_id long, rank int, vec_id long, score double"
    common_size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common_size is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == common_size["d"]).withColumn("key", F.xxhash64("v"))
    # the k + 1 smallest ids of each distinct vector can be among some query's k nearest; no others can
    first = F.row_number().over(Window.partitionBy("v", "key").orderBy("vec_id"))
    held = rows.withColumn("r", first).filter(F.col("r") <= k + 1)
    unique = common.staged(held.groupBy("key", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct-vectors")
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("key").alias("qkey"))
    queries = common.staged(queries, "query-ids")

    distinct = max(1, unique.count())
    drawn = unique.filter(common.seeded_unit(17, F.col("key")) < min(1.0, sample / distinct)).select("key", "v").orderBy("key").toPandas()  # about sample rows
    if drawn.empty:
        drawn = unique.select("key", "v").orderBy("key").limit(1).toPandas()
    depth = min(MOST_DEPTH, max(0, int(np.ceil(np.log2(distinct / leaf)))))
    forest = fit_forest(unit(drawn["v"]), trees, depth)
    shared = spark.sparkContext.broadcast(forest)  # at most trees * 2**MOST_DEPTH directions
    budget = min(trees * forest.leaves, max(trees, int(np.ceil(reach * forest.leaves ** (2 / 3)))))
    each = max(1, BLOCK // leaf)  # leaves of a part

    def placed(it):
        for pdf in it:
            at = shared.value.leaf_of(unit(pdf["v"])) if len(pdf) else np.zeros((0, trees), np.int64)
            for t in range(at.shape[1]):
                yield pd.DataFrame({"tree": t, "part": at[:, t] // each, "leaf": at[:, t], "key": pdf["key"], "v": pdf["v"], "ids": pdf["ids"]})

    def probed(it):
        for pdf in it:
            out = []
            for key, v, q in zip(pdf["key"], pdf["v"], unit(pdf["v"]) if len(pdf) else [], strict=True):
                parts: dict[tuple[int, int], list[int]] = {}
                for t, at in shared.value.search(q, budget):
                    parts.setdefault((t, at // each), []).append(at)
                out += [(t, part, leaves, key, v) for (t, part), leaves in parts.items()]
            yield pd.DataFrame(out, columns=["tree", "part", "leaves", "qkey", "v"])

    def sliced(df: DataFrame, key: str, mine: str) -> tuple[DataFrame, DataFrame]:
        """A part's rows in slices of about BLOCK; a part has more than one where its leaves are larger than fitted."""
        n = df.groupBy("tree", "part").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias(f"n_{mine}"))
        return df.join(F.broadcast(n), ["tree", "part"]).withColumn(mine, F.pmod(F.xxhash64(key), F.col(f"n_{mine}")).cast("int")).drop(f"n_{mine}"), n

    members = common.staged(unique.mapInPandas(placed, f"tree int, part int, leaf int, key long, v {kind}, ids array<long>"), "leaf-members")
    asked = unique.join(queries.select(F.col("qkey").alias("key")).distinct(), "key", "left_semi").select("key", "v")
    probes = common.staged(asked.mapInPandas(probed, f"tree int, part int, leaves array<int>, qkey long, v {kind}"), "leaf-probes")
    members, n_members = sliced(members, "key", "m")
    probes, n_probes = sliced(probes, "qkey", "p")
    # at most trees * 2**MOST_DEPTH rows each: every slice of a part's queries meets every slice of its vectors
    members = members.join(F.broadcast(n_probes), ["tree", "part"]).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n_p") - 1))).drop("n_p")
    probes = probes.join(F.broadcast(n_members), ["tree", "part"]).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("n_m") - 1))).drop("n_m")

    def ranked(probe: pd.DataFrame, member: pd.DataFrame) -> pd.DataFrame:
        """Of each query, the nearest vectors of the leaves that it searches here."""
        found: dict[int, list[np.ndarray]] = {}
        out = []
        if len(probe) and len(member):
            member = member.sort_values("leaf", kind="stable")
            x, q, keys, ids = unit(member["v"]), unit(probe["v"]), member["key"].to_numpy(), member["ids"].to_list()
            first_ids, leaf_at = np.array([i[0] for i in ids]), member["leaf"].to_numpy()
            of_leaf: dict[int, list[int]] = {}
            for i, leaves in enumerate(probe["leaves"]):
                for at in leaves:
                    of_leaf.setdefault(int(at), []).append(i)
            for at, mine in of_leaf.items():
                a, b = np.searchsorted(leaf_at, [at, at + 1])
                take = min(b - a, k + 1)
                for c in range(0, len(mine) if take else 0, 256):
                    near = q[mine[c : c + 256]] @ x[a:b].T
                    least = np.partition(near, b - a - take, axis=1)[:, b - a - take]
                    for i, row, low in zip(mine[c : c + 256], near, least, strict=True):
                        found.setdefault(i, []).append(a + np.flatnonzero(row >= low - 1e-12))
            qkeys = probe["qkey"].to_numpy()
            for i, places in found.items():
                at = np.concatenate(places)
                exact = (x[at] * q[i]).sum(1)
                for j in np.lexsort((first_ids[at], -exact))[: k + 1]:
                    out.append((qkeys[i], keys[at[j]], float(exact[j]), ids[at[j]]))
        return pd.DataFrame(out, columns=["qkey", "key", "score", "ids"])

    at = ["tree", "part", "m", "p"]
    near = probes.groupBy(*at).cogroup(members.groupBy(*at)).applyInPandas(ranked, "qkey long, key long, score double, ids array<long>")
    near = near.dropDuplicates(["qkey", "key"])
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), F.col("ids")[0]))).filter(F.col("r") <= k + 1)
    best = common.staged(best.select("qkey", "score", F.explode("ids").alias("vec_id")), "leaf-nearest")
    met = queries.join(best, "qkey").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
