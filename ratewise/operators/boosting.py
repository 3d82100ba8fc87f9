"""Boosted trees from gradient histograms, grown leaf by leaf or level by level, and what each feature adds to their score.

Features are cut into quantile bins once; rows lie in blocks of arrays (bins, labels, margins), and those of a tree's sample in
blocks of bins and gradients, so that a pass costs what the sums cost. A pass is a job of one stage: each task sums the
gradients by (node, feature, bin), and the tasks' sums are added up, of many tasks in two steps, on the driver: nodes times
bins values, whatever the table. Of two children only the one with fewer rows is summed; the other's sums are the
difference. Once all nodes that may be split have few rows, one job sends the rows of each to a task that goes on alone.
Growth is best first: a pass computes the children of all leaves that may still be split within the budget,
and the order of the splits is then replayed with what is known, so a tree takes about as many passes as it is deep. Rows
of the validation flag stop the rounds; a row's part in a tree's sample follows from a hash, so lost executors compute the
same again.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.functions.features import finite_or_zero
from ratewise.sources import tables


@dataclass(frozen=True)
class Settings:
    """rounds, learning rate; leaves of a tree (None: any) and depth (None: any); rows and hessian of a leaf at least; shares of rows and features of a tree; L1 and L2 weights; gain of a split at least; bins; rounds without a better validation loss before the end."""

    rounds: int = 1000
    rate: float = 0.05
    leaves: int | None = 31
    depth: int | None = None
    least_rows: int = 500
    least_weight: float = 1e-3
    row_share: float = 0.8
    column_share: float = 0.8
    l1: float = 0.0
    l2: float = 1.0
    least_gain: float = 0.0
    bins: int = 255
    patience: int = 50
    seed: int = 42


#: The two baseline settings.
LEAF_WISE = Settings()
DEPTH_WISE = Settings(rounds=1500, leaves=None, depth=6, least_rows=1, least_weight=10.0, bins=256)


@dataclass
class Tree:
    """Nodes as lists, the root first: feature (-1: a leaf), cut (largest bin that goes left), threshold (its value), children, value, rows, gain."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def values(self, x: np.ndarray, limits: list) -> np.ndarray:
        """The value of the leaf of each row, with limits (cut for bins, threshold for values) deciding the way."""
        out = np.empty(len(x))
        for at, rows in _leaves(self.feature, limits, self.left, self.right, x):
            out[rows] = self.value[at]
        return out


def _leaves(feature, limits, left, right, x: np.ndarray):
    """(leaf, its rows) for every leaf that has rows."""
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if feature[at] < 0:
            yield at, rows
            continue
        goes = x[:, feature[at]][rows] <= limits[at]
        for child, part in ((left[at], rows[goes]), (right[at], rows[~goes])):
            if len(part):
                todo.append((child, part))


@dataclass
class Boosted:
    """A fitted model: features in order, log-odds before any tree, trees up to the best round, and the validation losses."""

    features: list[str]
    base: float
    trees: list[Tree]
    losses: list[float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.values(x, t.threshold)
        return out

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "base": self.base, "losses": self.losses, "trees": [asdict(t) for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Boosted:
        m = json.loads(text)
        return Boosted(m["features"], m["base"], [Tree(**t) for t in m["trees"]], m["losses"])


def save(spark: SparkSession, model: Boosted, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Boosted:
    return Boosted.from_json(spark.read.text(path, wholetext=True).filter("length(value) > 0").first()[0])


def _values(features: list[str]) -> list:
    return [finite_or_zero(F.col(c).cast("double")) for c in features]


#: Rows of a block as it is dealt to a task, and, but for the last, of those that a task joins them to.
BLOCK, JOINED = 4_096, 262_144


def _block(rows: pa.Table, n: int, edges: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (features, label, flag, key) as one row of four binaries: a byte for each feature's bin, feature after feature, then labels, flags and keys."""
    x = np.column_stack([np.asarray(rows.column(i)) for i in range(n)]).reshape(-1, n)
    codes = np.empty((n, len(x)), np.uint8)
    for i in range(n):
        codes[i] = np.searchsorted(edges[i], x[:, i], "left")
    parts = [codes, *[np.asarray(rows.column(n + i)).astype(kind) for i, kind in enumerate((float, np.bool_, np.int64))]]
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in parts], ["x", "y", "valid", "key"])


@dataclass
class Prepared:
    """Rows cut into bins once, for any number of fits: an RDD of blocks (bins, labels, flags, keys, margins), held by Spark; edges of the bins; share of the label 1 among the training rows; whether rows are marked to judge by; bins asked for. Without a training row of each class there are no blocks."""

    spark: SparkSession
    features: list[str]
    edges: list[np.ndarray]
    rate: float | None
    blocks: RDD | None
    judged: bool
    bins: int

    def release(self) -> None:
        if self.blocks is not None:
            self.blocks.unpersist()


def prepare(df: DataFrame, features: list[str], label: str = "click", valid_flag: str | None = None, bins: int = 255, id_col: str | None = None) -> Prepared:
    """The rows of df for fit_prepared. df is computed once: its features are held until the blocks stand.

    For each feature the edges are the distinct values at bins - 1 even shares of the training rows; a row's bin is the
    number of edges below its value. Blocks are dealt evenly, so that every task of a pass has as much to do as the
    others, however few files or partitions df has.
    """
    n, spark, names = len(features), df.sparkSession, [f"f{i}" for i in range(len(features))]
    key = F.xxhash64(*([id_col] if id_col else features))
    valid = F.coalesce(F.col(valid_flag), F.lit(False)) if valid_flag else F.lit(False)
    rows = df.dropna(subset=[label]).select(*[v.alias(f) for v, f in zip(_values(features), names, strict=True)], F.col(label).cast("double").alias("y"), valid.alias("valid"), key.alias("key"))
    held = not df.storageLevel.useMemory
    rows = rows.persist() if held else rows
    try:
        shares, train = [i / bins for i in range(1, bins)], ~F.col("valid")
        met = rows.agg(F.avg(F.when(train, F.col("y"))).alias("rate"), *[F.percentile_approx(F.when(train, F.col(f)), shares, 100 * bins).alias(f) for f in names]).first()
        rate = met["rate"]
        if rate is None or not 0 < rate < 1:
            return Prepared(spark, features, [], rate, None, valid_flag is not None, bins)
        edges = [np.unique(np.array(met[f] or [0.0])) for f in names]

        def pack(batches):
            for b in batches:
                for start in range(0, b.num_rows, BLOCK):
                    yield _block(pa.Table.from_batches([b.slice(start, BLOCK)]), n, edges)

        base = math.log(rate / (1 - rate))

        def joined(some):
            x, *rest = zip(*some, strict=True)
            x, (y, valid, key) = np.concatenate(x, axis=1), map(np.concatenate, rest)
            return x, y, valid, key, np.full(len(y), base)

        def read(rows):
            some, count = [], 0
            for r in rows:
                some.append((np.frombuffer(r["x"], np.uint8).reshape(n, -1), np.frombuffer(r["y"]), np.frombuffer(r["valid"], np.bool_), np.frombuffer(r["key"], np.int64)))
                count += len(some[-1][1])
                if count >= JOINED:
                    yield joined(some)
                    some, count = [], 0
            if some:
                yield joined(some)

        parts = spark.sparkContext.defaultParallelism
        blocks = rows.mapInArrow(pack, "x binary, y binary, valid binary, key binary").repartition(parts).rdd.mapPartitions(read).persist(StorageLevel.MEMORY_AND_DISK)
        blocks.count()
        return Prepared(spark, features, edges, rate, blocks, valid_flag is not None, bins)
    finally:
        if held:
            rows.unpersist()


def _with_margin(blocks: RDD, trees: list[Tree]) -> RDD:
    def moved(block):
        x, y, valid, key, margin = block
        return x, y, valid, key, margin + sum(t.values(x.T, t.cut) for t in trees)

    return blocks.map(moved)


def _drawn(key: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Which rows are in a tree's sample: a hash of the row's key, the seed and the tree's number."""
    with np.errstate(over="ignore"):
        h = key.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xD6E8FEB86659FD93) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(11)).astype(float) * 2.0**-53 < share


def _soft(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _worth(g, h, s: Settings):
    return _soft(g, s.l1) ** 2 / (h + s.l2)


class _Cutter:
    """A tree's features and where the bins of each lie in a node's sums, [gradient, hessian, rows] x bins of all its features."""

    def __init__(self, columns: list[int], edges: list[np.ndarray], s: Settings):
        self.columns, self.s = columns, s
        self.ends = np.cumsum([0, *(len(edges[f]) + 1 for f in columns)]).tolist()
        wide = max(b - a for a, b in zip(self.ends, self.ends[1:], strict=False))
        self.at = np.array([[a + i if a + i < b else self.ends[-1] for i in range(wide)] for a, b in zip(self.ends, self.ends[1:], strict=False)])

    def empty(self) -> np.ndarray:
        return np.zeros((3, self.ends[-1]))

    def add(self, sums: np.ndarray, codes: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray | None) -> None:
        """Add rows (None: all) to a node's sums."""
        if rows is not None:
            g, h = g[rows], h[rows]
        for a, b, code in zip(self.ends, self.ends[1:], codes, strict=False):
            code = (code if rows is None else code[rows]).astype(np.intp)
            for k, weight in enumerate((g, h, None)):
                sums[k, a:b] += np.bincount(code, weight, b - a)

    def best(self, sums: np.ndarray) -> tuple | None:
        """A node's (gain, feature, cut, sums left, sums of all); of equal gains the first feature's first; gain -inf without a cut; None without rows."""
        s, filled = self.s, np.concatenate([sums, np.zeros((3, 1))], axis=1)[:, self.at]
        whole, left = filled.sum(axis=2), np.cumsum(filled, axis=2)[:, :, :-1]
        if not whole[2, 0]:
            return None
        right = whole[:, :, None] - left
        ok = (np.minimum(left[2], right[2]) >= max(s.least_rows, 1)) & (np.minimum(left[1], right[1]) >= s.least_weight)
        if not ok.any():
            return -math.inf, 0, 0, whole[:, 0].tolist(), whole[:, 0].tolist()
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = np.where(ok, _worth(left[0], left[1], s) + _worth(right[0], right[1], s) - _worth(whole[0], whole[1], s)[:, None], -math.inf)
        f, cut = np.unravel_index(np.argmax(np.round(gain, 10)), gain.shape)
        return float(gain[f, cut]), self.columns[f], int(cut), left[:, f, cut].tolist(), whole[:, f].tolist()


def _fewer(k: int, known: dict[int, tuple]) -> int:
    """The child of a split node that has fewer rows."""
    return 2 * k if 2 * known[k][3][2] <= known[k][4][2] else 2 * k + 1


def _may_split(known: dict[int, tuple], k: int, s: Settings) -> bool:
    return known[k][0] > s.least_gain and (s.depth is None or k.bit_length() - 1 < s.depth)


def _may_go_on(k: int, s: Settings) -> bool:
    """Whether a node's children may be split."""
    return s.depth is None or k.bit_length() < s.depth


def _order(known: dict[int, tuple], k: int) -> tuple[float, int]:
    return -round(known[k][0], 10), k


def _sampled(blocks: RDD, columns: list[int], tree: int, s: Settings, judged: bool) -> RDD:
    """Of each block, the rows of a tree's sample: bins of the tree's features, gradients and hessians; and the loss of the rows to judge by, with their number."""

    def part(block):
        x, y, valid, key, margin = block
        lost = 0.0
        if judged:
            q = np.clip(1 / (1 + np.exp(-margin[valid])), 1e-15, 1 - 1e-15)
            lost = -float(np.log(np.where(y[valid] == 1, q, 1 - q)).sum())
        use = np.flatnonzero(~valid & _drawn(key, s.seed, tree, s.row_share))
        p = 1 / (1 + np.exp(-margin[use]))
        return np.stack([x[f][use] for f in columns]), p - y[use], p * (1 - p), lost, int(valid.sum()) if judged else 0

    return blocks.map(part)


#: Tasks whose sums are added up on the driver; those of more tasks are added up in tasks before.
MEET = 32


def _above(nodes: list[int], known: dict[int, tuple], columns: list[int]) -> dict[int, tuple[int, int]]:
    """How the nodes above nodes are cut: place of the feature among columns, largest bin that goes left. Node k has the children 2k and 2k + 1."""
    return {a: (columns.index(known[a][1]), known[a][2]) for a in {k >> i for k in nodes for i in range(1, k.bit_length())}}


def _walk(codes: np.ndarray, above: dict[int, tuple[int, int]], nodes: list[int]):
    """(node, its rows; None: all) for each of nodes."""
    asked, todo = set(nodes), [(1, None)]
    while todo:
        k, rows = todo.pop()
        if k in asked:
            yield k, rows
        if k in above:
            column, cut = above[k]
            goes = (codes[column] if rows is None else codes[column][rows]) <= cut
            for child, side in ((2 * k, goes), (2 * k + 1, None)):
                if child in asked or child in above:
                    side = ~goes if side is None else side
                    todo.append((child, np.flatnonzero(side) if rows is None else rows[side]))


def _pass(sampled: RDD, cutter: _Cutter, known: dict[int, tuple], nodes: list[int]) -> tuple[list[np.ndarray], tuple[float, int]]:
    """(the nodes' sums, (validation loss, rows)): one job."""
    above = _above(nodes, known, cutter.columns)

    def count(some):
        sums, lost, judged = {k: cutter.empty() for k in nodes}, 0.0, 0
        for codes, g, h, lost_, judged_ in some:
            lost, judged = lost + lost_, judged + judged_
            for k, rows in _walk(codes, above, nodes):
                cutter.add(sums[k], codes, g, h, rows)
        yield np.stack([sums[k] for k in nodes]), lost, judged

    found, plus = sampled.mapPartitions(count), lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))
    sums, lost, judged = found.treeReduce(plus) if sampled.getNumPartitions() > MEET else reduce(plus, found.collect())
    return list(sums), (lost, judged)


#: Rows of a node at most, whose splits below are found by one task; or twice a task's even share of the sample, if that is more.
ALONE = 262_144


def _below(sampled: RDD, cutter: _Cutter, known: dict[int, tuple], nodes: list[int], budget: float) -> dict[int, tuple]:
    """What is known of the nodes below nodes of few rows, as far as they may be split within the budget: one job, that sends the rows of each to one task. Within a node, best first picks the same splits in the same order whatever else is split."""
    starts, above, s = {k: known[k] for k in nodes}, _above(nodes, known, cutter.columns), cutter.s
    tasks, task = min(sampled.getNumPartitions(), len(nodes)), {}
    load = [0.0] * tasks
    for k in sorted(nodes, key=lambda k: (-starts[k][4][2], k)):
        task[k] = load.index(min(load))
        load[task[k]] += starts[k][4][2]

    def deal(some):
        for codes, g, h, _, _ in some:
            for k, rows in _walk(codes, above, nodes):
                yield task[k], ((k, codes, g, h) if rows is None else (k, codes[:, rows], g[rows], h[rows]))

    def grow(some):
        parts: dict[int, list] = {}
        for _, (k, *arrays) in some:
            parts.setdefault(k, []).append(arrays)
        for top in list(parts):
            codes, g, h = (np.concatenate(x, axis=-1) for x in zip(*parts.pop(top), strict=True))
            found, at, sums, open_, done = {top: starts[top]}, {top: np.arange(len(g))}, {}, [top], 0
            while open_ and done < budget:
                k = min(open_, key=lambda k: _order(found, k))
                open_.remove(k)
                done += 1
                if done >= budget or not _may_go_on(k, s):
                    continue
                rows = at.pop(k)
                goes = codes[cutter.columns.index(found[k][1])][rows] <= found[k][2]
                at[2 * k], at[2 * k + 1] = rows[goes], rows[~goes]
                c = _fewer(k, found)
                for child in (c, c ^ 1):
                    if child == c or k not in sums:
                        sums[child] = cutter.empty()
                        cutter.add(sums[child], codes, g, h, at[child])
                    else:
                        sums[child] = sums.pop(k) - sums[c]
                    found[child] = cutter.best(sums[child])
                    if _may_split(found, child, s):
                        open_.append(child)
            del found[top]
            yield found

    dealt = sampled.mapPartitions(deal).partitionBy(tasks, lambda k: k)
    return {k: v for found in dealt.mapPartitions(grow).collect() for k, v in found.items()}


def _replayed(known: dict[int, tuple], s: Settings) -> tuple[list[int], list[int]]:
    """(nodes split so far, best first; nodes whose children the next pass computes: the one on which the next split hangs, and those that may yet be split within the budget, below leaves too)."""
    budget = math.inf if s.leaves is None else s.leaves - 1
    done, open_ = [], [1] if _may_split(known, 1, s) else []
    while open_ and len(done) < budget:
        best = min(open_, key=lambda k: _order(known, k))
        children = (2 * best, 2 * best + 1)
        if len(done) + 1 < budget and _may_go_on(best, s) and not all(c in known for c in children):
            rest = sorted((k for k in known if k != best and 2 * k not in known and _may_split(known, k, s) and _may_go_on(k, s)), key=lambda k: _order(known, k))
            return done, [best, *rest] if budget == math.inf else [best, *rest][: budget - len(done)]
        done.append(best)
        open_.remove(best)
        open_ += [c for c in children if c in known and _may_split(known, c, s)]
    return done, []


def _tree(known: dict[int, tuple], done: list[int], edges: list[np.ndarray], s: Settings) -> Tree:
    split, tree, number = set(done), Tree(), {}
    sums = {1: known[1][4]}
    for k in sorted(done):
        left = known[k][3]
        sums[2 * k], sums[2 * k + 1] = left, [a - b for a, b in zip(sums[k], left, strict=True)]
    order = sorted(sums)
    for i, k in enumerate(order):
        number[k] = i
    for k in order:
        g, h, rows = sums[k]
        gain, feature, cut = known[k][:3] if k in split else (0.0, -1, 0)
        for name, v in (("feature", feature), ("cut", int(cut)), ("threshold", float(edges[feature][cut]) if feature >= 0 else 0.0), ("left", number.get(2 * k, -1) if k in split else -1), ("right", number.get(2 * k + 1, -1) if k in split else -1),
                        ("value", float(-_soft(g, s.l1) / (h + s.l2) * s.rate)), ("cover", float(rows)), ("gain", float(gain))):
            getattr(tree, name).append(v)
    return tree


#: Trees after which rows carry their margin anew, and after which the lineage is cut: by a checkpoint, or where the session has no folder for it by adding all trees to the prepared rows.
REFRESH, CUT = 1, 25


def fit(df: DataFrame, features: list[str], label: str = "click", valid_flag: str | None = None, settings: Settings = LEAF_WISE, id_col: str | None = None, watch=None) -> Boosted:
    """Boosted trees on the rows that valid_flag does not mark; with it, rounds stop when its rows' loss has not fallen for settings.patience rounds, and the best round's trees are kept.

    Null, NaN and infinite features are 0; rows without a label are left out. id_col names a column that draws the row
    samples; without one the features do, and equal rows are drawn together. watch(round, loss) may end the fit by
    returning True. Without a training row of each class the model is its base alone.
    """
    ready = prepare(df, features, label, valid_flag, settings.bins, id_col)
    try:
        return fit_prepared(ready, settings, watch)
    finally:
        ready.release()


def fit_prepared(ready: Prepared, settings: Settings = LEAF_WISE, watch=None) -> Boosted:
    """fit on prepared rows, which stay prepared; settings.bins is what they were prepared with."""
    s, n, edges, rate = settings, len(ready.features), ready.edges, ready.rate
    if ready.blocks is None:
        return Boosted(ready.features, math.log(1e-7) if not rate else -math.log(1e-7), [], [])
    base, blocks, old, folder = math.log(rate / (1 - rate)), ready.blocks, None, ready.spark.sparkContext.getCheckpointDir()
    trees, pending, losses, best, kept = [], [], [], (math.inf, 0), []
    try:
        for tree in range(s.rounds + 1):
            last = tree == s.rounds
            if last and not ready.judged:
                break
            columns = sorted(np.random.default_rng([s.seed, tree]).permutation(n)[: max(1, round(s.column_share * n))].tolist())
            cutter = _Cutter(columns, edges, s)
            sampled = _sampled(_with_margin(blocks, pending) if pending else blocks, columns, tree, s, ready.judged).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                (root,), lost = _pass(sampled, cutter, {}, [1])
                if old is not None:  # its successor stands now
                    old.unpersist()
                    old = None
                while len(kept) > 1:
                    tables.delete(ready.spark, kept.pop(0).getCheckpointFile())
                if lost[1]:
                    losses.append(lost[0] / lost[1])
                    best = (losses[-1], tree) if losses[-1] < best[0] else best
                    if tree - best[1] >= s.patience or (watch and watch(tree, losses[-1])):
                        break
                known, sums = {1: cutter.best(root)}, {1: root}
                if last or known[1] is None:
                    break
                alone = max(ALONE, 2 * known[1][4][2] / sampled.getNumPartitions())
                while True:
                    done, wanted = _replayed(known, s)
                    if not wanted:
                        break
                    large = [k for k in wanted if known[k][4][2] > alone]
                    if not large:
                        known |= _below(sampled, cutter, known, wanted, math.inf if s.leaves is None else s.leaves - 1 - len(done))
                        continue
                    fewer = [_fewer(k, known) for k in large]
                    for c, found in zip(fewer, _pass(sampled, cutter, known, fewer)[0], strict=True):
                        sums[c], sums[c ^ 1] = found, sums.pop(c >> 1) - found
                        known |= {k: cutter.best(sums[k]) for k in (c, c ^ 1)}
            finally:
                sampled.unpersist()
            trees.append(_tree(known, done, edges, s))
            pending.append(trees[-1])
            if len(pending) >= REFRESH and len(trees) < s.rounds + ready.judged:
                cut = len(trees) % CUT < len(pending)
                newer = (_with_margin(ready.blocks, trees) if cut and not folder else _with_margin(blocks, pending)).persist(StorageLevel.MEMORY_AND_DISK)
                if cut and folder:
                    newer.checkpoint()
                    kept.append(newer)
                old, blocks, pending = blocks if blocks is not ready.blocks else None, newer, []
    finally:
        for held in (old, blocks):
            if held is not None and held is not ready.blocks:
                held.unpersist()
        for held in kept:
            if held.isCheckpointed():
                tables.delete(ready.spark, held.getCheckpointFile())
    return Boosted(ready.features, base, trees[: best[1]] if losses else trees, losses)


def score(model: Boosted, df: DataFrame, out: str = "score") -> DataFrame:
    """df and the probability of class 1."""
    text = model.to_json()

    @F.pandas_udf("double")
    def chance(x: pd.Series) -> pd.Series:
        m = Boosted.from_json(text)
        return pd.Series(1 / (1 + np.exp(-m.margin(np.array(x.tolist(), float).reshape(len(x), -1)))))

    return df.withColumn(out, chance(F.array(*_values(model.features))))


def importance(spark: SparkSession, model: Boosted) -> DataFrame:
    """feature, its share of the splits' gain, the number of splits by it, rank by gain."""
    gain, splits = [0.0] * len(model.features), [0] * len(model.features)
    for t in model.trees:
        for f, g in zip(t.feature, t.gain, strict=True):
            if f >= 0:
                gain[f] += g
                splits[f] += 1
    order = sorted(range(len(gain)), key=lambda i: (-gain[i], model.features[i]))
    rows = [(model.features[i], gain[i] / (sum(gain) or 1.0), splits[i], r) for r, i in enumerate(order, 1)]
    return spark.createDataFrame(rows, "feature string, gain double, splits long, rank int")


def _game(known: list[np.ndarray], shares: list[float], value: float) -> np.ndarray:
    """Shapley values (rows x features) of one leaf's game.

    The game is a product over the features on the leaf's path: 1 or 0 where the feature is known (whether the row
    keeps to the path), the share of the rows that do where it is not. The Shapley weights are the integral over t of
    t**k (1 - t)**(d - 1 - k), so the sum over subsets is the integral of a polynomial, which Gauss' rule gives exactly.
    """
    d, n = len(shares), len(known[0])
    out, (points, weights) = np.zeros((n, d)), np.polynomial.legendre.leggauss((d + 1) // 2)
    for t, w in zip((points + 1) / 2, weights / 2, strict=True):
        factors = [z * (1 - t) + o * t for o, z in zip(known, shares, strict=True)]
        ahead = [np.ones(n)]
        for p in factors[:-1]:
            ahead.append(ahead[-1] * p)
        behind = np.full(n, w * value)
        for i in reversed(range(d)):
            out[:, i] += (known[i] - shares[i]) * ahead[i] * behind
            behind = behind * factors[i]
    return out


#: Features of a path at most, for which a leaf's game is played once for every way of keeping to the path.
WAYS = 10


def tree_games(tree: Tree) -> tuple[float, dict[int, tuple]]:
    """(a tree's expected value, {leaf: features on its path, shares of the rows that keep to it, values of its game for every way of keeping to it})."""
    expected, games, todo = 0.0, {}, [(0, {}, 1.0)]
    while todo:
        at, path, reach = todo.pop()
        f = tree.feature[at]
        if f >= 0:
            for child in (tree.left[at], tree.right[at]):
                share = tree.cover[child] / tree.cover[at]
                todo.append((child, path | {f: path.get(f, 1.0) * share}, reach * share))
            continue
        expected += reach * tree.value[at]
        if path:
            d, shares = len(path), list(path.values())
            games[at] = list(path), shares, _game([(np.arange(2**d) >> i & 1).astype(float) for i in range(d)], shares, tree.value[at]) if d <= WAYS else None
    return expected, games


def tree_attribution(tree: Tree, games: dict[int, tuple], x: np.ndarray, limits: list, out: np.ndarray) -> None:
    """Add a tree's exact path-dependent Shapley values to out (features x rows)."""
    todo = [(0, {})]
    while todo:
        at, path = todo.pop()
        f = tree.feature[at]
        if f >= 0:
            goes = x[:, f] <= limits[at]
            for child, keeps in ((tree.left[at], goes), (tree.right[at], ~goes)):
                todo.append((child, path | {f: path[f] & keeps if f in path else keeps}))
        elif path:
            names, shares, played = games[at]
            known = list(path.values())
            if played is None:
                found = _game(known, shares, tree.value[at])
            else:
                way = np.zeros(len(x), np.intp)
                for i, keeps in enumerate(known):
                    way += keeps.astype(np.intp) << i
                found = played[way]
            for i, name in enumerate(names):
                out[name] += found[:, i]


def contributions(model: Boosted, df: DataFrame, id_col: str = "id") -> DataFrame:
    """id, base (the trees' expected log-odds), feature, value, contribution in log-odds; one row for each feature. Base and contributions add up to the score's log-odds."""
    text, kind = model.to_json(), df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.array(*_values(model.features)).alias("x"))

    def task(batches):
        m = Boosted.from_json(text)
        k, games = len(m.features), [tree_games(t) for t in m.trees]
        base = m.base + sum(expected for expected, _ in games)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                b = batch.slice(start, 2048)
                x = np.asarray(b.column(1).flatten(), float).reshape(-1, k)
                out = np.zeros(x.T.shape)
                for t, (_, game) in zip(m.trees, games, strict=True):
                    tree_attribution(t, game, x, t.threshold, out)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.full(x.size, base)), pa.array(m.features * len(x)), pa.array(x.ravel()), pa.array(out.T.ravel())], ["id", "base", "feature", "value", "contribution"])

    return rows.mapInArrow(task, f"id {kind}, base double, feature string, value double, contribution double").withColumnRenamed("id", id_col)


__all__ = ["DEPTH_WISE", "LEAF_WISE", "Boosted", "Prepared", "Settings", "Tree", "contributions", "fit", "fit_prepared", "importance", "load", "prepare", "replace", "save", "score"]
