"""N-gram Jaccard join with set-relation skipping.

1. Equal sets become one set, so copies cost nothing further. Shingles are ordered by a counting sketch of fixed size
   (rare first, then by hash); any one order gives exact results.
2. A set's first n - ceil(t * n) + slack shingles go to index lists. Two sets that link share at least as many list entries
   as the smaller one's slack, so a set with fewer shared entries than that links with nothing and leaves all lists.
3. Index skipping: a list's members stand in blocks by size and position, and pairs of blocks that cannot hold a link are
   skipped; within blocks size and position decide which pairs stay open. Of lists with the same members one is looked at,
   with their number as its weight; pairs that share fewer entries than the smaller one's slack are dropped.
4. Answer skipping: open pairs meet by groups of sets whose lists have the same leader (the least of their members). There
   the overlaps of a first set are counted from a small index; those of a similar set follow from them by the shingles in
   which the two sets differ.

A pair belongs to one pair of groups, however many lists hold it, so links are found once each and can be counted where
they are found: no step has a row for each pair, unless the links themselves are asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.llm import common, components, textbytes

#: Counters of the sketch that orders shingles.
COUNTERS = 1 << 18
_SLICES = 16
#: Members of an index list in one block, about; a shorter list is one block.
BLOCK = 1024
#: Sets of a group in which open pairs meet, about.
GROUP = 512
#: A set's list entries beyond the least number are this part of its shingles.
SLACK = 20
#: Pairs of members that a task looks at in the lists of one leader, about.
LOOKED_AT = 40_000_000
#: Pairs that a task holds before it hands them on.
_HELD = 1 << 19
_NODE = np.uint64(0x9E3779B97F4A7C15)


class _Sets:
    """The shingle sets of a stretch of texts, end to end; empty sets have node 0."""

    def __init__(self, column: pa.Array, size: int):
        self.sets = textbytes.shingle_sets(*textbytes.buffer_of(column), size)
        self.n = np.fromiter(map(len, self.sets), np.int64, len(self.sets))
        self.node = np.zeros(len(self.n), np.int64)
        self.flat = np.concatenate(self.sets) if len(self.sets) else np.empty(0, np.uint64)
        self.full = self.n > 0
        self.starts = (np.cumsum(self.n) - self.n)[self.full]
        if len(self.starts):
            one = np.add.reduceat(self.flat, self.starts)
            two = np.add.reduceat(textbytes.mixed(self.flat ^ _NODE), self.starts)
            self.node[self.full] = textbytes.mixed(one ^ textbytes.mixed(two + self.n[self.full].astype(np.uint64))).view(np.int64)


def _stretches(column: pa.Array, size: int):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for a, b in textbytes.parts(column):
        yield a, b, _Sets(column.slice(a, b - a), size)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _slot(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(COUNTERS - 1)).astype(np.int64)


def _measured(batches, size: int):
    """Of every row its set's size and node; at the end this task's counts of shingles, in slices."""
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for a, b, s in _stretches(batch.column(1), size):
            counts += np.bincount(_slot(s.flat), minlength=COUNTERS)
            none = pa.nulls(b - a, pa.binary())
            yield _batch(doc_id=batch.column(0).slice(a, b - a), n=pa.array(s.n), node=pa.array(s.node), slice=pa.nulls(b - a, pa.int32()), counts=none)
    for i, part in enumerate(counts.astype(np.uint32).reshape(_SLICES, -1)):
        if part.any():
            gone = pa.nulls(1, pa.int64())
            yield _batch(doc_id=gone, n=gone, node=gone, slice=pa.array([i], pa.int32()), counts=pa.array([part.tobytes()], pa.binary()))


def _summed(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(part.as_buffer(), np.uint32)
            total[i] = total[i] + part if i in total else part.astype(np.uint64)
    for i, part in total.items():
        yield _batch(slice=pa.array([i], pa.int32()), counts=pa.array([part.tobytes()], pa.binary()))


def _slack(n):
    return np.maximum(1, n // SLACK)


def _prefixes(batches, size: int, percent: int, sketch):
    """List entries of every different set of this task."""
    counts, seen = sketch.value, set()
    for batch in batches:
        for _, _, s in _stretches(batch.column(0), size):
            rank = counts[_slot(s.flat)]
            at = np.cumsum(s.n) - s.n
            keep = s.n + (-percent * s.n // 100) + _slack(s.n)
            tokens, nodes, lengths = [], [], []
            for i in np.flatnonzero(s.full).tolist():
                node = int(s.node[i])
                if node not in seen:
                    seen.add(node)
                    order = np.argsort(rank[at[i] : at[i] + s.n[i]], kind="stable")  # a set is in order of its hashes
                    tokens.append(s.sets[i][order[: keep[i]]])
                    nodes.append(node)
                    lengths.append(len(tokens[-1]))
            if tokens:
                lengths = np.array(lengths)
                position = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                yield _batch(token=pa.array(np.concatenate(tokens).view(np.int64)), node=pa.array(np.repeat(np.array(nodes, np.int64), lengths)), pos=pa.array(position.astype(np.int32)))


def _shared(batches):
    """Rows in order of (token, node): each entry once, and only those of tokens with several sets."""
    held, tied = None, False  # the last entry, and whether the one before it has its token
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
        token, node, _ = rows
        if not len(token):
            continue
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, pos = (r[new] for r in rows)
        with_next = np.append(token[1:] == token[:-1], False)
        with_last = np.append(tied, token[1:] == token[:-1])
        keep = (with_next | with_last)[:-1]
        held, tied = [token[-1:], node[-1:], pos[-1:]], bool(with_last[-1])
        yield _batch(token=pa.array(token[:-1][keep]), node=pa.array(node[:-1][keep]), pos=pa.array(pos[:-1][keep]))
    if held is not None and tied:
        yield _batch(token=pa.array(held[0]), node=pa.array(held[1]), pos=pa.array(held[2]))


def _fitting(na, pa_, nb, pb, percent: int):
    """Size and position: whether a shared shingle at these positions leaves room for a link."""
    need = -(-percent * (na + nb) // (100 + percent))
    most = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_ - 1, nb - pb - 1)
    return (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent) & (most >= need)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _within(batch, percent: int):
    """Open pairs of each list that is one block: (node, group) of both, size of the smaller and weight; lists of one length go together."""
    (offsets, node), *others = (_lists(batch.column(f"{c}_a")) for c in ("node", "n", "pos", "block"))
    n, pos, block = (v for _, v in others)
    lengths = np.diff(offsets)
    for m in np.unique(lengths[lengths > 1]).tolist():
        i, j = np.triu_indices(m, 1)
        starts = offsets[:-1][lengths == m]
        weight = batch.column("weight").to_numpy()[lengths == m]
        step = max(1, _HELD // len(i))
        for k in range(0, len(starts), step):
            u = (starts[k : k + step, None] + i).ravel()
            v = (starts[k : k + step, None] + j).ravel()
            fits = _fitting(n[u], pos[u], n[v], pos[v], percent)
            w = np.repeat(weight[k : k + step], len(i))[fits]
            yield node[u[fits]], block[u[fits]], node[v[fits]], block[v[fits]], np.minimum(n[u[fits]], n[v[fits]]), w


def _between(batch, percent: int):
    """Open pairs of two blocks of a long list, or of a block with itself."""
    a, b = ([_lists(batch.column(f"{c}_{s}")) for c in ("node", "n", "pos", "block")] for s in "ab")
    weight = batch.column("weight").to_numpy()
    for k in range(batch.num_rows):
        (na, sa, pa_, ga), (nb, sb, pb, gb) = ([v[at[k] : at[k + 1]] for at, v in side] for side in (a, b))
        fits = _fitting(sa[:, None], pa_[:, None], sb, pb, percent)
        if na[0] == nb[0]:
            fits &= na[:, None] < nb
        i, j = np.nonzero(fits)
        yield na[i], ga[i], nb[j], gb[j], np.minimum(sa[i], sb[j]), np.full(len(i), weight[k])


def _merged(found) -> list[np.ndarray]:
    """Each pair once, with its summed weight: x, gx, y, gy, n, weight, the lower group first, within a group the lower node."""
    x, gx, y, gy, n, w = (np.concatenate(c) for c in zip(*found, strict=True))
    turn = (gx > gy) | ((gx == gy) & (x > y))
    x, y, gx, gy = np.where(turn, y, x), np.where(turn, x, y), np.where(turn, gy, gx), np.where(turn, gx, gy)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    at = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    return [x[at], gx[order][at], y[at], gy[order][at], n[order][at], np.add.reduceat(w[order], at)]


def _by_groups(pairs: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each pair of groups, with its pairs."""
    order = np.lexsort((pairs[3], pairs[1]))
    x, gx, y, gy, n, w = (v[order] for v in pairs)
    at = np.flatnonzero(np.append(True, (gx[1:] != gx[:-1]) | (gy[1:] != gy[:-1])))
    offsets = pa.array(np.append(at, len(x)).astype(np.int32))
    of = lambda v, t=pa.int64(): pa.ListArray.from_arrays(offsets, pa.array(v, t))
    return _batch(ga=pa.array(gx[at]), gb=pa.array(gy[at]), xs=of(x), ys=of(y), ns=of(n.astype(np.int32), pa.int32()), ws=of(w.astype(np.int32), pa.int32()))


def _with_enough(batches):
    """Rows in order of (ga, gb): each pair of groups in one row, with the pairs that share as many list entries as a link of their sizes must."""
    key, held = None, []

    def close():
        x, y, n, w = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((y, x))
        x, y, n, w = x[order], y[order], n[order], w[order]
        at = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        enough = np.add.reduceat(w, at) >= _slack(n[at])
        at = at[enough]
        if len(at):
            offsets = pa.array(np.array([0, len(at)], np.int32))
            yield _batch(ga=pa.array([key[0]], pa.int64()), gb=pa.array([key[1]], pa.int64()), xs=pa.ListArray.from_arrays(offsets, pa.array(x[at])), ys=pa.ListArray.from_arrays(offsets, pa.array(y[at])))

    for batch in batches:
        columns = [batch.column(c) for c in ("xs", "ys", "ns", "ws")]
        for k, here in enumerate(zip(batch.column("ga").to_pylist(), batch.column("gb").to_pylist(), strict=True)):
            if here != key:
                if held:
                    yield from close()
                key, held = here, []
            held.append([c[k].values.to_numpy().astype(np.int64) for c in columns])
    if held:
        yield from close()


def _opened(batches, percent: int, pairs_of):
    """Open pairs, each once among those that a task holds."""
    found, held = [], 0
    for batch in batches:
        for pairs in pairs_of(batch, percent):
            if len(pairs[0]):
                found.append(pairs)
                held += len(pairs[0])
            if held > 2 * _HELD:
                found = [_merged(found)]
                held = len(found[0][0])
                if held > _HELD:
                    yield _by_groups(found[0])
                    found, held = [], 0
    if found:
        yield _by_groups(_merged(found))


def _packed_sets(batches, size: int):
    for batch in batches:
        for _, _, s in _stretches(batch.column(0), size):
            yield _batch(node=pa.array(s.node), packed=pa.array([x.tobytes() for x in s.sets], pa.binary()))


def _without(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x but for the elements of y; both sorted, y not empty."""
    return x[y[np.minimum(np.searchsorted(y, x), len(y) - 1)] != x]


class _Index:
    """Lists of the sets that hold a shingle, by place in sets."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.tokens, self.owner, self.sets = flat[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order], len(sets)

    def overlaps(self, x: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.tokens, x, "left"), np.searchsorted(self.tokens, x, "right")
        n = hi - lo
        at = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=self.sets)


def overlaps_of_pairs(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Overlaps of sets[x[k]] and sets[y[k]]; x in order. A set's overlaps follow from an earlier, similar set's by the shingles in which they differ."""
    right, place = np.unique(y, return_inverse=True)
    cuts = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)]
    out = np.empty(len(x), np.int64)
    if len(x) == 1:
        a, b = sets[x[0]], sets[y[0]]
        out[0] = len(a) - len(_without(a, b))
        return out
    index, leader, known = _Index([sets[k] for k in right]), None, None
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        mine = sets[x[a]]
        counts = None
        if leader is not None:
            more, less = _without(mine, leader), _without(leader, mine)
            if 2 * (len(more) + len(less)) < len(mine):
                counts = known + index.overlaps(more) - index.overlaps(less)
        if counts is None:
            counts = index.overlaps(mine)
            leader, known = mine, counts
        out[a:b] = counts[place[a:b]]
    return out


def _least_tied(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of 0..n-1 that ties over a, b lead to."""
    least = np.arange(n)
    while True:
        low, new = np.minimum(least[a], least[b]), least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _answers(batches, percent: int, pairs: bool):
    """Rows in order of (ga, gb, role): sets, then pairs of them. Yields links a, b, or for each set that links its number of links and a set it is tied to."""
    key, nodes, copies, sets, xs, ys = None, [], [], [], [], []
    out, held = [], 0

    def close():
        at = np.array(nodes, np.int64)
        order = np.argsort(at, kind="stable")
        at = at[order]
        x, y = (np.searchsorted(at, np.concatenate(v)) for v in (xs, ys))
        pair = np.unique(x * len(at) + y)
        x, y = pair // len(at), pair % len(at)
        ordered, weight = [sets[k] for k in order], np.array(copies, np.int64)[order]
        n = np.array([len(s) for s in ordered])
        o = overlaps_of_pairs(ordered, x, y)
        linked = o * 100 >= percent * (n[x] + n[y] - o)
        x, y = x[linked], y[linked]
        if pairs:
            return [np.minimum(at[x], at[y]), np.maximum(at[x], at[y])]
        links = np.bincount(x, weight[y], len(at)).astype(np.int64) + np.bincount(y, weight[x], len(at)).astype(np.int64)
        has = links > 0
        return [at[has], at[_least_tied(len(at), x, y)][has], links[has]]

    def handed():
        names = ("a", "b") if pairs else ("node", "root", "links")
        columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
        out.clear()
        return _batch(**dict(zip(names, columns, strict=True)))

    for batch in batches:
        ga, gb, role, node, copy = (batch.column(c).to_pylist() for c in ("ga", "gb", "role", "node", "copies"))
        packed, left, right = (batch.column(c) for c in ("packed", "xs", "ys"))
        for k in range(batch.num_rows):
            if (ga[k], gb[k]) != key:
                if xs:
                    out.append(close())
                    held += len(out[-1][0])
                    if held > 20_000:
                        yield handed()
                        held = 0
                key, nodes, copies, sets, xs, ys = (ga[k], gb[k]), [], [], [], [], []
            if role[k] == 0:
                if not nodes or nodes[-1] != node[k]:
                    nodes.append(node[k])
                    copies.append(copy[k])
                    sets.append(np.frombuffer(packed[k].as_py(), np.uint64))
            else:
                xs.append(left[k].values.to_numpy())
                ys.append(right[k].values.to_numpy())
    if xs:
        out.append(close())
    if out:
        yield handed()


def _order(measured: DataFrame):
    """The summed sketch, broadcast: COUNTERS numbers, however large the corpus."""
    parts = common.in_arrow(measured.filter("slice is not null").select("slice", "counts").repartition(_SLICES, "slice"), _summed, "slice int, counts binary").collect()
    counts = np.zeros((_SLICES, COUNTERS // _SLICES), np.uint64)
    for r in parts:
        counts[r["slice"]] += np.frombuffer(r["counts"], np.uint64)
    return measured.sparkSession.sparkContext.broadcast(counts.reshape(-1))


def _open_pairs(kept: DataFrame, percent: int, results: common.Scratch) -> DataFrame:
    """ga, gb, xs, ys: pairs that size and position leave open, from list entries (token, node, pos, n)."""
    scratch = common.Scratch(kept.sparkSession)
    lists = kept.groupBy("token").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("m1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("m2"), F.min("node").alias("leader")).filter("members > 1")
    lists = scratch.staged(lists.groupBy("members", "m1", "m2", "leader").agg(F.min("token").alias("token"), F.count("*").cast("int").alias("weight")).select("token", "members", "leader", "weight"), "set-lists")  # of lists with the same members, one, with their number
    shared = scratch.staged(kept.join(lists, "token"), "set-shared")
    leaders = scratch.staged(shared.groupBy("node").agg(F.min("leader").alias("least")), "set-leaders")
    parts = leaders.groupBy("least").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    placed = leaders.join(parts, "least").select("node", F.xxhash64("least", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"))
    shared = shared.join(placed, "node")
    apart = lambda c: F.when(F.col("members") > BLOCK, c.cast("int")).otherwise(0)
    keys = [apart(F.floor(F.log("n") / F.lit(float(np.log(1.25))))).alias("bn"), apart(F.floor(F.col("pos") * 20 / F.col("n"))).alias("bp"), apart(F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK))).alias("bh")]
    blocks = shared.groupBy("token", "members", "leader", "weight", *keys).agg(F.collect_list(F.struct("node", "n", "pos", "block")).alias("e"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("pos").alias("p0"), F.max("pos").alias("p1"))
    blocks = scratch.staged(blocks.withColumn("at", F.struct("bn", "bp", "bh")), "set-blocks")

    def side(s: str) -> list[Column]:
        return [F.col(f"e.{c}").alias(f"{c}_{s}") for c in ("node", "n", "pos", "block")]

    schema = "ga long, gb long, xs array<long>, ys array<long>, ns array<int>, ws array<int>"
    tasks = common.shuffle_partitions(kept.sparkSession)  # few bytes, much work: not to be left to their size
    # lists of one leader hold much the same pairs: where they are opened together, a pair is handed on once
    shares = lists.groupBy("leader").agg(F.ceil(F.sum(F.least("members", F.lit(BLOCK)).cast("double") ** 2) / (2 * LOOKED_AT)).cast("int").alias("shares"))
    short = blocks.filter(F.col("members") <= BLOCK).join(shares, "leader").withColumn("share", F.pmod(F.xxhash64("token"), F.col("shares")))
    short = common.in_arrow(short.select("leader", "share", "weight", *side("a")).repartition(tasks, "leader", "share"), lambda it: _opened(it, percent, _within), schema)
    c = F.col
    bounds = ("n0", "n1", "p0", "p1", "at")
    a, b = (blocks.filter(F.col("members") > BLOCK).select("token", *(["leader", "weight"] if s == "a" else []), *side(s), *[F.col(x).alias(f"{x}_{s}") for x in bounds]) for s in "ab")
    sized = (c("n1_a") * 100 >= c("n0_b") * percent) & (c("n1_b") * 100 >= c("n0_a") * percent)
    # the most a pair of these blocks can share, against the least that a link of the smallest sizes needs
    most = F.least("p1_a", "p1_b") + 1 + F.least(c("n1_a") - c("p0_a") - 1, c("n1_b") - c("p0_b") - 1)
    room = most >= F.ceil(percent * (c("n0_a") + c("n0_b")) / (100 + percent))
    met = a.join(b, "token").filter((c("at_a") <= c("at_b")) & sized & room)
    kinds = ("at_a.bn", "at_a.bh", "at_b.bn", "at_b.bh")
    long = met.select("leader", "weight", *[F.col(k).alias(k.replace(".", "_")) for k in kinds], *[f"{v}_{s}" for s in "ab" for v in ("node", "n", "pos", "block")])
    long = common.in_arrow(long.repartition(tasks, "leader", *[k.replace(".", "_") for k in kinds]), lambda it: _opened(it, percent, _between), schema)
    found = short.unionByName(long).repartition(tasks, "ga", "gb").sortWithinPartitions("ga", "gb")
    opened = results.staged(common.in_arrow(found, _with_enough, "ga long, gb long, xs array<long>, ys array<long>"), "set-pairs")
    scratch.clear()
    return opened


def _joined(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows' sets, different sets, answers of _answers)."""
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    early, middle, scratch = (common.Scratch(docs.sparkSession) for _ in range(3))
    measured = common.staged(common.in_arrow(rows, lambda it: _measured(it, size), "doc_id long, n long, node long, slice int, counts binary"), "set-sizes")
    sketch = _order(measured)
    sized = measured.filter("slice is null").select("doc_id", "n", "node")
    classes = measured.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"))
    classes = common.staged(classes, "set-classes")

    entries = common.in_arrow(rows.select("text"), lambda it: _prefixes(it, size, percent, sketch), "token long, node long, pos int")
    entries = entries.repartition(common.shuffle_partitions(docs.sparkSession), "token").sortWithinPartitions("token", "node")
    entries = early.staged(common.in_arrow(entries, _shared, "token long, node long, pos int"), "set-entries")
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / SLACK))  # the slack of the smallest set that can link with this one
    good = entries.groupBy("node").agg(F.count("*").alias("entries")).join(classes, "node").filter(F.col("entries") >= least).select("node", F.col("n").cast("int").alias("n"))
    kept = middle.staged(entries.join(early.staged(good, "set-linkable"), "node"), "set-kept")
    early.clear()
    opened = _open_pairs(kept, percent, scratch)
    middle.clear()

    members = opened.select("ga", "gb", F.explode(F.array_distinct(F.concat("xs", "ys"))).alias("node")).distinct()
    members = scratch.staged(members.join(classes.select("node", "first", "copies"), "node"), "set-members")
    ids = scratch.staged(members.select(F.col("first").alias("_id")).distinct(), "set-ids")
    texts = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    sets = common.in_arrow(texts, lambda it: _packed_sets(it, size), "node long, packed binary")
    no_array, none = F.lit(None).cast("array<long>"), F.lit(None).cast("long")
    left = members.join(sets, "node").select("ga", "gb", F.lit(0).alias("role"), "node", "copies", "packed", no_array.alias("xs"), no_array.alias("ys"))
    right = opened.select("ga", "gb", F.lit(1).alias("role"), none.alias("node"), none.alias("copies"), F.lit(None).cast("binary").alias("packed"), "xs", "ys")
    met = left.unionByName(right).repartition(common.shuffle_partitions(docs.sparkSession), "ga", "gb").sortWithinPartitions("ga", "gb", "role", "node")
    answers = common.in_arrow(met, lambda it: _answers(it, percent, pairs), "a long, b long" if pairs else "node long, root long, links long")
    answers = common.staged(answers, "set-answers")
    scratch.clear()
    return sized, classes, answers


def linked_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id, n, node for every row, node being its set; and a, b for every two different sets that link, a < b, once.

    Words are split by ASCII white space, A-Z lower-cased; a text with fewer than size words is one shingle, a text without
    words (or null) has none (n = 0) and links with nothing. Rows that repeat an id are sets of their own. An empty table
    gives empty results. Shingles and equal sets are told apart by 64-bit hashes. links has a row for each link: in a group
    of near copies they grow with the square of the group; similar_groups counts them without.
    """
    sized, _, links = _joined(docs, id_col, text_col, size, percent, True)
    return sized, links


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row: components of the links between shingle sets, and the number of other rows that the row links with.

    Rows with equal sets link. A null id is a component's id only where all its ids are null. Sets and links as in linked_sets.
    """
    sized, classes, answers = _joined(docs, id_col, text_col, size, percent, False)
    others = answers.groupBy("node").agg(F.sum("links").alias("others"))
    tied = components.components(answers.select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = classes.join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = found.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = found.join(least, "component").join(others, "node", "left").select("node", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return sized.join(ids, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs, with the smallest id of each group of linked documents, all columns as they are. Rows that repeat that id all stay."""
    kept = similar_groups(docs, id_col, text_col, size, percent).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept.alias("kept"), docs[id_col].cast("bigint").eqNullSafe(F.col("kept._id")), "left_semi")
