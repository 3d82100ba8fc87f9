"""Boosted trees and their attribution against a plain reimplementation and against sums over all subsets."""

import itertools
import math
import random
from pathlib import Path

import numpy as np
import pytest

from ratewise.operators import boosting, evaluation, models

FEATURES = ["a", "b", "c", "d"]


def table(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c, d = rng.randint(0, 9), rng.random(), rng.choice([None, 1.0, float("nan"), 5.0]), rng.randint(0, 2)
        z = (a > 4) * 1.2 - (b < 0.3) * 1.5 + (a > 6) * (d == 1) * 1.5 - 0.3
        rows.append((i, a, b, c, d, int(rng.random() < 1 / (1 + math.exp(-z))), i % 4 == 0))
    return rows, spark.createDataFrame(rows, "id long, a int, b double, c double, d int, click int, valid boolean").repartition(3)


def plain_trees(rows, s, rounds):
    """Best-first growth with a whole scan for each node; the same edges, gains and ties."""
    x = np.array([[0.0 if v is None or v != v else v for v in r[1:5]] for r in rows], float)
    y, use = np.array([r[5] for r in rows], float), np.array([not r[6] for r in rows])
    x, y = x[use], y[use]
    edges = []
    for j in range(4):
        v = np.sort(x[:, j])
        edges.append(np.unique([v[max(0, math.ceil(i / s.bins * len(v)) - 1)] for i in range(1, s.bins)]))
    margin, out = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), []
    soft = lambda g: math.copysign(max(abs(g) - s.l1, 0), g)
    worth = lambda g, h: soft(g) ** 2 / (h + s.l2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def best(rows_at):
            found = (-math.inf, None, None)
            for j in range(4):
                for e in edges[j]:
                    left = x[rows_at, j] <= e
                    lo, hi = rows_at[left], rows_at[~left]
                    if min(len(lo), len(hi)) < max(1, s.least_rows) or min(h[lo].sum(), h[hi].sum()) < s.least_weight:
                        continue
                    gain = round(worth(g[lo].sum(), h[lo].sum()) + worth(g[hi].sum(), h[hi].sum()) - worth(g[rows_at].sum(), h[rows_at].sum()), 10)
                    if gain > found[0]:
                        found = (gain, j, e)
            return found

        leaves = {1: np.arange(len(y))}
        while s.leaves is None or len(leaves) < s.leaves:
            open_ = [(-b[0], k, b) for k, at in leaves.items() if (s.depth is None or k.bit_length() - 1 < s.depth) and (b := best(at))[0] > s.least_gain]
            if not open_:
                break
            _, k, (_, j, e) = min(open_, key=lambda t: t[:2])
            at = leaves.pop(k)
            leaves[2 * k], leaves[2 * k + 1] = at[x[at, j] <= e], at[x[at, j] > e]
        values = {k: -soft(g[at].sum()) / (h[at].sum() + s.l2) * s.rate for k, at in leaves.items()}
        for k, at in leaves.items():
            margin[at] += values[k]
        out.append(sorted((len(at), round(values[k], 9)) for k, at in leaves.items()))
    return out


@pytest.mark.parametrize("settings", [
    boosting.Settings(rounds=3, leaves=7, least_rows=10, row_share=1.0, column_share=1.0, bins=32, l1=0.4, rate=0.3),
    boosting.Settings(rounds=2, leaves=None, depth=3, least_rows=1, least_weight=4.0, row_share=1.0, column_share=1.0, bins=64, least_gain=0.05, rate=0.3)], ids=["leaf-wise", "depth-wise"])
def test_trees_equal_a_plain_reimplementation(spark, settings):
    rows, df = table(spark)
    model = boosting.fit(df, FEATURES, settings=settings)
    train_all = [(*r[:6], False) for r in rows]
    got = [sorted((int(t.cover[i]), round(t.value[i], 9)) for i, f in enumerate(t.feature) if f < 0) for t in model.trees]
    assert got == plain_trees(train_all, settings, settings.rounds)
    assert all(len(t.feature) <= 2 * (settings.leaves or 8) - 1 for t in model.trees)


def test_rounds_stop_and_samples_repeat(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    _, df = table(spark)
    s = boosting.replace(boosting.LEAF_WISE, rounds=9, least_rows=5, leaves=4, rate=0.9, patience=2, bins=16)
    one, two = (boosting.fit(d, FEATURES, valid_flag="valid", settings=s, id_col="id") for d in (df, df.repartition(5)))
    assert len(one.trees) == int(np.argmin(one.losses)) and len(one.losses) - 1 - len(one.trees) in (s.patience, s.rounds - len(one.trees))
    assert np.allclose(one.losses, two.losses) and [t.feature for t in one.trees] == [t.feature for t in two.trees]
    boosting.save(spark, one, str(tmp_path / "m"))
    again = boosting.load(spark, str(tmp_path / "m"))
    scored = boosting.score(again, df)
    loss = evaluation.probability_metrics(scored.filter("valid"), "score", "click").first()["log_loss"]
    assert math.isclose(loss, min(one.losses), rel_tol=1e-6)
    gains = boosting.importance(spark, one).collect()
    assert math.isclose(sum(r["gain"] for r in gains), 1) and sum(r["splits"] for r in gains) == sum(f >= 0 for t in one.trees for f in t.feature)
    assert boosting.fit(df.filter("click = 1"), FEATURES).trees == [] and boosting.fit(df.limit(0), FEATURES).trees == []


def expectation(t, x, known, at=0):
    """A tree's expected value where only known features are looked at."""
    f = t.feature[at]
    if f < 0:
        return t.value[at]
    if f in known:
        return expectation(t, x, known, t.left[at] if x[f] <= t.threshold[at] else t.right[at])
    return sum(t.cover[c] / t.cover[at] * expectation(t, x, known, c) for c in (t.left[at], t.right[at]))


def test_contributions_equal_sums_over_subsets_and_add_up(spark):
    rows, df = table(spark, 300)
    s = boosting.Settings(rounds=3, leaves=9, least_rows=4, row_share=0.9, column_share=1.0, bins=16, rate=0.4)
    model = boosting.fit(df, FEATURES, settings=s, id_col="id")
    parts = boosting.contributions(model, df)
    got = {(r["id"], r["feature"]): r["contribution"] for r in parts.collect()}
    for r in rows[:25]:
        x = [0.0 if v is None or v != v else float(v) for v in r[1:5]]
        for i, name in enumerate(FEATURES):
            want, rest = 0.0, [j for j in range(4) if j != i]
            for k in range(4):
                for known in itertools.combinations(rest, k):
                    weight = math.factorial(k) * math.factorial(3 - k) / math.factorial(4)
                    want += weight * sum(expectation(t, x, {*known, i}) - expectation(t, x, set(known)) for t in model.trees)
            assert math.isclose(got[r[0], name], want, abs_tol=1e-10)
    assert models.check_additive(parts, boosting.score(model, df)).first()["max_error"] < 1e-9


def test_a_fit_reads_its_rows_once_and_a_tree_takes_as_many_passes_as_it_is_deep(spark, monkeypatch):
    _, df = table(spark)
    seen, passes, one = spark.sparkContext.accumulator(0), [], boosting._pass

    def watched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(boosting, "_pass", lambda *a: passes.append(1) or one(*a))
    s = boosting.Settings(rounds=3, leaves=None, depth=5, least_rows=1, least_weight=0.5, row_share=1.0, column_share=1.0, bins=64, rate=0.3)
    model = boosting.fit(df.mapInArrow(watched, df.schema), FEATURES, valid_flag="valid", settings=s)
    assert seen.value == 600 and len(passes) <= 3 * 5 + 1 and max(len(t.feature) for t in model.trees) > 25


def test_passes_of_blocks_hold_the_rows_of_one_partition_too(spark):
    rows, df = table(spark)
    ready = boosting.prepare(df.coalesce(1), FEATURES, bins=32)
    assert ready.blocks.getNumPartitions() == spark.sparkContext.defaultParallelism and ready.blocks.map(lambda b: len(b[1])).sum() == len(rows)
    ready.release()


@pytest.mark.parametrize("alone", [1, 60, 10**6])
def test_trees_are_the_same_whichever_nodes_one_task_finishes(spark, monkeypatch, alone):
    monkeypatch.setattr(boosting, "ALONE", alone)
    rows, df = table(spark)
    jobs, one, below = [], boosting._pass, boosting._below
    monkeypatch.setattr(boosting, "_pass", lambda *a: jobs.append("pass") or one(*a))
    monkeypatch.setattr(boosting, "_below", lambda *a: jobs.append("below") or below(*a))
    s = boosting.Settings(rounds=3, leaves=12, least_rows=5, row_share=1.0, column_share=1.0, bins=32, rate=0.3)
    model = boosting.fit(df.repartition(16), FEATURES, settings=s)
    got = [sorted((int(t.cover[i]), round(t.value[i], 9)) for i, f in enumerate(t.feature) if f < 0) for t in model.trees]
    assert got == plain_trees([(*r[:6], False) for r in rows], s, 3)
    if alone == 10**6:
        assert jobs == ["pass", "below"] * 3


def test_lineage_is_cut_and_its_files_go(spark, monkeypatch, tmp_path):
    _, df = table(spark)
    s = boosting.Settings(rounds=7, leaves=4, least_rows=5, bins=16, rate=0.3)
    whole = boosting.fit(df, FEATURES, valid_flag="valid", settings=s, id_col="id")
    monkeypatch.setattr(boosting, "CUT", 2)
    gone, one = [], boosting.tables.delete
    monkeypatch.setattr(boosting.tables, "delete", lambda session, path: gone.append(path) or one(session, path))
    cut = boosting.fit(df, FEATURES, valid_flag="valid", settings=s, id_col="id")
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    anew = boosting.fit(df, FEATURES, valid_flag="valid", settings=s, id_col="id")
    assert np.allclose(whole.losses, cut.losses, atol=1e-12) and np.allclose(whole.losses, anew.losses, atol=1e-12)
    assert len(gone) == 3 and all(not Path(p.removeprefix("file:")).exists() for p in gone)


def test_contributions_are_the_same_whether_games_are_played_once_or_by_row(spark, monkeypatch):
    rows, df = table(spark, 300)
    model = boosting.fit(df, FEATURES, settings=boosting.Settings(rounds=3, leaves=9, least_rows=4, column_share=1.0, bins=16, rate=0.4), id_col="id")
    x = np.array([[0.0 if v is None or v != v else v for v in r[1:5]] for r in rows], float)
    for t in model.trees:
        found = []
        for most in (boosting.WAYS, 0):
            with monkeypatch.context() as m:
                m.setattr(boosting, "WAYS", most)
                expected, games = boosting.tree_games(t)
            found.append(np.zeros(x.T.shape))
            boosting.tree_attribution(t, games, x, t.threshold, found[-1])
        assert np.allclose(*found, atol=1e-14) and np.allclose(expected + found[0].sum(axis=0), t.values(x, t.threshold))
