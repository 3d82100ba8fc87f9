"""The sampler of settings on a fixed loss surface, the pruning rule, and a small search."""

import json
import math
import random

import numpy as np

from ratewise.operators import boosting, search


def surface(p):
    """A bowl on the scales of the draws with one narrow direction; the best is at neither end."""
    part = lambda name, want, weight: weight * ((search.SPACE[name].at(p[name]) - search.SPACE[name].at(want)) / (search.SPACE[name].bounds()[1] - search.SPACE[name].bounds()[0])) ** 2
    return part("rate", 0.05, 8) + part("depth", 7, 1) + part("least_rows", 60, 4) + part("l2", 0.1, 2) + part("row_share", 0.8, 1)


def best(first, seed, trials=60):
    sampler = search.Sampler(seed=seed, first=first)
    for _ in range(trials):
        p = sampler.ask()
        sampler.tell(p, surface(p))
    return min(loss for loss, _ in sampler.told), sampler


def test_learns_more_than_even_draws():
    learned, even = [best(10, s)[0] for s in range(12)], [best(10**9, s)[0] for s in range(12)]
    assert np.median(learned) < 0.6 * np.median(even) and sum(a < b for a, b in zip(learned, even, strict=True)) >= 9


def test_draws_lie_in_their_ranges_and_repeat():
    _, one = best(5, 3, 80)
    _, two = best(5, 3, 80)
    assert one.told == two.told and len(one.space) == 9
    for _, p in one.told:
        assert all(r.low <= p[n] <= r.high for n, r in search.SPACE.items()) and p["leaves"] <= min(128, 2 ** p["depth"])
        assert all(isinstance(p[n], int) for n in ("depth", "leaves", "least_rows"))
    depths = [p["depth"] for _, p in best(10**9, 1, 2000)[1].told]
    assert min(depths.count(d) for d in range(5, 13)) > 180  # the ends are as likely as the rest


def test_a_density_is_one_over_its_range():
    d = search.Density([0.1, 0.12, 0.9], 0.0, 1.0)
    x = np.linspace(0, 1, 20001)
    assert math.isclose(np.exp(d.log(x)).mean(), 1, rel_tol=1e-3) and d.log(np.array([0.11])) > d.log(np.array([0.5]))


def test_lagging_trials_end():
    lag = search.Lagging(trials=2, rounds=3)
    lag.curves = [[5, 4, 3, 2, 1], [5, 5, 4, 4, 3], [9, 9]]
    assert not lag([9, 9, 9]) and lag([9, 9, 9, 9]) and not lag([9, 9, 9, 2.5]) and not lag([9, 9, 9, 2, 9, 9])


def test_search_finds_its_best_trial(spark):
    rng = random.Random(4)
    rows = [(i, a := rng.randint(0, 9), b := rng.random(), int(rng.random() < 0.15 + 0.6 * (a > 5) * (b > 0.4)), i % 3 == 0) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, a int, b double, click int, valid boolean")
    trials, model = search.search(df, ["a", "b"], "valid", 3, id_col="id", base=boosting.replace(boosting.LEAF_WISE, rounds=4, bins=16))
    rows = sorted(trials.collect(), key=lambda r: r["rank"])
    assert [r["log_loss"] for r in rows] == sorted(r["log_loss"] for r in rows) and len(model.trees) == rows[0]["best_round"]
    assert all(set(json.loads(r["params"])) == set(search.SPACE) for r in rows) and rows[0]["auc"] > 0.6


def test_trials_share_the_rows_bins(spark, monkeypatch):
    prepared, one = [], boosting.prepare
    monkeypatch.setattr(boosting, "prepare", lambda *a: prepared.append(one(*a)) or prepared[-1])
    df = spark.createDataFrame([(i, i % 10, int(i % 10 > 5) ^ (i % 7 == 0), i % 3 == 0) for i in range(300)], "id long, a int, click int, valid boolean")
    trials, _ = search.search(df, ["a"], "valid", 3, id_col="id", base=boosting.replace(boosting.LEAF_WISE, rounds=2, bins=16))
    assert trials.count() == 3 and len(prepared) == 1
