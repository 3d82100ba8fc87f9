"""Ranks, running sums, samples and score segments over many ranges, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ratewise.operators import evaluation, ranking, rates, splits


@pytest.fixture
def many_ranges(monkeypatch):
    monkeypatch.setattr(ranking, "SAMPLED", 2)
    monkeypatch.setattr(ranking, "KEPT", 2)


def test_ranges_follow_the_order_and_grow_with_the_rows(spark, many_ranges):
    for n in (40, 2000):
        x = ranking.with_range(spark.range(n).select(F.md5(F.col("id").cast("string")).alias("x")).unionByName(spark.createDataFrame([(None,)], "x string")), "x").collect()
        pairs = sorted((r["x"], r["_range"]) for r in x if r["x"] is not None)
        assert [r for _, r in pairs] == sorted(r for _, r in pairs) and {r["_range"] for r in x if r["x"] is None} == {-1}
        assert n / 10 < len({r for _, r in pairs}) < n / 2


def test_bounds_run_no_job_before_the_query_and_shuffle_no_values(spark):
    tracker = spark.sparkContext.statusTracker()
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    spark.sparkContext.setJobGroup("build", "")
    ranking.with_place(df, "g", "id")
    evaluation.topk_metrics(df.select("id", F.col("g").alias("click"), (F.col("id") / 7).alias("score")))
    splits.stratified_split(df, "g", 0.5)
    assert list(tracker.getJobIdsForGroup("build")) == []
    spark.sparkContext.setJobGroup("", "")


def test_running_sums_and_places(spark, many_ranges):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", None, "b"]), rng.randint(0, 9)) for i in rng.sample(range(10_000), 400)] + [(None, "a", 4)]
    df = spark.createDataFrame(rows, "x long, g string, v int")
    for down in (False, True):
        order = sorted(rows, key=lambda r: (r[0] is None, -r[0] if r[0] is not None else 0) if down else (r[0] is not None, r[0] or 0))
        sums, want = {}, {}
        for x, g, v in order:
            want[x] = sums.get(g, 0)
            sums[g] = want[x] + v
        assert {r["x"]: r["v_before"] for r in ranking.with_running(df, "x", ["v"], down, "g").collect()} == want
    place, want = {}, {}
    for x, g, _ in sorted(rows[:-1]):
        want[x] = place[g] = place.get(g, 0) + 1
    assert {r["x"]: r["place"] for r in ranking.with_place(df.dropna(subset=["x"]), "g", "x").collect()} == want


@pytest.mark.parametrize("scores", [[0.5], [0.1, 0.2, 0.3], [i / 1000 for i in range(1000)]])
def test_topk_and_groups_with_ties(spark, many_ranges, scores):
    """One score for all rows, few scores, nearly distinct ones; ties are cut by id."""
    rng = random.Random(5)
    rows = [(i, rng.choice(scores), rng.randint(0, 1)) for i in range(333)]
    df = spark.createDataFrame(rows, "id long, score double, click int")
    ranked = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = {r["coverage"]: (r["rows"], r["clicks"], r["cutoff"]) for r in evaluation.topk_metrics(df).collect()}
    for c in evaluation.TOPK_COVERAGES:
        top = ranked[: max(1, -int(-(333 * c) // 1))]
        assert got[c] == (len(top), sum(r[2] for r in top), top[-1][1])
    for ascending in (False, True):
        order, at = ranked[::-1] if ascending else ranked, 0
        for r in sorted(evaluation.score_groups(df, 10, ascending).collect(), key=lambda r: r["grp"]):
            part = order[at : at + 333 // 10 + (r["grp"] <= 333 % 10)]
            at += len(part)
            assert (r["n_rows"], r["clicks"], r["min_score"], r["max_score"]) == (len(part), sum(x[2] for x in part), min(x[1] for x in part), max(x[1] for x in part))
        assert at == 333


def test_score_summary_equals_its_parts(spark, many_ranges):
    rng = random.Random(7)
    df = spark.createDataFrame([(round(rng.random(), 2), rng.choice([0, 0, 1])) for _ in range(500)], "score double, click int")
    one = evaluation.score_summary(df).first()
    assert abs(one["auc"] - evaluation.roc_auc(df).first()[0]) < 1e-12 and abs(one["average_precision"] - evaluation.average_precision(df).first()[0]) < 1e-12
    parts = evaluation.probability_metrics(df).first()
    assert abs(one["log_loss"] - parts["log_loss"]) < 1e-12 and abs(one["brier"] - parts["brier"]) < 1e-12 and one["n_rows"] == 500
    assert one["p50"] == df.agg(F.percentile("score", 0.5)).first()[0]


def test_samples_take_the_smallest_draws(spark, monkeypatch):
    """Quotas that end within a cell, at its end, at nothing and at all rows; a null group is a group of a stratified sample."""
    rows = [(i, "a" if i % 3 else None if i % 2 else "b") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string")
    draw = lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), str(i))
    for digits in (1, 4):
        monkeypatch.setattr(splits, "CELL_DIGITS", digits)
        for n in (0, 1, 7, 600, 900):
            assert {r["id"] for r in splits.simple_sample(df, n).collect()} == set(sorted(range(600), key=draw)[:n])
        got = splits.stratified_sample(df, "g", 90).collect()
        for g, k in (("a", 60), ("b", 15), (None, 15)):
            assert {r["id"] for r in got if r["g"] == g} == set(sorted((i for i, x in rows if x == g), key=draw)[:k])
        assert splits.stratified_split(df, "g", 0.35).filter("part = 'a'").count() == 210
    with pytest.raises(Exception, match="fewer than"):
        splits.stratified_sample(df, "g", 601).count()


def test_volume_ranks_share_the_best(spark, many_ranges):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([9, 7, 7, 7, 3, 1, 1])], "k int, impressions long")
    assert sorted((r["k"], r["impressions_rank"]) for r in rates.with_volume_rank(df).collect()) == [(0, 1), (1, 2), (2, 2), (3, 2), (4, 5), (5, 6), (6, 6)]
