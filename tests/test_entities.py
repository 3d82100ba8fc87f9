"""History and encoding of several keys in one plan, against the operators of one key and plain sums; saved models; scores by method."""

import random

import pytest
from pyspark.sql import functions as F

from ratewise.operators import calibration, entities, history, models
from ratewise.plans import reports

KEYS = ["k", "n", "user_id"]
SCHEMA = "id long, k string, n int, user_id long, date string, click int, saved_key string, te double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [
        (i, rng.choice(["a", "a", "a", "n", None, ""]), rng.choice([1, 2, None]), rng.choice([7, 8, 9, 10]), rng.choice([None, *[f"2024-01-{d:02d}" for d in (2, 3, 5, 9)]]), rng.choice([0, 0, 1, None]), "mine", 0.5)
        for i in range(300)
    ]
    return spark.createDataFrame(data, SCHEMA).checkpoint()


COLUMNS = [*history.HISTORY, "te"]


def values(df, key):
    names = [f"{key}_{c}" for c in COLUMNS]
    return {r["id"]: tuple(None if r[c] is None else round(r[c], 9) for c in names) for r in df.select("id", *names).collect()}


def test_by_date_equals_the_operators_of_one_key_and_plain_sums(spark, rows, tmp_path):
    found = entities.add_keys(rows, KEYS, str(tmp_path))
    assert found.columns == [*rows.columns, *[f"{k}_{c}" for k in KEYS for c in COLUMNS]]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == len(KEYS) and "hashpartitioning" not in plan
    plain = rows.collect()
    for key in KEYS:
        got = values(found, key)
        assert got == values(history.add_target_encoding(history.add_history(rows, key), key), key)
        for r in plain:
            past = [q for q in plain if r["date"] and q["date"] and q["date"] < r["date"] and q["click"] is not None]
            mine = [q["click"] for q in past if q[key] == r[key]]
            assert got[r["id"]][:2] == (len(mine), sum(mine))
            if r["date"]:
                prior = sum(q["click"] for q in past) / len(past) if past else 0.17
                assert got[r["id"]][4] == pytest.approx((sum(mine) + 20 * prior) / (len(mine) + 20), abs=1e-8)
            else:
                assert got[r["id"]] == (0, 0, 0.0, 0.0, None)


def test_later_split_equals_the_operators_of_one_key(spark, rows, tmp_path):
    dated = rows.dropna(subset=["date"])
    train, valid = dated.filter("date < '2024-01-05'"), dated.filter("date = '2024-01-05'")
    rest = dated.filter("date = '2024-01-09'").unionByName(spark.createDataFrame([(999, "new", 5, None, "2024-01-09", None, "", None)], SCHEMA))
    for name, part in (("train", train), ("valid", valid)):
        entities.save_daily_sums(part, KEYS, f"{tmp_path}/{name}")
    found = entities.add_keys_split(rest, [f"{tmp_path}/train", f"{tmp_path}/valid"], KEYS, str(tmp_path))
    for key in KEYS:
        want = history.add_te_split(history.add_history_split(rest, [train, valid], key), [train, valid], key)
        assert values(found, key) == values(want, key)
    assert values(found, "k")[999][:4] == (0, 0, 0.0, 0.0)


def test_appended_days_equal_a_rebuild(spark, rows, tmp_path):
    entities.save_daily_sums(rows.filter("date < '2024-01-05'"), KEYS, f"{tmp_path}/days")
    entities.save_daily_sums(rows.filter("date >= '2024-01-05'"), KEYS, f"{tmp_path}/days", mode="append")
    entities.save_maps_by_date(spark, f"{tmp_path}/days", f"{tmp_path}/map")
    again, whole = entities.look_up(rows, f"{tmp_path}/map", KEYS, "date"), entities.add_keys(rows, KEYS, f"{tmp_path}/whole")
    assert all(values(again, k) == values(whole, k) for k in KEYS)


def test_empty_tables_and_no_keys(spark, rows, tmp_path):
    empty = rows.filter("false")
    assert entities.add_keys(empty, KEYS, f"{tmp_path}/e").count() == 0
    later = entities.add_keys_split(rows, [f"{tmp_path}/e/daily"], KEYS, f"{tmp_path}/l")
    assert set(values(later, "k").values()) == {(0, 0, 0.0, 0.0, 0.17)} and later.count() == 300
    with pytest.raises(ValueError, match="no key"):
        entities.add_keys(rows, [], f"{tmp_path}/n")


def test_saved_model_scores_alike(spark, tmp_path):
    rows = reports.model_rows(spark, "/root/testdata/sf0.001")
    model = models.fit_logistic(rows.filter("split = 'train'"), reports.FEATURES)
    models.save_model(model, str(tmp_path / "m"))
    score = lambda m: {r["id"]: r["score"] for r in models.score(m, rows, reports.FEATURES).collect()}
    assert score(models.load_model(str(tmp_path / "m"))) == score(model)


def test_scores_by_method(spark):
    df = spark.createDataFrame([(1, 0, 0.2, None), (2, 1, 0.7, 0.9)], "id long, click int, a double, b double")
    got = calibration.scores_long(df, {"raw": "a", "sigmoid": "b"}, ["id", "click"])
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:3]) == [(1, 0, "raw", 0.2), (1, 0, "sigmoid", None), (2, 1, "raw", 0.7), (2, 1, "sigmoid", 0.9)]
    assert got.groupBy("method").agg(F.count("score").alias("n")).count() == 2
