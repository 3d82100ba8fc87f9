"""History maps for any date and saved maps, against plain sums."""

import random

import pytest

from ratewise.operators import history


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    return [(i, rng.choice(["a", "a", "a", "b", None, "c"]), f"2024-01-{rng.choice([2, 3, 5, 9]):02d}", rng.choice([0, 0, 1, None])) for i in range(200)]


SCHEMA = "id long, k string, date string, click int"


def sums(rows, key, before=None):
    mine = [r for r in rows if r[1] == key and r[3] is not None and (before is None or r[2] < before)]
    return len(mine), sum(r[3] for r in mine)


def test_history_at_any_date_equals_plain_sums(spark, rows):
    daily = history.daily_key_stats(spark.createDataFrame(rows, SCHEMA), "k")
    intervals = history.history_intervals(daily, "k")
    assert intervals.count() == len({(r[1], r[2]) for r in rows})
    dates = ["2023-12-31", "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-09", "2024-02-01", None]
    asked = [(i, k, d) for i, (k, d) in enumerate((k, d) for k in ("a", "b", None, "new") for d in dates for _ in range(2))]
    df = spark.createDataFrame(asked, "id long, k string, date string")
    found = history.look_up_history(df, intervals, "k")
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: (r["k_hist_impressions"], r["k_hist_clicks"], r["k_hist_ctr"]) for r in found.collect()}
    assert len(got) == len(asked)
    for i, k, d in asked:
        n, c = sums(rows, k, d) if d else (0, 0)
        assert got[i] == (n, c, c / n if n else 0.0)


def test_adding_a_day_equals_a_rebuild_and_look_ups_leave_the_map_in_place(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    first, later = df.filter("date < '2024-01-05'"), df.filter("date >= '2024-01-05'")
    stats = lambda x: history.daily_key_stats(x, "k")
    history.save_history_map(stats(first), "k", "rw_map_1")
    history.add_days(spark, "rw_map_1", stats(later.unionByName(spark.createDataFrame([(900, "late", "2024-01-09", 1)], SCHEMA))), "k", "rw_map_2")
    history.save_history_map(stats(df.unionByName(spark.createDataFrame([(900, "late", "2024-01-09", 1)], SCHEMA))), "k", "rw_map_whole")
    read = lambda t: sorted(map(tuple, spark.table(t).select("saved_key", "k", "impressions", "clicks").collect()))
    try:
        assert read("rw_map_2") == read("rw_map_whole") and len(read("rw_map_1")) == 4
        asked = spark.createDataFrame([(1, "a"), (2, None), (3, "n"), (4, "late"), (5, "a")], "id long, k string")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = history.look_up_saved(asked, "rw_map_2", "k")
        got = {r["id"]: (r["k_hist_impressions"], r["k_hist_clicks"]) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert got == {1: sums(rows, "a"), 2: sums(rows, None), 3: (0, 0), 4: (1, 1), 5: sums(rows, "a")}
        assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount" in plan
        with pytest.raises(ValueError, match="written over"):
            history.add_days(spark, "rw_map_1", stats(later), "k", "rw_map_1")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("rw_map_1", "rw_map_2", "rw_map_whole"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_frequency_map_is_saved(spark, rows, tmp_path):
    history.save_frequency_map(spark.createDataFrame(rows, SCHEMA), "k", str(tmp_path / "f"))
    assert {r["k"]: r["frequency"] for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {k: sum(r[1] == k for r in rows) for k in "abc"}
