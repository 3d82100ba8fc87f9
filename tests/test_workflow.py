"""Sources, SQL, ranks, later splits, checks and attribution on hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewise.functions import features
from ratewise.operators import calibration, checks, cleaning, evaluation, history, models, ranking, splits
from ratewise.plans import workflow
from ratewise.sources import sql, tables

DATA = "/root/testdata/sf0.001"


def test_sources_and_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", 0.5, "2024-01-01"), (2, None, 0.1, "2024-01-02")], "id long, click string, score double, date string")
    a.write.parquet(str(tmp_path / "a"))
    assert tables.read_events(spark, str(tmp_path / "a"), ["id"]).columns == ["id"]
    assert tables.read_many(spark, str(tmp_path / "a"), str(tmp_path / "a"), columns=["id", "score"]).count() == 4
    with pytest.raises(ValueError):
        tables.read_many(spark)
    tables.save_predictions(a, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["id", "click", "date", "probability"]
    tables.write_report_json(a.agg(F.struct(F.count("*").alias("n"), F.max("click").alias("c")).alias("r")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["r"]["n"] == 2
    tables.write_by_date(a, str(tmp_path / "d"), "date")
    assert spark.read.parquet(str(tmp_path / "d")).filter("date = '2024-01-02'").count() == 1
    assert tables.head_sample(a, 1).count() == 1
    tables.query_to_csv(spark, "SELECT :v AS v", str(tmp_path / "c"), {"v": 3})
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["v"] == "3"


def test_sql_files_and_catalog(spark, tmp_path):
    df = sql.register_events(spark.sql("SELECT timestamp'2024-01-01 05:06:07' AS hour_dt, true AS flag, 7 AS k UNION ALL SELECT null, null, 8"), "rw_t")
    assert sorted((r["k"], r["hour_dt"], r["flag"]) for r in df.collect()) == [(7, "2024-01-01 05:06:07", 1), (8, None, 0)]
    f = tmp_path / "q.sql"
    f.write_text("-- one; not a statement\nSELECT ';' AS a;\n/* two; it's * not / one */\nSELECT count(*) /* ; */ AS n FROM rw_t;\n/* ; */\n")
    assert [r.collect()[0][0] for r in sql.run_sql_file(spark, str(f))] == [";", 2]
    assert "rw_t" in sql.table_names(spark) and sql.table_columns(spark, "rw_t")[1] == ("flag", "int") and sql.row_count(spark, "rw_t") == 2
    with pytest.raises(ValueError):
        sql.row_count(spark, "rw_nothing")


def test_quarantine_keeps_raw_labels(spark, tmp_path):
    raw = spark.createDataFrame([(1, "0"), (2, " 1.0 "), (3, "x"), (4, "2"), (5, ""), (6, None), (7, " 1")], "id long, click_text string")
    parsed = raw.withColumn("click", cleaning.safe_int(F.col("click_text"), "tinyint"))
    good = cleaning.quarantine(parsed, cleaning.flag_invalid_label(F.col("click_text"), F.col("click")), str(tmp_path / "q"), {"click": "click_text"})
    assert sorted((r.id, r.click) for r in good.collect()) == [(1, 0), (2, 1), (5, None), (6, None), (7, 1)]
    assert sorted((r.id, r.click_raw) for r in spark.read.parquet(str(tmp_path / "q")).collect()) == [(3, "x"), (4, "2")]
    report = {(r.measure, r.column): r.n for r in cleaning.cleaning_report(raw.select(F.col("id").cast("string"), F.col("click_text").alias("click"), F.lit("14102103").alias("hour")), {"click": "tinyint"}, "hour", "id", "click").collect()}
    assert [report[k, "click"] for k in ("label_0", "label_1", "label_null", "label_other", "quarantined", "unparsed", "out_of_range")] == [1, 2, 3, 1, 2, 1, 0]
    assert {(r.side, r.column) for r in cleaning.compare_schemas(spark, ["a", "b"], ["b", "c", "d"], ("d",)).collect()} == {("a", "a"), ("b", "c")}


def test_ranks_with_one_score_for_most_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0.5 if i % 3 else float(np.round(rng.uniform(), 1)), int(rng.integers(0, 2))) for i in range(900)] + [(1000, 0.5, None)]
    df = spark.createDataFrame(rows, "id long, score double, click int")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = {r.id: (r["rank"], r.decile) for r in evaluation.with_score_rank(df).collect()}
    assert all(got[r[0]][0] == k + 1 for k, r in enumerate(order)) and sorted({d for _, d in got.values()}) == list(range(1, 11))
    labelled = [r for r in rows if r[2] is not None]
    pos, neg = [r[1] for r in labelled if r[2]], [r[1] for r in labelled if not r[2]]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert math.isclose(evaluation.roc_auc(df).first().auc, want)
    for values in ([3.0], [1.0, 2.0, 2.0, 10.0], list(rng.normal(size=701))):
        q = ranking.quantiles(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double"), "v", [0.0, 0.1, 0.5, 1.0]).first().q
        assert np.allclose(q, np.quantile(values, [0.0, 0.1, 0.5, 1.0]))
    assert ranking.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).collect() == []


def test_undefined_rates_are_null(spark):
    df = spark.createDataFrame([(0.2, 1), (0.4, 0), (0.4, None)], "score double, click int")
    r = {r.threshold: r for r in evaluation.threshold_metrics(df, [0.1, 0.9]).collect()}
    assert r[0.9].precision is None and r[0.9].lift is None and r[0.9].recall == 0 and r[0.1].tp + r[0.1].fp == 2 and r[0.1].npv is None
    assert evaluation.roc_auc(df.filter("click = 1")).first().auc is None
    grid = [r.threshold for r in evaluation.threshold_grid(df).collect()]
    assert grid == sorted(set(grid)) and 0.5 in grid and 0.95 in grid and 0.2 in grid


def test_history_of_two_keys_and_later_splits(spark):
    rows = [("a", "x", "2024-01-01", 1), ("a", None, "2024-01-02", 0), ("b", "x", "2024-01-02", 1), ("a", "x", "2024-01-03", 1), ("c", "y", "2024-01-03", 0)]
    df = spark.createDataFrame(rows, "site string, app string, date string, click int")
    both = history.add_target_encoding(history.add_history(history.add_history(df, "site"), "app"), "site")
    got = {(r.site, r.date): r for r in both.collect()}
    assert (got["a", "2024-01-03"].site_hist_impressions, got["a", "2024-01-03"].site_hist_clicks, got["a", "2024-01-03"].app_hist_impressions) == (2, 1, 2)
    assert got["a", "2024-01-01"].site_te == 0.17 and got["c", "2024-01-03"].site_hist_impressions == 0
    assert got["a", "2024-01-03"].site_exposure_percentile == 1.0  # seen twice, b once
    found = models.discover_features([*both.columns, "is_weekend", "C14_te"], deny=("C14_te",))
    assert "site_te" in found and "app_hist_ctr" in found
    late = history.add_te_split(history.add_history_split(spark.createDataFrame([("a",), ("z",), (None,)], "site string"), [df], "site"), [df], "site")
    r = {r.site: r for r in late.collect()}
    assert r["a"].site_hist_impressions == 3 and r["z"].site_hist_impressions == 0 and math.isclose(r["z"].site_te, 0.6) and math.isclose(r["a"].site_te, (2 + 20 * 0.6) / 23)
    m = models.build_matrix(both.withColumn("hour_of_day", F.lit(6)), ["site_hist_impressions", "site_te", "hour_sin"]).collect()
    assert all(math.isclose(r.hour_sin, 1.0) for r in m) and {round(r.site_hist_impressions, 4) for r in m} == {0.0, 0.6931, 1.0986}


def test_checks_that_fail(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "train", "2024-01-01"), (2, 1, "train", "2024-01-05"), (3, None, "valid", "2024-01-05")], "id long, click int, split string, date string")
    status = lambda x: {r.subject: r.status for r in x.collect()}
    assert status(checks.check_split_dates(df, ["train", "valid"])) == {"train": "PASS", "valid": "ERROR"}
    assert status(checks.check_stage_row_counts({"a": df, "b": df.filter("id > 1")})) == {"train": "ERROR", "valid": "PASS"}
    assert checks.check_strict_labels(df, "t").first().observed == "1: 3"
    with pytest.raises(ValueError):
        checks.verify_fingerprint(df, df.filter("id > 1"))
    assert status(checks.check_label_presence(spark, ["id", "click"], ["id", "click"])) == {"labelled": "PASS", "unlabelled": "ERROR"}
    assert status(checks.check_time_nulls({"t": df.withColumn("ts", F.lit(None).cast("timestamp"))})) == {"t": "WARNING"}
    df.write.parquet(str(tmp_path / "s"))
    stats = tables.table_stats(spark, {"s": str(tmp_path / "s")})
    assert status(checks.check_stage_tables(stats, ["s", "gone"])) == {"s": "PASS", "gone": "ERROR"}
    a = df.withColumn("p", F.col("id"))
    r = checks.positional_match(a, a.withColumn("id", F.when(F.col("id") == 2, 9).otherwise(F.col("id"))).filter("p < 3"), "p").first()
    assert (r.rows_a, r.rows_b, r.mismatches, r.first_mismatch) == (3, 2, 2, 2)
    assert {r.status for r in checks.check_submission_order(a, a, "p").collect()} == {"PASS"}
    scored = df.select("id", "click", F.lit(0.5).alias("score"))
    assert {r.check: r.status for r in checks.check_predictions(scored, 3, 0.4).collect()} == {"score_missing": "PASS", "score_range": "PASS", "id_null": "PASS", "label_null": "ERROR", "label_other": "PASS", "row_count": "PASS", "mean_score": "WARNING"}
    assert {r.check: r.status for r in checks.check_features(df, ["id", "click", "date"], "t").collect()} == {"feature_id": "PASS", "feature_click": "ERROR", "feature_date": "ERROR"}
    metrics = spark.createDataFrame([("m", 0.7, 0.4, 0.2, 0.01), ("n", float("nan"), 0.4, 0.2, 0.01)], "model string, auc double, log_loss double, brier double, calibration_gap double")
    assert status(checks.check_metrics(metrics)) == {"m": "PASS", "n": "ERROR"} and set(status(checks.check_metrics(metrics.drop("brier"))).values()) == {"ERROR"}
    assert {r.status for r in workflow.m9_check_strategy(spark, DATA).collect()} == {"PASS"}
    with pytest.raises(Exception, match="fewer than"):
        splits.stratified_sample(df, "click", 50).collect()


def test_calibration_split_and_checks(spark):
    df = spark.createDataFrame([(i, i % 4 == 0, i / 400) for i in range(400)], "id long, y boolean, score double").select("id", F.col("y").cast("int").alias("click"), "score")
    parts, row = calibration.calibration_split(df)
    counts = {(r.part, r.click): r["count"] for r in parts.groupBy("part", "click").count().collect()}
    assert counts == {("a", 1): 60, ("a", 0): 180, ("b", 1): 40, ("b", 0): 120} and row.first().status == "PASS"
    fit, rest = parts.filter("part = 'a'"), parts.filter("part = 'b'")
    metrics = calibration.calibration_metrics(calibration.apply_sigmoid(calibration.fit_sigmoid(fit), rest), {"raw": "score", "sigmoid": "sigmoid"})
    bins = evaluation.score_groups(rest, 20, True)
    assert {r.status for r in calibration.check_calibration(parts, df, metrics, bins).collect()} == {"PASS"}
    assert "ERROR" in {r.status for r in calibration.check_calibration(parts.unionByName(rest.withColumn("part", F.lit("a"))), df, metrics, bins).collect()}
    best = calibration.select_calibrator(metrics).first()
    assert best.method == "sigmoid" and best.log_loss_change < 0
    assert calibration.refit_selected(df, "raw") is None and calibration.refit_selected(df, "sigmoid").coefficients[0] is not None
    fell = df.withColumn("after", F.when(F.col("id") == 200, 0.0).otherwise(F.col("score")))
    assert calibration.check_monotone(fell, "score", "after").first().falls == 1


def test_attribution_groups_and_cases(spark):
    c = spark.createDataFrame([(1, "site_te", 0.5), (1, "app_freq", -0.2), (1, "hour_sin", 0.0), (2, "site_te", -0.1)], "id long, feature string, contribution double")
    cases = spark.createDataFrame([("true_positive", 1, 0.9), ("true_negative", 2, 0.1)], "case string, id long, score double")
    x = models.case_contributions(c, cases)
    assert [(r.feature, r.direction) for r in x.filter("case = 'true_positive'").orderBy("rank").collect()] == [("site_te", "increase"), ("app_freq", "decrease"), ("hour_sin", "neutral")]
    e = {r["case"]: (r.top_positive, r.top_negative) for r in models.case_extremes(x).collect()}
    assert e == {"true_positive": ("site_te", "app_freq"), "true_negative": (None, "site_te")}
    g = {r.entity: (r.feature_count, r.top_feature) for r in models.group_importance(models.global_importance(c.withColumn("value", F.lit(0.0))), "entity", ["site", "app"]).collect()}
    assert g == {"site": (1, "site_te"), "app": (1, "app_freq"), "time": (1, "hour_sin")}
    f = spark.createDataFrame([(n,) for n in ("x_te", "x_hist_ctr", "x_hist_impressions", "x_hist_clicks", "x_exposure_percentile", "x_freq", "is_weekend", "odd")], "n string")
    assert [r[0] for r in f.select(features.feature_family(F.col("n"))).collect()] == ["target_encoding", "historical_ctr", "historical_impressions", "historical_clicks", "exposure_percentile", "frequency", "time", "other"]
    v = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.5,)], "v double")
    assert [r[0] for r in v.select(features.finite_or_zero(F.col("v"))).collect()] == [0.0, 0.0, 0.0, 2.5]
