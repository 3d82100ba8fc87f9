"""Sources, cleaning reports, models and calibrators on the small tables and on hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewise.operators import calibration, checks, cleaning, models
from ratewise.plans import end_to_end, learned, reports
from ratewise.sources import tables

DATA = "/root/testdata/sf0.001"


def test_csv_round_trip_and_cleaning_report(spark, tmp_path):
    raw = spark.createDataFrame([("1", " 1.0", "14102103"), ("1", "0.5", "14102199"), ("2", " ", "14102100"), ("3", "NA", None), ("4", "300", "14102105")], "id string, click string, hour string")
    tables.write_table_csv(raw, str(tmp_path / "t"), ["hour", "id", "click"])
    back = tables.read_events_csv(spark, str(tmp_path / "t"), ["hour", "id", "click"], ("", "NA"))
    assert back.filter("click is null").count() == 1 and dict(back.dtypes)["click"] == "string"
    report = {(r.measure, r.column): r.n for r in cleaning.cleaning_report(back, {"click": "tinyint"}, "hour", "id").collect()}
    assert report["rows", None] == 5 and report["bad_hour", "hour"] == 1 and report["extra_ids", "id"] == 1
    assert report["lost", "click"] == 2 and report["nulls", "click"] == 1


def test_linear_contributions_add_up_to_the_score(spark):
    rows = reports.model_rows(spark, DATA)
    model = models.fit_logistic(rows.filter("split = 'train'"), reports.FEATURES)
    scored = models.score(model, rows, reports.FEATURES)
    parts = models.linear_contributions(model, rows, reports.FEATURES)
    assert models.check_additive(parts, scored).first().max_error < 1e-9
    shares = models.global_importance(parts).collect()
    assert sorted(r["rank"] for r in shares) == [1, 2, 3, 4, 5] and math.isclose(sum(r.percent for r in shares), 100)


def test_tree_importance_counts_splits_of_the_operators_own_settings(spark, monkeypatch):
    fitted, fit = [], models.fit_boosted
    monkeypatch.setattr(models, "fit_boosted", lambda *a, **k: fitted.append((fit(*a, **k), k)) or fitted[-1][0])
    rows = reports.j9_tree_importance(spark, DATA).collect()
    model, given = fitted[0]
    assert not {"rounds", "depth"} & set(given)
    assert sum(r["splits"] for r in rows) == sum((t.numNodes - 1) // 2 for t in model.stages[-1].trees) > 0
    assert all((r["splits"] > 0) >= (r["gain"] > 0) for r in rows)


def test_cases_are_the_extremes(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.9), (3, 0, 0.7), (4, 1, 0.1), (5, 0, 0.3), (6, 0, 0.2)], "id long, click int, score double")
    assert {r.case: r.id for r in models.find_cases(df, 0.5).collect()} == {"true_positive": 1, "false_positive": 3, "false_negative": 4, "true_negative": 6}


def test_calibrators_against_plain_fits(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.uniform(0.01, 0.99, 600), 2)
    y = (rng.uniform(size=600) < s**2).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y, strict=True))], "id long, score double, click int")
    out = calibration.apply_isotonic(calibration.fit_isotonic(df), calibration.apply_sigmoid(calibration.fit_sigmoid(df), df))
    assert calibration.check_monotone(out, "score", "isotonic").first().falls == 0
    pools = []  # pool adjacent violators, plainly
    for v in sorted(set(s)):
        pools.append([y[s == v].sum(), (s == v).sum(), [v]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
            a = pools.pop()
            pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2] + a[2]]
    want = {v: min(max(c / n, 1e-7), 1 - 1e-7) for c, n, vs in pools for v in vs}
    assert all(math.isclose(r.isotonic, want[r.score], abs_tol=1e-9) for r in out.collect())
    metrics = calibration.calibration_metrics(out, {"raw": "score", "sigmoid": "sigmoid", "isotonic": "isotonic"})
    loss = {r.method: r.log_loss for r in metrics.collect()}
    assert loss["isotonic"] < loss["sigmoid"] < loss["raw"] and calibration.select_calibrator(metrics).first().method == "isotonic"


def test_checks_find_bad_values(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (2, 2, 1.5), (None, None, float("nan"))], "id long, click int, score double")
    bad = {r.check: r.observed for r in checks.check_values(df, checks.prediction_rules(), "p").collect()}
    assert bad == {"score_missing": "1", "score_range": "2", "id_null": "1", "label_null": "1", "label_other": "1"}
    stats = checks.column_stats(df.select(F.lit("a").alias("split"), F.col("score").alias("x_te"), F.lit(float("inf")).alias("y_te")), ["x_te", "y_te"])
    assert {(r.feature, r.missing_count, r.inf_count, r.status) for r in stats.collect()} == {("x_te", 1, 0, "ERROR"), ("y_te", 0, 3, "ERROR")}


@pytest.mark.parametrize("name", sorted(set(end_to_end.QUERIES) - set(end_to_end.SQL)))
def test_runs(spark, name):
    assert end_to_end.QUERIES[name](spark, DATA).count() > 0


def _counted(spark, df):
    """df, and an accumulator of the rows that are computed for it."""
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(watched, df.schema), seen


@pytest.mark.parametrize("name", ["j11_score_models", "n3_global_importance", "n5_cases"])
def test_model_rows_are_computed_once(spark, monkeypatch, name):
    rows = reports.model_rows(spark, DATA)
    watched, seen = _counted(spark, rows)
    monkeypatch.setattr(reports, "model_rows", lambda *_: watched)
    assert end_to_end.QUERIES[name](spark, DATA).count() > 0 and seen.value == rows.count()


def test_rows_of_tree_contributions_are_computed_once(spark, monkeypatch):
    rows = learned.noisy_rows(spark, DATA)
    watched, seen = _counted(spark, rows)
    monkeypatch.setattr(learned, "noisy_rows", lambda *_: watched)
    found = learned.n1_tree_contributions(spark, DATA).collect()
    assert len(found) == len(learned.FEATURES) and found[0]["max_error"] < 1e-9 and seen.value == rows.count()
