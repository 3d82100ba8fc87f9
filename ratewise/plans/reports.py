"""Queries of checks, samples, score reports, calibrators and models over the given tables; SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.functions import features
from ratewise.operators import calibration, checks, evaluation, history, models, quality, splits
from ratewise.plans.catalog import _E, _GRID, _L, BOUNDS, QUERIES, SQL, _add, events, lines
from ratewise.sources import tables

_SPLIT = "CASE WHEN date BETWEEN '2024-01-01' AND '2024-01-24' THEN 'train' WHEN date BETWEEN '2024-01-25' AND '2024-01-27' THEN 'valid' WHEN date BETWEEN '2024-01-28' AND '2024-01-30' THEN 'holdout' END"


def split_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("split", splits.split_of(F.col("ts"), BOUNDS)).dropna(subset=["split"])


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


_add("h9_fingerprint", f"WITH {_E} SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 12) AS BIGINT)) AS VARCHAR) AS fingerprint FROM e")(
    lambda s, d: checks.id_fingerprint(events(s, d)))
_add("h11_daily_distribution", f"""WITH {_E}, x AS (SELECT {_SPLIT} AS split, date, count(*) AS n_rows, CAST(sum(click) AS BIGINT) AS clicks, round(avg(click), 9) AS ctr FROM e GROUP BY ALL)
 SELECT *, round(n_rows / sum(n_rows) OVER (PARTITION BY split), 9) AS share_in_split FROM x WHERE split IS NOT NULL""")(lambda s, d: _rounded(checks.daily_distribution(split_events(s, d)), "ctr", "share_in_split"))
_add("h12_source_distribution", f"WITH {_E} SELECT bucket, count(*) AS group_rows, count(*) FILTER (click = 1) AS sampled_rows, round(count(*) FILTER (click = 1) / count(*), 9) AS ratio FROM e GROUP BY 1")(
    lambda s, d: _rounded(checks.source_distribution(events(s, d), events(s, d).filter("click = 1"), "bucket"), "ratio"))
_add("i4_label_values", f"WITH {_E}, x AS (SELECT count(*) FILTER (click IS NULL) AS a, count(*) FILTER (click NOT IN (0, 1)) AS b FROM e), y AS (SELECT unnest(['label_null', 'label_other']) AS \"check\", unnest([a, b]) AS bad FROM x) SELECT \"check\", 'events' AS subject, CASE WHEN bad = 0 THEN 'PASS' ELSE 'ERROR' END AS status, CAST(bad AS VARCHAR) AS observed, '0' AS expected FROM y")(
    lambda s, d: checks.check_values(events(s, d), checks.label_rules(), "events"))
_add("i10_category_summary", f"""WITH {_L}, x AS (SELECT 'l_suppkey' AS feature_name, CAST(l_suppkey AS VARCHAR) AS feature_value, count(click) AS impressions, CAST(sum(click) AS BIGINT) AS clicks, avg(click) AS ctr FROM l GROUP BY 2
 UNION ALL SELECT 'l_linestatus', l_linestatus, count(click), CAST(sum(click) AS BIGINT), avg(click) FROM l GROUP BY 2)
 SELECT feature_name, feature_value, impressions, clicks, round(ctr, 9) AS ctr FROM x QUALIFY row_number() OVER (PARTITION BY feature_name ORDER BY impressions DESC, feature_value NULLS FIRST) <= 20""")(
    lambda s, d: _rounded(checks.category_rate_summary([quality.category_rates(lines(s, d), c) for c in ("l_suppkey", "l_linestatus")]), "ctr"))
_STAT = "SELECT {s} AS split, '{c}' AS feature, count(*) - count({c}) AS missing_count, count(*) FILTER (isinf(CAST({c} AS DOUBLE))) AS inf_count, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 9) AS mean, count(*) FILTER (NOT {c} BETWEEN 0 AND 1) AS invalid_count FROM e GROUP BY 1"
_add("i15_column_stats", f"""WITH {_E}, x AS ({_STAT.format(s=_SPLIT, c="score")} UNION ALL {_STAT.format(s=_SPLIT, c="bucket")})
 SELECT *, CASE WHEN invalid_count > 0 THEN 'ERROR' WHEN missing_count > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM x WHERE split IS NOT NULL""")(lambda s, d: _rounded(checks.column_stats(split_events(s, d), ["score", "bucket"]), "mean"))
_add("i18_cold_start", f"WITH {_E} SELECT count(*) AS n_rows, count(*) FILTER (EXISTS (SELECT 1 FROM e p WHERE p.date < e.date AND p.site IS NOT DISTINCT FROM e.site)) AS known FROM e WHERE date = (SELECT min(date) FROM e)")(
    lambda s, d: checks.cold_start(history.add_history(events(s, d), "site"), ["site_hist_impressions", "site_hist_clicks", "site_exposure_percentile"]))
_add("i19_mapping_consistent", f"WITH {_E}, x AS (SELECT site, count(DISTINCT bucket) + max(CASE WHEN bucket IS NULL THEN 1 ELSE 0 END) > 1 AS b, count(DISTINCT click) + max(CASE WHEN click IS NULL THEN 1 ELSE 0 END) > 1 AS c FROM e GROUP BY 1) SELECT unnest(['bucket', 'click']) AS feature, unnest([a, b]) AS keys FROM (SELECT count(*) FILTER (b) AS a, count(*) FILTER (c) AS b FROM x)")(
    lambda s, d: checks.mapping_consistent(events(s, d), "site", ["bucket", "click"]))
_Q = ", ".join(f"round(quantile_cont(score, {p / 100}), 9) AS p{p}" for p in evaluation.PERCENTS)
_add("k7_score_summary", f"WITH {_L} SELECT count(*) AS n_rows, CAST(sum(click) AS BIGINT) AS clicks, round(avg(click), 9) AS ctr, round(avg(score), 9) AS mean_score, {_Q}, (SELECT auc FROM ({SQL['k2_auc']})) AS auc, (SELECT average_precision FROM ({SQL['k5_average_precision']})) AS average_precision, (SELECT log_loss FROM ({SQL['k3_k4_probability']})) AS log_loss, (SELECT brier FROM ({SQL['k3_k4_probability']})) AS brier FROM l")(
    lambda s, d: _rounded(evaluation.score_summary(lines(s, d)), "ctr", "mean_score", *[f"p{p}" for p in evaluation.PERCENTS], "auc", "average_precision", "log_loss", "brier"))
_add("m7_operating_points", SQL["m3_thresholds"].replace("WITH l AS", "WITH m AS (WITH l AS", 1) + """), g AS (SELECT unnest([
 {'point': 'max_f1', 'goal': f1, 'ok': true}, {'point': 'max_youden_j', 'goal': youden_j, 'ok': true}, {'point': 'recall_80', 'goal': "precision", 'ok': recall >= 0.8}, {'point': 'recall_90', 'goal': "precision", 'ok': recall >= 0.9},
 {'point': 'precision_25', 'goal': recall, 'ok': "precision" >= 0.25}, {'point': 'coverage_10', 'goal': -abs(coverage - 0.1), 'ok': true}, {'point': 'coverage_20', 'goal': -abs(coverage - 0.2), 'ok': true}]) AS x, * FROM m),
 r AS (SELECT x.point AS point, x.ok AS feasible, threshold, "precision", recall, f1, coverage, row_number() OVER (PARTITION BY x.point ORDER BY x.ok DESC, round(x.goal, 9) DESC, threshold DESC) AS k FROM g)
 SELECT point, feasible, CASE WHEN feasible THEN threshold END AS threshold, CASE WHEN feasible THEN "precision" END AS "precision", CASE WHEN feasible THEN recall END AS recall, CASE WHEN feasible THEN f1 END AS f1, CASE WHEN feasible THEN coverage END AS coverage FROM r WHERE k = 1""")(
    lambda s, d: evaluation.operating_points(_rounded(evaluation.threshold_metrics(lines(s, d), _GRID), "precision", "recall", "f1", "coverage", "youden_j")))
_BINS = "b AS (SELECT count(*) AS n, abs(avg(score) - avg(click)) AS gap FROM (SELECT *, ntile(20) OVER (ORDER BY score, id DESC) AS grp FROM e) GROUP BY grp)"
_add("l6_ece_mce", f"WITH {_E}, {_BINS} SELECT round(sum(gap * n) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM b")(
    lambda s, d: calibration.ece_mce(evaluation.score_groups(events(s, d), 20, True)).select(F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce")))

FEATURES = ["bucket", "hour_sin", "hour_cos", "site_hist_ctr", "site_exposure_percentile"]


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split events with the features of a model."""
    sin, cos = features.hour_cyclic(F.hour("ts"))
    x = history.add_history(split_events(spark, sf_dir), "site")
    return x.withColumns({"hour_sin": sin, "hour_cos": cos}).select("id", "click", "split", *FEATURES)


def _trained(spark: SparkSession, sf_dir: str):
    rows = tables.staged(model_rows(spark, sf_dir), "rows")
    return rows, models.fit_logistic(rows.filter("split = 'train'"), FEATURES)


def j7_logistic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression fitted on the training dates, every row scored."""
    rows, model = _trained(spark, sf_dir)
    return models.score(model, rows, FEATURES).select("id", "split", "click", "score")


def j8_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.coefficients(spark, _trained(spark, sf_dir)[1], FEATURES)


def j9_tree_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on training dates, rounds stopped on the validation dates."""
    rows = model_rows(spark, sf_dir).filter("split <> 'holdout'").withColumn("is_valid", F.col("split") == "valid")
    return models.tree_importance(spark, models.fit_boosted(rows, FEATURES, valid_flag="is_valid"), FEATURES)


def l7_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw, sigmoid and isotonic scores, fitted on the training dates and measured on the others."""
    rows = split_events(spark, sf_dir)
    fit, rest = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    rest = calibration.apply_isotonic(calibration.fit_isotonic(fit), calibration.apply_sigmoid(calibration.fit_sigmoid(fit), rest))
    return calibration.calibration_metrics(rest, {"raw": "score", "sigmoid": "sigmoid", "isotonic": "isotonic"})


def k9_compare_calibrators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.compare_models(l7_calibration(spark, sf_dir))


def n3_global_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _trained(spark, sf_dir)
    return models.global_importance(models.linear_contributions(model, rows, FEATURES))


def n5_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.find_cases(j7_logistic_scores(spark, sf_dir), 0.2)


QUERIES |= {f.__name__: f for f in (j7_logistic_scores, j8_coefficients, j9_tree_importance, l7_calibration, k9_compare_calibrators, n3_global_importance, n5_cases)}
