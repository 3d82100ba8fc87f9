"""Queries of boosted trees, their attribution and search, averaged descent, and history at any date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.functions import features
from ratewise.operators import averaged, boosting, evaluation, history, models, search
from ratewise.plans.catalog import _E, _L, _add, events, lines
from ratewise.plans.reports import _rounded, split_events
from ratewise.plans.workflow import QUERIES, SQL
from ratewise.sources import tables

FEATURES = ["score", "user_id", "hour_sin", "hour_cos", "site_hist_ctr", "site_exposure_percentile"]


def noisy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split events with features, a label that follows the value but for one row in five, and a flag of the validation dates."""
    x = history.add_history(split_events(spark, sf_dir), "site")
    sin, cos = features.hour_cyclic(F.hour("ts"))
    flip = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    high = F.coalesce(F.col("bucket") >= 1, F.lit(False))
    return x.withColumns({"hour_sin": sin, "hour_cos": cos, "click": (high != flip).cast("int"), "is_valid": F.col("split") == "valid"}).select("id", "click", "split", "is_valid", *FEATURES)


def _fitted(spark: SparkSession, sf_dir: str, settings: boosting.Settings) -> tuple[DataFrame, boosting.Boosted]:
    rows = tables.staged(noisy_rows(spark, sf_dir), "rows")
    return rows, boosting.fit(rows.filter("split <> 'holdout'"), FEATURES, valid_flag="is_valid", settings=settings, id_col="id")


def j5_leaf_wise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of the features in trees of the leaf-wise baseline setting, stopped on the validation dates."""
    return boosting.importance(spark, _fitted(spark, sf_dir, boosting.LEAF_WISE)[1])


def j5_depth_wise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout scores of trees of the depth-wise baseline setting."""
    rows, model = _fitted(spark, sf_dir, boosting.DEPTH_WISE)
    return boosting.score(model, rows.filter("split = 'holdout'")).select("id", "click", "score")


def n1_tree_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global importance from exact contributions of every holdout row, with the largest error of their sums."""
    rows, model = _fitted(spark, sf_dir, boosting.LEAF_WISE)
    rest = rows.filter("split = 'holdout'")
    parts = tables.staged(boosting.contributions(model, rest), "contributions")
    return models.global_importance(parts).join(F.broadcast(models.check_additive(parts, boosting.score(model, rest))))


def j6_parzen_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four trials of three rounds; from the third on they are drawn by the densities of the earlier ones."""
    rows = noisy_rows(spark, sf_dir).filter("split <> 'holdout'")
    base = boosting.replace(boosting.LEAF_WISE, rounds=3, patience=3)
    return search.search(rows, FEATURES, "is_valid", 4, id_col="id", base=base, sampler=search.Sampler(seed=1, first=2))[0]


def j4_averaged_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC and losses of averaged descent on the holdout dates."""
    rows = noisy_rows(spark, sf_dir)
    scored = averaged.score(averaged.fit(rows.filter("split = 'train'"), FEATURES), rows.filter("split = 'holdout'"))
    return evaluation.score_summary(scored).select("n_rows", "ctr", "mean_score", "auc", "log_loss", "brier")


QUERIES |= {f.__name__: f for f in (j5_leaf_wise, j5_depth_wise, n1_tree_contributions, j6_parzen_search, j4_averaged_descent)}


def g4_history_at_any_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their site's history as of two days later: a date of its own, on which the site need not occur."""
    e = events(spark, sf_dir)
    asked = e.select("id", "site", F.date_format(F.date_add("ts", 2), "yyyy-MM-dd").alias("date"))
    found = history.look_up_history(asked, history.history_intervals(history.daily_key_stats(e, "site"), "site"), "site")
    return _rounded(found, "site_hist_ctr").select("id", "site_hist_impressions", "site_hist_clicks", "site_hist_ctr")


_add("g4_history_at_any_date", f"""WITH {_E}, d AS (SELECT site, date, count(click) AS n, sum(click) AS c FROM e GROUP BY ALL), q AS (SELECT DISTINCT site, strftime(ts + INTERVAL 2 DAY, '%Y-%m-%d') AS at FROM e),
 p AS (SELECT q.site, q.at, CAST(sum(n) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS c FROM q JOIN d ON d.site IS NOT DISTINCT FROM q.site AND d.date < q.at GROUP BY ALL)
 SELECT id, coalesce(n, 0) AS site_hist_impressions, coalesce(c, 0) AS site_hist_clicks, round(coalesce(c / nullif(n, 0), 0), 9) AS site_hist_ctr FROM e LEFT JOIN p ON p.site IS NOT DISTINCT FROM e.site AND p.at = strftime(ts + INTERVAL 2 DAY, '%Y-%m-%d')""")(g4_history_at_any_date)
_add("e7_finite_or_zero", """WITH x AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN '-Infinity'::DOUBLE WHEN 3 THEN 'NaN'::DOUBLE ELSE value END AS v FROM events)
 SELECT id, round(CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0 ELSE v END, 3) AS v FROM x""")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.round(features.finite_or_zero(
        F.expr("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN double('Infinity') WHEN 2 THEN double('-Infinity') WHEN 3 THEN double('NaN') ELSE value END")).cast("double"), 3).alias("v")))
_add("e6_hour_cosine", f"WITH {_E} SELECT id, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_cos FROM e")(
    lambda s, d: events(s, d).select("id", (F.round(features.hour_cyclic(F.hour("ts"))[1], 6) + 0.0).alias("hour_cos")))


#: A second model's score, in another order than the first's: the distance from 0.3.
_OTHER = "abs(score - 0.3)"


def _two_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines(spark, sf_dir)
    both = [evaluation.model_metrics(x.withColumn("score", F.round(c, 9)), n) for n, c in (("base", F.col("score")), ("far", F.expr(_OTHER)))]
    return both[0].unionByName(both[1])


def _metrics_sql(name: str, score: str) -> str:
    q = "greatest(least(score, 1 - 1e-7), 1e-7)"
    return f"""{name}_l AS (SELECT click, round({score}, 9) AS score FROM l), {name}_s AS (SELECT score, count(*) AS n, sum(click) AS c FROM {name}_l GROUP BY 1),
 {name}_a AS (SELECT *, coalesce(sum(c) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ca FROM {name}_s),
 {name} AS (SELECT '{name}' AS model, (SELECT sum((n - c) * (ca + c / 2)) / (CAST(sum(c) AS DOUBLE) * sum(n - c)) FROM {name}_a) AS auc, avg(-ln(CASE WHEN click = 1 THEN {q} ELSE 1 - {q} END)) AS log_loss, abs(avg(score) - avg(click)) AS calibration_gap FROM {name}_l)"""


_BOTH = f"WITH {_L}, {_metrics_sql('base', 'score')}, {_metrics_sql('far', _OTHER)}, m AS (SELECT * FROM base UNION ALL SELECT * FROM far)"
_GAIN = ["auc_gain", "auc_gain_percent", "log_loss_reduction", "log_loss_reduction_percent", "gap_reduction", "gap_reduction_percent"]
_add("k11_two_orders", f"""{_BOTH} SELECT m.model, round(m.auc - b.auc, 8) + 0.0 AS auc_gain, round(100 * (m.auc - b.auc) / b.auc, 6) + 0.0 AS auc_gain_percent, round(b.log_loss - m.log_loss, 8) + 0.0 AS log_loss_reduction, round(100 * (b.log_loss - m.log_loss) / b.log_loss, 6) + 0.0 AS log_loss_reduction_percent,
 round(b.calibration_gap - m.calibration_gap, 8) + 0.0 AS gap_reduction, round(100 * (b.calibration_gap - m.calibration_gap) / b.calibration_gap, 6) + 0.0 AS gap_reduction_percent FROM m, base b""")(
    lambda s, d: evaluation.relative_improvement(_two_orders(s, d), "base").select("model", *[(F.round(c, 6 if c.endswith("percent") else 8) + 0.0).alias(c) for c in _GAIN]))
_add("k12_two_orders", f"""{_BOTH} SELECT 'auc' AS criterion, arg_max(model, auc) AS model, round(max(auc), 8) AS value FROM m UNION ALL SELECT 'log_loss', arg_min(model, log_loss), round(min(log_loss), 8) FROM m UNION ALL SELECT 'calibration_gap', arg_min(model, calibration_gap), round(min(calibration_gap), 8) FROM m""")(
    lambda s, d: evaluation.best_per_metric(_two_orders(s, d)).withColumn("value", F.round("value", 8)))
_add("k10_priority", f"""{_BOTH} SELECT model, CAST(rank() OVER (ORDER BY auc DESC) AS INTEGER) AS auc_rank, CAST(rank() OVER (ORDER BY log_loss) AS INTEGER) AS log_loss_rank, CAST(rank() OVER (ORDER BY calibration_gap) AS INTEGER) AS gap_rank,
 CAST(row_number() OVER (ORDER BY auc DESC, log_loss, calibration_gap, model) AS INTEGER) AS priority_rank FROM m""")(
    lambda s, d: evaluation.compare_models_priority(_two_orders(s, d), "base").select("model", "auc_rank", "log_loss_rank", "gap_rank", "priority_rank"))
_BEST = "FILTER (k <= greatest(1, ceil(total * {c})))"
_add("m8_strategy", f"""WITH {_E}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k, count(*) OVER () AS total FROM e)
 SELECT 'raw' AS method, count(*) AS n_rows, CAST(sum(click) AS BIGINT) AS clicks, round(avg(click), 9) AS ctr, {", ".join(f"round(avg(click) {_BEST.format(c=c)}, 9) AS top_{round(100 * c)}_ctr, round(CAST(sum(click) {_BEST.format(c=c)} AS DOUBLE) / sum(click), 9) AS top_{round(100 * c)}_capture" for c in (0.01, 0.05, 0.1, 0.2))} FROM r""")(
    lambda s, d: _rounded(evaluation.strategy_summary(e := events(s, d), "raw", evaluation.threshold_metrics(e, [0.1, 0.2, 0.4])), "ctr", *[f"top_{p}_{m}" for p in (1, 5, 10, 20) for m in ("ctr", "capture")])
    .select("method", "n_rows", "clicks", "ctr", *[f"top_{p}_{m}" for p in (1, 5, 10, 20) for m in ("ctr", "capture")]))
