"""Queries of registered tables, labels, later splits, samples, stage checks, threshold strategy and attribution over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.functions import features
from ratewise.operators import calibration, checks, cleaning, evaluation, history, models, rates, splits
from ratewise.plans import reports
from ratewise.plans.catalog import _E, _G, _L, BOUNDS, QUERIES, SQL, _add, _sql_query, events, lines
from ratewise.plans.reports import _SPLIT, _rounded, split_events
from ratewise.sources import sql, tables

_SE = f"{_E}, se AS (SELECT * FROM (SELECT *, {_SPLIT} AS split FROM e) WHERE split IS NOT NULL)"


def a8_registered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a view with text times and 0/1 flags, read by SQL with arguments."""
    sql.register_events(events(spark, sf_dir).withColumn("is_first", F.col("bucket") == 0), "rw_registered")
    return sql.run_sql(spark, "SELECT substr(ts, 1, 10) AS day, is_first, count(*) AS n_rows, min(ts) AS first_ts FROM rw_registered WHERE click = :click GROUP BY 1, 2", {"click": 1})


_add("a8_registered_events", f"WITH {_E} SELECT date AS day, CAST(coalesce(bucket = 0, false) AS INTEGER) AS is_first, count(*) AS n_rows, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS first_ts FROM e WHERE click = 1 GROUP BY 1, 2")(a8_registered_events)
_add("a12_table_stats", "SELECT 'events' AS \"table\", count(*) AS n_rows, CAST(1 AS BIGINT) AS files, (SELECT count(*) FROM (DESCRIBE events)) AS columns FROM events UNION ALL SELECT 'lineitem', count(*), CAST(1 AS BIGINT), (SELECT count(*) FROM (DESCRIBE lineitem)) FROM lineitem")(
    lambda s, d: tables.table_stats(s, {n: f"{d}/{n}.parquet" for n in ("events", "lineitem")}))
_add("b5_invalid_labels", "SELECT l_returnflag, count(*) AS n_rows, count(*) FILTER (l_returnflag NOT IN ('R', 'N') OR l_linenumber > 1 AND l_returnflag = 'N') AS invalid FROM lineitem GROUP BY 1")(
    lambda s, d: (x := s.read.parquet(f"{d}/lineitem.parquet")).withColumn("bad", cleaning.flag_invalid_label(F.col("l_returnflag"), F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "N", F.col("l_linenumber")))).groupBy("l_returnflag").agg(F.count("*").alias("n_rows"), F.count_if("bad").alias("invalid")))
_add("b8_row_conservation", "SELECT 'row_conservation' AS \"check\", 'cleaning' AS subject, CASE WHEN count(*) = count(*) FILTER (event_type <> 'error') THEN 'PASS' ELSE 'ERROR' END AS status, CAST(count(*) FILTER (event_type <> 'error') AS VARCHAR) AS observed, CAST(count(*) AS VARCHAR) AS expected FROM events")(
    lambda s, d: checks.check_row_conservation(s.read.parquet(f"{d}/events.parquet"), s.read.parquet(f"{d}/events.parquet").filter("event_type <> 'error'")))
_add("b9_column_nulls", "SELECT 'doc_id' AS \"column\", 'bigint' AS data_type, count(*) - count(doc_id) AS nulls FROM documents UNION ALL SELECT 'text', 'string', count(*) - count(text) FROM documents UNION ALL SELECT 'lang', 'string', count(*) - count(lang) FROM documents UNION ALL SELECT 'source', 'string', count(*) - count(source) FROM documents")(
    lambda s, d: cleaning.profile_columns(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source")))
_add("c13_heat_matrix", f"""WITH {_L}, x AS (SELECT l_linenumber, l_linestatus, 100.0 * avg(click) AS r, count(*) < 10000 AS low FROM l GROUP BY ALL)
 SELECT CAST(g.range AS INTEGER) AS l_linenumber, max(r) FILTER (l_linestatus = 'F') AS "c_F", max(r) FILTER (l_linestatus = 'O') AS "c_O", CAST(bool_or(low) FILTER (l_linestatus = 'F') AS DOUBLE) AS "low_F", CAST(bool_or(low) FILTER (l_linestatus = 'O') AS DOUBLE) AS "low_O" FROM range(1, 10) g LEFT JOIN x ON x.l_linenumber = g.range GROUP BY 1""")(
    lambda s, d: rates.heat_matrix(rates.cross_rate(lines(s, d).withColumn("l_linenumber", F.col("l_linenumber").cast("int")), "l_linenumber", "l_linestatus", 10_000), "l_linenumber", "l_linestatus", list(range(1, 10)), ["F", "O"]).withColumns({c: F.col(c).cast("double") for c in ("low_F", "low_O")}))
_add("c14_missing_either", "SELECT count(*) FILTER (coalesce(trim(lang), '') = '') AS first_missing, count(*) FILTER (coalesce(trim(source), '') = '') AS second_missing, count(*) FILTER (coalesce(trim(lang), '') = '' OR coalesce(trim(source), '') = '') AS either_missing, count(*) FILTER (coalesce(trim(lang), '') = '' AND coalesce(trim(source), '') = '') AS both_missing FROM documents")(
    lambda s, d: rates.missing_either(s.read.parquet(f"{d}/documents.parquet"), "lang", "source"))
_add("c15_top_rows", f"WITH {_L} SELECT l_suppkey, count(*) AS impressions, CAST(sum(click) AS BIGINT) AS clicks FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")(
    lambda s, d: rates.top_rows(rates.rate_by(lines(s, d), ["l_suppkey"]), 20, "l_suppkey").select("l_suppkey", "impressions", "clicks"))
_sql_query("d3_by_supplier", f"SELECT l_suppkey, {_G} FROM {{t}} GROUP BY l_suppkey ORDER BY impressions DESC, l_suppkey", _L, "l", lines)
_sql_query("d6_top_users", f"SELECT user_id, {_G} FROM {{t}} GROUP BY user_id ORDER BY impressions DESC, user_id LIMIT 15", _E, "e", events)
_add("e4_event_date", f"WITH {_E} SELECT id, date AS d1, date AS d2 FROM e")(
    lambda s, d: (e := events(s, d).withColumn("hour", F.concat(F.date_format("ts", "yyMMddHH"), F.lit(".0")))).select("id", features.event_date(e).cast("string").alias("d1"), features.event_date(e.drop("date")).cast("string").alias("d2")))
_add("e5_log1p", f"WITH {_E} SELECT id, round(ln(1 + count(site) OVER (PARTITION BY site)), 9) AS site_freq FROM e")(
    lambda s, d: _rounded(features.log1p_columns(history.add_frequency(events(s, d), events(s, d), "site")), "site_freq").select("id", "site_freq"))
_add("e6_e7_e10_row_values", f"WITH {_E} SELECT id, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS hard FROM e")(
    lambda s, d: events(s, d).select("id", (F.round(features.hour_cyclic(F.hour("ts"))[0], 6) + 0.0).alias("hour_sin"), features.hard_label(F.col("score")).alias("hard")))
_add("f6_positional_match", f"WITH {_E}, p AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM e), q AS (SELECT id + CASE WHEN bucket = 3 THEN 1 ELSE 0 END AS id, row_number() OVER (ORDER BY id) AS k FROM e WHERE id < (SELECT max(id) FROM e)) SELECT count(p.k) AS rows_a, count(q.k) AS rows_b, count(*) FILTER (p.id IS DISTINCT FROM q.id) AS mismatches, min(CASE WHEN p.id IS DISTINCT FROM q.id THEN coalesce(p.k, q.k) END) AS first_mismatch FROM p FULL JOIN q ON p.k = q.k")(
    lambda s, d: _positions(events(s, d)))


def _positions(e: DataFrame) -> DataFrame:
    from ratewise.operators import ranking

    placed = ranking.with_place(e.withColumn("one", F.lit(1)), "one", "id", "k")
    other = placed.join(F.broadcast(e.agg(F.max("id").alias("m")))).filter(F.col("id") < F.col("m")).withColumn("id", F.col("id") + (F.coalesce(F.col("bucket") == 3, F.lit(False))).cast("int"))
    return checks.positional_match(placed, other, "k")


_TWO = "site", "bucket"


def _two_keys(s, d) -> DataFrame:
    """History and encoding by two keys in one table."""
    x = events(s, d)
    for key in _TWO:
        x = history.add_target_encoding(history.add_history(x, key), key)
    return _rounded(x.select("id", *[f"{k}_{c}" for k in _TWO for c in ("hist_impressions", "hist_clicks", "te")]), "site_te", "bucket_te")


def _past_sql(key: str) -> str:
    return f"""d_{key} AS (SELECT date, {key}, count(click) AS n, sum(click) AS c FROM e GROUP BY ALL),
 p_{key} AS (SELECT date, {key}, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS n, CAST(coalesce(sum(c) OVER w, 0) AS BIGINT) AS c FROM d_{key} WINDOW w AS (PARTITION BY {key} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


_add("g7_g16_two_keys", f"""WITH {_E}, {_past_sql("site")}, {_past_sql("bucket")}, t AS (SELECT date, sum(click) AS c, count(click) AS n FROM e GROUP BY 1),
 pr AS (SELECT date, coalesce(CAST(sum(c) OVER w AS DOUBLE) / sum(n) OVER w, 0.17) AS prior FROM t WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT id, a.n AS site_hist_impressions, a.c AS site_hist_clicks, round((a.c + 20 * prior) / (a.n + 20), 9) AS site_te, b.n AS bucket_hist_impressions, b.c AS bucket_hist_clicks, round((b.c + 20 * prior) / (b.n + 20), 9) AS bucket_te
 FROM e JOIN pr ON e.date = pr.date JOIN p_site a ON a.date = e.date AND a.site IS NOT DISTINCT FROM e.site JOIN p_bucket b ON b.date = e.date AND b.bucket IS NOT DISTINCT FROM e.bucket""")(_two_keys)


def _later(s, d, split: str, earlier: tuple[str, ...]) -> DataFrame:
    x = split_events(s, d)
    past = [x.filter(F.col("split") == e) for e in earlier]
    rows = history.add_te_split(history.add_history_split(x.filter(F.col("split") == split), past, "user_id"), past, "user_id")
    return _rounded(rows.select("id", *[f"user_id_{c}" for c in (*history.HISTORY, "te")]), "user_id_hist_ctr", "user_id_exposure_percentile", "user_id_te")


def _later_sql(split: str, earlier: str) -> str:
    return f"""WITH {_SE}, past AS (SELECT * FROM se WHERE split IN ({earlier})), m AS (SELECT user_id, count(click) AS n, CAST(sum(click) AS BIGINT) AS c FROM past GROUP BY 1), o AS (SELECT sum(click) / count(click) AS prior FROM past),
 r AS (SELECT *, (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2) / count(*) OVER () AS p FROM m WHERE n > 0)
 SELECT id, coalesce(n, 0) AS user_id_hist_impressions, coalesce(c, 0) AS user_id_hist_clicks, round(coalesce(c / n, 0), 9) AS user_id_hist_ctr, round(coalesce(p, 0), 9) AS user_id_exposure_percentile, round((coalesce(c, 0) + 20 * prior) / (coalesce(n, 0) + 20), 9) AS user_id_te
 FROM se JOIN o ON true LEFT JOIN r ON r.user_id IS NOT DISTINCT FROM se.user_id WHERE split = '{split}'"""


_add("g9_g17_valid", _later_sql("valid", "'train'"))(lambda s, d: _later(s, d, "valid", ("train",)))
_add("g9_g17_holdout", _later_sql("holdout", "'train', 'valid'"))(lambda s, d: _later(s, d, "holdout", ("train", "valid")))
_add("g11_unseen_ratio", f"WITH {_SE}, x AS (SELECT count(*) AS n, count(*) FILTER (user_id NOT IN (SELECT user_id FROM se WHERE split = 'train')) AS u FROM se WHERE split = 'valid') SELECT 'user_id' AS key, n AS n_rows, u AS unseen_rows, CAST(u AS DOUBLE) / n AS unseen_ratio FROM x")(
    lambda s, d: history.unseen_ratio(history.add_history_split((x := split_events(s, d)).filter("split = 'valid'"), [x.filter("split = 'train'")], "user_id"), ["user_id"]))
_add("g12_feature_bounds", f"WITH {_E} SELECT 'score' AS feature, min(score) AS min, max(score) AS max, round(avg(score), 9) AS mean FROM e UNION ALL SELECT 'bucket', CAST(min(bucket) AS DOUBLE), CAST(max(bucket) AS DOUBLE), round(avg(bucket), 9) FROM e")(
    lambda s, d: _rounded(history.feature_bounds(events(s, d), ["score", "bucket"]), "mean"))
_NARROW = {"train": ("2024-01-03", "2024-01-20"), "valid": ("2024-01-22", "2024-01-27")}
_add("h1_split_counts", f"WITH {_E} SELECT CASE WHEN date BETWEEN '2024-01-03' AND '2024-01-20' THEN 'train' WHEN date BETWEEN '2024-01-22' AND '2024-01-27' THEN 'valid' WHEN date IS NULL THEN 'null_time' ELSE 'out_of_range' END AS split, count(*) AS n_rows FROM e GROUP BY 1")(
    lambda s, d: splits.split_counts(events(s, d), _NARROW))
_add("h3_split_conservation", f"WITH {_E}, x AS (SELECT count(*) AS n, count(*) FILTER (date BETWEEN '2024-01-03' AND '2024-01-20' OR date BETWEEN '2024-01-22' AND '2024-01-27') AS k FROM e) SELECT 'split_conservation' AS \"check\", 'splits' AS subject, CASE WHEN n = k THEN 'PASS' ELSE 'WARNING' END AS status, CAST(k AS VARCHAR) AS observed, CAST(n AS VARCHAR) AS expected FROM x")(
    lambda s, d: checks.check_split_conservation(events(s, d), splits.split_counts(events(s, d), _NARROW), list(_NARROW)))
_DRAW = "md5('42:' || CAST(id AS VARCHAR)) || ':' || CAST(id AS VARCHAR)"


def _strata(n: str) -> str:
    return f"""WITH {_E}, g AS (SELECT click, count(*) AS n_rows FROM e GROUP BY 1), q AS (SELECT click, {n} AS want, {n} * n_rows // (SELECT count(*) FROM e) AS base, ({n} * n_rows) % (SELECT count(*) FROM e) AS rest FROM g),
 z AS (SELECT click, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, click DESC) <= want - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM q), r AS (SELECT id, click, row_number() OVER (PARTITION BY click ORDER BY {_DRAW}) AS k FROM e)"""


_add("h6_stratified_split", _strata("CAST(round_even(0.6 * (SELECT count(*) FROM e), 0) AS BIGINT)") + " SELECT id, CASE WHEN k <= quota THEN 'a' ELSE 'b' END AS part FROM r JOIN z ON r.click = z.click")(lambda s, d: splits.stratified_split(events(s, d), "click", 0.6).select("id", "part"))
_add("h7_stratified_sample", _strata("500") + " SELECT id, r.click FROM r JOIN z ON r.click = z.click WHERE k <= quota")(lambda s, d: splits.stratified_sample(events(s, d), "click", 500).select("id", "click"))
_add("h8_simple_sample", f"WITH {_E} SELECT id FROM e ORDER BY {_DRAW} LIMIT 300")(lambda s, d: splits.simple_sample(events(s, d), 300).select("id"))
_add("h13_sample_summary", f"WITH {_SE}, x AS (SELECT split, CAST(CASE split WHEN 'train' THEN 500 ELSE (SELECT count(*) FROM se WHERE split = 'valid') END AS BIGINT) AS target_rows, count(*) AS actual_rows, min(date) AS start_date, max(date) AS end_date, count(*) FILTER (click = 1) AS label_1, count(*) FILTER (click = 0) AS label_0, round(avg(click), 9) AS ctr, CAST(1 AS INTEGER) AS feature_count, count(*) - count(score) AS null_count, count(*) FILTER (isinf(score)) AS inf_count FROM se WHERE split <> 'holdout' GROUP BY 1) SELECT *, CASE WHEN target_rows = actual_rows AND null_count = 0 AND inf_count = 0 THEN 'PASS' ELSE 'ERROR' END AS status FROM x")(
    lambda s, d: _rounded(checks.sample_summary((x := split_events(s, d)).filter("split <> 'holdout'"), {"train": 500, "valid": x.filter("split = 'valid'").count()}, ["score"]), "ctr"))
_add("i3_time_nulls", "SELECT 'time_nulls' AS \"check\", 'events' AS subject, CASE WHEN count(*) = count(ts) THEN 'PASS' ELSE 'WARNING' END AS status, CAST(count(*) - count(ts) AS VARCHAR) AS observed, '0' AS expected FROM events UNION ALL SELECT 'time_nulls', 'lines', CASE WHEN count(*) = count(l_shipdate) THEN 'PASS' ELSE 'WARNING' END, CAST(count(*) - count(l_shipdate) AS VARCHAR), '0' FROM lineitem")(
    lambda s, d: checks.check_time_nulls({"events": events(s, d), "lines": lines(s, d)}))
_add("i5_strict_labels", f"WITH {_E}, b AS (SELECT CAST(id AS VARCHAR) AS id, row_number() OVER (ORDER BY id) AS k FROM e WHERE bucket NOT IN (0, 1) OR bucket IS NULL) SELECT 'strict_labels' AS \"check\", 'events' AS subject, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'ERROR' END AS status, CASE WHEN count(*) = 0 THEN '0' ELSE count(*) || ': ' || string_agg(id, ',' ORDER BY id) FILTER (k <= 10) END AS observed, '0' AS expected FROM b")(
    lambda s, d: checks.check_strict_labels(events(s, d), "events", label="bucket"))
_add("i14_stage_rows", f"WITH {_SE}, a AS (SELECT split, count(*) AS n, count(*) FILTER (site IS NOT NULL AND bucket <> 4) AS m FROM se GROUP BY 1) SELECT 'stage_rows' AS \"check\", split AS subject, CASE WHEN n = m THEN 'PASS' ELSE 'ERROR' END AS status, 'base=' || n || ' history=' || m AS observed, CAST(n AS VARCHAR) AS expected FROM a")(
    lambda s, d: checks.check_stage_row_counts({"base": (x := split_events(s, d)), "history": x.filter("site is not null and bucket <> 4")}))
_add("i17_split_dates", f"WITH {_SE}, a AS (SELECT split, min(date) AS lo, max(date) AS hi FROM se GROUP BY 1), b AS (SELECT *, lag(hi) OVER (ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'valid' THEN 2 ELSE 3 END) AS last FROM a) SELECT 'split_dates' AS \"check\", split AS subject, CASE WHEN last IS NULL OR lo > last THEN 'PASS' ELSE 'ERROR' END AS status, lo || ' to ' || hi AS observed, 'after ' || coalesce(last, 'nothing') AS expected FROM b")(
    lambda s, d: checks.check_split_dates(split_events(s, d), ["train", "valid", "holdout"]))
_add("k1_confusion", f"""WITH {_L}, x AS (SELECT count(*) FILTER (score >= 0.25 AND click = 1) AS tp, count(*) FILTER (score >= 0.25 AND click = 0) AS fp, count(*) FILTER (score < 0.25 AND click = 0) AS tn, count(*) FILTER (score < 0.25 AND click = 1) AS fn FROM l)
 SELECT *, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round((tp + fp) / (tp + fp + tn + fn), 9) AS positive_share FROM x""")(
    lambda s, d: _rounded(evaluation.confusion(lines(s, d), 0.25), "accuracy", "precision", "recall", "f1", "positive_share"))
_Q13 = ", ".join(f"quantile_cont(score, {q})" for q in (0, *[round(1 - c, 12) for c in evaluation.GRID_COVERAGES], 1))
_FIXED = [round(i / 100, 2) for i in range(1, 51)] + [round(0.55 + 0.05 * i, 2) for i in range(9)]
_add("m2_threshold_grid", f"WITH {_L}, q AS (SELECT unnest(list_concat({_FIXED}::DOUBLE[], [{_Q13}])) AS t FROM l) SELECT DISTINCT round(t, 9) AS threshold FROM q")(
    lambda s, d: _rounded(evaluation.threshold_grid(lines(s, d)), "threshold").distinct())
_WIDE = [0.05, 0.1, 0.25, 0.4, 0.6, 5.0]
_add("m3_threshold_rates", f"""WITH {_L}, g AS (SELECT unnest({_WIDE}::DOUBLE[]) AS threshold), x AS (SELECT threshold, count(*) FILTER (score >= threshold AND click = 1) AS tp, count(*) FILTER (score >= threshold AND click = 0) AS fp, count(*) FILTER (score < threshold AND click = 0) AS tn, count(*) FILTER (score < threshold AND click = 1) AS fn FROM l, g GROUP BY 1)
 SELECT threshold, tp + fn AS positive_rows, fp + tn AS negative_rows, tp + fp AS selected_rows, round(fp / nullif(fp + tn, 0), 9) AS false_positive_rate, round(fn / nullif(fn + tp, 0), 9) AS false_negative_rate, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy,
 round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 9) AS balanced_accuracy, round(tn / nullif(tn + fn, 0), 9) AS npv, round(tp / nullif(tp + fp, 0), 9) AS selected_ctr, round(fn / nullif(fn + tn, 0), 9) AS unselected_ctr, round((tp + fn) / (tp + fp + tn + fn), 9) AS overall_ctr,
 round(tp / nullif(tp + fp, 0) / ((tp + fn) / (tp + fp + tn + fn)), 9) AS lift, round(fn / nullif(tp + fn, 0), 9) AS missed, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM x""")(
    lambda s, d: evaluation.threshold_metrics(lines(s, d), _WIDE).select("threshold", "positive_rows", "negative_rows", "selected_rows", *[F.round(c, 9).alias(c) for c in ("false_positive_rate", "false_negative_rate", "accuracy", "balanced_accuracy", "npv", "selected_ctr", "unselected_ctr", "overall_ctr", "lift", "missed", "f1")]))
_ALL = list(evaluation.TOPK_COVERAGES)
_add("m5_topk_all", f"""WITH {_E}, g AS (SELECT unnest({_ALL}::DOUBLE[]) AS coverage), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k, count(*) OVER () AS total, sum(click) OVER () AS all_clicks FROM e)
 SELECT coverage, count(*) AS rows, CAST(sum(click) AS BIGINT) AS clicks, round(sum(click) / max(all_clicks) / (count(*) / max(total)), 9) AS gain, round(count(*) * max(all_clicks) / max(total), 6) AS expected_clicks, round(sum(click) - count(*) * max(all_clicks) / max(total), 6) AS incremental_clicks
 FROM r, g WHERE k <= greatest(1, ceil(total * coverage)) GROUP BY 1""")(
    lambda s, d: evaluation.topk_metrics(events(s, d)).select("coverage", "rows", "clicks", F.round("gain", 9).alias("gain"), F.round("expected_clicks", 6).alias("expected_clicks"), F.round("incremental_clicks", 6).alias("incremental_clicks")))
_add("m6_decile_shares", f"""WITH {_E}, r AS (SELECT *, CAST(ntile(10) OVER (ORDER BY score DESC, id) AS INTEGER) AS grp FROM e), g AS (SELECT grp, count(*) AS n, sum(click) AS c FROM r GROUP BY 1)
 SELECT grp, round(c / n / (sum(c) OVER () / sum(n) OVER ()), 9) AS lift, round(c / sum(c) OVER (), 9) AS click_share, CAST(sum(n) OVER w AS BIGINT) AS cumulative_rows, round(sum(n) OVER w / sum(n) OVER (), 9) AS cumulative_coverage, CAST(sum(c) OVER w AS BIGINT) AS cumulative_clicks, round(sum(c) OVER w / sum(c) OVER (), 9) AS cumulative_capture FROM g WINDOW w AS (ORDER BY grp)""")(
    lambda s, d: _rounded(evaluation.score_groups(events(s, d), 10, False), "lift", "click_share", "cumulative_coverage", "cumulative_capture").select("grp", "lift", "click_share", "cumulative_rows", "cumulative_coverage", "cumulative_clicks", "cumulative_capture"))


def m9_check_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds, top-K and deciles of one table against one another."""
    e = events(spark, sf_dir)
    return checks.check_strategy(evaluation.threshold_metrics(e, _FIXED), evaluation.topk_metrics(e), evaluation.score_groups(e, 10, False), e.count())


_PROB = "round(avg(-ln(CASE WHEN click = 1 THEN greatest(least({s}, 1 - 1e-7), 1e-7) ELSE 1 - greatest(least({s}, 1 - 1e-7), 1e-7) END)), 9)"


def _two_models(s, d) -> DataFrame:
    """Two scores of the same rows as two models."""
    x = lines(s, d)
    both = [evaluation.model_metrics(x.withColumn("score", c), n) for n, c in (("base", F.col("score")), ("half", F.col("score") / 2))]
    return both[0].unionByName(both[1])


_add("k8_k11_improvement", f"""WITH {_L}, x AS (SELECT {_PROB.format(s="score")} AS a, {_PROB.format(s="(score / 2)")} AS b, round(abs(avg(score) - avg(click)), 9) AS ga, round(abs(avg(score / 2) - avg(click)), 9) AS gb FROM l)
 SELECT 'base' AS model, CAST(0 AS DOUBLE) AS auc_gain, CAST(0 AS DOUBLE) AS log_loss_reduction, CAST(0 AS DOUBLE) AS gap_reduction FROM x UNION ALL SELECT 'half', 0, round(a - b, 6), round(ga - gb, 6) FROM x""")(
    lambda s, d: evaluation.relative_improvement(_two_models(s, d), "base").select("model", (F.round("auc_gain", 6) + 0.0).alias("auc_gain"), F.round("log_loss_reduction", 6).alias("log_loss_reduction"), F.round("gap_reduction", 6).alias("gap_reduction")))
_add("k12_best_per_metric", f"""WITH {_L}, x AS (SELECT {_PROB.format(s="score")} AS a, {_PROB.format(s="(score / 2)")} AS b, abs(avg(score) - avg(click)) AS ga, abs(avg(score / 2) - avg(click)) AS gb FROM l)
 SELECT 'auc' AS criterion, 'base' AS model FROM x UNION ALL SELECT 'log_loss', CASE WHEN a <= b THEN 'base' ELSE 'half' END FROM x UNION ALL SELECT 'calibration_gap', CASE WHEN ga <= gb THEN 'base' ELSE 'half' END FROM x""")(
    lambda s, d: evaluation.best_per_metric(_two_models(s, d).withColumn("auc", F.round("auc", 9))).select("criterion", "model"))
_add("n8_sample_drift", f"WITH {_E}, x AS (SELECT avg(click) AS a, avg(click) FILTER (bucket = 1) AS b FROM e) SELECT round(a, 9) AS full_ctr, round(b, 9) AS sample_ctr, CASE WHEN abs(a - b) > 0.01 THEN 'WARNING' ELSE 'PASS' END AS status FROM x")(
    lambda s, d: _rounded(checks.sample_drift(events(s, d), events(s, d).filter("bucket = 1")), "full_ctr", "sample_ctr").drop("drift"))
_add("l1_calibration_split", _strata("CAST(round_even(0.6 * (SELECT count(*) FROM e), 0) AS BIGINT)") + ", x AS (SELECT CASE WHEN k <= quota THEN 'a' ELSE 'b' END AS part, count(*) AS n_rows, CAST(sum(r.click) AS BIGINT) AS clicks FROM r JOIN z ON r.click = z.click GROUP BY 1) SELECT * FROM x")(
    lambda s, d: calibration.calibration_split(events(s, d))[0].groupBy("part").agg(F.count("*").alias("n_rows"), F.sum("click").alias("clicks")))


def n4_family_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance by feature family."""
    return models.group_importance(reports.n3_global_importance(spark, sf_dir), "family")


def n6_case_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the most extreme cases."""
    rows, model = reports._trained(spark, sf_dir)
    return models.case_contributions(models.linear_contributions(model, rows, reports.FEATURES), models.find_cases(models.score(model, rows, reports.FEATURES), 0.2))


def n7_case_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.case_extremes(n6_case_contributions(spark, sf_dir))


def j6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three seeded trials of boosted trees on the training dates, judged on the validation dates."""
    rows = reports.model_rows(spark, sf_dir).filter("split <> 'holdout'").withColumn("is_valid", F.col("split") == "valid")
    return models.search_boosted(spark, rows, reports.FEATURES, "is_valid", trials=3, rounds=10)[0]


def j11_score_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regressions on all and on the key features, scored in one table."""
    rows, model = reports._trained(spark, sf_dir)
    few = ["site_hist_ctr", "site_exposure_percentile"]
    return models.score_models(rows, {"full": (model, reports.FEATURES), "keys": (models.fit_logistic(rows.filter("split = 'train'"), few), few)}, ["id", "split", "click"])


QUERIES |= {f.__name__: f for f in (m9_check_strategy, n4_family_importance, n6_case_contributions, n7_case_extremes, j6_search, j11_score_models)}
