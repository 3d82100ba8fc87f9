"""Queries of the engine's own operators over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.functions import features
from ratewise.operators import cleaning, evaluation, history, quality, rates, splits

QUERIES, SQL = {}, {}
BOUNDS = {"train": ("2024-01-01", "2024-01-24"), "valid": ("2024-01-25", "2024-01-27"), "holdout": ("2024-01-28", "2024-01-30")}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as impressions with a click label."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("id"), "ts", F.date_format("ts", "yyyy-MM-dd").alias("date"), (F.col("event_type") == "click").cast("int").alias("click"),
        F.floor(F.col("value") / 50).cast("int").alias("bucket"), F.get_json_object("props", "$.k").alias("site"), "user_id", F.round(F.col("value") / 500, 4).alias("score"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return x.select("l_orderkey", "l_linenumber", "l_linestatus", "l_suppkey", "l_partkey", F.col("l_shipdate").alias("ts"), (F.col("l_returnflag") == "R").cast("int").alias("click"), F.round(F.col("l_discount") * 5 + F.col("l_tax"), 4).alias("score"))


_E = """e AS (SELECT event_id AS id, ts, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS click,
 CAST(floor(value / 50) AS INTEGER) AS bucket, json_extract_string(props, '$.k') AS site, user_id, round(value / 500, 4) AS score FROM events)"""
_L = """l AS (SELECT l_orderkey, l_linenumber, l_linestatus, l_suppkey, l_partkey, l_shipdate AS ts, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS click,
 round(l_discount * 5 + l_tax, 4) AS score FROM lineitem)"""
_SUMS = "count(*) AS impressions, CAST(sum(click) AS BIGINT) AS clicks, CAST(sum(click) AS DOUBLE) / count(*) AS ctr"


def _add(name: str, sql: str):
    def put(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


def _rates(table: str, cte: str, keys: str, more: str = "") -> str:
    return f"WITH {cte}, o AS (SELECT CAST(sum(click) AS DOUBLE) / count(*) AS overall_ctr, count(*) AS total FROM {table}), g AS (SELECT {keys}, {_SUMS} FROM {table} GROUP BY ALL) SELECT g.*, overall_ctr, ctr - overall_ctr AS ctr_vs_overall{more} FROM g, o"


_add("c1_overall", f"WITH {_L} SELECT {_SUMS} FROM l")(lambda s, d: rates.overall_rate(lines(s, d)))
_add("c2_rate_by_line", _rates("l", _L, "l_linenumber"))(lambda s, d: rates.rate_by(lines(s, d), ["l_linenumber"]))
_add("c3_rate_by_hour", f"""WITH {_E}, o AS (SELECT CAST(sum(click) AS DOUBLE) / count(*) AS overall_ctr FROM e),
 g AS (SELECT CAST(hour(ts) AS INTEGER) AS h, count(*) AS n, CAST(sum(click) AS BIGINT) AS c FROM e GROUP BY 1),
 x AS (SELECT CAST(r.range AS INTEGER) AS hour_of_day, coalesce(n, 0) AS impressions, coalesce(c, 0) AS clicks, coalesce(CAST(c AS DOUBLE) / n, 0) AS ctr FROM range(24) r LEFT JOIN g ON g.h = r.range)
 SELECT x.*, overall_ctr, ctr - overall_ctr AS ctr_vs_overall FROM x, o""")(lambda s, d: rates.rate_by_hour(events(s, d)))
_add("c4_rate_by_date", _rates("e", _E, "date"))(lambda s, d: rates.rate_by_date(events(s, d)))
_add("c5_c6_share_and_rank", _rates("l", _L, "l_suppkey", ", CAST(impressions AS DOUBLE) / total AS impression_share, rank() OVER (ORDER BY impressions DESC) AS impressions_rank").replace("SELECT g.*", "SELECT g.*"))(
    lambda s, d: rates.with_volume_rank(rates.with_share(rates.rate_by(lines(s, d), ["l_suppkey"]), rates.overall_rate(lines(s, d)))))
_add("c7_cross_rate", _rates("l", _L, "l_linenumber, l_linestatus", ", CAST(impressions AS DOUBLE) / total AS impression_share, impressions < 100000 AS is_low_volume"))(lambda s, d: rates.cross_rate(lines(s, d), "l_linenumber", "l_linestatus"))
_add("c9_top_keys", f"WITH {_L} SELECT l_partkey, count(*) AS impressions FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")(lambda s, d: rates.top_keys(lines(s, d), "l_partkey", 15))
_add("c11_cross_top_rate", f"""WITH {_L}, t AS (SELECT l_suppkey FROM l GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10), k AS (SELECT * FROM l WHERE l_suppkey IN (SELECT * FROM t)),
 o AS (SELECT CAST(sum(click) AS DOUBLE) / count(*) AS overall_ctr, count(*) AS total FROM k), g AS (SELECT l_suppkey, l_linestatus, {_SUMS} FROM k GROUP BY ALL)
 SELECT g.*, overall_ctr, ctr - overall_ctr AS ctr_vs_overall, CAST(impressions AS DOUBLE) / total AS impression_share, impressions < 100000 AS is_low_volume,
 CAST(impressions AS DOUBLE) / sum(impressions) OVER (PARTITION BY l_suppkey) AS within_group_share FROM g, o""")(lambda s, d: rates.cross_top_rate(lines(s, d), "l_suppkey", "l_linestatus", 10))
_add("c12_pivot", f"WITH {_L} SELECT l_linenumber, CAST(sum(click) FILTER (l_linestatus = 'F') AS DOUBLE) / count(*) FILTER (l_linestatus = 'F') AS \"c_F\", CAST(sum(click) FILTER (l_linestatus = 'O') AS DOUBLE) / count(*) FILTER (l_linestatus = 'O') AS \"c_O\" FROM l GROUP BY 1")(
    lambda s, d: rates.pivot_measure(rates.cross_rate(lines(s, d), "l_linenumber", "l_linestatus"), "l_linenumber", "l_linestatus", ["F", "O"]))
_add("c14_missing", "SELECT 'lang' AS key, count(*) FILTER (lang IS NULL) AS nulls, count(*) FILTER (trim(lang) = '') AS blanks FROM documents UNION ALL SELECT 'source', count(*) FILTER (source IS NULL), count(*) FILTER (trim(source) = '') FROM documents")(
    lambda s, d: rates.missing_counts(s.read.parquet(f"{d}/documents.parquet"), ["lang", "source"]))


def _sql_query(name: str, sql: str, cte: str, table: str, source) -> None:
    """A query that is SQL in the engine too: the same text runs over a view."""

    def run(spark, sf_dir):
        source(spark, sf_dir).createOrReplaceTempView(f"rw_{name}")
        return spark.sql(sql.format(t=f"rw_{name}"))

    QUERIES[name], SQL[name] = run, f"WITH {cte} " + sql.format(t=table)


_G = "count(*) AS impressions, CAST(sum(click) AS BIGINT) AS clicks, avg(click) AS ctr"
_sql_query("d1_overall", f"SELECT {_G} FROM {{t}}", _L, "l", lines)
_sql_query("d2_by_line", f"SELECT l_linenumber, {_G} FROM {{t}} GROUP BY l_linenumber ORDER BY impressions DESC", _L, "l", lines)
_sql_query("d4_by_hour", f"SELECT substr(CAST(ts AS STRING), 12, 2) AS hour, {_G} FROM {{t}} GROUP BY substr(CAST(ts AS STRING), 12, 2) ORDER BY hour", _E, "e", events)
_sql_query("d5_top_parts", f"SELECT l_partkey, {_G} FROM {{t}} GROUP BY l_partkey ORDER BY impressions DESC, l_partkey LIMIT 15", _L, "l", lines)
_sql_query("d7_line_status", f"SELECT l_linenumber, l_linestatus, {_G} FROM {{t}} GROUP BY l_linenumber, l_linestatus", _L, "l", lines)
_sql_query("d8_hour_bucket", f"SELECT substr(CAST(ts AS STRING), 12, 2) AS hour, bucket, {_G} FROM {{t}} GROUP BY substr(CAST(ts AS STRING), 12, 2), bucket ORDER BY hour, bucket", _E, "e", events)

_add("b4_duplicates", f"WITH {_L} SELECT is_dup, count(*) AS n_rows FROM (SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS is_dup FROM l) GROUP BY 1")(
    lambda s, d: cleaning.flag_duplicates(lines(s, d), ["l_orderkey", "l_linenumber"]).groupBy("is_dup").agg(F.count("*").alias("n_rows")))
_add("b6_labels", f"WITH {_E} SELECT CAST(click AS VARCHAR) AS label, count(*) AS rows FROM e GROUP BY 1")(lambda s, d: cleaning.label_distribution(events(s, d)))
_add("b9_profile", f"WITH {_E} SELECT count(*) AS n_rows, count(id) - count(DISTINCT id) AS extra_ids, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (click IS NULL) AS null_labels, avg(click) AS sample_rate FROM e")(
    lambda s, d: cleaning.profile(events(s, d), "click", "id", "ts"))
_add("e1_time_parts", f"WITH {_E} SELECT id, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(day(ts) AS INTEGER) AS day, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, CAST(bucket AS VARCHAR) || '_' || site AS bucket_site FROM e")(
    lambda s, d: features.time_parts(events(s, d)).withColumn("bucket_site", features.cross_key(F.col("bucket"), F.col("site"))).select("id", "hour_of_day", "day", "weekday", "is_weekend", "bucket_site"))
_add("g1_f1_frequency", f"WITH {_E} SELECT id, count(site) OVER (PARTITION BY site) AS site_freq FROM e")(lambda s, d: history.add_frequency(events(s, d), events(s, d), "site").select("id", "site_freq"))
_PAST = "days AS (SELECT date, site, count(click) AS n, sum(click) AS c FROM e GROUP BY ALL), past AS (SELECT d.date, p.site, CAST(sum(n) AS BIGINT) AS hist_impressions, CAST(sum(c) AS BIGINT) AS hist_clicks FROM (SELECT DISTINCT date FROM e) d JOIN days p ON p.date < d.date GROUP BY ALL)"
_add("g7_history", f"""WITH {_E}, {_PAST}, r AS (SELECT *, (rank() OVER (PARTITION BY date ORDER BY hist_impressions) + (count(*) OVER (PARTITION BY date, hist_impressions) - 1) / 2) / count(*) OVER (PARTITION BY date) AS exposure_percentile FROM past)
 SELECT id, coalesce(hist_impressions, 0) AS hist_impressions, coalesce(hist_clicks, 0) AS hist_clicks, coalesce(CAST(hist_clicks AS DOUBLE) / hist_impressions, 0) AS hist_ctr, coalesce(round(exposure_percentile, 9), 0) AS exposure_percentile
 FROM e LEFT JOIN r ON e.date = r.date AND e.site IS NOT DISTINCT FROM r.site""")(
    lambda s, d: history.add_history(events(s, d), "site").select("id", *[F.col(f"site_{c}").alias(c) for c in ("hist_impressions", "hist_clicks", "hist_ctr")], F.round("site_exposure_percentile", 9).alias("exposure_percentile")))
_add("g16_target_encoding", f"""WITH {_E}, {_PAST}, t AS (SELECT date, sum(click) AS c, count(click) AS n FROM e GROUP BY 1),
 pr AS (SELECT date, coalesce(CAST(sum(c) OVER w AS DOUBLE) / sum(n) OVER w, 0.17) AS prior FROM t WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT id, round((coalesce(hist_clicks, 0) + 20.0 * prior) / (coalesce(hist_impressions, 0) + 20.0), 9) AS te FROM e JOIN pr ON e.date = pr.date LEFT JOIN past p ON e.date = p.date AND e.site IS NOT DISTINCT FROM p.site""")(
    lambda s, d: history.add_target_encoding(events(s, d), "site").select("id", F.round("site_te", 9).alias("te")))
_add("h2_split_summary", f"""WITH {_E}, x AS (SELECT *, CASE WHEN date BETWEEN '2024-01-01' AND '2024-01-24' THEN 'train' WHEN date BETWEEN '2024-01-25' AND '2024-01-27' THEN 'valid' WHEN date BETWEEN '2024-01-28' AND '2024-01-30' THEN 'holdout' END AS split FROM e)
 SELECT split, min(date) AS start_date, max(date) AS end_date, count(*) AS n_rows, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM e) AS share FROM x WHERE split IS NOT NULL GROUP BY 1""")(lambda s, d: splits.split_summary(events(s, d), BOUNDS))
_QUOTA = f"""WITH {_E}, g AS (SELECT bucket, count(*) AS n_rows FROM e GROUP BY 1), q AS (SELECT bucket, n_rows, 1000 * n_rows // sum(n_rows) OVER () AS base, (1000 * n_rows) % CAST(sum(n_rows) OVER () AS BIGINT) AS rest FROM g),
 z AS (SELECT bucket, n_rows, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, bucket DESC) <= 1000 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q)"""
_add("h4_quota", _QUOTA + " SELECT bucket, n_rows, quota FROM z")(lambda s, d: splits.proportional_quota(events(s, d).groupBy("bucket").agg(F.count("*").alias("n_rows")), "bucket", 1000))
_add("h5_sample", _QUOTA + ", r AS (SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS k FROM e) SELECT id, r.bucket FROM r JOIN z ON r.bucket = z.bucket WHERE k <= quota")(
    lambda s, d: splits.sample_per_group(events(s, d), "bucket", 1000, "id").select("id", "bucket"))
_add("i8_feature_quality", f"""WITH {_E} SELECT 'bucket' AS feature_name, 'int' AS data_type, count(*) - count(bucket) AS missing_count, round(1 - count(bucket) / count(*), 9) AS missing_rate, count(DISTINCT bucket) AS unique_count, CAST(count(DISTINCT bucket) <= 1 AS INTEGER) AS is_constant, CAST(min(bucket) AS DOUBLE) AS min, CAST(max(bucket) AS DOUBLE) AS max, round(avg(bucket), 6) AS mean, median(bucket) AS median, round(stddev_samp(bucket), 6) AS std FROM e
 UNION ALL SELECT 'user_id', 'bigint', count(*) - count(user_id), round(1 - count(user_id) / count(*), 9), count(DISTINCT user_id), CAST(count(DISTINCT user_id) <= 1 AS INTEGER), CAST(min(user_id) AS DOUBLE), CAST(max(user_id) AS DOUBLE), round(avg(user_id), 6), median(user_id), round(stddev_samp(user_id), 6) FROM e""")(lambda s, d: quality.feature_quality(events(s, d), ["bucket", "user_id"]).withColumns({"missing_rate": F.round("missing_rate", 9), "is_constant": F.col("is_constant").cast("int")}))
_add("i11_rate_spread", f"""WITH {_L}, r AS (SELECT 'l_linenumber' AS feature_name, avg(click) AS ctr FROM l GROUP BY l_linenumber UNION ALL SELECT 'l_linestatus', avg(click) FROM l GROUP BY l_linestatus)
 SELECT feature_name, min(ctr) AS minimum_ctr, max(ctr) AS maximum_ctr, max(ctr) - min(ctr) AS ctr_spread, count(*) AS top_category_count FROM r GROUP BY 1""")(lambda s, d: quality.rate_spread(lines(s, d), ["l_linenumber", "l_linestatus"]))
_add("i12_correlation", f"WITH {_E} SELECT 'bucket' AS feature_name, round(corr(bucket, click), 9) AS pearson FROM e UNION ALL SELECT 'user_id', round(corr(user_id, click), 9) FROM e")(lambda s, d: quality.label_correlation(events(s, d), ["bucket", "user_id"]))
_S = "s AS (SELECT score, count(*) AS n, sum(click) AS c FROM l GROUP BY 1), a AS (SELECT *, coalesce(sum(n) OVER w, 0) AS na, coalesce(sum(c) OVER w, 0) AS ca FROM s WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
_add("k2_auc", f"WITH {_L}, {_S} SELECT round(sum((n - c) * (ca + c / 2)) / (CAST(sum(c) AS DOUBLE) * sum(n - c)), 9) AS auc FROM a")(lambda s, d: evaluation.roc_auc(lines(s, d)).select(F.round("auc", 9).alias("auc")))
_add("k5_average_precision", f"WITH {_L}, {_S} SELECT round(sum(c * CAST(ca + c AS DOUBLE) / (na + n)) / sum(c), 9) AS average_precision FROM a")(lambda s, d: evaluation.average_precision(lines(s, d)).select(F.round("average_precision", 9).alias("average_precision")))
_add("k3_k4_probability", f"""WITH {_L}, p AS (SELECT *, greatest(least(score, 1 - 1e-7), 1e-7) AS q FROM l) SELECT round(avg(-ln(CASE WHEN click = 1 THEN q ELSE 1 - q END)), 9) AS log_loss, round(avg((score - click) * (score - click)), 9) AS brier,
 round(avg(score), 9) AS mean_score, round(avg(click), 9) AS actual_rate, round(abs(avg(score) - avg(click)), 9) AS calibration_gap FROM p""")(
    lambda s, d: (x := evaluation.probability_metrics(lines(s, d))).select(*[F.round(c, 9).alias(c) for c in x.columns]))
_GRID = [round(i / 100, 2) for i in range(1, 51)]
_add("m3_thresholds", f"""WITH {_L}, g AS (SELECT unnest({_GRID}::DOUBLE[]) AS threshold), x AS (SELECT threshold, CAST(sum(CASE WHEN score >= threshold THEN click ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN score >= threshold THEN 1 - click ELSE 0 END) AS BIGINT) AS fp,
 CAST(sum(CASE WHEN score < threshold THEN 1 - click ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN score < threshold THEN click ELSE 0 END) AS BIGINT) AS fn FROM l, g GROUP BY 1)
 SELECT threshold, tp, fp, tn, fn, round((tp + fp) / (tp + fp + tn + fn), 9) AS coverage, round(tp / nullif(tp + fp, 0), 9) AS "precision", round(tp / nullif(tp + fn, 0), 9) AS recall,
 round(tn / nullif(tn + fp, 0), 9) AS specificity, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 9) AS f1, round(tp / nullif(tp + fp, 0) / ((tp + fn) / (tp + fp + tn + fn)), 9) AS lift,
 round(tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0) - 1, 9) AS youden_j FROM x""")(
    lambda s, d: evaluation.threshold_metrics(lines(s, d), _GRID).select("threshold", "tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("coverage", "precision", "recall", "specificity", "f1", "lift", "youden_j")]))
_COVER = [0.01, 0.05, 0.1, 0.2, 0.5, 1.0]
_add("m5_topk", f"""WITH {_E}, g AS (SELECT unnest({_COVER}::DOUBLE[]) AS coverage), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k, count(*) OVER () AS total, sum(click) OVER () AS all_clicks FROM e)
 SELECT coverage, count(*) AS rows, CAST(sum(click) AS BIGINT) AS clicks, min(score) AS cutoff, round(avg(click), 9) AS ctr, round(sum(click) / max(all_clicks), 9) AS capture, round(avg(click) / (max(all_clicks) / max(total)), 9) AS lift
 FROM r, g WHERE k <= greatest(1, ceil(total * coverage)) GROUP BY 1""")(lambda s, d: evaluation.topk_metrics(events(s, d), _COVER).select("coverage", "rows", "clicks", "cutoff", *[F.round(c, 9).alias(c) for c in ("ctr", "capture", "lift")]))


def _groups_sql(n: int, order: str) -> str:
    return f"WITH {_E}, r AS (SELECT *, CAST(ntile({n}) OVER (ORDER BY {order}) AS INTEGER) AS grp FROM e) SELECT grp, count(*) AS n_rows, CAST(sum(click) AS BIGINT) AS clicks, min(score) AS min_score, max(score) AS max_score, round(avg(score), 6) AS mean_score, round(avg(click), 9) AS ctr FROM r GROUP BY 1"


def _groups(n: int, ascending: bool):
    return lambda s, d: evaluation.score_groups(events(s, d), n, ascending).select("grp", "n_rows", "clicks", "min_score", "max_score", F.round("mean_score", 6).alias("mean_score"), F.round("ctr", 9).alias("ctr"))


_add("m6_deciles", _groups_sql(10, "score DESC, id"))(_groups(10, False))
_add("l5_calibration_bins", _groups_sql(20, "score, id DESC"))(_groups(20, True))
