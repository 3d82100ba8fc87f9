"""Queries from raw CSV to clean tables, rates, reports and saved predictions, each through the sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.functions import features
from ratewise.operators import averaged, checks, cleaning, entities, rates
from ratewise.plans.catalog import _E, _add, events
from ratewise.plans.learned import FEATURES, QUERIES, SQL, noisy_rows
from ratewise.plans.reports import _SPLIT, split_events
from ratewise.sources import sql, tables

COLUMNS = ["id", "click", "hour", "site"]
#: Text of the label and the hour of a raw row by its id: spaces, decimals, blanks and values that do not parse.
_CLICK = "CASE WHEN id % 37 = 0 THEN 'x' WHEN id % 41 = 0 THEN '7' WHEN id % 43 = 0 THEN ' ' WHEN id % 47 = 0 THEN '0.5' WHEN id % 2 = 0 THEN concat(' ', click) ELSE concat(click, '.0') END"
_HOUR_BAD = "id % 29 = 0"


def raw_csv(spark: SparkSession, sf_dir: str) -> str:
    """The path of events as headed CSV with dirty labels, hours and sites."""
    path = tables.new_folder(spark, "raw")
    e = events(spark, sf_dir)
    raw = e.select(F.col("id").cast("string").alias("id"), F.expr(_CLICK).alias("click"), F.when(F.expr(_HOUR_BAD), "99999999").otherwise(F.date_format("ts", "yyMMddHH")).alias("hour"), F.concat(F.lit("  "), "site", F.lit("　")).alias("site"))
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def clean(raw: DataFrame) -> DataFrame:
    """Typed rows beside the raw label."""
    label, hour = cleaning.safe_int(F.col("click"), "tinyint"), cleaning.parse_hour(F.col("hour"))
    return raw.select(F.col("id").try_cast("bigint").alias("id"), label.alias("click"), F.col("click").alias("raw_click"), hour.alias("ts"), F.date_format(hour, "yyyy-MM-dd").alias("date"), cleaning.trimmed(F.col("site")).alias("site"))


def _kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """(rows whose label stands, folder of the quarantined ones)."""
    rows, out = clean(tables.read_events_csv(spark, raw_csv(spark, sf_dir), COLUMNS)), tables.new_folder(spark, "quarantine")
    return cleaning.quarantine(rows, cleaning.flag_invalid_label(F.col("raw_click"), F.col("click")), out, {"click": "raw_click"}), out


def a1_csv_to_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CSV, cleaned, quarantined, written by date, read again with two columns, and counted."""
    path = tables.new_folder(spark, "clean")
    tables.write_by_date(_kept(spark, sf_dir)[0].dropna(subset=["date"]), path, "date")
    x = rates.rate_by(tables.read_events(spark, path, ["date", "click"]).dropna(subset=["click"]), ["date"])
    return x.select(F.col("date").cast("string").alias("date"), "impressions", "clicks", F.round("ctr", 9).alias("ctr"))


_BAD = "(id % 37 = 0 OR id % 41 = 0 OR (id % 43 <> 0 AND id % 47 = 0))"
_BLANK = "(id % 37 <> 0 AND id % 41 <> 0 AND id % 43 = 0)"
_add("a1_csv_to_rates", f"WITH {_E} SELECT date, count(*) AS impressions, CAST(sum(click) AS BIGINT) AS clicks, round(avg(click), 9) AS ctr FROM e WHERE NOT {_BAD} AND NOT {_BLANK} AND id % 29 <> 0 GROUP BY 1")(a1_csv_to_rates)
_add("a13_quarantined", f"WITH {_E} SELECT id, CASE WHEN id % 37 = 0 THEN 'x' WHEN id % 41 = 0 THEN '7' ELSE '0.5' END AS click_raw, CASE WHEN id % 37 <> 0 AND id % 41 = 0 THEN 7 ELSE -1 END AS click FROM e WHERE {_BAD}")(
    lambda s, d: s.read.parquet(_kept(s, d)[1]).select("id", "click_raw", F.coalesce(F.col("click").cast("int"), F.lit(-1)).alias("click")))
_add("b1_b3_clean_values", f"""WITH {_E} SELECT id, site, CASE WHEN id % 29 <> 0 THEN strftime(ts, '%Y-%m-%d %H:00:00') END AS at, CASE WHEN id % 37 <> 0 AND id % 41 = 0 THEN 7 WHEN NOT {_BAD} AND NOT {_BLANK} THEN click ELSE -1 END AS click FROM e""")(
    lambda s, d: clean(tables.read_events_csv(s, raw_csv(s, d), COLUMNS)).select("id", "site", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.coalesce(F.col("click").cast("int"), F.lit(-1)).alias("click")))
_CELLS = {
    ("rows", None): "count(*)", ("bad_hour", "hour"): f"count(*) FILTER ({_HOUR_BAD})", ("extra_ids", "id"): "count(id) - count(DISTINCT id)", ("blanks", "click"): f"count(*) FILTER ({_BLANK})", ("lost", "click"): "count(*) FILTER (id % 37 = 0 OR (id % 41 <> 0 AND id % 43 <> 0 AND id % 47 = 0))",
    ("label_0", "click"): f"count(*) FILTER (NOT {_BAD} AND NOT {_BLANK} AND click = 0)", ("label_1", "click"): f"count(*) FILTER (NOT {_BAD} AND NOT {_BLANK} AND click = 1)", ("label_other", "click"): "count(*) FILTER (id % 37 <> 0 AND id % 41 = 0)", ("quarantined", "click"): f"count(*) FILTER ({_BAD})"}
_add("b7_cleaning_report", f"WITH {_E} " + " UNION ALL ".join(f"SELECT '{m}' AS measure, {repr(c) if c else 'NULL'} AS \"column\", CAST({n} AS BIGINT) AS n FROM e" for (m, c), n in _CELLS.items()))(
    lambda s, d: cleaning.cleaning_report(tables.read_events_csv(s, raw_csv(s, d), COLUMNS), {"click": "tinyint"}, "hour", "id", "click").filter(" OR ".join(f"(measure = '{m}' AND column <=> {repr(c) if c else 'NULL'})" for m, c in _CELLS)))
_add("b10_schema_differences", "SELECT 'a' AS side, 'props' AS \"column\" UNION ALL SELECT 'b', column_name FROM (DESCRIBE lineitem) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE events)) UNION ALL SELECT 'a', column_name FROM (DESCRIBE events) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE lineitem)) AND column_name NOT IN ('props', 'ts')")(
    lambda s, d: cleaning.compare_schemas(s, s.read.parquet(f"{d}/events.parquet").columns, s.read.parquet(f"{d}/lineitem.parquet").columns, ("ts",)))


def a4_read_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits written as datasets of their own, in columns of different order, and read as one table."""
    x, paths = split_events(spark, sf_dir), []
    for name, columns in (("train", ["id", "click", "split"]), ("valid", ["split", "id", "click"]), ("holdout", ["click", "split", "id"])):
        paths.append(tables.new_folder(spark, name))
        x.filter(F.col("split") == name).select(*columns).write.parquet(paths[-1])
    return tables.read_many(spark, *paths, columns=["split", "click", "id"]).groupBy("split").agg(F.count("*").alias("n_rows"), F.sum("click").alias("clicks"), F.max("id").alias("last_id"))


_add("a4_read_many", f"WITH {_E}, x AS (SELECT *, {_SPLIT} AS split FROM e) SELECT split, count(*) AS n_rows, CAST(sum(click) AS BIGINT) AS clicks, max(id) AS last_id FROM x WHERE split IS NOT NULL GROUP BY 1")(a4_read_many)


def a6_a7_small_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's result as CSV and the same table as JSON lines, both read back."""
    csv, report = tables.new_folder(spark, "csv"), tables.new_folder(spark, "json")
    sql.register_events(events(spark, sf_dir), "rw_sinks")
    text = "SELECT site, count(*) AS n_rows, sum(click) AS clicks FROM rw_sinks WHERE click >= :least GROUP BY site"
    tables.query_to_csv(spark, text, csv, {"least": 0})
    tables.write_report_json(sql.run_sql(spark, text, {"least": 1}), report)
    kind = "site string, n_rows long, clicks long"
    return spark.read.schema(kind).option("header", True).csv(csv).withColumn("sink", F.lit("csv")).unionByName(spark.read.schema(kind).json(report).withColumn("sink", F.lit("json")))


_add("a6_a7_small_sinks", f"WITH {_E} SELECT site, count(*) AS n_rows, CAST(sum(click) AS BIGINT) AS clicks, 'csv' AS sink FROM e GROUP BY 1 UNION ALL SELECT site, count(*), CAST(sum(click) AS BIGINT), 'json' FROM e WHERE click >= 1 GROUP BY 1")(a6_a7_small_sinks)


def a15_saved_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events to scored rows: features of earlier dates, a line fitted on the training dates, predictions saved, read back and checked."""
    rows, path = noisy_rows(spark, sf_dir), tables.new_folder(spark, "predictions")
    model = averaged.fit(rows.filter("split = 'train'"), FEATURES)
    tables.save_predictions(averaged.score(model, rows.filter("split = 'holdout'")), path, columns=("id", "click", "split"))
    back = spark.read.parquet(path)
    return checks.check_values(back, checks.prediction_rules("probability"), "predictions").unionByName(
        back.agg(F.lit("rows").alias("check"), F.lit("predictions").alias("subject"), F.lit("PASS").alias("status"), F.count("*").cast("string").alias("observed"), F.count_distinct("id").cast("string").alias("expected")))


_add("a15_saved_predictions", f"""WITH {_E}, x AS (SELECT CAST(count(*) AS VARCHAR) AS n FROM (SELECT *, {_SPLIT} AS split FROM e) WHERE split = 'holdout')
 SELECT unnest(['score_missing', 'score_range', 'id_null', 'label_null', 'label_other']) AS "check", 'predictions' AS subject, 'PASS' AS status, '0' AS observed, '0' AS expected UNION ALL SELECT 'rows', 'predictions', 'PASS', n, n FROM x""")(a15_saved_predictions)
_add("i2_i7_checks", "SELECT 'PASSED' AS status, CAST(2 AS BIGINT) AS passed, CAST(0 AS BIGINT) AS warnings, CAST(0 AS BIGINT) AS errors, 'events' AS subject UNION ALL SELECT 'FAILED', 1, 0, 1, 'lineitem'")(
    lambda s, d: _summaries(s, d))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two required columns of each table, summed up."""
    out = None
    for name in ("events", "lineitem"):
        columns = spark.read.parquet(f"{sf_dir}/{name}.parquet").columns
        both = checks.check_columns(spark, columns, ["event_id"], name).unionByName(checks.check_columns(spark, columns, columns[:2], name))
        row = checks.summary(both).withColumn("subject", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


KEYS = ["site", "bucket", "user_id", "hour_of_day", "bucket_site"]
_VALUES = ("hist_impressions", "hist_clicks", "hist_ctr", "exposure_percentile", "te")


def _five(x: DataFrame) -> DataFrame:
    """Events with five keys of three types, nulls among them."""
    return features.time_parts(x).withColumns({"bucket_site": features.cross_key(F.col("bucket"), F.col("site")), "site": F.when(F.col("id") % 11 != 0, F.col("site"))})


def _values(x: DataFrame) -> DataFrame:
    return x.select("id", *[(F.round(f"{k}_{c}", 9) if c in _VALUES[2:] else F.col(f"{k}_{c}")).alias(f"{k}_{c}") for k in KEYS for c in _VALUES])


def g7_g16_five_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History and encoding of five keys before each event's date, from one pass for all daily sums."""
    return _values(entities.add_keys(_five(split_events(spark, sf_dir)), KEYS, tables.new_folder(spark, "keys")))


def g9_g17_five_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout events with history and encoding of five keys over train and valid, from the two splits' saved daily sums."""
    x, folder = _five(split_events(spark, sf_dir)), tables.new_folder(spark, "keys")
    for name in ("train", "valid"):
        entities.save_daily_sums(x.filter(F.col("split") == name), KEYS, f"{folder}/{name}")
    return _values(entities.add_keys_split(x.filter("split = 'holdout'"), [f"{folder}/train", f"{folder}/valid"], KEYS, folder))


_E5 = f"{_E}, f AS (SELECT id, date, click, CASE WHEN id % 11 <> 0 THEN site END AS site, bucket, user_id, CAST(hour(ts) AS INTEGER) AS hour_of_day, bucket || '_' || site AS bucket_site, {_SPLIT} AS split FROM e), s5 AS (SELECT * FROM f WHERE split IS NOT NULL)"


def _key_by_date_sql(k: str) -> str:
    return f"""d_{k} AS (SELECT {k}, date, count(click) AS n, sum(click) AS c FROM s5 GROUP BY ALL), a_{k} AS (SELECT t.date, d.{k}, CAST(sum(n) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS c FROM (SELECT DISTINCT date FROM s5) t JOIN d_{k} d ON d.date < t.date GROUP BY ALL),
 p_{k} AS (SELECT *, (rank() OVER (PARTITION BY date ORDER BY n) + (count(*) OVER (PARTITION BY date, n) - 1) / 2) / count(*) OVER (PARTITION BY date) AS p FROM a_{k} WHERE n > 0)"""


def _key_whole_sql(k: str) -> str:
    return f"""d_{k} AS (SELECT {k}, count(click) AS n, CAST(sum(click) AS BIGINT) AS c FROM s5 WHERE split <> 'holdout' GROUP BY 1), p_{k} AS (SELECT *, (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2) / count(*) OVER () AS p FROM d_{k} WHERE n > 0)"""


def _key_columns_sql(k: str) -> str:
    n, c = f"coalesce(p_{k}.n, 0)", f"coalesce(p_{k}.c, 0)"
    return f"{n} AS {k}_hist_impressions, {c} AS {k}_hist_clicks, round(coalesce(p_{k}.c / p_{k}.n, 0), 9) AS {k}_hist_ctr, round(coalesce(p_{k}.p, 0), 9) AS {k}_exposure_percentile, round(({c} + 20 * prior) / ({n} + 20), 9) AS {k}_te"


_add("g7_g16_five_keys", f"""WITH {_E5}, {", ".join(_key_by_date_sql(k) for k in KEYS)}, t AS (SELECT date, sum(click) AS c, count(click) AS n FROM s5 GROUP BY 1),
 pr AS (SELECT date, coalesce(CAST(sum(c) OVER w AS DOUBLE) / sum(n) OVER w, 0.17) AS prior FROM t WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT id, {", ".join(_key_columns_sql(k) for k in KEYS)} FROM s5 JOIN pr ON pr.date = s5.date {" ".join(f"LEFT JOIN p_{k} ON p_{k}.date = s5.date AND p_{k}.{k} IS NOT DISTINCT FROM s5.{k}" for k in KEYS)}""")(g7_g16_five_keys)
_add("g9_g17_five_keys", f"""WITH {_E5}, {", ".join(_key_whole_sql(k) for k in KEYS)}, o AS (SELECT CAST(sum(click) AS DOUBLE) / count(click) AS prior FROM s5 WHERE split <> 'holdout')
 SELECT id, {", ".join(_key_columns_sql(k) for k in KEYS)} FROM s5 JOIN o ON true {" ".join(f"LEFT JOIN p_{k} ON p_{k}.{k} IS NOT DISTINCT FROM s5.{k}" for k in KEYS)} WHERE s5.split = 'holdout'""")(g9_g17_five_keys)


__all__ = ["QUERIES", "SQL"]
