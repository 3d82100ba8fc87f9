"""Checks of tables as rows (check, subject, status, observed, expected), and reports over splits and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECK = "check string, subject string, status string, observed string, expected string"


def check_columns(spark: SparkSession, columns: list[str], required: list[str], subject: str) -> DataFrame:
    """Required columns of a stage, without reading it."""
    missing = sorted(set(required) - set(columns))
    return spark.createDataFrame([("required_columns", subject, "ERROR" if missing else "PASS", ",".join(missing), "")], CHECK)


def check_values(df: DataFrame, rules: dict[str, Column], subject: str) -> DataFrame:
    """For each rule (name: what a bad row fulfils) the bad rows; all rules in one pass."""
    rows = df.agg(*[F.count_if(bad).alias(f"b{i}") for i, bad in enumerate(rules.values())])
    per = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"b{i}").alias("bad")) for i, n in enumerate(rules)])
    x = rows.select(F.inline(per))
    return x.select("check", F.lit(subject).alias("subject"), F.when(F.col("bad") == 0, "PASS").otherwise("ERROR").alias("status"), F.col("bad").cast("string").alias("observed"), F.lit("0").alias("expected"))


def label_rules(label: str = "click") -> dict[str, Column]:
    c = F.col(label)
    return {"label_null": c.isNull(), "label_other": c.isNotNull() & ~c.isin(0, 1)}


def prediction_rules(score: str = "score", id_col: str = "id", label: str = "click") -> dict[str, Column]:
    s = F.col(score).cast("double")
    return {"score_missing": s.isNull() | F.isnan(s), "score_range": ~s.between(0, 1), "id_null": F.col(id_col).isNull()} | label_rules(label)


def summary(checks: DataFrame) -> DataFrame:
    """One row: checks by status, and PASSED where none is an error or a warning."""
    x = checks.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("PASS", "passed"), ("WARNING", "warnings"), ("ERROR", "errors"))])
    return x.withColumn("status", F.when((F.col("warnings") == 0) & (F.col("errors") == 0), "PASSED").otherwise("FAILED"))


def invalid_value(feature: str, impressions: str | None = None) -> Column:
    """By the feature's ending: negative counts, clicks above impressions, rates outside [0, 1]; null is not invalid."""
    c = F.col(feature)
    if feature.endswith(("_impressions", "_freq")):
        return c < 0
    if feature.endswith("_clicks"):
        return (c < 0) | (c > F.col(impressions)) if impressions else c < 0
    return ~c.between(0, 1)


def column_stats(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """For each split and feature: missing, infinite, range and mean of finite values, invalid values, status. One pass."""
    out = []
    for c in columns:
        x = F.col(c).cast("double")
        finite = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        pair = c.removesuffix("_clicks") + "_impressions"
        out.append(F.struct(
            F.lit(c).alias("feature"), F.count_if(x.isNull() | F.isnan(x)).alias("missing_count"), F.count_if(F.abs(x) == float("inf")).alias("inf_count"), F.min(finite).alias("min"), F.max(finite).alias("max"),
            F.avg(finite).alias("mean"), F.count_if(invalid_value(c, pair if pair in df.columns else None)).alias("invalid_count")))
    x = df.groupBy(split).agg(F.array(*out).alias("f")).select(split, F.inline("f"))
    status = F.when((F.col("inf_count") > 0) | (F.col("invalid_count") > 0), "ERROR").when(F.col("missing_count") > 0, "WARNING").otherwise("PASS")
    return x.withColumn("status", status)


def cold_start(df: DataFrame, columns: list[str], date: str = "date") -> DataFrame:
    """Rows of the earliest date, and how many of them have a history other than 0."""
    first = df.agg(F.min(date).alias("_first"))
    known = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(0)) != 0 for c in columns])
    return df.join(F.broadcast(first), F.col(date) == F.col("_first")).agg(F.count("*").alias("n_rows"), F.count_if(known).alias("known"))


def mapping_consistent(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """For each feature the keys with more than one value, null being a value."""
    values = [(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int")) > 1).alias(c) for c in features]
    x = df.groupBy(key).agg(*values).agg(*[F.count_if(c).alias(c) for c in features])
    return x.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("keys")) for c in features])))


def category_rate_summary(tables: list[DataFrame], top: int = 20) -> DataFrame:
    """Stacked category rates, of each feature the top values by impressions."""
    every = reduce(DataFrame.unionByName, tables)
    order = Window.partitionBy("feature_name").orderBy(F.desc("impressions"), F.asc_nulls_first("feature_value"))
    return every.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= top).drop("_k")


def id_fingerprint(df: DataFrame, id_col: str = "id") -> DataFrame:
    """One row that tells sets of ids apart whatever their order: rows and the sum of 48 bits of each id's MD5."""
    bits = F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("fingerprint"))


def same_ids(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    x = id_fingerprint(a, id_col).select(F.struct("n_rows", "fingerprint").alias("a")).join(F.broadcast(id_fingerprint(b, id_col).select(F.struct("n_rows", "fingerprint").alias("b"))))
    return x.select((F.col("a") == F.col("b")).alias("same"))


def daily_distribution(df: DataFrame, split: str = "split", date: str = "date", label: str = "click") -> DataFrame:
    """Rows, clicks and rate of each date, and its share of its split."""
    x = df.groupBy(split, date).agg(F.count("*").alias("n_rows"), F.sum(label).alias("clicks"), F.avg(label).alias("ctr"))
    return x.withColumn("share_in_split", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(split)))


def source_distribution(whole: DataFrame, sample: DataFrame, group: str) -> DataFrame:
    """For each group its rows, those sampled, and their ratio."""
    a = whole.groupBy(group).agg(F.count("*").alias("group_rows"))
    b = sample.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("sampled_rows"))
    x = a.join(b, F.col(group).eqNullSafe(F.col("_g")), "left").select(group, "group_rows", F.coalesce("sampled_rows", F.lit(0)).alias("sampled_rows"))
    return x.withColumn("ratio", F.col("sampled_rows") / F.col("group_rows"))


def check_rows(one: DataFrame, rules: dict[str, tuple[str, Column | None]], subject: str, bad: str = "ERROR") -> DataFrame:
    """Check rows from a one-row table: for each rule (name: observed column, expected value, or None for 0) PASS where they are equal."""
    rows = []
    for name, (column, expected) in rules.items():
        want = F.lit(0) if expected is None else expected
        status = F.when(F.col(column).eqNullSafe(want), "PASS").otherwise(bad)
        rows.append(F.struct(F.lit(name).alias("check"), F.lit(subject).alias("subject"), status.alias("status"), F.col(column).cast("string").alias("observed"), want.cast("string").alias("expected")))
    return one.select(F.inline(F.array(*rows)))


def check_row_conservation(raw: DataFrame, clean: DataFrame, subject: str = "cleaning") -> DataFrame:
    """Rows read equal rows written."""
    one = raw.agg(F.count("*").alias("read")).join(F.broadcast(clean.agg(F.count("*").alias("written"))))
    return check_rows(one, {"row_conservation": ("written", F.col("read"))}, subject)


def check_split_conservation(df: DataFrame, counts: DataFrame, splits: list[str]) -> DataFrame:
    """The rows of the splits add up to all rows; the difference is those left out."""
    one = df.agg(F.count("*").alias("all")).join(F.broadcast(counts.agg(F.coalesce(F.sum(F.when(F.col("split").isin(*splits), F.col("n_rows"))), F.lit(0)).alias("kept"))))
    return check_rows(one, {"split_conservation": ("kept", F.col("all"))}, "splits", "WARNING")


def verify_fingerprint(a: DataFrame, b: DataFrame, id_col: str = "id") -> None:
    """An error where two tables have different ids."""
    if not same_ids(a, b, id_col).first()["same"]:
        raise ValueError("the samples have different ids")


def check_label_presence(spark: SparkSession, labelled: list[str], unlabelled: list[str], label: str = "click") -> DataFrame:
    """The labelled table's columns have the label, the other table's have not."""
    rows = [("label_present", "labelled", "PASS" if label in labelled else "ERROR", str(label in labelled), "True"), ("label_absent", "unlabelled", "ERROR" if label in unlabelled else "PASS", str(label in unlabelled), "False")]
    return spark.createDataFrame(rows, CHECK)


def check_time_nulls(tables: dict[str, DataFrame], ts: str = "ts") -> DataFrame:
    """Rows without a time, for each table; any is a warning."""
    return reduce(DataFrame.unionByName, [check_rows(df.agg(F.count_if(F.col(ts).isNull()).alias("nulls")), {"time_nulls": ("nulls", None)}, name, "WARNING") for name, df in tables.items()])


def check_strict_labels(df: DataFrame, subject: str, id_col: str = "id", label: str = "click", examples: int = 10) -> DataFrame:
    """Every label is 0 or 1; observed has the number of others and up to examples of their smallest ids."""
    bad = F.col(label).isNull() | ~F.col(label).isin(0, 1)
    few = df.filter(bad).select(id_col).orderBy(id_col).limit(examples).agg(F.array_join(F.sort_array(F.collect_list(F.col(id_col).cast("string"))), ",").alias("ids"))
    one = df.agg(F.count_if(bad).alias("n")).join(F.broadcast(few))
    observed = F.when(F.col("n") == 0, F.lit("0")).otherwise(F.concat(F.col("n").cast("string"), F.lit(": "), "ids"))
    return check_rows(one.select(observed.alias("bad")), {"strict_labels": ("bad", F.lit("0"))}, subject)


def positional_match(a: DataFrame, b: DataFrame, position: str, id_col: str = "id") -> DataFrame:
    """One row: rows of both, positions where their ids differ or one has none, and the first such position. position: a column that numbers the rows of each table."""
    x = a.select(F.col(position).alias("p"), F.col(id_col).alias("ia"), F.lit(1).alias("a")).join(b.select(F.col(position).alias("p"), F.col(id_col).alias("ib"), F.lit(1).alias("b")), "p", "full")
    off = ~F.col("ia").eqNullSafe(F.col("ib")) | F.col("a").isNull() | F.col("b").isNull()
    return x.agg(F.count("a").alias("rows_a"), F.count("b").alias("rows_b"), F.count_if(off).alias("mismatches"), F.min(F.when(off, F.col("p"))).alias("first_mismatch"))


def check_submission_order(template: DataFrame, submission: DataFrame, position: str, id_col: str = "id") -> DataFrame:
    """Rows and order of ids are those of the template."""
    return check_rows(positional_match(template, submission, position, id_col), {"row_count": ("rows_b", F.col("rows_a")), "id_order": ("mismatches", None)}, "submission")


def check_stage_tables(stats: DataFrame, required: list[str]) -> DataFrame:
    """From table_stats: each required table is there and has rows, files and columns."""
    wanted = stats.sparkSession.createDataFrame([(r,) for r in required], "table string")
    x = wanted.join(F.broadcast(stats), "table", "left")  # one row for each table
    found = F.coalesce((F.col("n_rows") > 0) & (F.col("files") > 0) & (F.col("columns") > 0), F.lit(False))
    observed = F.concat_ws(" / ", F.coalesce("n_rows", F.lit(0)), F.coalesce("files", F.lit(0)), F.coalesce("columns", F.lit(0)))
    return x.select(F.lit("stage_table").alias("check"), F.col("table").alias("subject"), F.when(found, "PASS").otherwise("ERROR").alias("status"), observed.alias("observed"), F.lit("rows / files / columns").alias("expected"))


def check_stage_row_counts(stages: dict[str, DataFrame], split: str = "split") -> DataFrame:
    """For each split, every stage has as many rows as the first."""
    counts = [df.groupBy(F.col(split).alias("s")).agg(F.lit(n).alias("stage"), F.lit(i).alias("i"), F.count("*").alias("n")) for i, (n, df) in enumerate(stages.items())]
    x = reduce(DataFrame.unionByName, counts).groupBy("s").agg(F.min_by("n", "i").alias("want"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "stage", "n"))), lambda v: F.concat_ws("=", v["stage"], v["n"])), " ").alias("seen"), F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("stages"))
    good = (F.col("low") == F.col("high")) & (F.col("stages") == len(stages))
    return x.select(F.lit("stage_rows").alias("check"), F.col("s").alias("subject"), F.when(good, "PASS").otherwise("ERROR").alias("status"), F.col("seen").alias("observed"), F.col("want").cast("string").alias("expected"))


def check_split_dates(df: DataFrame, order: list[str], split: str = "split", date: str = "date") -> DataFrame:
    """Each split begins after the one before it ends; observed has its first and last date."""
    spans = df.groupBy(split).agg(F.min(date).cast("string").alias("lo"), F.max(date).cast("string").alias("hi"))
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(split))
    last = F.lag("hi").over(Window.orderBy(place))  # one row for each split
    x = spans.withColumn("last", last)
    status = F.when(F.col("last").isNull() | (F.col("lo") > F.col("last")), "PASS").otherwise("ERROR")
    return x.select(F.lit("split_dates").alias("check"), F.col(split).alias("subject"), status.alias("status"), F.concat_ws(" to ", "lo", "hi").alias("observed"), F.concat(F.lit("after "), F.coalesce("last", F.lit("nothing"))).alias("expected"))


def check_features(df: DataFrame, columns: list[str], subject: str) -> DataFrame:
    """Model features are numeric and neither null, NaN nor infinite; one check row for each."""
    numeric = {c: t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal") for c, t in df.dtypes}
    bad = {c: F.col(c).isNull() | F.isnan(F.col(c).try_cast("double")) | (F.abs(F.col(c).try_cast("double")) == float("inf")) if numeric[c] else F.lit(True) for c in columns}
    return check_values(df, {f"feature_{c}": b for c, b in bad.items()}, subject)


def check_predictions(df: DataFrame, rows: int | None = None, expected_mean: float | None = None, slack: float = 0.01, score: str = "score", id_col: str = "id", label: str = "click") -> DataFrame:
    """Scores are there, finite and in [0, 1], labels 0 or 1, ids not null; with rows and expected_mean, their number and mean are as expected."""
    out = check_values(df, prediction_rules(score, id_col, label), "predictions")
    one = df.agg(F.count("*").alias("n"), F.avg(score).alias("mean"))
    if rows is not None:
        out = out.unionByName(check_rows(one, {"row_count": ("n", F.lit(rows))}, "predictions"))
    if expected_mean is not None:
        near = F.abs(F.col("mean") - expected_mean) <= slack
        out = out.unionByName(one.select(F.lit("mean_score").alias("check"), F.lit("predictions").alias("subject"), F.when(near, "PASS").otherwise("WARNING").alias("status"), F.round("mean", 9).cast("string").alias("observed"), F.lit(str(expected_mean)).alias("expected")))
    return out


def sample_summary(df: DataFrame, targets: dict[str, int], features: list[str], split: str = "split", date: str = "date", label: str = "click") -> DataFrame:
    """For each split of a sample: target and actual rows, date range, labels, rate, number of features, nulls and infinities among them, status."""
    nulls = sum((F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in features), F.lit(0))
    infs = sum((F.count_if(F.abs(F.col(c).cast("double")) == float("inf")) for c in features), F.lit(0))
    x = df.groupBy(split).agg(
        F.count("*").alias("actual_rows"), F.min(date).cast("string").alias("start_date"), F.max(date).cast("string").alias("end_date"), F.count_if(F.col(label) == 1).alias("label_1"), F.count_if(F.col(label) == 0).alias("label_0"), F.avg(label).alias("ctr"),
        nulls.alias("null_count"), infs.alias("inf_count"))
    target = F.lit(None).cast("bigint")
    for name, n in targets.items():
        target = F.when(F.col(split) == name, F.lit(n).cast("bigint")).otherwise(target)
    good = (F.col("target_rows") == F.col("actual_rows")) & (F.col("null_count") == 0) & (F.col("inf_count") == 0)
    return x.withColumns({"target_rows": target, "feature_count": F.lit(len(features))}).withColumn("status", F.when(good, "PASS").otherwise("ERROR"))


def sample_drift(whole: DataFrame, sample: DataFrame, label: str = "click", slack: float = 0.01) -> DataFrame:
    """One row: the rate of all rows and of a sample, their distance, and a warning above slack."""
    x = whole.agg(F.avg(label).alias("full_ctr")).join(F.broadcast(sample.agg(F.avg(label).alias("sample_ctr"))))
    x = x.withColumn("drift", F.abs(F.col("full_ctr") - F.col("sample_ctr")))
    return x.withColumn("status", F.when(F.col("drift") > slack, "WARNING").otherwise("PASS"))


def check_metrics(metrics: DataFrame, required: tuple[str, ...] = ("auc", "log_loss", "brier", "calibration_gap")) -> DataFrame:
    """For each model: required metrics are columns, finite and in range, and no holdout row was used."""
    gone = [c for c in required if c not in metrics.columns]
    bad = F.lit(bool(gone))
    for c in required:
        if c not in gone:
            bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (F.col(c) < 0)
    used = F.col("holdout_used") if "holdout_used" in metrics.columns else F.lit(False)
    status = F.when(bad | used, "ERROR").otherwise("PASS")
    return metrics.select(F.lit("metrics").alias("check"), F.col("model").alias("subject"), status.alias("status"), F.lit(",".join(gone)).alias("observed"), F.lit("").alias("expected"))


def check_strategy(thresholds: DataFrame, topk: DataFrame, deciles: DataFrame, rows: int) -> DataFrame:
    """The confusion counts of each threshold add up to rows, rates lie in range, lifts are not negative, top-K rows and clicks never fall, full coverage has all rows and lift 1, deciles add up."""
    grow = Window.orderBy("coverage")  # one row for each coverage
    falls = (F.col("clicks") < F.lag("clicks").over(grow)) | (F.col("rows") < F.lag("rows").over(grow))
    a = thresholds.agg(
        F.count_if(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") != rows).alias("confusion"), F.count_if(~F.col("precision").between(0, 1) | ~F.col("recall").between(0, 1) | ~F.col("coverage").between(0, 1)).alias("ranges"), F.count_if(F.col("lift") < 0).alias("lifts"))
    b = topk.withColumn("falls", falls).agg(F.count_if("falls").alias("falls"), F.count_if((F.col("coverage") == 1) & ((F.col("rows") != rows) | (F.abs(F.col("lift") - 1) > 1e-9))).alias("full"))
    c = deciles.agg(F.sum("n_rows").alias("decile_rows"))
    rules = {n: (n, None) for n in ("confusion", "ranges", "lifts", "falls", "full")} | {"decile_rows": ("decile_rows", F.lit(rows))}
    return check_rows(a.join(F.broadcast(b)).join(F.broadcast(c)), rules, "strategy")
