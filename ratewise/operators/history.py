"""Frequency, strictly earlier history and smoothed target encoding of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratewise.operators.rates import rate

#: Fixed values of the encoding: prior without any history, and the prior's weight in rows.
FIRST_PRIOR, SMOOTHING = 0.17, 20.0


def apply_mapping(df: DataFrame, mapping: DataFrame, keys: list[str], fills: dict[str, float | None]) -> DataFrame:
    """Left look-up that keeps every row; a null key finds a null key; misses are filled."""
    m = mapping.select(*[F.col(k).alias(f"_m_{k}") for k in keys], *fills)
    on = [df[k].eqNullSafe(m[f"_m_{k}"]) for k in keys]
    out = df.join(m, on, "left").drop(*[f"_m_{k}" for k in keys])
    filled = {c: v for c, v in fills.items() if v is not None}
    return out.fillna(filled) if filled else out


def frequency_map(df: DataFrame, key: str) -> DataFrame:
    return df.dropna(subset=[key]).groupBy(key).agg(F.count("*").alias("frequency"))


def save_frequency_map(df: DataFrame, key: str, path: str) -> None:
    """The frequency map of a key as a table (key, frequency)."""
    frequency_map(df, key).write.mode("overwrite").parquet(path)


def add_frequency(df: DataFrame, fitted_on: DataFrame, key: str) -> DataFrame:
    return apply_mapping(df, frequency_map(fitted_on, key), [key], {"frequency": 0}).withColumnRenamed("frequency", f"{key}_freq")


def daily_key_stats(df: DataFrame, key: str, date: str = "date", label: str = "click") -> DataFrame:
    """Labelled rows and clicks by date and key; a null key is a key."""
    return df.groupBy(date, key).agg(F.count(label).alias("impressions"), F.coalesce(F.sum(label), F.lit(0)).cast("bigint").alias("clicks"))


def history_intervals(daily: DataFrame, key: str, date: str = "date") -> DataFrame:
    """Interval map of a key's history: key, valid_from, valid_to, hist_impressions, hist_clicks, hist_ctr.

    A row holds for the dates after valid_from up to valid_to (null: all later ones): the sums of the key's dates up to
    valid_from. As many rows as the key has dates; a date before its first has no row.
    """
    own = Window.partitionBy(key).orderBy(date)  # one row for each date of a key
    x = daily.dropna(subset=[date]).select(key, F.col(date).alias("valid_from"), F.lead(date).over(own).alias("valid_to"), F.sum("impressions").over(own).alias("hist_impressions"), F.sum("clicks").over(own).alias("hist_clicks"))
    return x.withColumn("hist_ctr", rate(F.col("hist_clicks"), F.col("hist_impressions")))


def look_up_history(df: DataFrame, intervals: DataFrame, key: str, date: str = "date") -> DataFrame:
    """Each row with what its key's history was before its date, whatever the date, in columns KEY_hist_impressions, KEY_hist_clicks, KEY_hist_ctr; no history, or no date, gives 0.

    Only the distinct (key, date) of the rows meet the map, in order of date within a key, so a key that most rows have
    brings no more rows than there are dates, and no row is compared with intervals that do not hold it.
    """
    names = ("hist_impressions", "hist_clicks", "hist_ctr")
    state = F.struct(*names)
    asked = df.select(F.col(key).alias("_k"), F.col(date).alias("_d")).dropna(subset=["_d"]).distinct().withColumns({"_asks": F.lit(0), "_state": F.lit(None).cast(intervals.select(state.alias("s")).schema["s"].dataType)})
    known = intervals.select(F.col(key).alias("_k"), F.col("valid_from").alias("_d"), F.lit(1).alias("_asks"), state.alias("_state"))  # a date's own rows come after its question
    upto = Window.partitionBy("_k").orderBy("_d", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = asked.unionByName(known).withColumn("_state", F.last("_state", ignorenulls=True).over(upto)).filter("_asks = 0")
    m = found.select(F.col("_k").alias(key), F.col("_d").alias(date), *[F.col(f"_state.{c}").alias(f"{key}_{c}") for c in names])
    return apply_mapping(df, m, [date, key], {f"{key}_{c}": HISTORY[c] for c in names})


def with_exposure_percentile(history: DataFrame, by: list[str], column: str = "hist_impressions") -> DataFrame:
    """Average rank over count of the keys with impressions, within each value of by (a date, or nothing); other keys get 0.

    Ranks come from the counts of each distinct number of impressions, so a date with very many keys is no window partition.
    """
    sizes = history.filter(F.col(column) > 0).groupBy(*by, column).agg(F.count("*").alias("keys"))
    return _with_percentile(history, sizes, by, column)


def _with_percentile(rows: DataFrame, sizes: DataFrame, by: list[str], column: str) -> DataFrame:
    """sizes: keys with each number of impressions, for each value of by."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row for each number of impressions
    upto = F.sum("keys").over(w.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = sizes.select(*by, column, ((upto - (F.col("keys") - 1) / 2) / F.sum("keys").over(w)).alias("exposure_percentile"))
    return rows.join(ranks, [*by, column], "left").fillna(0.0, ["exposure_percentile"])


def history_where_seen(daily: DataFrame, key: str, date: str = "date", of: tuple[str, ...] = ()) -> DataFrame:
    """For every (date, key) that occurs: impressions and clicks of the key's earlier dates, their rate, and the key's percentile among all keys seen before.

    Sums run along each key's own dates. What the keys' sums are before a date follows from the changes: a key leaves its
    last number of impressions and enters a new one; so dates meet numbers of impressions, not keys. Daily sums without a
    date are earlier than none and are left out. of: columns that tell several kinds of keys in one table apart.
    """
    daily = daily.dropna(subset=[date])
    own = Window.partitionBy(*of, key).orderBy(date)  # one row for each date of a key
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    x = daily.select(date, *of, key, F.coalesce(F.sum("impressions").over(before), F.lit(0)).alias("hist_impressions"), F.coalesce(F.sum("clicks").over(before), F.lit(0)).alias("hist_clicks"), F.sum("impressions").over(own).alias("_upto"))
    moves = x.select(F.col(date).alias("_d"), *of, F.inline(F.array(F.struct(F.col("_upto").alias("hist_impressions"), F.lit(1).alias("_by")), F.struct(F.col("hist_impressions"), F.lit(-1).alias("_by")))))
    moves = moves.filter("hist_impressions > 0").groupBy("_d", *of, "hist_impressions").agg(F.sum("_by").alias("_by")).filter("_by <> 0")
    dates = daily.select(date).distinct()  # one row for each date
    sizes = moves.join(F.broadcast(dates), F.col("_d") < F.col(date)).groupBy(date, *of, "hist_impressions").agg(F.sum("_by").alias("keys")).filter("keys > 0")
    return _with_percentile(x.drop("_upto"), sizes, [date, *of], "hist_impressions").withColumn("hist_ctr", rate(F.col("hist_clicks"), F.col("hist_impressions")))


#: Columns of a key's history, with the values of an unseen key; in a table of rows they carry the key's name in front.
HISTORY = {"hist_impressions": 0, "hist_clicks": 0, "hist_ctr": 0.0, "exposure_percentile": 0.0}


def _named(mapping: DataFrame, key: str, columns) -> DataFrame:
    return mapping.withColumnsRenamed({c: f"{key}_{c}" for c in columns})


def add_history(df: DataFrame, key: str, date: str = "date", label: str = "click") -> DataFrame:
    """Each row with its key's history before its date, in columns KEY_hist_impressions, KEY_hist_clicks, KEY_hist_ctr, KEY_exposure_percentile; no history gives 0."""
    past = history_where_seen(daily_key_stats(df, key, date, label), key, date)
    return apply_mapping(df, _named(past, key, HISTORY), [date, key], {f"{key}_{c}": v for c, v in HISTORY.items()})


def history_map(df: DataFrame, key: str, label: str = "click") -> DataFrame:
    """One mapping over a whole split, for the next one: key, hist_impressions, hist_clicks, hist_ctr, exposure_percentile."""
    m = df.groupBy(key).agg(F.count(label).alias("hist_impressions"), F.coalesce(F.sum(label), F.lit(0)).cast("bigint").alias("hist_clicks"))
    return with_exposure_percentile(m, []).withColumn("hist_ctr", rate(F.col("hist_clicks"), F.col("hist_impressions")))


def add_history_split(df: DataFrame, earlier: list[DataFrame], key: str, label: str = "click") -> DataFrame:
    """Rows of a later split with their key's history over all rows of the earlier splits (valid: train; holdout: train and valid); columns as in add_history."""
    mapping = history_map(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), earlier), key, label)
    return apply_mapping(df, _named(mapping, key, HISTORY), [key], {f"{key}_{c}": v for c, v in HISTORY.items()})


#: Columns that a saved map adds up, with what a day adds when a key is missing from it.
SUMMED = ("impressions", "clicks")


def saved_key(key: Column) -> Column:
    """A text that tells a null key from every value, so that a bucketed map needs no null-safe join."""
    return F.when(key.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), key.cast("string")))


def _write_map(rows: DataFrame, table: str, buckets: int) -> None:
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, "saved_key").sortBy("saved_key").saveAsTable(table)


def save_history_map(daily: DataFrame, key: str, table: str, buckets: int | None = None) -> None:
    """A map (saved_key, key, impressions, clicks) from daily sums, as a table in buckets of the key: as many as shuffle partitions, or more."""
    n = buckets or int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = daily.groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMMED])
    _write_map(sums.select(saved_key(F.col(key)).alias("saved_key"), key, *SUMMED), table, n)


def add_days(spark: SparkSession, table: str, daily: DataFrame, key: str, into: str) -> None:
    """The map of table with more daily sums, written as the table into (another one; a reader of the first is not disturbed). Only the days are shuffled."""
    if into == table:
        raise ValueError("a map is not written over the table that it is read from")
    n = next(int(r["data_type"]) for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r["col_name"] == "Num Buckets")
    old = spark.table(table).select("saved_key", F.col(key).alias("_old"), *[F.col(c).alias(f"_{c}") for c in SUMMED])
    new = daily.groupBy(key).agg(*[F.sum(c).alias(c) for c in SUMMED]).withColumn("saved_key", saved_key(F.col(key)))
    both = old.join(new, "saved_key", "full")
    _write_map(both.select("saved_key", F.coalesce("_old", key).alias(key), *[(F.coalesce(F.col(f"_{c}"), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))).alias(c) for c in SUMMED]), into, n)


def look_up_saved(df: DataFrame, table: str, key: str) -> DataFrame:
    """Each row with its key's KEY_hist_impressions, KEY_hist_clicks and KEY_hist_ctr of a saved map; a missing key gives 0. The map's side is read in its buckets, without a shuffle."""
    m = df.sparkSession.table(table).select("saved_key", *[F.col(c).alias(f"_{c}") for c in SUMMED])
    out = df.withColumn("saved_key", saved_key(F.col(key))).join(m, "saved_key", "left").drop("saved_key")
    n, c = (F.coalesce(F.col(f"_{x}"), F.lit(0)) for x in SUMMED)
    return out.withColumns({f"{key}_hist_impressions": n, f"{key}_hist_clicks": c, f"{key}_hist_ctr": rate(c, n)}).drop("_impressions", "_clicks")


def unseen_ratio(df: DataFrame, keys: list[str]) -> DataFrame:
    """key, n_rows, unseen_rows, unseen_ratio: rows whose key had no history; one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"{k}_hist_impressions") == 0).alias(f"u{i}") for i, k in enumerate(keys)])
    x = one.select("n", F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"u{i}").alias("unseen_rows")) for i, k in enumerate(keys)])))
    return x.select("key", F.col("n").alias("n_rows"), "unseen_rows", rate(F.col("unseen_rows"), F.col("n")).alias("unseen_ratio"))


def feature_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, min, max, mean; one pass."""
    one = df.agg(*[F.struct(F.lit(c).alias("feature"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).alias("mean")).alias(f"b{i}") for i, c in enumerate(columns)])
    return one.select(F.inline(F.array(*[f"b{i}" for i in range(len(columns))])))


def smoothed_rate(clicks: Column, n: Column, prior: Column, m: float = SMOOTHING) -> Column:
    return F.greatest(F.least((clicks + m * prior) / (n + m), F.lit(1.0)), F.lit(0.0))


def priors_by_date(daily: DataFrame, date: str = "date") -> DataFrame:
    """Rate of all dates before each date; the first date has FIRST_PRIOR. Sums without a date are left out."""
    totals = daily.dropna(subset=[date]).groupBy(date).agg(F.sum("impressions").alias("n"), F.sum("clicks").alias("c"))
    before = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)  # one row for each date
    return totals.select(date, F.coalesce(F.try_divide(F.sum("c").over(before).cast("double"), F.sum("n").over(before)), F.lit(FIRST_PRIOR)).alias("prior"))


def add_target_encoding(df: DataFrame, key: str, date: str = "date", label: str = "click", m: float = SMOOTHING) -> DataFrame:
    """KEY_te, the encoding from strictly earlier dates; an unseen key has its date's prior. Rows without a date have none."""
    daily = daily_key_stats(df, key, date, label).dropna(subset=[date])
    before = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)  # one row for each date of a key
    past = daily.select(date, key, F.coalesce(F.sum("impressions").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("clicks").over(before), F.lit(0)).alias("_c"))
    te = past.join(F.broadcast(priors_by_date(daily, date)), date).withColumn(f"{key}_te", smoothed_rate(F.col("_c"), F.col("_n"), F.col("prior"), m))
    return apply_mapping(df, te, [date, key], {f"{key}_te": None})


def te_map(df: DataFrame, key: str, label: str = "click", m: float = SMOOTHING) -> DataFrame:
    """key, te, prior over a whole split, for the next one; without any labelled row the prior is FIRST_PRIOR."""
    prior = df.agg(F.coalesce(F.try_divide(F.sum(label).cast("double"), F.count(label)), F.lit(FIRST_PRIOR)).alias("prior"))
    x = df.groupBy(key).agg(F.count(label).alias("_n"), F.coalesce(F.sum(label), F.lit(0)).alias("_c")).join(F.broadcast(prior))
    return x.select(key, smoothed_rate(F.col("_c"), F.col("_n"), F.col("prior"), m).alias("te"), "prior")


def add_te_split(df: DataFrame, earlier: list[DataFrame], key: str, label: str = "click", m: float = SMOOTHING) -> DataFrame:
    """Rows of a later split with KEY_te over all rows of the earlier splits; an unseen key has their prior."""
    past = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), earlier)
    prior = past.agg(F.coalesce(F.try_divide(F.sum(label).cast("double"), F.count(label)), F.lit(FIRST_PRIOR)).alias("_prior"))
    rows = apply_mapping(df, te_map(past, key, label, m).withColumnRenamed("te", f"{key}_te"), [key], {f"{key}_te": None})
    return rows.join(F.broadcast(prior)).withColumn(f"{key}_te", F.coalesce(f"{key}_te", "_prior")).drop("_prior")
