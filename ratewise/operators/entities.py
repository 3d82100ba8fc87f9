"""History and encoding of several keys in one plan: one pass over the rows for all keys' daily sums, maps saved by key, look-ups that leave the rows where they are while a map is small.

A map is a folder of Parquet with a part for each key, `key=0`, `key=1` and so on in the order of the keys. Its values are
named by saved_key, a text that tells a null from every value, so that keys of any type share the map and its look-ups are
plain equalities. Spark reads a part's size from its files: it broadcasts parts below its own threshold and shuffles for
larger ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.operators.history import FIRST_PRIOR, HISTORY, SMOOTHING, history_where_seen, priors_by_date, saved_key, smoothed_rate, with_exposure_percentile
from ratewise.operators.rates import rate

_SUMS = "saved_key string, hist_impressions long, hist_clicks long, hist_ctr double, exposure_percentile double"
DAILY = "key int, saved_key string, date string, impressions long, clicks long"
BY_DATE = f"date string, {_SUMS}, te double"
WHOLE = f"{_SUMS}, te double"


def _each_key(df: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """more, key, saved_key: a row for each key of each row, key being its place in keys."""
    if not keys:
        raise ValueError("no key given")
    return df.select(*more, F.posexplode(F.array(*[saved_key(F.col(k)) for k in keys])).alias("key", "saved_key"))


def daily_sums(df: DataFrame, keys: list[str], date: str = "date", label: str = "click") -> DataFrame:
    """key, saved_key, date, impressions, clicks: labelled rows and clicks of every key by date, from one pass. Rows without a date are left out."""
    dated = df.dropna(subset=[date])
    rows = _each_key(dated, keys, F.col(date).cast("string").alias("date"), F.col(label).alias("_label"))
    return rows.groupBy("key", "saved_key", "date").agg(F.count("_label").alias("impressions"), F.coalesce(F.sum("_label"), F.lit(0)).cast("bigint").alias("clicks"))


def save_daily_sums(df: DataFrame, keys: list[str], path: str, date: str = "date", label: str = "click", mode: str = "overwrite") -> None:
    """daily_sums as Parquet; with mode append, the sums of dates that are not in path yet."""
    daily_sums(df, keys, date, label).write.mode(mode).parquet(path)


def save_maps_by_date(spark: SparkSession, daily_path: str, path: str, m: float = SMOOTHING) -> None:
    """From saved daily sums, every key's history and encoding before each of its dates: date, saved_key, HISTORY's columns, te."""
    daily = spark.read.schema(DAILY).parquet(daily_path)
    past = history_where_seen(daily, "saved_key", of=("key",))
    priors = priors_by_date(daily.filter("key = 0"))  # every row is counted once under each key
    x = past.join(F.broadcast(priors), "date").withColumn("te", smoothed_rate(F.col("hist_clicks"), F.col("hist_impressions"), F.col("prior"), m))
    x.select("key", *_names(BY_DATE)).write.mode("overwrite").partitionBy("key").parquet(path)


def save_maps(spark: SparkSession, daily_paths: list[str], path: str, m: float = SMOOTHING) -> None:
    """From the saved daily sums of earlier splits, one map of every key over all their dates, for a later split: saved_key, HISTORY's columns, te."""
    daily = spark.read.schema(DAILY).parquet(*daily_paths)
    sums = daily.groupBy("key", "saved_key").agg(F.sum("impressions").alias("hist_impressions"), F.sum("clicks").alias("hist_clicks"))
    x = with_exposure_percentile(sums, ["key"]).withColumn("hist_ctr", rate(F.col("hist_clicks"), F.col("hist_impressions")))
    x = x.join(F.broadcast(split_prior(spark, daily_paths))).withColumn("te", smoothed_rate(F.col("hist_clicks"), F.col("hist_impressions"), F.col("_prior"), m))
    x.select("key", *_names(WHOLE)).write.mode("overwrite").partitionBy("key").parquet(path)


def split_prior(spark: SparkSession, daily_paths: list[str]) -> DataFrame:
    """_prior: the rate of all labelled rows of the splits, FIRST_PRIOR without any; one row."""
    first = spark.read.schema(DAILY).parquet(*daily_paths).filter("key = 0")
    return first.agg(F.coalesce(F.try_divide(F.sum("clicks").cast("double"), F.sum("impressions")), F.lit(FIRST_PRIOR)).alias("_prior"))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _part(spark: SparkSession, path: str, place: int, schema: str) -> DataFrame:
    """A key's part of a map; empty where the map was fitted on no rows."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/key={place}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def look_up(df: DataFrame, path: str, keys: list[str], date: str | None = None) -> DataFrame:
    """Each row with KEY_hist_impressions, KEY_hist_clicks, KEY_hist_ctr, KEY_exposure_percentile and KEY_te of every key.

    keys in the order in which the map was saved; date for a map by date. What the map lacks gives 0, and a null KEY_te.
    """

    def one(rows: DataFrame, place_key: tuple[int, str]) -> DataFrame:
        place, key = place_key
        m = _part(df.sparkSession, path, place, BY_DATE if date else WHOLE)
        on = ["_saved_key", "_date"] if date else ["_saved_key"]
        m = m.withColumnsRenamed({"saved_key": "_saved_key", "date": "_date"} | {c: f"{key}_{c}" for c in (*HISTORY, "te")})
        asked = rows.withColumns({"_saved_key": saved_key(F.col(key))} | ({"_date": F.col(date).cast("string")} if date else {}))
        found = asked.join(m, on, "left").drop(*on)
        return found.fillna({f"{key}_{c}": v for c, v in HISTORY.items()})

    return reduce(one, enumerate(keys), df)


def add_keys(df: DataFrame, keys: list[str], folder: str, date: str = "date", label: str = "click", m: float = SMOOTHING) -> DataFrame:
    """Rows of the training split with every key's history and encoding from strictly earlier dates; daily sums and maps are saved below folder.

    The rows are read twice, once for all daily sums and once for the result. A row without a date has no history and no encoding.
    """
    spark = df.sparkSession
    save_daily_sums(df, keys, f"{folder}/daily", date, label)
    save_maps_by_date(spark, f"{folder}/daily", f"{folder}/by-date", m)
    return look_up(df, f"{folder}/by-date", keys, date)


def add_keys_split(df: DataFrame, daily_paths: list[str], keys: list[str], folder: str, m: float = SMOOTHING) -> DataFrame:
    """Rows of a later split with every key's history and encoding over the earlier splits, whose daily sums are read, not their rows; an unseen key is encoded by the splits' prior. The map is saved below folder."""
    spark = df.sparkSession
    save_maps(spark, daily_paths, f"{folder}/whole", m)
    rows = look_up(df, f"{folder}/whole", keys).join(F.broadcast(split_prior(spark, daily_paths)))
    return rows.withColumns({f"{k}_te": F.coalesce(f"{k}_te", "_prior") for k in keys}).drop("_prior")
