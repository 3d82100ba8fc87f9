"""Grouped rate tables: impressions, clicks and their rate by key, with shares, ranks, gap filling and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewise.operators import ranking


def rate(clicks: Column, impressions: Column) -> Column:
    """clicks / impressions, 0 without impressions."""
    return F.coalesce(F.try_divide(clicks.cast("double"), impressions.cast("double")), F.lit(0.0))


def _sums(label: str) -> list[Column]:
    return [F.count("*").alias("impressions"), F.coalesce(F.sum(label), F.lit(0)).cast("bigint").alias("clicks")]


def overall_rate(df: DataFrame, label: str = "click") -> DataFrame:
    """One row: all rows, non-null labels summed, their rate."""
    return df.agg(*_sums(label)).withColumn("ctr", rate(F.col("clicks"), F.col("impressions")))


def with_overall(table: DataFrame, overall: DataFrame) -> DataFrame:
    """Add the overall rate (one row) and the difference to it."""
    one = overall.select(F.col("ctr").alias("overall_ctr"))
    return table.join(F.broadcast(one)).withColumn("ctr_vs_overall", F.col("ctr") - F.col("overall_ctr"))


def _cells(df: DataFrame, keys: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """(groups of non-null keys, the overall row): one scan serves both, as the overall row sums the groups of all keys."""
    every = df.groupBy(*keys).agg(*_sums(label)).withColumn("ctr", rate(F.col("clicks"), F.col("impressions")))
    whole = every.agg(F.coalesce(F.sum("impressions"), F.lit(0)).alias("impressions"), F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"))
    return every.dropna(subset=keys), whole.withColumn("ctr", rate(F.col("clicks"), F.col("impressions")))


def rate_by(df: DataFrame, keys: list[str], label: str = "click", overall: DataFrame | None = None) -> DataFrame:
    """Rates by keys, against the overall rate of all rows (or a given overall row). Rows with a null key are left out of the groups."""
    grouped, whole = _cells(df, keys, label)
    return with_overall(grouped, whole if overall is None else overall)


def rate_by_hour(df: DataFrame, ts: str = "ts", label: str = "click") -> DataFrame:
    """All 24 hours, those without rows as 0; overall is that of rows with a time."""
    timed = df.filter(F.col(ts).isNotNull())
    found = timed.groupBy(F.hour(ts).alias("hour_of_day")).agg(*_sums(label))
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour_of_day"))
    full = hours.join(found, "hour_of_day", "left").fillna(0, ["impressions", "clicks"])
    return with_overall(full.withColumn("ctr", rate(F.col("clicks"), F.col("impressions"))), overall_rate(timed, label))


def rate_by_date(df: DataFrame, ts: str = "ts", label: str = "click") -> DataFrame:
    timed = df.filter(F.col(ts).isNotNull()).withColumn("date", F.date_format(ts, "yyyy-MM-dd"))
    return rate_by(timed, ["date"], label)


def with_share(table: DataFrame, total: DataFrame) -> DataFrame:
    """Share of all rows; total: a one-row table with impressions."""
    one = total.select(F.col("impressions").alias("_total"))
    return table.join(F.broadcast(one)).withColumn("impression_share", rate(F.col("impressions"), F.col("_total"))).drop("_total")


def with_volume_rank(table: DataFrame, name: str = "impressions_rank") -> DataFrame:
    """Competition rank by impressions of an aggregated table (a row for each key): one more than the keys with more impressions, from the counts of each number of impressions."""
    sizes = table.groupBy(F.col("impressions").alias("_i")).agg(F.count("*").alias("_keys"))
    above = ranking.with_running(sizes, "_i", ["_keys"], descending=True).select("_i", (F.col("_keys_before") + 1).cast("int").alias(name))
    return table.join(above, F.col("impressions").eqNullSafe(F.col("_i"))).drop("_i")


def cross_rate(df: DataFrame, k1: str, k2: str, low_volume: int = 100_000, label: str = "click") -> DataFrame:
    """Rates by two keys with each cell's share of all rows and whether it has few."""
    grouped, whole = _cells(df, [k1, k2], label)
    return with_share(with_overall(grouped, whole), whole).withColumn("is_low_volume", F.col("impressions") < low_volume)


def within_group_share(table: DataFrame, group: str) -> DataFrame:
    whole = F.sum("impressions").over(Window.partitionBy(group))
    return table.withColumn("within_group_share", rate(F.col("impressions"), whole))


def top_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n keys with most rows, ties to the smaller key."""
    return df.dropna(subset=[key]).groupBy(key).agg(F.count("*").alias("impressions")).orderBy(F.desc("impressions"), key).limit(n)


def keep_top_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.join(F.broadcast(top_keys(df, key, n).select(key)), key, "left_semi")


def cross_top_rate(df: DataFrame, k1: str, k2: str, n: int, low_volume: int = 100_000, label: str = "click") -> DataFrame:
    """cross_rate over the rows of k1's n largest keys, with each cell's share of its k1."""
    return within_group_share(cross_rate(keep_top_keys(df, k1, n), k1, k2, low_volume, label), k1)


def pivot_measure(table: DataFrame, row: str, column: str, values: list, measure: str = "ctr", scale: float = 1.0) -> DataFrame:
    """A row for each row key, a column c_VALUE for each of values; an absent cell is null."""
    cells = [F.max(F.when(F.col(column) == v, F.col(measure) * scale)).alias(f"c_{v}") for v in values]
    return table.groupBy(row).agg(*cells)


def missing_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each key: null and blank values."""
    sums = [F.count_if(F.col(k).isNull()).alias(f"n{i}") for i, k in enumerate(keys)] + [F.count_if(F.trim(F.col(k).cast("string")) == "").alias(f"b{i}") for i, k in enumerate(keys)]
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"n{i}").alias("nulls"), F.col(f"b{i}").alias("blanks")) for i, k in enumerate(keys)])
    return df.agg(*sums).select(F.inline(rows))


def heat_matrix(table: DataFrame, row: str, column: str, rows: list, columns: list, scale: float = 100.0) -> DataFrame:
    """Of a cross table, for each of rows (all of them, found or not): the scaled rate c_VALUE and the low-volume flag low_VALUE of each of columns; absent cells are null."""
    low = pivot_measure(table.withColumn("_low", F.col("is_low_volume").cast("int")), row, column, columns, "_low").select(row, *[(F.col(f"c_{v}") == 1).alias(f"low_{v}") for v in columns])
    grid = table.sparkSession.createDataFrame([(v,) for v in rows], table.select(row).schema)
    return grid.join(F.broadcast(pivot_measure(table, row, column, columns, "ctr", scale)), row, "left").join(F.broadcast(low), row, "left")  # one row for each of rows


def missing_either(df: DataFrame, k1: str, k2: str) -> DataFrame:
    """One row: rows where the first, the second, either or both keys are null or blank."""
    a, b = (F.coalesce(F.trim(F.col(k).cast("string")) == "", F.lit(True)) for k in (k1, k2))
    return df.agg(F.count_if(a).alias("first_missing"), F.count_if(b).alias("second_missing"), F.count_if(a | b).alias("either_missing"), F.count_if(a & b).alias("both_missing"))


def top_rows(table: DataFrame, n: int, *ties: str) -> DataFrame:
    """The n rows of a rate table with most impressions."""
    return table.orderBy(F.desc("impressions"), *ties).limit(n)
