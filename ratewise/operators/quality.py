"""Checks of features against the label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.operators import ranking


def feature_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each numeric column: type, missing and its share, distinct, whether constant, range, mean, exact median, sample deviation.

    Distinct values are counted and ordered by groups of values, never gathered in one task.
    """
    kinds = dict(df.dtypes)
    out = None
    for c in columns:
        one = df.agg(
            F.count("*").alias("_n"), F.count_if(F.col(c).isNull()).alias("missing_count"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"))
        distinct = df.select(c).dropna().distinct().agg(F.count("*").alias("unique_count"))
        row = one.join(F.broadcast(distinct)).join(F.broadcast(ranking.quantiles(df, c, [0.5])), how="left").select(
            F.lit(c).alias("feature_name"), F.lit(kinds[c]).alias("data_type"), "missing_count", F.try_divide(F.col("missing_count").cast("double"), F.col("_n").cast("double")).alias("missing_rate"), "unique_count", (F.col("unique_count") <= 1).alias("is_constant"),
            "min", "max", "mean", F.col("q")[0].alias("median"), "std")
        out = row if out is None else out.unionByName(row)
    return out


def category_rates(df: DataFrame, feature: str, label: str = "click") -> DataFrame:
    """Labelled rows, clicks and rate by value (as text; null is a value)."""
    return df.groupBy(F.col(feature).cast("string").alias("feature_value")).agg(F.count(label).alias("impressions"), F.sum(label).alias("clicks"), F.avg(label).alias("ctr")).select(F.lit(feature).alias("feature_name"), "*")


def rate_spread(df: DataFrame, columns: list[str], label: str = "click") -> DataFrame:
    every = reduce(DataFrame.unionByName, [category_rates(df, c, label) for c in columns])
    x = every.groupBy("feature_name").agg(F.min("ctr").alias("minimum_ctr"), F.max("ctr").alias("maximum_ctr"), F.count("*").alias("top_category_count"))
    return x.withColumn("ctr_spread", F.col("maximum_ctr") - F.col("minimum_ctr"))


def label_correlation(df: DataFrame, columns: list[str], label: str = "click") -> DataFrame:
    """Pearson with the label over rows that have both."""
    rows = df.agg(*[F.corr(c, label).alias(f"r{i}") for i, c in enumerate(columns)])
    return rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature_name"), F.round(f"r{i}", 9).alias("pearson")) for i, c in enumerate(columns)])))
