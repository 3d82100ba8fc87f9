"""Exact ranks without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window partition sorts, about; a larger group is cut into that many more buckets.
ROWS_PER_BUCKET = 50_000


def with_rank(df: DataFrame, group: str, unit: str, ties: list[str], rank: str, size: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add rank (from 0, by unit and then ties, within group) and size (the group's rows).

    unit lies in [0, 1) and spreads evenly, so that it cuts a group into buckets of even size; a hot group is thus
    ranked by many tasks. group has no nulls. Rows equal in unit and all ties get their ranks in any order.
    """
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias(size))
    rows = df.join(sizes, F.col(group) == F.col("_g")).drop("_g")
    rows = rows.withColumn("_b", F.floor(F.col(unit) * F.ceil(F.col(size) / rows_per_bucket)))
    before = (
        rows.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("_g").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)))
        .select("_g", "_c", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    rows = rows.join(before, (F.col(group) == F.col("_g")) & (F.col("_b") == F.col("_c"))).drop("_g", "_c")
    within = F.row_number().over(Window.partitionBy(group, "_b").orderBy(unit, *ties))
    return rows.withColumn(rank, F.col("_before") + within - 1).drop("_b", "_before")
