"""Running sums, ranks and exact quantiles over a whole table, without a window over all rows.

Rows are cut into ranges by bounds drawn from the column: those of one in SAMPLED hashes, each KEPT-th of them in order,
so the ranges grow in number with the rows and reruns agree. The bounds are a scalar subquery (one pass over the column, no
shuffle of its values, no job before the query runs); a row finds its range by binary search. Rows are
summed by range and ordered within a range only; any bounds give the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: One value in so many is drawn, each KEPT-th drawn value is a bound: a range has about SAMPLED * KEPT rows.
SAMPLED, KEPT = 1 << 15, 16
#: Steps of the binary search: fewer than 2**STEPS bounds are found, those of about 5 * 10**11 rows.
STEPS = 20


def bounds(df: DataFrame, column: str) -> DataFrame:
    """One row: the bounds of column's values as a sorted array."""
    drawn = df.select(F.col(column).alias("v")).filter(F.col("v").isNotNull() & (F.pmod(F.xxhash64("v"), F.lit(SAMPLED)) == 0))
    return drawn.agg(F.filter(F.array_sort(F.collect_set("v")), lambda _, i: i % KEPT == KEPT - 1).alias("bounds"))


def with_range(df: DataFrame, column: str, name: str = "_range", of: DataFrame | None = None) -> DataFrame:
    """df with the number of the range that a row's value is in, ascending; nulls are in range -1. Bounds come from the same column of another table, if one is given."""
    out = df.withColumns({"_range_of": F.col(column), "_range_bounds": bounds(df if of is None else of, column).scalar()})
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(STEPS))])
    # _range_bounds is named once, so the subquery's value is used in place; _range_of twice, so a computed column is not computed again for each step
    found = F.aggregate(steps, F.lit(0), lambda p, step: F.when(F.get("_range_bounds", p + step - 1) <= F.col("_range_of"), p + step).otherwise(p))
    return out.withColumn(name, F.when(F.col("_range_of").isNull(), -1).otherwise(found)).drop("_range_of", "_range_bounds")


def with_running(df: DataFrame, column: str, values: list[str], descending: bool = False, group: str | None = None, of: DataFrame | None = None) -> DataFrame:
    """df with VALUE_before for each of values: its sum over the rows before, in order of column, within group if given.

    column is unique within a group; nulls come first in ascending and last in descending order. Missing sums are 0.
    of: the rows that df counts, with the same column: its bounds are the same, without df's shuffle.
    """
    keys = [group] if group else []
    rows = with_range(df, column, of=of)
    way = F.desc_nulls_last if descending else F.asc_nulls_first
    earlier = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(way("_r")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r")).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    bases = totals.select(*[f"_k{i}" for i in range(len(keys))], "_r", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_b_{v}") for v in values])  # a row for each range of a group
    on = [F.col("_range").eqNullSafe(F.col("_r")), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    within = Window.partitionBy(*keys, "_range").orderBy(way(column)).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(bases, on)
    return out.withColumns({f"{v}_before": F.col(f"_b_{v}") + F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values}).drop("_range", "_r", *[f"_k{i}" for i in range(len(keys))], *[f"_b_{v}" for v in values])


def with_place(df: DataFrame, group: str, order: str, name: str = "place", of: DataFrame | None = None) -> DataFrame:
    """name from 1 within each group, in order of a unique column; a group that most rows have is ordered in ranges, with bounds from another table's column if one is given."""
    rows = with_range(df, order, of=of)
    cells = rows.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    bases = cells.select("_g", "_r", F.coalesce(before, F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(order))
    joined = rows.join(bases, F.col(group).eqNullSafe(F.col("_g")) & F.col("_range").eqNullSafe(F.col("_r")))
    return joined.withColumn(name, F.col("_base") + within).drop("_range", "_g", "_r", "_base")


def quantiles(df: DataFrame, column: str, points: list[float], group: str | None = None) -> DataFrame:
    """(group,) q: the exact quantiles of the non-null values as an array, interpolated between the two values around each point. Without a value there is no row."""
    keys = [group] if group else []
    rows = df.select(*keys, F.col(column).cast("double").alias("_v")).dropna(subset=["_v"])
    counts = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    run = with_running(counts, "_v", ["_n"], group=group, of=rows)
    whole = counts.groupBy(*[F.col(k).alias("_g") for k in keys]).agg(F.sum("_n").alias("_total"))
    joined = run.join(F.broadcast(whole), F.col(group).eqNullSafe(F.col("_g"))) if group else run.join(F.broadcast(whole))
    found = joined.groupBy(*keys).agg(F.array(*quantile_values(F.col("_v"), F.col("_n_before"), F.col("_n"), F.col("_total"), points)).alias("q"), F.max("_total").alias("_total"))
    return found.filter("_total > 0").drop("_total")


def quantile_values(value, before, n, total, points: list[float]) -> list:
    """For each point an aggregate over distinct values that gives its interpolated quantile, from the rows before a value, with it, and in all."""
    out = []
    for p in points:
        at = F.lit(float(p)) * (total - 1)
        holds = lambda k: (k >= before) & (k < before + n)
        low, high = F.max(F.when(holds(F.floor(at)), value)), F.max(F.when(holds(F.ceil(at)), value))
        out.append(low + (high - low) * F.max(at - F.floor(at)))
    return out
