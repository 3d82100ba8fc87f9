"""Date splits and exact, repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_of(ts: Column, bounds: dict[str, tuple[str, str]]) -> Column:
    """The split whose dates (first, last) hold the time; null outside of all."""
    day, out = F.to_date(ts), F.lit(None).cast("string")
    for name, (first, last) in bounds.items():
        out = F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), name).otherwise(out)
    return out


def split_summary(df: DataFrame, bounds: dict[str, tuple[str, str]], ts: str = "ts") -> DataFrame:
    """Rows of each split, its first and last date, and its share of all rows."""
    whole = df.agg(F.count("*").alias("total"))
    x = df.withColumn("split", split_of(F.col(ts), bounds)).dropna(subset=["split"])
    x = x.groupBy("split").agg(F.date_format(F.min(ts), "yyyy-MM-dd").alias("start_date"), F.date_format(F.max(ts), "yyyy-MM-dd").alias("end_date"), F.count("*").alias("n_rows"))
    return x.join(F.broadcast(whole)).withColumn("share", F.col("n_rows") / F.col("total")).drop("total")


def proportional_quota(groups: DataFrame, group: str, n: int | float) -> DataFrame:
    """group, quota from (group, n_rows): shares of n rows (or of the fraction n of all rows, rounded) by largest remainder, ties to the higher group. An error where there are fewer than n rows."""
    whole = groups.agg(F.sum("n_rows").alias("total"))
    want = F.lit(n) if isinstance(n, int) else F.bround(F.lit(n) * F.col("total")).cast("bigint")
    x = groups.join(F.broadcast(whole)).withColumn("want", want)
    exact = F.col("want") * F.col("n_rows")
    x = x.withColumns({"base": F.floor(exact / F.col("total")), "rest": exact % F.col("total")})
    if_enough = F.when(F.col("total") >= F.col("want"), F.col("base")).otherwise(F.raise_error(F.lit(f"fewer than {n} rows")).cast("bigint"))
    x = x.withColumn("base", if_enough)
    missing = F.col("want") - F.sum("base").over(Window.partitionBy())  # one row for each group
    place = F.row_number().over(Window.orderBy(F.desc("rest"), F.desc(group)))
    return x.withColumn("quota", F.col("base") + (place <= missing).cast("int")).select(group, "n_rows", "quota")


def sample_per_group(df: DataFrame, group: str, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """Exactly the quota of each group that is not null, the rows of smallest md5 of seed and id."""
    rows = df.dropna(subset=[group])
    quota = proportional_quota(df.groupBy(group).agg(F.count("*").alias("n_rows")), group, n)
    return _drawn(rows, group, quota, id_col, seed).filter("_in").drop("_in")


def time_split(df: DataFrame, bounds: dict[str, tuple[str, str]], ts: str = "ts") -> DataFrame:
    """df with the column split; rows outside of all ranges or without a time are left out (split_counts counts them)."""
    return df.withColumn("split", split_of(F.col(ts), bounds)).dropna(subset=["split"])


def split_counts(df: DataFrame, bounds: dict[str, tuple[str, str]], ts: str = "ts") -> DataFrame:
    """split, n_rows of every split, and of the rows left out: out_of_range and null_time."""
    where = F.when(F.col(ts).isNull(), "null_time").otherwise(F.coalesce(split_of(F.col(ts), bounds), F.lit("out_of_range")))
    return df.groupBy(where.alias("split")).agg(F.count("*").alias("n_rows"))


def _draw(seed: int, id_col: str) -> Column:
    """A text that is unique to an id and in an order that the seed decides."""
    i = F.col(id_col).cast("string")
    return F.concat_ws(":", F.md5(F.concat_ws(":", F.lit(str(seed)), i).cast("binary")), i)


#: Leading digits of a draw that cut a group into 65,536 cells of even size.
CELL_DIGITS = 4


def _drawn(df: DataFrame, group: str, quota: DataFrame, id_col: str, seed: int) -> DataFrame:
    """df with _in: whether a row is among the first quota rows of its group in drawn order.

    Rows are counted by group and cell (leading digits of the draw); where the quota ends within a cell, the draws of that
    one cell are ordered. The last draw taken is then compared with every row's: rows are neither shuffled nor ranked.
    """
    rows = df.select(F.col(group).alias("_g"), _draw(seed, id_col).alias("_draw")).withColumn("_cell", F.substring("_draw", 1, CELL_DIGITS))
    cells = rows.groupBy("_g", "_cell").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_g").orderBy("_cell"))  # 65,536 cells of a group at most
    q = quota.select(F.col(group).alias("_k"), "quota")  # one row for each group
    cut = cells.withColumn("_upto", upto).join(F.broadcast(q), F.col("_g").eqNullSafe(F.col("_k")))
    cut = cut.filter((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota"))).select(F.col("_g").alias("_k"), F.col("_cell").alias("_c"), (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_left"))
    place = F.row_number().over(Window.partitionBy("_g").orderBy("_draw"))  # the rows of one cell
    last = rows.join(F.broadcast(cut), F.col("_g").eqNullSafe(F.col("_k")) & (F.col("_cell") == F.col("_c"))).withColumn("_place", place)
    last = last.filter(F.col("_place") == F.col("_left")).select(F.col("_g").alias("_k"), F.col("_draw").alias("_last"))  # no row for a quota of 0
    out = df.withColumn("_draw", _draw(seed, id_col)).join(F.broadcast(last), F.col(group).eqNullSafe(F.col("_k")), "left")
    return out.withColumn("_in", F.coalesce(F.col("_draw") <= F.col("_last"), F.lit(False))).drop("_draw", "_k", "_last")


def stratified_split(df: DataFrame, label: str, fraction: float, id_col: str = "id", seed: int = 42) -> DataFrame:
    """df with the column part, a or b: a holds fraction of all rows (rounded) and of each label as nearly as whole rows allow. ids are unique."""
    quota = proportional_quota(df.groupBy(label).agg(F.count("*").alias("n_rows")), label, float(fraction))
    return _drawn(df, label, quota, id_col, seed).withColumn("part", F.when(F.col("_in"), "a").otherwise("b")).drop("_in")


def stratified_sample(df: DataFrame, label: str, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """n rows, each label in proportion."""
    quota = proportional_quota(df.groupBy(label).agg(F.count("*").alias("n_rows")), label, n)
    return _drawn(df, label, quota, id_col, seed).filter("_in").drop("_in")


def simple_sample(df: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """n rows without replacement, the first in drawn order; all rows where there are fewer."""
    rows = df.withColumn("_all", F.lit(1))
    quota = rows.groupBy("_all").agg(F.least(F.count("*"), F.lit(n)).alias("quota"))
    return _drawn(rows, "_all", quota, id_col, seed).filter("_in").drop("_in", "_all")
